"""Review chains, conflicts, coverage, readiness and panel votes."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leaves(documents: DataFrame) -> DataFrame:
    """Rows ``id, supersedes, ...`` that no other row supersedes."""
    return documents.join(documents.select(F.col("supersedes").alias("id")).where("id IS NOT NULL"), "id", "left_anti")


def chain_issues(documents: DataFrame) -> DataFrame:
    """``code, id``: missing predecessors and predecessors with two successors."""
    named = documents.where("supersedes IS NOT NULL")
    missing = named.join(documents.select(F.col("id").alias("supersedes")), "supersedes", "left_anti").select(F.lit("MISSING_PREDECESSOR").alias("code"), "id")
    branch = named.groupBy(F.col("supersedes").alias("id")).count().where("count > 1").select(F.lit("BRANCHED_CHAIN"), "id")
    return missing.union(branch)


def conflicts(accepted: DataFrame, subject: list[str], verdict: str) -> DataFrame:
    """Subjects with differing accepted verdicts, and these."""
    return accepted.groupBy(*subject).agg(F.array_sort(F.collect_set(verdict)).alias("verdicts")).where(F.size("verdicts") > 1)


def link_coverage(links: DataFrame, assessments: DataFrame) -> DataFrame:
    """Declared links ``src, dst, rel`` with assessments ``src, dst, relation, accepted``: one status each."""
    tally = assessments.groupBy("src", "dst").agg(F.bool_or("accepted").alias("any"), F.bool_or(F.col("accepted") & (F.col("relation") == "supports")).alias("for"), F.bool_or(F.col("accepted") & (F.col("relation") == "refutes")).alias("against"))
    fits = F.when(F.col("rel") == "supports", F.col("for")).otherwise(F.col("against"))
    clash = F.when(F.col("rel") == "supports", F.col("against")).otherwise(F.col("for"))
    status = F.when(F.col("any").isNull(), "unassessed").when(F.col("for") & F.col("against"), "conflict").when(fits, "covered").when(clash, "contradicted").otherwise("pending")
    return links.join(tally, ["src", "dst"], "left").select("src", "dst", "rel", status.alias("status"))


def readiness(basis: DataFrame) -> DataFrame:
    """A ladder over booleans ``meaning, executed, current, replayed, reviewed`` of each ``id``: the first rung that is missing."""
    rung = F.lit("ready")
    for name in reversed(("meaning", "executed", "current", "replayed", "reviewed")):
        rung = F.when(~F.coalesce(F.col(name), F.lit(False)), f"needs_{name}").otherwise(rung)
    return basis.select("id", rung.alias("readiness"))


def group_decisions(ballots: DataFrame) -> DataFrame:
    """Ballots ``candidate, grp, decision``: a group endorses if all do, rejects if any does, else abstains."""
    decision = F.when(F.bool_or(F.col("decision") == "reject"), "reject").when(F.bool_and(F.col("decision") == "endorse"), "endorse").otherwise("abstain")
    return ballots.groupBy("candidate", "grp").agg(decision.alias("decision"))


def panel_vote(ballots: DataFrame, quorum: int = 2) -> DataFrame:
    """``candidate, endorse, reject, abstain, status``: a quorum of groups and two thirds of those that decide."""
    count = lambda d: F.count_if(F.col("decision") == d).alias(d)
    tally = group_decisions(ballots).groupBy("candidate").agg(count("endorse"), count("reject"), count("abstain"))
    decided = F.col("endorse") + F.col("reject")
    status = F.when(decided < quorum, "no_quorum").when(3 * F.col("endorse") >= 2 * decided, "recommended").otherwise("not_recommended")
    return tally.withColumn("status", status)


def role_coverage(endorsements: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """Candidates of ``candidate, grp, role`` for whose roles as many different groups can be found.

    By Hall's condition: any k of the roles together have at least k groups; only counts are made.
    """
    fits = F.lit(True)
    for k in range(1, len(roles) + 1):
        for some in itertools.combinations(roles, k):
            fits = fits & (F.count_distinct(F.when(F.col("role").isin(*some), F.col("grp"))) >= k)
    return endorsements.groupBy("candidate").agg(fits.alias("covered"))


def panel_recommendation(candidates: DataFrame, proposals: DataFrame, ballots: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """``set_id, candidate, status`` of frozen sets: which candidate a panel recommends, or the first gate that stands against it.

    ``candidates``: ``set_id, candidate``; ``proposals``: ``set_id, candidate, grp, passed``;
    ``ballots``: ``set_id, candidate, grp, role, decision, blocking``.  Groups that proposed
    the candidate do not count as external.  Only counts by candidate and group are joined.
    """
    key = ["set_id", "candidate"]
    single = candidates.distinct().groupBy("set_id").agg(F.count("*").alias("n_candidates"))
    proposers = proposals.groupBy(*key, "grp").agg(F.bool_and(F.coalesce("passed", F.lit(False))).alias("passed"))
    behind = proposers.groupBy(*key).agg(F.count("*").alias("proposers"), F.bool_and("passed").alias("passed"))
    has = lambda role: F.bool_or((F.col("decision") == "endorse") & (F.col("role") == role)).alias(f"r_{role}")
    by_group = ballots.groupBy(*key, "grp").agg(F.bool_and(F.col("decision") == "endorse").alias("endorses"), F.bool_or(F.col("decision") == "reject").alias("rejects"), F.bool_or("blocking").alias("blocking"), *map(has, roles))
    groups = by_group.join(proposers.select(*key, "grp", F.lit(True).alias("own")), [*key, "grp"], "left")
    outside = F.col("own").isNull()
    speaks = lambda some: F.count_if(outside & F.col("endorses") & reduce(lambda a, b: a | b, (F.col(f"r_{r}") for r in some)))
    covered = reduce(lambda a, b: a & b, (speaks(some) >= k for k in range(1, len(roles) + 1) for some in itertools.combinations(roles, k)))
    tally = groups.groupBy(*key).agg(
        F.count_if(outside & F.col("endorses")).alias("endorse"), F.count_if(outside & F.col("rejects")).alias("reject"),
        F.count_if(outside).alias("outsiders"), F.bool_or("blocking").alias("blocking"), covered.alias("covered"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    decided = zero("endorse") + zero("reject")
    quorum = ((zero("proposers") >= 2) & (zero("endorse") >= 1)) | ((zero("proposers") >= 1) & (zero("endorse") >= 2))
    gates = (
        (F.col("n_candidates") == 1, "several_candidates"), (F.coalesce("passed", F.lit(False)), "not_validated"), (zero("proposers") + zero("outsiders") >= 3, "too_few_groups"), (quorum, "no_quorum"),
        (F.coalesce("covered", F.lit(False)), "roles_open"), (~F.coalesce("blocking", F.lit(False)), "blocked"), ((decided > 0) & (3 * zero("endorse") >= 2 * decided), "no_majority"),
    )
    status = F.lit("recommended")
    for gate, name in reversed(gates):
        status = F.when(~gate, name).otherwise(status)
    rows = candidates.distinct().join(single, "set_id").join(behind, key, "left").join(tally, key, "left")
    return rows.select(*key, status.alias("status"))


#: Which review state may follow which.
TRANSITIONS = {"proposed": ("accepted", "rejected", "contested", "superseded"), "accepted": ("contested", "superseded"), "contested": ("accepted", "rejected", "superseded"), "rejected": ("superseded",), "superseded": ()}


def transition_issues(documents: DataFrame) -> DataFrame:
    """``code, id`` of successors ``id, supersedes, state, actor, body, at`` that do not follow from their predecessor: a state out of order, another body, an earlier time, or a first reviewer who is the proposer."""
    then = documents.select(F.col("id").alias("supersedes"), F.col("state").alias("was"), F.col("actor").alias("by"), F.col("body").alias("old"), F.col("at").alias("since"))
    both = documents.where("supersedes IS NOT NULL").join(then, "supersedes")
    allowed = reduce(lambda a, b: a | b, ((F.col("was") == was) & F.col("state").isin(*to) for was, to in TRANSITIONS.items() if to))
    codes = F.array_compact(
        F.array(
            F.when(~F.coalesce(allowed, F.lit(False)), "TRANSITION_NOT_ALLOWED"), F.when(~F.col("body").eqNullSafe(F.col("old")), "BODY_CHANGED"),
            F.when(F.col("at") < F.col("since"), "TIME_GOES_BACK"), F.when((F.col("was") == "proposed") & (F.col("by") == F.col("actor")), "REVIEWER_IS_PROPOSER"),
        )
    )
    return both.select(F.explode(codes).alias("code"), "id")
