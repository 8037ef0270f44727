"""Term mappings and the policies that select them.

A mapping row is ``id, supersedes, term, relation, target, state``; a target is
``target, kind, deprecated`` and a term ``term, kind``.  A policy is the flat table
``policy, mapping`` of the mappings that it selects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.reviews import leaves


def current(mappings: DataFrame) -> DataFrame:
    """Present mappings, each with whether other accepted ones give its term another meaning."""
    live = leaves(mappings)
    meaning = F.struct("relation", "target")
    accepted = live.where("state = 'accepted'").groupBy("term").agg(F.min(meaning).alias("least"), F.max(meaning).alias("most"))
    split = accepted.select("term", (F.col("least") != F.col("most")).alias("split"))
    return live.join(split, "term", "left").withColumn("conflict", (F.col("state") == "accepted") & F.coalesce("split", F.lit(False))).drop("split")


def eligibility(mappings: DataFrame, terms: DataFrame, targets: DataFrame) -> DataFrame:
    """``id, term, findings, eligible``: what stands against each present mapping; accepted ones without findings are eligible."""
    known = targets.select("target", F.col("kind").alias("target_kind"), "deprecated")
    rows = current(mappings).join(known, "target", "left").join(terms.select("term", "kind"), "term", "left")
    found = F.array_compact(
        F.array(
            F.when(F.col("target_kind").isNull(), "TARGET_MISSING"),
            F.when(F.col("deprecated"), "TARGET_DEPRECATED"),
            F.when(F.col("kind") != F.col("target_kind"), "KIND_MISMATCH"),
            F.when(F.col("conflict"), "CONFLICT"),
        )
    )
    return rows.select("id", "term", F.array_join(found, ",").alias("findings"), ((F.col("state") == "accepted") & (F.size(found) == 0)).alias("eligible"))


def policy_issues(policy: DataFrame, mappings: DataFrame, judged: DataFrame) -> DataFrame:
    """``policy, mapping, code``: selected mappings that are missing, superseded or not eligible, or that share their term."""
    chosen = policy.distinct()
    found = chosen.join(mappings.select(F.col("id").alias("mapping"), F.lit(True).alias("known")), "mapping", "left")
    found = found.join(judged.select(F.col("id").alias("mapping"), "term", "eligible"), "mapping", "left")
    code = F.when(F.col("known").isNull(), "MAPPING_MISSING").when(F.col("eligible").isNull(), "MAPPING_SUPERSEDED").when(~F.col("eligible"), "MAPPING_NOT_ELIGIBLE")
    single = found.select("policy", "mapping", code.alias("code")).where("code IS NOT NULL")
    live = found.where("term IS NOT NULL")
    twice = live.groupBy("policy", "term").count().where("count > 1")
    return single.union(live.join(twice, ["policy", "term"], "left_semi").select("policy", "mapping", F.lit("TERM_REPEATED")))
