"""What authors declare (methods, requirements, roles, changes), checked as flat tables.

Issues are ``code, id, detail``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types that may require methods, statuses that count as live (as does none).
CLAIM_TYPES = ("claim", "hypothesis", "prediction", "conclusion")
LIVE = ("current", "confirmed")


def _issue(rows: DataFrame, code: str, node: str = "id", *detail: str) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.col(node).alias("id"), F.concat_ws(" ", *(F.col(d).cast("string") for d in detail)).alias("detail"))


def _live(status: Column) -> Column:
    return F.coalesce(status.isin(*LIVE), status.isNull())


def _more_than_once(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def method_issues(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """Declared steps ``id, step, statement, required`` of nodes ``id, type, status``: on other nodes than methods, repeated, without a name, a text or a flag."""
    elsewhere = steps.select("id").distinct().join(nodes.where("type = 'method'"), "id", "left_anti")
    bad = steps.where(~F.coalesce((F.col("step") != "") & (F.trim("statement") != "") & F.col("required").isNotNull(), F.lit(False)))
    return _issue(elsewhere, "STEPS_ON_OTHER_NODE").union(_issue(_more_than_once(steps, "id", "step"), "DUPLICATE_STEP", "id", "step")).union(_issue(bad, "MALFORMED_STEP", "id", "step"))


def requirement_issues(nodes: DataFrame, requires: DataFrame, steps: DataFrame) -> DataFrame:
    """Requirements ``id, method, step``: of nodes that are no claims, repeated, of methods that are missing, of another type, without steps or (for live claims) not live, of unknown steps."""
    asks = requires.select("id", "method").distinct()
    kind = nodes.select("id", F.col("type").alias("claim_type"), F.col("status").alias("claim_status"))
    target = nodes.select(F.col("id").alias("method"), F.col("type").alias("method_type"), F.col("status").alias("method_status"), F.lit(True).alias("there"))
    having = steps.select(F.col("id").alias("method"), F.lit(True).alias("has_steps")).distinct()
    both = asks.join(kind, "id", "left").join(target, "method", "left").join(having, "method", "left")
    code = (
        F.when(F.col("there").isNull(), "MISSING_METHOD").when(~F.coalesce(F.col("method_type") == "method", F.lit(False)), "NOT_A_METHOD")
        .when(_live(F.col("claim_status")) & ~_live(F.col("method_status")), "INACTIVE_METHOD").when(F.col("has_steps").isNull(), "METHOD_WITHOUT_STEPS")
    )
    judged = both.withColumn("code", code)
    odd = judged.where(~F.coalesce(F.col("claim_type").isin(*CLAIM_TYPES), F.lit(False))).select("id").distinct()
    sound = judged.where("code IS NULL").select("id", "method")
    unknown = requires.join(sound, ["id", "method"], "left_semi").join(steps.select(F.col("id").alias("method"), "step"), ["method", "step"], "left_anti").distinct()
    return (
        judged.where("code IS NOT NULL").select("code", "id", F.col("method").alias("detail"))
        .union(_issue(odd, "REQUIREMENTS_ON_OTHER_NODE")).union(_issue(_more_than_once(requires, "id", "method", "step"), "REPEATED_STEP_REFERENCE", "id", "method", "step"))
        .union(_issue(unknown, "UNKNOWN_METHOD_STEP", "id", "method", "step"))
    )


def overlapping_roles(values: DataFrame, within: bool = False) -> DataFrame:
    """``id, value, roles`` of ``id, role, value`` that stands in several roles of one thing, or (``within``) twice in one."""
    seen = values.groupBy("id", "value").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count_distinct("role").alias("kinds"), F.count("*").alias("n"))
    return seen.where(F.col("kinds" if not within else "n") > 1).select("id", "value", "roles")


#: The operations that must not name the same thing in one request, by kind.
OPERATIONS = {"node": ("add_nodes", "replace_nodes", "remove_nodes"), "edge": ("add_edges", "remove_edges"), "concept": ("set_concepts", "remove_concepts")}


def change_issues(requests: DataFrame, changes: DataFrame, base_hash: str | None = None, max_operations: int | None = None) -> DataFrame:
    """Requests ``id, base_hash`` with operations ``id, operation, key``: unknown, repeated or overlapping operations, none, too many, another base."""
    kinds = F.create_map(*(F.lit(x) for kind, names in OPERATIONS.items() for name in names for x in (name, kind)))
    given = changes.withColumn("kind", kinds[F.col("operation")])
    odd = _issue(given.where("kind IS NULL"), "UNKNOWN_OPERATION", "id", "operation")
    known = given.where("kind IS NOT NULL")
    twice = _issue(_more_than_once(known, "id", "operation", "key"), "REPEATED_OPERATION", "id", "operation", "key")
    overlap = known.groupBy("id", "kind", "key").agg(F.count_distinct("operation").alias("n")).where("n > 1")
    sizes = requests.select("id").join(changes.groupBy("id").agg(F.count("*").alias("n")), "id", "left")
    found = odd.union(twice).union(_issue(overlap, "OVERLAPPING_OPERATIONS", "id", "kind", "key")).union(_issue(sizes.where("n IS NULL"), "EMPTY_REQUEST"))
    if max_operations is not None:
        found = found.union(_issue(sizes.where(F.col("n") > max_operations), "TOO_MANY_OPERATIONS", "id", "n"))
    if base_hash is not None:
        found = found.union(_issue(requests.where(~F.col("base_hash").eqNullSafe(F.lit(base_hash))), "BASE_CHANGED", "id", "base_hash"))
    return found


def evaluation_issues(evaluations: DataFrame, reasons: tuple[str, ...]) -> DataFrame:
    """Ballot entries ``id, candidate, decision, reasons (array), blocking``: decisions, reasons and blocking that do not fit together."""
    c = F.col
    tests = (
        ("UNKNOWN_DECISION", ~c("decision").isin("endorse", "reject", "abstain")),
        ("REASONS_NOT_CANONICAL", F.exists("reasons", lambda x: ~x.isin(*reasons)) | (c("reasons") != F.array_sort(F.array_distinct("reasons")))),
        ("REASON_MISSING", c("decision").isin("reject", "abstain") & (F.size("reasons") == 0)),
        ("ENDORSEMENT_WITH_OBJECTIONS", (c("decision") == "endorse") & ((F.size("reasons") > 0) | c("blocking"))),
        ("MUST_BLOCK", F.arrays_overlap("reasons", F.array(F.lit("MATERIAL_DISSENT"), F.lit("CRITICAL_ABSTENTION"))) & ~c("blocking")),
    )
    codes = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(True)), code) for code, test in tests)))
    return evaluations.select(F.explode(codes).alias("code"), "id", F.col("candidate").cast("string").alias("detail"))


#: The kinds of cases that a rule pack must be tried with, and the states each may expect.
CASES = {
    "positive": ("derivable",), "explicit_negative": ("refutable",), "missing_premise": ("unknown",), "boundary": ("derivable", "refutable", "unknown"),
    "unit_mismatch": ("input_rejected",), "conflict": ("conflict",), "counterexample": ("refutable",),
}


def competency_issues(cases: DataFrame, atoms: DataFrame) -> DataFrame:
    """Test cases of rule packs: ``pack, id, category, target, expected, observed, terms`` with inputs ``pack, id, atom, predicate, unitless, terms``.

    ``atom`` is the canonical text, ``unitless`` the same without its units; ``terms`` says
    whether a case's inputs together, or an input alone, hold all of the target's terms.  Sets are compared by counting what two
    cases of one pack and target share, so no case's inputs are gathered; pairs are formed
    with the positive and negative cases only.  Issues are ``code, pack, detail``.
    """
    given = atoms.dropDuplicates(["pack", "id", "atom"])
    size = given.groupBy("pack", "id").agg(F.count("*").alias("size"), F.xxhash64(F.array_sort(F.collect_set("atom"))).alias("all"))
    rows = cases.join(size, ["pack", "id"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    issue = lambda df, code, detail="id": df.select(F.lit(code).alias("code"), "pack", F.col(detail).alias("detail"))
    kinds = cases.sparkSession.createDataFrame([(k,) for k in CASES], "category string")
    absent = cases.select("pack").distinct().join(F.broadcast(kinds)).join(cases, ["pack", "category"], "left_anti")  # seven rows
    fits = F.coalesce(F.array_contains(F.create_map(*(x for k, v in CASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[F.col("category")], F.col("expected")), F.lit(False))
    again = rows.groupBy("pack", "target", "size", "all").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1")
    found = [
        issue(absent, "CATEGORY_ABSENT", "category"), issue(_more_than_once(cases, "pack", "id"), "DUPLICATE_CASE"), issue(cases.where(~fits), "EXPECTED_STATE_INVALID"),
        issue(cases.where(~F.coalesce(F.col("expected") == F.col("observed"), F.lit(False))), "CASE_FAILED"),
        issue(rows.where("size = 0 AND category <> 'missing_premise'"), "CASE_WITHOUT_INPUTS"), issue(again, "CASE_RELABELLED"),
    ]

    def against(category: str, base: str, on: str = "atom") -> DataFrame:
        """Cases of a category, each with every ``base`` case of its target, their sizes and how many inputs they share."""
        left = rows.where(F.col("category") == category).select("pack", "target", "id", F.col("size").alias("own"), F.col("terms").alias("held"))
        right = rows.where(F.col("category") == base).select("pack", "target", F.col("id").alias("base"), F.col("size").alias("other"))
        mine, theirs = given.select("pack", "id", on), given.select("pack", F.col("id").alias("base"), on)
        if on != "atom":
            mine, theirs = (x.groupBy(*x.columns).count() for x in (mine, theirs))
            shared = left.join(right, ["pack", "target"]).join(mine.withColumnRenamed("count", "m"), ["pack", "id"]).join(theirs.withColumnRenamed("count", "t"), ["pack", "base", on])
            tally = shared.groupBy("pack", "id", "base").agg(F.sum(F.least("m", "t")).alias("shared"))
        else:
            tally = left.join(right, ["pack", "target"]).join(mine, ["pack", "id"]).join(theirs, ["pack", "base", on]).groupBy("pack", "id", "base").agg(F.count("*").alias("shared"))
        return left.join(right, ["pack", "target"]).join(tally, ["pack", "id", "base"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))

    def unmatched(category: str, good: DataFrame, code: str) -> DataFrame:
        return issue(cases.where(F.col("category") == category).join(good.select("pack", "id").distinct(), ["pack", "id"], "left_anti"), code)

    found.append(unmatched("missing_premise", against("missing_premise", "positive").where("shared = own AND own < other"), "NOT_A_MISSING_PREMISE"))
    found.append(unmatched("boundary", against("boundary", "positive").where("own = other AND shared = own - 1 AND held"), "NOT_A_BOUNDARY"))
    unit = against("unit_mismatch", "positive").where("own = other AND shared = own - 1").join(against("unit_mismatch", "positive", "unitless").where("shared = own").select("pack", "id", "base"), ["pack", "id", "base"], "left_semi")
    found.append(unmatched("unit_mismatch", unit, "NOT_A_UNIT_MISMATCH"))
    # a conflict is the union of a positive and a negative case: both are within it, and nothing is left over
    whole = lambda base: against("conflict", base).where("shared = other").select("pack", "id", "own", F.col("base").alias(base), F.col("other").alias(f"n_{base}"))
    pairs = whole("positive").join(whole("explicit_negative").drop("own"), ["pack", "id"])
    both = pairs.join(given.select("pack", F.col("id").alias("positive"), "atom"), ["pack", "positive"]).join(given.select("pack", F.col("id").alias("explicit_negative"), "atom"), ["pack", "explicit_negative", "atom"]).groupBy("pack", "id", "positive", "explicit_negative").agg(F.count("*").alias("common"))
    union = pairs.join(both, ["pack", "id", "positive", "explicit_negative"], "left").where("n_positive + n_explicit_negative - coalesce(common, 0) = own")
    found.append(unmatched("conflict", union, "NOT_A_CONFLICT"))
    # a counterexample adds atoms on the target's terms, of predicates that a positive case uses, to a negative case
    wider = against("counterexample", "explicit_negative").where("shared = other AND other < own").select("pack", "target", "id", "base")
    positive = rows.where("category = 'positive'").select("pack", "target", F.col("id").alias("positive"))
    used = given.select("pack", F.col("id").alias("positive"), "predicate").distinct()
    added = wider.join(given.select("pack", "id", "atom", "predicate", "terms"), ["pack", "id"]).join(given.select("pack", F.col("id").alias("base"), "atom"), ["pack", "base", "atom"], "left_anti")
    tried = added.join(positive, ["pack", "target"]).join(used.withColumn("used", F.lit(True)), ["pack", "positive", "predicate"], "left")
    good = tried.groupBy("pack", "id", "base", "positive").agg(F.bool_and(F.coalesce("used", F.lit(False)) & F.coalesce("terms", F.lit(False))).alias("good")).where("good")
    found.append(unmatched("counterexample", good, "NOT_A_COUNTEREXAMPLE"))
    result = found[0]
    for more in found[1:]:
        result = result.union(more)
    return result
