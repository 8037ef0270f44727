"""Judgements about results for claims and about code for methods, and what follows from them.

A claim assessment is a row ``id, verdict, state`` with structs ``claim`` and ``result``
(a frame: one text for each dimension) and ``alignment`` (one word for each); findings
are ``id, severity, code, detail``.  Rules that look at one row are column expressions,
so judging a ledger takes one scan; only hashes, chains and mappings are joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import is_digest

#: The dimensions of a frame, in the order in which they are listed.
DIMENSIONS = ("population", "exposure", "comparator", "outcome", "direction", "magnitude", "time_scope", "inference_level")
#: The levels of a result that suffice for a claim's level.
SUFFICES = {
    "descriptive": ("descriptive", "associational", "predictive", "causal", "mechanistic"),
    "associational": ("associational", "predictive", "causal", "mechanistic"),
    "predictive": ("predictive",),
    "causal": ("causal", "mechanistic"),
    "mechanistic": ("mechanistic",),
}
#: Errors that stand against any verdict.
HARD = ("EVIDENCE_ANCHOR_INVALID", "ASSESSMENT_STALE", "ASSESSMENT_CONTESTED", "ASSESSMENT_STORE_INTEGRITY", "ALIGNMENT_INCONSISTENT")
STRICT = ("supports_as_written", "contradicts_as_written")


def _is(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _listed(names: list[tuple[str, Column]]) -> Column:
    return F.array_join(F.array_compact(F.array(*(F.when(_is(test), name) for name, test in names))), ", ")


def semantic_findings(documents: DataFrame) -> DataFrame:
    """What the rules say about each assessment: evidence of too weak a kind, another scope, incomplete alignments."""
    verdict, align = F.col("verdict"), lambda d: F.col(f"alignment.{d}")
    grave = F.when(verdict.isin(*STRICT), "error").otherwise("warning")
    level, reached = F.col("claim.inference_level"), F.col("result.inference_level")
    adequate = _is(reduce(lambda a, b: a | b, ((level == need) & reached.isin(*some) for need, some in SUFFICES.items())))
    contradicts = _is(verdict == "contradicts_as_written")
    differs = [(d, (align(d) == "mismatch") & ~(contradicts & F.lit(d == "direction"))) for d in DIMENSIONS[:-1]]
    stated = _is((F.trim(F.col("claim.direction")) != "") & (F.trim(F.col("result.direction")) != ""))
    directed = _is((align("direction") == "match") | (contradicts & (align("direction") == "mismatch")))
    finer = _is(align("magnitude") == "not_stated") & F.col("claim.magnitude").isNull() & F.col("result.magnitude").isNotNull() & stated & directed
    partial = [(d, align(d).isin("partial", "not_stated") & ~(finer & F.lit(d == "magnitude"))) for d in DIMENSIONS]
    found = lambda severity, code, detail: F.struct(severity.alias("severity"), F.lit(code).alias("code"), detail.alias("detail"))
    weak = F.concat_ws(" ", reached, F.lit("evidence for a"), level, F.lit("claim"))
    says = F.array(
        F.when(~adequate & _is(level.isin("causal", "mechanistic")), found(grave, "CAUSAL_MODALITY_MISMATCH", weak)),
        F.when(~adequate & ~_is(level.isin("causal", "mechanistic")), found(grave, "INFERENCE_LEVEL_INADEQUATE", weak)),
        F.when(adequate & _is(align("inference_level") == "mismatch"), found(grave, "INFERENCE_LEVEL_MISMATCH", F.lit("declared"))),
        F.when(~adequate & _is(align("inference_level") == "match"), found(F.lit("error"), "ALIGNMENT_INCONSISTENT", F.lit("a match despite inadequate evidence"))),
        F.when(contradicts & ~_is(align("direction") == "mismatch"), found(F.lit("error"), "CONTRADICTION_DIRECTION_NOT_ESTABLISHED", F.lit("no direction mismatch"))),
        F.when(_listed(differs) != "", found(grave, "CLAIM_SCOPE_MISMATCH", _listed(differs))),
        F.when(_listed(partial) != "", found(grave, "CLAIM_ALIGNMENT_INCOMPLETE", _listed(partial))),
    )
    return documents.select("id", F.inline(F.array_compact(says)))


def stale(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Findings for what was locked (``id, part, node, hash``; part: claim node, result node, result artifact) and is no longer the same or there (``part, node, hash``)."""
    now = current.select("part", "node", F.col("hash").alias("now"), F.lit(True).alias("there"))
    off = stored.join(now, ["part", "node"], "left").where(F.col("there").isNull() | ~F.col("hash").eqNullSafe(F.col("now")))
    detail = F.concat_ws(" ", F.col("part"), F.when(F.col("there").isNull(), "unavailable:").otherwise("changed:"), F.col("node"))
    listed = off.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(detail)), "; ").alias("detail"))
    return listed.select("id", F.lit("error").alias("severity"), F.lit("ASSESSMENT_STALE").alias("code"), "detail")


def contested(leaves: DataFrame, code: str = "ASSESSMENT_CONTESTED") -> DataFrame:
    """Findings for present accepted assessments (``id, subject, verdict, state``) whose subject has another accepted verdict."""
    accepted = leaves.where("state = 'accepted'")
    split = accepted.groupBy("subject").agg((F.min("verdict") != F.max("verdict")).alias("split")).where("split")
    return accepted.join(split, "subject", "left_semi").select("id", F.lit("error").alias("severity"), F.lit(code).alias("code"), F.lit("conflicting accepted verdicts").alias("detail"))


def derived(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """``id, effective_state, proposed_relation, active_relation, stale, acceptable``: what an assessment says now, and whether a reviewer may accept it."""
    error = F.col("severity") == "error"
    has = lambda *codes: F.bool_or(F.col("code").isin(*codes))
    tally = findings.groupBy("id").agg(
        F.bool_or(error).alias("errors"), F.bool_or(error & F.col("code").isin(*HARD)).alias("hard"),
        has("ASSESSMENT_STALE").alias("stale"), has("ASSESSMENT_CONTESTED").alias("contested"),
    )
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    verdict = F.col("verdict")
    proposed = F.when((verdict == "supports_as_written") & ~flag("errors"), "supports").when((verdict == "supports_narrower_claim") & ~flag("hard"), "related").when((verdict == "contradicts_as_written") & ~flag("errors"), "refutes")
    state = F.when(flag("contested"), "contested").otherwise(F.col("state"))
    blocked = F.when(verdict.isin(*STRICT), flag("errors")).otherwise(flag("hard"))
    rows = documents.select("id", "verdict", "state").join(tally, "id", "left")
    return rows.select("id", state.alias("effective_state"), proposed.alias("proposed_relation"), F.when((state == "accepted") & ~flag("errors"), proposed).alias("active_relation"), flag("stale").alias("stale"), (~blocked).alias("acceptable"))


def anchor_valid(text: Column, observed: Column, expected: Column) -> Column:
    """Whether an anchor holds: there is a text, and its value or hash is the expected one."""
    return text.isNotNull() & _is(observed == expected)


# -- methods -------------------------------------------------------------------------


def method_findings(documents: DataFrame, alignments: DataFrame, stages: DataFrame, steps: DataFrame) -> DataFrame:
    """Findings ``id, severity, code, detail`` about judgements ``id, contract, method, verdict``.

    ``alignments``: ``id, step, stage, alignment``; ``stages``: ``contract, stage, method, step``;
    ``steps``: ``method, step, required``.  Every required step is to be mapped once, and
    the verdict must fit the alignments.
    """
    mapped = stages.groupBy("contract", "method", "step").agg(F.count("*").alias("n"))
    due = documents.select("id", "contract", "method").join(steps.where("required").select("method", "step"), "method")
    off = due.join(mapped, ["contract", "method", "step"], "left").where("n IS NULL OR n <> 1")
    unmapped = off.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("step")), ", ").alias("detail"))
    first = unmapped.select("id", F.lit("error").alias("severity"), F.lit("METHOD_REQUIRED_STEP_MAPPING_INVALID").alias("code"), "detail")
    tally = alignments.groupBy("id").agg(F.bool_and(F.col("alignment") == "match").alias("all_match"), F.bool_or(F.col("alignment") == "mismatch").alias("mismatch"))
    rows = documents.select("id", "verdict").join(tally, "id", "left")
    match, differs = F.coalesce("all_match", F.lit(True)), F.coalesce("mismatch", F.lit(False))
    code = (
        F.when((F.col("verdict") == "implements") & ~match, "METHOD_IMPLEMENTATION_ALIGNMENT_INCOMPLETE")
        .when((F.col("verdict") == "partially_implements") & match, "METHOD_VERDICT_ALIGNMENT_INCONSISTENT")
        .when((F.col("verdict") == "contradicts") & ~differs, "METHOD_VERDICT_ALIGNMENT_INCONSISTENT")
    )
    second = rows.select("id", F.lit("error").alias("severity"), code.alias("code"), F.col("verdict").alias("detail")).where("code IS NOT NULL")
    return first.union(second)


def method_stale(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Findings for judgements whose contract changed since: ``id`` with hashes ``source, method, code, stages, whole`` then and now; the parts that differ, or the contract as a whole."""
    now = current.select("id", F.struct("source", "method", "code", "stages", "whole").alias("now"))
    both = stored.join(now, "id", "left")
    differs = lambda part: ~F.col(part).eqNullSafe(F.col(f"now.{part}"))
    parts = _listed([(part, differs(part)) for part in ("source", "method", "code", "stages")])
    detail = F.when(F.col("now").isNull(), "unavailable").when(parts != "", parts).when(differs("whole"), "another dependency")
    return both.select("id", F.lit("error").alias("severity"), F.lit("METHOD_CONFORMANCE_STALE").alias("code"), detail.alias("detail")).where("detail IS NOT NULL")


def method_derived(documents: DataFrame, alignments: DataFrame, findings: DataFrame) -> DataFrame:
    """``id, effective_state, eligible, active_verdict, implementation_current, stale``."""
    has = lambda code: F.bool_or(F.col("code") == code)
    tally = findings.groupBy("id").agg(F.bool_or(F.col("severity") == "error").alias("errors"), has("METHOD_ASSESSMENT_CONTESTED").alias("contested"), has("METHOD_CONFORMANCE_STALE").alias("stale"))
    match = alignments.groupBy("id").agg(F.bool_and(F.col("alignment") == "match").alias("all_match"))
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    state = F.when(flag("contested"), "contested").otherwise(F.col("state"))
    eligible = _is(F.col("verdict") == "implements") & F.coalesce("all_match", F.lit(True)) & ~flag("errors")
    active = F.when((state == "accepted") & ~flag("errors"), F.col("verdict"))
    rows = documents.select("id", "verdict", "state").join(tally, "id", "left").join(match, "id", "left")
    return rows.select("id", state.alias("effective_state"), eligible.alias("eligible"), active.alias("active_verdict"), (_is(active == "implements") & eligible).alias("implementation_current"), flag("stale").alias("stale"))


def stage_coverage(stages: DataFrame, judged: DataFrame, alignments: DataFrame) -> DataFrame:
    """``contract, stage, covered``: whether a current implementation judgement (``id, contract, method, implementation_current``) matches the stage's own step."""
    good = judged.where("implementation_current").select("id", "contract", "method")
    match = alignments.where("alignment = 'match'").select("id", "step", "stage").join(good, "id").select("contract", "stage", "method", "step").distinct()
    return stages.join(match.withColumn("hit", F.lit(True)), ["contract", "stage", "method", "step"], "left").groupBy("contract", "stage").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("covered"))


def intermediates(produced: DataFrame, roles: DataFrame, receipts: DataFrame) -> DataFrame:
    """``run, state``: whether the intermediates on a claim's ancestry are as the receipts say.

    ``produced``: ``run, node`` made on the ancestry; ``roles``: ``run, node, path`` of
    intermediates kept as files; ``receipts``: ``run, node, path, state, sha256, version, size, current``.
    """
    due = roles.join(produced.distinct(), ["run", "node"], "left_semi").withColumnRenamed("path", "due")
    sound = (F.col("state") == "stable") & (F.col("path") == F.col("due")) & is_digest(F.col("sha256")) & (F.col("size") >= 0) & (F.col("version") == F.concat(F.lit("file:sha256:"), F.col("sha256"))) & F.col("current")
    held = due.join(receipts, ["run", "node"], "left").groupBy("run", "node").agg(F.bool_or(_is(sound)).alias("ok"))
    state = held.groupBy("run").agg(F.when(F.bool_and("ok"), "current").otherwise("missing_or_stale").alias("state"))
    return produced.select("run").distinct().join(state, "run", "left").select("run", F.coalesce("state", F.lit("not_required")).alias("state"))


def proof_groups(proofs: DataFrame) -> DataFrame:
    """Active proofs ``proof, derivation``, once each: how many derivations give it, and the least of them."""
    return proofs.groupBy("proof").agg(F.min("derivation").alias("derivation"), F.count_distinct("derivation").alias("derivations"))
