"""Reconciliation of append-only ledgers: ``event_id, run_id, type, at`` and what each event carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def firsts(events: DataFrame) -> DataFrame:
    """The first event of each run and type, by time and id, with how many there are."""
    return events.groupBy("run_id", "type").agg(F.min_by(F.struct("event_id", "at", "version"), F.struct("at", "event_id")).alias("first"), F.count("*").alias("n"))


def pair_runs(events: DataFrame) -> DataFrame:
    """``run_id, start_id, finish_id, started, finished``: a run without one of them has nulls there."""
    first = firsts(events)
    side = lambda kind, a, b: first.where(F.col("type") == kind).select("run_id", F.col("first.event_id").alias(a), F.col("first.at").alias(b))
    return side("run.started", "start_id", "started").join(side("run.finished", "finish_id", "finished"), "run_id", "full_outer")


def link_issues(events: DataFrame) -> DataFrame:
    """``code, run_id``: runs whose events do not pair."""
    pairs, first = pair_runs(events), firsts(events).where(F.col("type").isin("run.started", "run.finished"))
    named = F.when(F.col("start_id").isNull(), "FINISH_WITHOUT_START").when(F.col("finish_id").isNull(), "RUN_INCOMPLETE").when(F.col("finished") < F.col("started"), "FINISH_BEFORE_START")
    again = F.when(F.col("type") == "run.started", "DUPLICATE_START").otherwise("DUPLICATE_FINISH")
    return pairs.select(named.alias("code"), "run_id").where("code IS NOT NULL").union(first.where("n > 1").select(again, "run_id"))


def latest(events: DataFrame, by: list[str]) -> DataFrame:
    """The last event of each key, by time and id: an aggregate that combines before the shuffle."""
    rest = [c for c in events.columns if c not in by]
    return events.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("at", "event_id")).alias("x")).select(*by, "x.*")


def drift(events: DataFrame, by: list[str]) -> DataFrame:
    """Keys whose last version is not the one that was recorded first."""
    return events.groupBy(*by).agg(F.min_by("version", F.struct("at", "event_id")).alias("recorded"), F.max_by("version", F.struct("at", "event_id")).alias("current")).where("recorded <> current")


def replacements(runs: DataFrame, by: list[str]) -> DataFrame:
    """For each finished run the latest run of the same key that started after it: a window, not an inequality join.

    The last start of a key is after a finish exactly if it is the maximum and later.
    """
    last = runs.where("started IS NOT NULL").groupBy(*by).agg(F.max(F.struct("started", "run_id")).alias("last"))
    return runs.where("finished IS NOT NULL").join(last, by).where(F.col("last.started") > F.col("finished")).select(*by, "run_id", F.col("last.run_id").alias("replaced_by"))


def transition(before: Column, after: Column) -> Column:
    """The label of a change between two content hashes (null: absent)."""
    return F.when(before.isNull() & after.isNull(), "missing").when(before.isNull(), "created").when(after.isNull(), "deleted").when(before == after, "unchanged").otherwise("content_changed")


def window_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, transition`` of two scans ``path, hash``; unchanged paths are left out."""
    both = before.withColumnRenamed("hash", "b").join(after.withColumnRenamed("hash", "a"), "path", "full_outer")
    return both.select("path", transition(F.col("b"), F.col("a")).alias("transition")).where("transition <> 'unchanged'")


def outcome(precondition: Column, interrupted: Column, launch_error: Column, code: Column, contract: Column) -> Column:
    """The precedence of run outcomes."""
    return F.when(precondition, "precondition_failed").when(interrupted, "interrupted").when(launch_error, "launch_error").when(code != 0, "failed").when(contract, "contract_failed").otherwise("succeeded")


def replay_compare(attempts: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by, attempts, outcome``: whether all attempts gave one value."""
    kinds = F.count_distinct(value)
    return attempts.groupBy(*by).agg(F.count("*").alias("attempts"), F.when(F.count(value) < F.count("*"), "output_missing").when(F.count("*") < 2, "insufficient").when(kinds == 1, "byte_repeatable").otherwise("differs").alias("outcome"))


def stage_fold(events: DataFrame, stages: dict[str, str | None]) -> DataFrame:
    """Checkpoints of each run folded in order: ``run_id, stage, at, seq, state``.

    ``stages`` names each stage's parent.  The first checkpoint of a stage counts, a
    later one is a duplicate; it is out of order unless its parent came before.
    """
    order = F.struct("at", "event_id")
    one = events.groupBy("run_id", F.col("type").alias("stage")).agg(F.min(order).alias("first"), F.count("*").alias("n"))
    parent = F.create_map(*(F.lit(x) for pair in stages.items() for x in pair))
    known = one.where(F.col("stage").isin(*stages)).withColumn("parent", parent[F.col("stage")])
    above = known.select("run_id", F.col("stage").alias("parent"), F.col("first").alias("parent_first"))
    seq = F.row_number().over(Window.partitionBy("run_id").orderBy("first"))  # a run has no more rows than there are stages
    state = F.when(F.col("parent").isNotNull() & (F.col("parent_first").isNull() | (F.col("parent_first") > F.col("first"))), "out_of_order").when(F.col("n") > 1, "repeated").otherwise("accepted")
    return known.join(above, ["run_id", "parent"], "left").select("run_id", "stage", seq.alias("seq"), state.alias("state"))
