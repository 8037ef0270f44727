"""Replay certificates: what their attempts gave, and whether they still hold.

``attempts`` is (cert, attempt, launch_error: boolean, code, stdout, stderr, writes:
hash of undeclared writes or null, trace: state or null), ``outputs`` (cert, attempt,
path, state, hash) and ``source`` (cert, path, hash), the receipt's own outputs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.pipelines import COMPLETE


def attempt_outcome(launch_error: Column, code: Column, unstable: Column) -> Column:
    """The one outcome that fits an attempt; no exit code means that time ran out."""
    out = F.when(launch_error, "launch_error").when(code.isNull(), "timed_out").when(code != 0, "failed")
    return out.when(unstable, "output_missing_or_unstable").otherwise("succeeded")


def attempt_outcomes(attempts: DataFrame, outputs: DataFrame) -> DataFrame:
    """The attempts with ``outcome``; an output that is not stable, or has no state, spoils one that ended well."""
    off = outputs.where("NOT (state <=> 'stable')").select("cert", "attempt", F.lit(True).alias("off")).distinct()
    joined = attempts.join(off, ["cert", "attempt"], "left")
    return joined.withColumn("outcome", attempt_outcome(F.coalesce("launch_error", F.lit(False)), F.col("code"), F.coalesce("off", F.lit(False)))).drop("off")


def compare(attempts: DataFrame, outputs: DataFrame, source: DataFrame, traced: bool = False) -> DataFrame:
    """``cert, attempts, all_succeeded, outputs_equal, matches_source, streams_equal, writes_equal, writes_present, traces_complete, outcome``.

    Outputs are compared by counts for each path, so no list of them is gathered.  Equality
    holds only where every attempt succeeded; one attempt equals itself.  ``traced`` asks
    for complete stage traces.  Nulls compare as equal.
    """
    alike = lambda c: F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0none"))) <= 1
    judged = attempt_outcomes(attempts, outputs).groupBy("cert").agg(
        F.count("*").alias("attempts"), F.every(F.col("outcome") == "succeeded").alias("all_succeeded"), (alike("stdout") & alike("stderr")).alias("streams_same"),
        alike("writes").alias("writes_same"), F.some(F.col("writes").isNotNull()).alias("writes_present"), F.every(F.coalesce(F.col("trace") == COMPLETE, F.lit(False))).alias("traced_whole"),
    )
    hashes = F.coalesce("hash", F.lit("\0none"))
    paths = outputs.groupBy("cert", "path").agg(F.count_distinct("attempt").alias("n"), F.min(hashes).alias("low"), F.max(hashes).alias("high"))
    wanted = source.select("cert", "path", F.coalesce("hash", F.lit("\0none")).alias("want")).distinct()
    both = paths.join(wanted, ["cert", "path"], "full_outer").join(judged.select("cert", "attempts"), "cert")
    one = F.coalesce((F.col("n") == F.col("attempts")) & (F.col("low") == F.col("high")), F.lit(False))
    told = both.groupBy("cert").agg(F.every(one | F.col("n").isNull()).alias("same"), F.every(one & (F.col("low").eqNullSafe(F.col("want")))).alias("as_source"))
    fits = F.lit(not traced) | F.col("traced_whole")
    flags = judged.join(told, "cert", "left").select(
        "cert", "attempts", "all_succeeded", (F.col("all_succeeded") & F.coalesce("same", F.lit(True))).alias("outputs_equal"), (F.col("all_succeeded") & F.coalesce("as_source", F.lit(True))).alias("matches_source"),
        (F.col("all_succeeded") & F.col("streams_same")).alias("streams_equal"), (F.col("all_succeeded") & F.col("writes_same")).alias("writes_equal"), "writes_present", fits.alias("traces_complete"),
    )
    whole = reduce(Column.__and__, (F.col(c) for c in ("outputs_equal", "matches_source", "streams_equal", "writes_equal", "traces_complete")))
    return flags.withColumn("outcome", F.when(~F.col("all_succeeded"), "replay_failed").when(whole, "byte_repeatable").otherwise("repeatability_mismatch"))


def findings(certificates: DataFrame, runs: DataFrame, inputs: DataFrame, files: DataFrame, contracts: DataFrame) -> DataFrame:
    """``code, cert, detail``: why a certificate no longer holds.

    ``certificates`` is (cert, run, start_id, finish_id, computation, contract), ``runs``
    (run, start_id, finish_id, outcome, computation, contract), ``inputs`` (run, path,
    hash) as recorded, ``files`` (path, hash) and ``contracts`` (contract, which still
    resolve) as they are.  A run that is gone, and a file that is gone, count as changed.
    """
    c, r = certificates.alias("c"), runs.alias("r")
    both = c.join(r, "run", "left").select("c.cert", "run", *(F.col(f"{x}.{n}").alias(f"{x}_{n}") for x in "cr" for n in ("start_id", "finish_id", "computation", "contract")), "r.outcome")
    differs = lambda *names: reduce(Column.__or__, (~F.col(f"c_{n}").eqNullSafe(F.col(f"r_{n}")) for n in names))
    say = lambda rows, code, detail: rows.select(F.lit(code).alias("code"), "cert", detail.alias("detail")).distinct()
    drifted = inputs.join(files.withColumnRenamed("hash", "now"), "path", "left").where("NOT (hash <=> now)").select("run", "path")
    found = (
        say(both.where(differs("start_id", "finish_id")), "REPLAY_SOURCE_STALE", F.lit("other events")),
        say(both.where("NOT (outcome <=> 'succeeded')"), "REPLAY_SOURCE_STALE", F.lit("the run did not succeed")),
        say(both.where(differs("computation", "contract")), "REPLAY_SOURCE_STALE", F.lit("another computation or contract")),
        say(both.select("cert", "run").join(drifted, "run"), "REPLAY_INPUT_DRIFT", F.col("path")),
        say(both.select("cert", F.col("r_contract").alias("contract")).join(contracts, "contract", "left_anti"), "REPLAY_CONTRACT_DRIFT", F.coalesce("contract", F.lit("none"))),
    )
    return reduce(DataFrame.union, found)


def currentness(compared: DataFrame, found: DataFrame) -> DataFrame:
    """``cert, current, byte_repeatable_current, review_ready_current`` of what ``compare`` and ``findings`` return."""
    off = found.select("cert", F.lit(True).alias("off")).distinct()
    now = compared.join(off, "cert", "left").withColumn("current", F.col("off").isNull())
    same = F.col("current") & (F.col("outcome") == "byte_repeatable")
    return now.select("cert", "current", same.alias("byte_repeatable_current"), (same & ~F.col("writes_present") & F.col("traces_complete")).alias("review_ready_current"))
