"""Render manifests against the graph and the files as they are.

Flat inputs, so that no manifest is gathered into one row:

- ``renders``: ``id, path`` of the nodes that should have a manifest
- ``manifests``: ``id, node, output, output_hash, version`` of those that have one
- ``inputs``: ``id, path, hash`` of what each manifest has locked, ``at`` its place
- ``expected``: ``id, path`` of the inputs that the graph tells
- ``locked``: ``id, concept, value`` of the backbone that each manifest has locked
- ``files``: ``path, hash`` of what is there
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import is_digest
from strandline.operators.checks import finding

#: The version of present manifests, a parameter; those before had none and shorter hashes.
VERSION = "render-manifest/2"


def missing(renders: DataFrame, manifests: DataFrame) -> DataFrame:
    return finding(renders.join(manifests.select("id"), "id", "left_anti"), "error", "MISSING_MANIFEST", F.col("id"), F.col("path"))


def _digest(hash_column, version):
    return F.when(version.isNull(), is_digest(hash_column, 40)).otherwise(is_digest(hash_column, 64))


def invalid(renders: DataFrame, manifests: DataFrame, inputs: DataFrame, version: str = VERSION) -> DataFrame:
    """An unknown version; another node or output; a bad output hash; inputs that are repeated or lack a path or a hash."""
    of = manifests.join(renders, "id")
    known = F.col("version").isNull() | (F.col("version") == version)
    why = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("node") == F.col("id"), F.col("version").isNull() & F.col("node").isNull()), "another node"),
            F.when(~F.col("output").eqNullSafe(F.col("path")), "another output"),
            F.when(~_digest(F.col("output_hash"), F.col("version")), "no output hash"),
        )
    )
    own = of.select("id", F.explode(F.when(known, why).otherwise(F.array(F.lit("unknown version")))).alias("why"))
    sound = of.where(known).select("id", "version")
    bad = F.coalesce(F.col("path") != "", F.lit(False)) & _digest(F.col("hash"), F.col("version"))
    listed = inputs.join(sound, "id").groupBy("id", "path").agg(F.count("*").alias("n"), F.bool_and(bad).alias("good"))
    broken = listed.where("n > 1 OR NOT good").select("id", F.lit("repeated or malformed input").alias("why")).distinct()
    return finding(own.union(broken), "error", "INVALID_MANIFEST", F.col("id"), F.col("why"))


def backbone_mismatch(manifests: DataFrame, locked: DataFrame, bindings: DataFrame) -> DataFrame:
    """Manifests whose locked bindings are not those of their node."""
    now = bindings.join(manifests.select("id"), "id", "left_semi").withColumnRenamed("value", "now")
    both = locked.join(manifests.select("id"), "id", "left_semi").withColumnRenamed("value", "then").join(now, ["id", "concept"], "full_outer")
    off = both.where(~F.col("then").eqNullSafe(F.col("now"))).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("concept")), ",").alias("concepts"))
    return finding(off, "error", "MANIFEST_BACKBONE_MISMATCH", F.col("id"), F.col("concepts"))


def input_mismatch(manifests: DataFrame, inputs: DataFrame, expected: DataFrame) -> DataFrame:
    """Inputs that the graph tells and the manifest lacks, or the other way round; one row for each."""
    has = inputs.join(manifests.select("id"), "id", "left_semi").select("id", "path").distinct()
    due = expected.join(manifests.select("id"), "id", "left_semi").select("id", "path").distinct()
    lacks = due.join(has, ["id", "path"], "left_anti").select("id", F.concat(F.lit("missing: "), "path").alias("detail"))
    more = has.join(due, ["id", "path"], "left_anti").select("id", F.concat(F.lit("undeclared: "), "path").alias("detail"))
    return finding(lacks.union(more), "error", "MANIFEST_INPUT_MISMATCH", F.col("id"), F.col("detail"))


def output_drift(renders: DataFrame, manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Outputs that are there and differ from what was locked."""
    both = manifests.where(_digest(F.col("output_hash"), F.col("version"))).join(renders, "id").join(files, "path")
    return finding(both.where("hash <> output_hash"), "error", "OUTPUT_DRIFT", F.col("id"), F.col("path"))


def stale_data(manifests: DataFrame, inputs: DataFrame, files: DataFrame) -> DataFrame:
    """The first locked input of each manifest, in its order, that is gone or has changed."""
    sound = inputs.join(manifests.select("id", "version"), "id").where(_digest(F.col("hash"), F.col("version")))
    now = files.select("path", F.col("hash").alias("now"))
    off = sound.join(now, "path", "left").where("now IS NULL OR now <> hash")
    first = off.groupBy("id").agg(F.min_by(F.struct("path", "now"), F.struct("at", "path")).alias("x"))
    return finding(first, "error", "STALE_DATA", F.col("id"), F.concat(F.when(F.col("x.now").isNull(), "missing: ").otherwise("changed: "), F.col("x.path")))


def dirty_roots(renders: DataFrame, manifests: DataFrame, inputs: DataFrame, locked: DataFrame, bindings: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id`` of the nodes from which staleness spreads: renders that are off, and the nodes of inputs that are (``nodes``: ``id, path``)."""
    own = backbone_mismatch(manifests, locked, bindings).union(output_drift(renders, manifests, files)).select(F.col("node_id").alias("id"))
    paths = stale_data(manifests, inputs, files).select(F.regexp_extract("detail", "^(?:missing|changed): (.*)$", 1).alias("path")).distinct()
    return own.union(nodes.join(paths, "path", "left_semi").select("id")).distinct()
