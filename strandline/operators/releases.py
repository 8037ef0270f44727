"""Release manifests as tables: their form, their inventory, and whether a project still is what they say.

``files``: ``at`` (place in the manifest), ``location, path, roles, ids`` (arrays), ``sha256, size``;
``stores``: ``at, role, records``; ``counts``: ``role, n`` as the manifest states them.
Issues are ``code, item, detail``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import is_digest
from strandline.operators.search import diff


def _issue(rows: DataFrame, code: str, item: str, detail=None) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.col(item).cast("string").alias("item"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


def role_counts(files: DataFrame) -> DataFrame:
    return files.select(F.explode(F.array_distinct("roles")).alias("role")).groupBy("role").agg(F.count("*").alias("n"))


def _displaced(rows: DataFrame, *key: str) -> DataFrame:
    """Rows that do not come after the row before them: each is joined with its neighbour by place, so nothing is sorted in one task."""
    before = rows.select((F.col("at") + 1).alias("at"), F.struct(*key).alias("before"))
    return rows.join(before, "at").where(F.struct(*key) <= F.col("before"))


def issues(files: DataFrame, stores: DataFrame, counts: DataFrame, single: tuple[str, ...] = ("config", "graph"), required: tuple[str, ...] = ()) -> DataFrame:
    """Malformed files; files and stores out of order or repeated; counts that are not those of the files; roles that must come once."""
    own = role_counts(files)
    bad = files.where(~F.coalesce(is_digest(F.col("sha256")) & (F.col("size") >= 0) & (F.col("path") != "") & F.col("location").isin("project", "external"), F.lit(False)))
    roles = files.where((F.size("roles") == 0) | (F.col("roles") != F.array_sort(F.array_distinct("roles"))))
    told = counts.withColumnRenamed("n", "told").join(own, "role", "full_outer").where(~F.col("told").eqNullSafe(F.col("n")))
    named = files.sparkSession.createDataFrame([(r,) for r in single], "role string").join(own, "role", "left").where(~F.col("n").eqNullSafe(F.lit(1)))
    held = stores.join(own, "role", "left").where(F.col("records") != F.coalesce("n", F.lit(0)))
    found = _issue(bad, "FILE_MALFORMED", "path").union(_issue(roles, "ROLES_NOT_CANONICAL", "path")).union(_issue(_displaced(files, "location", "path"), "FILES_OUT_OF_ORDER", "path"))
    found = found.union(_issue(_displaced(stores, "role"), "STORES_OUT_OF_ORDER", "role")).union(_issue(told, "ROLE_COUNT_MISMATCH", "role", F.coalesce("n", F.lit(0))))
    found = found.union(_issue(named, "ROLE_NOT_SINGLE", "role", F.coalesce("n", F.lit(0)))).union(_issue(held, "STORE_COUNT_MISMATCH", "role", F.coalesce("n", F.lit(0))))
    if required:
        lacks = files.sparkSession.createDataFrame([(r,) for r in required], "role string").join(stores, "role", "left_anti")
        found = found.union(_issue(lacks, "STORE_MISSING", "role"))
    return found


def changed_fields(before: DataFrame, after: DataFrame) -> DataFrame:
    """``location, path, change, fields``: files added, removed or changed, and in what."""
    by = ["location", "path"]
    rest = ("roles", "ids", "sha256", "size")
    changes = diff(before.select(*by, *rest), after.select(*by, *rest), by)
    a, b = before.select(*by, F.struct(*rest).alias("a")), after.select(*by, F.struct(*rest).alias("b"))
    fields = F.array_join(F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in rest))), ",")
    both = changes.join(a, by, "left").join(b, by, "left")
    return both.select(*by, "change", F.when(F.col("change") == "changed", fields).otherwise("").alias("fields"))


def verified(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """One row ``added, removed, changed, valid``: whether the files of a project are those of its manifest."""
    count = lambda change: F.count_if(F.col("change") == change).alias(change)
    return changed_fields(manifest, current).agg(count("added"), count("removed"), count("changed")).withColumn("valid", F.expr("added + removed + changed = 0"))
