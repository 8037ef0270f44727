"""Exact terminology search, snapshot diffs and change sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources.scratch import settled


def normal_key(text: Column) -> Column:
    """Blanks collapsed, ends trimmed, lowered: the comparison form of a term."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def candidates(queries: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """Queries ``query`` against ``term_id, tier, text``: the best match of each term, ranked; ``limit`` is the feature."""
    wanted = queries.select("query", normal_key(F.col("query")).alias("norm")).distinct()
    best = terms.withColumn("norm", normal_key(F.col("text"))).join(wanted, "norm").groupBy("query", "term_id").agg(F.min("tier").alias("tier"))
    w = Window.partitionBy("query")
    return best.select("query", "term_id", "tier", F.row_number().over(w.orderBy("tier", "term_id")).alias("rank"), F.count("*").over(w).alias("matches")).where(F.col("rank") <= limit)


def diff(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """``by, change``: added, removed or changed; equal rows are left out. Values are compared null-safely."""
    rest = [c for c in before.columns if c not in by]
    b, a = before.select(*by, F.struct(*rest).alias("b")), after.select(*by, F.struct(*rest).alias("a"))
    both = b.join(a, by, "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(*by, change.alias("change")).where("change IS NOT NULL")


def apply_changes(base: DataFrame, add: DataFrame, replace: DataFrame, remove: DataFrame, by: list[str]) -> DataFrame:
    """A change set on a keyed table: what is removed or replaced goes, what replaces or is added comes."""
    gone = remove.select(*by).union(replace.select(*by)).distinct()
    return base.join(gone, by, "left_anti").unionByName(replace.join(base.select(*by), by, "left_semi")).unionByName(add.join(base.select(*by), by, "left_anti"))


def role_inventory(files: DataFrame) -> DataFrame:
    """``path, hash, role`` to one row for each path: its roles, and whether its snapshots agree."""
    return files.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), (F.count_distinct("hash") > 1).alias("conflict"))


def within_budget(items: DataFrame, group: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """Items of each group, in order, as long as their sizes add up to no more than ``budget``."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return items.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def numbered(rows: DataFrame, by: str, order: str, name: str = "place") -> DataFrame:
    """The rows with their place from 1 in each group, by ``order``, also where a few groups hold all rows.

    Ranges of (group, order) are numbered each for itself; the rows of a group before a
    range come from one count for each group and range.  Of equal rows any comes first.
    """
    ranges = settled(rows.repartitionByRange(by, order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("__range", by).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__range").alias("__r"), F.col(by).alias("__by"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = ranges.withColumn("__own", F.row_number().over(Window.partitionBy("__range", by).orderBy(order)))
    joined = own.join(offsets, (F.col("__range") == F.col("__r")) & F.col(by).eqNullSafe(F.col("__by")))
    return joined.select(*rows.columns, (F.col("__before") + F.col("__own")).alias(name))
