"""Connected components of an edge table that no machine holds whole.

Alternating large-star and small-star rounds (Kiveris et al., 2014): each round
is two aggregations and two joins; only minima are aggregated, so a hub's
neighbours are never gathered.  Each round's edges are written to the shared
folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import drop_path, scratch_path


def _star(directed: DataFrame) -> DataFrame:
    """For each u, the least of its neighbours and itself."""
    return directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(u long, v long)`` edges to ``(node, component)``: each node that has an edge, with its component's least node.

    Self-loops and repeated edges do no harm; no edges give no rows; rows with a null end are left out.
    """
    spark = edges.sparkSession

    def save(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = scratch_path(spark, "edges")
        df.write.parquet(path)
        kept = spark.read.schema("u long, v long").parquet(path)
        mark = kept.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        return kept, path, tuple(mark)

    # Stored with u > v.
    oriented = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, path, mark = save(oriented)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_star(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        minima = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(minima, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(minima.select("u", F.col("m").alias("v"))).distinct()
        following, new_path, new_mark = save(small)
        drop_path(spark, path)
        current, path, done, mark = following, new_path, new_mark == mark, new_mark
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    # Settled: every edge leads from a node to its component's least node.
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
