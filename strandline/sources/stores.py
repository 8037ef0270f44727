"""Content-addressed JSON stores: one file for each document, named by the hash of its bytes.

Reading verifies each file against its name and splits good from bad; a store with
any bad row has no current documents (fail closed).  Appending is create-only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.scalars import is_digest


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``id, text, issue``: issue is null for a sound document."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    named = files.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("id"), F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("text"))
    issue = F.when(~is_digest(F.col("id")), "INVALID_NAME").when(F.col("id") != F.col("hash"), "HASH_MISMATCH").when(F.expr("try_parse_json(text)").isNull(), "INVALID_JSON")
    return named.select("id", "text", issue.alias("issue"))


def documents(store: DataFrame, schema: T.StructType) -> DataFrame:
    """The parsed documents, or none at all if the store has an issue."""
    bad = store.where("issue IS NOT NULL").select(F.lit(1).alias("bad")).limit(1)
    parsed = store.where("issue IS NULL").select("id", F.from_json("text", schema).alias("d"))
    return parsed.join(F.broadcast(bad), F.lit(True), "left_anti").select("id", "d.*")  # one row at most


def append(new: DataFrame, path: str, text_col: str = "text") -> None:
    """Add texts that the store lacks, as a text file each is not needed: rows go below ``prefix=xx``."""
    spark = new.sparkSession
    named = new.select(F.sha2(text_col, 256).alias("id"), F.col(text_col).alias("text")).dropDuplicates(["id"]).withColumn("prefix", F.substring("id", 1, 2))
    try:
        have = spark.read.schema("id string, text string, prefix string").parquet(path)
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        have = None
    fresh = named.join(have.select("id"), "id", "left_anti") if have is not None else named
    fresh.write.mode("append").partitionBy("prefix").parquet(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A graph document to nodes, edges and concepts; of a repeated id the last definition wins."""
    schema = "nodes array<struct<id:string,type:string,status:string,path:string,value:string,note:string,date:string,backbone:string>>, edges array<struct<`from`:string,`to`:string,rel:string>>, concepts map<string,struct<canonical:string,legacy:string,note:string>>"
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    listed = raw.select(F.posexplode("nodes").alias("pos", "n")).select("pos", "n.*")
    nodes = listed.groupBy("id").agg(F.max_by(F.struct(*listed.columns), "pos").alias("n")).select("n.*")
    edges = raw.select(F.explode("edges").alias("e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.col("e.rel").alias("rel"))
    concepts = raw.select(F.explode("concepts").alias("name", "c")).select("name", "c.*")
    return nodes, edges, concepts
