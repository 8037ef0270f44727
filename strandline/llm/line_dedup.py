"""Operator 3: line dedup over levelled sorted runs of line hashes.

A *run* is a Parquet table of line keys sorted by their hash: ``h1, h2`` (two
independent 64-bit hashes of the key), ``n_docs``, ``max_id`` and ``fresh`` (no
earlier run had the key).  ``LineRuns`` takes batches: each batch is reduced to one
run, anti-joined with the present runs on their sort key, which tells its new
lines, and added to level 0; when a level has ``fanout`` runs they are compacted
into one run of the next level.  The merge of all runs tells how many documents
hold a key and which id is the largest.

``drop_shared_lines`` feeds a corpus through such runs: one scan reduces it to
``batches`` batches by id hash, which are ingested one after another, then it drops
the lines.  Only the rare keys that are shared often enough meet the documents
again; they are broadcast when a count shows that they are few, else joined by a
shuffle.

Cases: a null or empty text is one empty line; blanks are those of
``[\\x20\\x09-\\x0D]``; every input row counts as a document, so repeated rows
count apart; a null id ranks below all others; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import BLANKS, ascii_lower, drop_path, let, scratch_path

#: Shared keys up to which they are broadcast: 16 bytes and an id each.
BROADCAST_KEYS = 1_000_000
LEAST = -(1 << 63)
RUN = "h1 long, h2 long, n_docs long, max_id long, fresh boolean"


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """The key of each line, in order."""
    return F.transform(text_lines(ascii_lower(text)), lambda line: F.btrim(line, F.lit(BLANKS)))


def _hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


class LineRuns:
    """Runs below one folder, in levels."""

    def __init__(self, spark: SparkSession, root: str | None = None, fanout: int = 4, min_length: int = 40):
        self.spark, self.root = spark, root or scratch_path(spark, "line-runs")
        self.fanout, self.min_length = fanout, min_length
        self.levels: list[list[str]] = [[]]
        self._made = 0

    def _keys(self, docs: DataFrame, id_col: str, *also: str) -> DataFrame:
        """A row for each document and distinct key of ``min_length`` code points or more."""
        long_keys = F.array_distinct(F.transform(F.filter(line_keys(F.col("text")), lambda k: F.length(k) >= self.min_length), _hashes))
        return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("doc"), *also, F.explode(long_keys).alias("k")).select("doc", *also, "k.h1", "k.h2")

    def _save(self, run: DataFrame, level: int) -> None:
        path = f"{self.root}/level-{level}/run-{self._made}"
        self._made += 1
        run.sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def read(self, paths: list[str] | None = None) -> DataFrame:
        paths = [p for level in self.levels for p in level] if paths is None else paths
        return self.spark.read.schema(RUN).parquet(*paths) if paths else self.spark.createDataFrame([], RUN)

    @staticmethod
    def merge(runs: DataFrame) -> DataFrame:
        return runs.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("max_id").alias("max_id"), F.bool_or("fresh").alias("fresh"))

    def add(self, batch: DataFrame, id_col: str = "doc_id") -> None:
        """Reduce one batch (with ``text``) to a run and ingest it."""
        self.ingest(self._keys(batch, id_col).groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("max_id")))

    def ingest(self, keys: DataFrame) -> None:
        """Add a batch of distinct keys ``h1, h2, n_docs, max_id``: those that no run has yet are fresh."""
        if any(self.levels):
            known = self.read().where("fresh").select("h1", "h2", F.lit(True).alias("known"))  # one row for each key of all runs
            run = keys.join(known, ["h1", "h2"], "left").select("h1", "h2", "n_docs", "max_id", F.col("known").isNull().alias("fresh"))
        else:
            run = keys.select("h1", "h2", "n_docs", "max_id", F.lit(True).alias("fresh"))
        self._save(run, 0)
        self.compact()

    def add_all(self, docs: DataFrame, id_col: str = "doc_id", batches: int = 3) -> None:
        """Reduce a corpus to ``batches`` batches (by id hash) in a single scan and ingest one after another."""
        keys = (
            self._keys(docs.withColumn("batch", F.pmod(F.xxhash64(id_col), F.lit(batches))), id_col, "batch")
            .groupBy("h1", "h2", "batch")
            .agg(F.count("*").alias("n_docs"), F.max("doc").alias("max_id"))
        )
        path = f"{self.root}/batches-{self._made}"
        self._made += 1
        keys.write.partitionBy("batch").parquet(path)
        staged = self.spark.read.schema("h1 long, h2 long, n_docs long, max_id long, batch int").parquet(path)
        for k in range(batches):
            self.ingest(staged.where(F.col("batch") == k).drop("batch"))
        drop_path(self.spark, path)

    def new_lines(self, batch: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """``doc, h1, h2`` of the batch's keys that no run has yet."""
        return self._keys(batch, id_col).join(self.read().select("h1", "h2"), ["h1", "h2"], "left_anti").select("doc", "h1", "h2")

    def compact(self) -> None:
        """Merge each level that is full into one run of the next."""
        level = 0
        while level < len(self.levels):
            if len(paths := self.levels[level]) >= self.fanout:
                self._save(self.merge(self.read(paths)), level + 1)
                self.levels[level] = []
                for path in paths:
                    drop_path(self.spark, path)
            level += 1

    def shared(self, min_docs: int) -> DataFrame:
        """Keys that at least ``min_docs`` documents hold: ``h1, h2, max_id``."""
        return self.merge(self.read()).where(F.col("n_docs") >= min_docs).select("h1", "h2", "max_id")


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", min_length: int = 40, min_docs: int = 5, batches: int = 3, fanout: int = 2) -> DataFrame:
    """Append ``n_lines``, ``n_dropped``, ``kept_text``; rows and other columns stay."""
    spark = docs.sparkSession
    base = docs.drop("n_lines", "n_dropped", "kept_text")
    runs = LineRuns(spark, fanout=fanout, min_length=min_length)
    runs.add_all(base.select(id_col, "text"), id_col, batches)
    path = scratch_path(spark, "shared-keys")
    runs.shared(min_docs).write.parquet(path)
    shared = spark.read.schema("h1 long, h2 long, max_id long").parquet(path)
    drop_path(spark, runs.root)
    if shared.count() <= BROADCAST_KEYS:
        shared = F.broadcast(shared)

    mark = F.xxhash64("text")
    numbered = F.filter(
        F.transform(line_keys(F.col("text")), lambda k, i: F.struct(F.when(F.length(k) >= min_length, _hashes(k)).alias("k"), i.alias("at"))),
        lambda x: x.k.isNotNull(),
    )
    lines = base.select(F.col(id_col).alias("id"), mark.alias("mark"), F.explode(numbered).alias("line")).select("id", "mark", "line.at", "line.k.h1", "line.k.h2")
    dropped = (
        lines.join(shared, ["h1", "h2"])
        .where(F.coalesce(F.col("id").cast("long"), F.lit(LEAST)) != F.col("max_id"))
        .groupBy("id", "mark")
        .agg(F.collect_set("at").alias("gone"))
    )
    joined = base.withColumn("__mark", mark).alias("d").join(dropped.alias("g"), F.col(f"d.{id_col}").eqNullSafe(F.col("g.id")) & F.col("d.__mark").eqNullSafe(F.col("g.mark")), "left")

    def rest(lines: Column) -> Column:
        gone = F.coalesce(F.col("g.gone"), F.array().cast("array<int>"))
        kept = let(F.struct(lines.alias("all"), gone.alias("gone")), lambda x: F.struct(
            F.size(x["all"]).cast("long").alias("n_lines"),
            F.size(x["gone"]).cast("long").alias("n_dropped"),
            F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x["all"]) - 1), x["gone"]), lambda i: x["all"][i]), "\n").alias("kept_text"),
        ))
        return kept

    out = joined.withColumn("__cut", F.when(F.col("g.gone").isNull(), F.struct(
        F.size(text_lines(F.col("d.text"))).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.coalesce("d.text", F.lit("")).alias("kept_text"),
    )).otherwise(rest(text_lines(F.col("d.text")))))
    return out.select(*(F.col(f"d.{c}") for c in base.columns), "__cut.n_lines", "__cut.n_dropped", "__cut.kept_text")


def op3_line_dedup(documents: DataFrame) -> DataFrame:
    cut = drop_shared_lines(documents.select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, g.i AS i, string_split(coalesce(text, ''), chr(10))[g.i] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i) g
), keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM lines
), shared AS (
  SELECT k, max(doc_id) AS max_id FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, shared.k IS NOT NULL AND keyed.doc_id <> shared.max_id AS gone FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
