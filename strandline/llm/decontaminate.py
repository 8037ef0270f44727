"""Operator 4: benchmark decontamination by a broadcast hash set of windows.

The benchmark's windows (``size`` consecutive words, or a shorter item whole)
form a table of distinct windows with their items.  It grows with the benchmark,
not with the corpus; a count decides whether it is broadcast, and beyond
``BROADCAST_WINDOWS`` the same join runs by a shuffle.  One scan emits the
documents' windows into the hash join, whose equality test on the words verifies
each hit; only hits leave the scan.  Hits are then gathered per document, which
has no more than its own positions.

Cases: null texts have no words and are clean; an item without words has no
window; windows that several items share count for each; repeated rows are looked
up together and each keep their row; a null id is an id of its own; further columns
are kept by ``remove_spans`` and ``drop_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import LOWER, UPPER, let, written

#: Windows up to which the set is broadcast (about 100 bytes each).
BROADCAST_WINDOWS = 1_000_000
#: Not part of a word; A-Z are none of these but are lowered first.
SEPARATORS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lowered words: every separator becomes a blank and the text is split there."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SEPARATORS + UPPER, " " * len(SEPARATORS) + LOWER)
    return F.array_remove(F.split(spaced, " "), "")


def _hash(w: Column, at: Column, size: int) -> Column:
    return F.when(at + size <= F.size(w), F.xxhash64(*(F.get(w, at + k) for k in range(size))))


def _text(w: Column, at: Column, size: Column | int) -> Column:
    return F.array_join(F.slice(w, at + 1, size), " ")


def _positions(df: DataFrame, *kept: str) -> DataFrame:
    """A row for each word position of the column ``w``, and one more at its end."""
    return df.select(*kept, "w", F.explode(F.sequence(F.lit(0), F.size("w"))).alias("at"))


def item_windows(benchmark: DataFrame, size: int = 10, id_col: str = "item_id") -> DataFrame:
    """``size, h, window, items``: each distinct window with its hash and the items that have it."""
    listed = benchmark.select(F.col(id_col).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = _positions(listed.withColumn("size", F.least(F.size("w"), F.lit(size))), "item", "size").where(F.col("at") + F.col("size") <= F.size("w"))
    w, i, n = F.col("w"), F.col("at"), F.col("size")
    h = F.coalesce(*(F.when(n == k, _hash(w, i, k)) for k in range(1, size + 1)))
    return at.select("item", "size", h.alias("h"), _text(w, i, n).alias("window")).groupBy("size", "h", "window").agg(F.collect_set("item").alias("items"))


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", size: int = 10) -> DataFrame:
    """``id, mark, n_words, copies, hits array<struct<at, size>>, items`` for each distinct document, in one scan.

    Every position is hashed and looked up; a hit counts once its words are equal.
    """
    windows = written(item_windows(benchmark, size), "windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # no more than ``size`` numbers
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("mark"), words(F.col("text")).alias("w"))
    rows = _positions(named, "id", "mark")
    w, at = F.col("w"), F.col("at")
    if len(sizes) == 1:
        rows = rows.withColumn("h", _hash(w, at, sizes[0]))
    else:
        rows = rows.withColumn("h", F.explode(F.array(*(_hash(w, at, n) for n in sizes)) if sizes else F.array(F.lit(None).cast("long"))))
    if windows.count() <= BROADCAST_WINDOWS:
        found = rows.join(F.broadcast(windows), "h", "left").where((at == F.size(w)) | (_text(w, at, F.col("size")) == F.col("window")))
        found = found.select("id", "mark", "at", F.size(w).alias("n"), "size", "items")
        copies = F.count_if(at == F.col("n")) / max(len(sizes), 1)  # the end of a text comes once for each size
    else:  # texts stay where they are: positions meet windows by hash, and hits meet their text again
        met = rows.where(F.col("h").isNotNull()).select("id", "mark", "at", "h").join(windows, "h").drop("h").dropDuplicates(["id", "mark", "at", "size", "window"])
        same = named.alias("d").join(met.alias("m"), F.col("d.id").eqNullSafe(F.col("m.id")) & F.col("d.mark").eqNullSafe(F.col("m.mark")), "left")
        found = same.select("d.id", "d.mark", F.coalesce("at", F.lit(-1)).alias("at"), F.size(w).alias("n"), F.when(_text(w, at, F.col("size")) == F.col("window"), F.col("size")).alias("size"), "items", F.struct("at", "window").alias("place"))
        copies = F.count("*") / F.size(F.collect_set("place"))  # each row has met each place once
    hit = F.col("size").isNotNull() & (at < F.col("n"))
    return found.groupBy("id", "mark").agg(
        F.max("n").cast("long").alias("n_words"),
        copies.cast("int").alias("copies"),
        F.collect_set(F.when(hit, F.struct("at", "size"))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("items"))))).alias("items"),
    )


def covered(hits: Column) -> Column:
    """How many positions the hits cover."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        F.array_sort(hits), zero,
        lambda s, x: F.struct((s.n + F.greatest(F.lit(0), x.at + x["size"] - F.greatest(s.end, x.at))).alias("n"), F.greatest(s.end, x.at + x["size"]).alias("end")),
        lambda s: s.n.cast("long"),
    )


def _with_hits(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    d = docs.withColumn("__mark", F.xxhash64("text")).alias("d")
    return d.join(found.alias("h"), F.col(f"d.{id_col}").eqNullSafe(F.col("h.id")) & (F.col("d.__mark") == F.col("h.mark")), "left")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", size: int = 10) -> DataFrame:
    """``id_col, n_words, n_hit, items`` for each document."""
    found = find_hits(docs, benchmark, id_col, size)
    judged = found.select(F.col("id").alias(id_col), "n_words", covered(F.col("hits")).alias("n_hit"), "items", "copies")
    return judged.withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copies")


def drop_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", size: int = 10) -> DataFrame:
    """The rows without any hit, unchanged."""
    found = find_hits(docs, benchmark, id_col, size).where(F.size("hits") > 0).select("id", "mark")
    d = docs.withColumn("__mark", F.xxhash64("text"))
    return d.join(found, d[id_col].eqNullSafe(found["id"]) & (d["__mark"] == found["mark"]), "left_anti").drop("__mark")


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", size: int = 10) -> DataFrame:
    """All rows; in those with hits the words that are hit are cut, each with the separators before it."""
    found = find_hits(docs, benchmark, id_col, size).where(F.size("hits") > 0)
    base = docs.drop("clean_text")
    pieces = F.regexp_extract_all(F.col("d.text"), F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*" + WORD_ANY_CASE), F.lit(0))
    tail = F.regexp_extract(F.col("d.text"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z", 0)
    gone = F.array_distinct(F.flatten(F.transform("h.hits", lambda h: F.sequence(h.at, h.at + h["size"] - 1))))
    clean = let(F.struct(pieces.alias("p"), gone.alias("g")), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x.p) - 1), x.g), lambda i: x.p[i]), ""))
    return _with_hits(base, found, id_col).select(*(F.col(f"d.{c}") for c in base.columns), F.when(F.col("h.hits").isNull(), F.col("d.text")).otherwise(F.concat(clean, tail)).alias("clean_text"))


def op4_decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(documents.select("doc_id", "text"), benchmark)
    listed = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[g.i : g.i + least(len(w), 10) - 1], ' ') AS win
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i) g WHERE len(w) > 0
), sizes AS (
  SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, n, g.i AS i, array_to_string(w[g.i : g.i + n - 1], ' ') AS win
  FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) g WHERE len(w) >= n
), hits AS (
  SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
