"""Operator 2: quality rules as a bitmask ledger.

``measure`` takes every measurement once per text, ``ledger`` turns them into one
bit per failed rule.  A policy is a named, versioned set of rules; applying one,
or asking what it would keep without one of its rules, reads bits only and never
a text.  Everything is built of DataFrame functions and needs no shuffle but for
the one-row aggregate of an ablation.

Cases: a null or empty text has no words and fails ``few_words``; a word is
``[^\\x20\\x09-\\x0D]+``; repeated rows each keep their row; columns of the
input that bear an output's name are replaced, others are kept.  Windows are
compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import BLANKS, let

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits")


def rules() -> dict[str, Column]:
    """Rule names in the order of their bits, with the condition that fails them."""
    n = F.col("n_words")
    return {
        "few_words": n < 50,
        "repeated_windows": 100 * F.col("n_repeat_words") > 50 * n,
        "symbol_heavy": 10 * F.col("n_symbols") > 3 * n,
        "duplicate_lines": 10 * F.col("n_dup_lines") > 5 * F.col("n_lines"),
        "short_words": F.col("word_chars") < 2 * n,
        "long_words": F.col("word_chars") > 20 * n,
        "digit_heavy": 10 * F.col("n_digits") > 3 * F.col("word_chars"),
    }


#: Policies by name and version. Never edit one; add a version.
POLICIES: dict[str, tuple[str, ...]] = {
    "base/1": ("few_words", "repeated_windows"),
    "web/1": ("few_words", "repeated_windows", "symbol_heavy", "duplicate_lines", "short_words", "long_words", "digit_heavy"),
}
CURRENT = "web/1"


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that the text has twice or more, in O(n log n)."""

    def count(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("at")))

        def starts(s: Column) -> Column:
            again = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, k: again(x, k - 1) | again(x, k + 1)), lambda x: x["at"]))

        # Each start covers three words, less what the next start covers as well.
        def covered(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, b: a + b)

        return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(let(F.sort_array(windows), starts), covered))

    return let(words, count)


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Append the measurements (all long)."""
    base = df.drop(*MEASURES)
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0)
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    lined = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return base.withColumns({
        "__w": counted, "__l": lined,
        "word_chars": _without(text, BLANKS).cast("long"),
        "n_symbols": (F.length(text) - _without(text, SYMBOLS)).cast("long"),
        "n_digits": (F.length(text) - _without(text, "0123456789")).cast("long"),
    }).select(*base.columns, "__w.n_words", "word_chars", "n_symbols", "__l.n_dup_lines", "__w.n_repeat_words", "__l.n_lines", "n_digits")


def ledger(df: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Measurements and ``failures``: bit k is set if rule k fails."""
    measured = measure(df.drop("failures"), text_col)
    bits = [F.when(F.coalesce(failed, F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)) for k, failed in enumerate(rules().values())]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    out = measured.withColumn("failures", total.cast("long"))
    return out if keep_text else out.drop(text_col)


def mask(names: tuple[str, ...]) -> int:
    order = list(rules())
    return sum(1 << order.index(name) for name in names)


def apply_policy(entries: DataFrame, policy: str = CURRENT, out: str = "kept") -> DataFrame:
    """Append whether a ledger's entry passes the policy."""
    return entries.withColumn(out, F.col("failures").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0)


def ablation(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of the policy: entries that fail it, that fail it alone, and that the policy keeps without it."""
    names = POLICIES[policy]
    of = F.col("failures").bitwiseAND(F.lit(mask(names)))
    tallies = [F.struct(
        F.lit(name).alias("rule"),
        F.count_if(of.bitwiseAND(F.lit(mask((name,)))) != 0).alias("failed"),
        F.count_if(of == mask((name,))).alias("failed_alone"),
        F.count_if(of.bitwiseAND(F.lit(mask(tuple(x for x in names if x != name)))) == 0).alias("kept_without"),
    ) for name in names]
    return entries.agg(F.array(*tallies).alias("all")).select(F.explode("all").alias("x")).select("x.*")


def op2_quality_rules(documents: DataFrame) -> DataFrame:
    entries = apply_policy(apply_policy(ledger(documents.select("doc_id", "text")), "base/1", "base_ok"))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_ok")).alias("base_failed"), "kept", "failures")


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), m AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t
), wins AS (
  SELECT doc_id, g.i AS i, w[g.i] || ' ' || w[g.i + 1] || ' ' || w[g.i + 2] AS win
  FROM m, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i) g
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1
  ) GROUP BY doc_id
), r AS (
  SELECT m.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    len(ls) AS n_lines, length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS n_digits
  FROM m LEFT JOIN rep ON m.doc_id = rep.doc_id
), f AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
    + 8 * (10 * n_dup_lines > 5 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT
    + 64 * (10 * n_digits > 3 * word_chars)::INT AS BIGINT) AS failures FROM r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) > 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""
