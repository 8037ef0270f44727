"""Operator 6: secret scans with a randomness test battery.

Fixed patterns give the base spans.  Further candidates are all runs of at least
``MIN_LENGTH`` key-like characters that hold a letter.  Each gets an inferred
encoding, the smallest alphabet that holds it, and three tests against draws that
are uniform over it: chi-squared of the character counts, a runs test about the
alphabet's middle, and lag-1 serial correlation.  A candidate that one of them
rejects at ``ALPHA`` (shared among the three) is no random key.

The other hypothesis is that a candidate is made as the corpus' words are: a
bigram model of all key-like characters outside candidates and base spans, letters
in either case (sums over all documents, of a fixed size), and a pattern of cases.  The likelihood ratio against the uniform
draw bounds a p-value: words reach a ratio of r with a probability of 1 / r at
most, so evidence grows with the length and has no ceiling.  Benjamini-Hochberg
per length class, on a histogram of fixed size, bounds the false discoveries.
One scan reads the texts; all later steps read what it found.

Cases: a null text is empty; repeated rows each keep their row; candidates that
touch a base span are dropped, base spans always stay; offsets are code points,
ends exclusive; without any text outside candidates the model is uniform over all
characters and little is flagged.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import bounded_batches, trim, written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_LENGTH = 16
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}")
LETTER = re.compile(r"[A-Za-z]")
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets from the smallest on; the first that holds a token is its own.
ENCODINGS = (
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), _DIGITS + "abcdef"),
    ("lower", re.compile(r"[a-z]+"), _LOWER),
    ("upper", re.compile(r"[A-Z]+"), _UPPER),
    ("base32", re.compile(r"[A-Z2-7]+"), _UPPER + "234567"),
    ("lower36", re.compile(r"[a-z0-9]+"), _DIGITS + _LOWER),
    ("upper36", re.compile(r"[A-Z0-9]+"), _DIGITS + _UPPER),
    ("letters", re.compile(r"[A-Za-z]+"), _UPPER + _LOWER),
    ("alphanumeric", re.compile(r"[A-Za-z0-9]+"), _DIGITS + _UPPER + _LOWER),
    ("base64", re.compile(r".+", re.DOTALL), _UPPER + _LOWER + _DIGITS + "+/"),
)
#: The chance that the battery rejects a random key, in all.
ALPHA = 0.005
#: Characters of the word model, letters in either case, and the share of its probability that is spread evenly.
SYMBOLS = _LOWER + _DIGITS + "+/_-="
EVEN = 0.05
#: Code points that are counted at once, so that a very long text needs bounded memory.
PART = 1 << 18
#: The share of false discoveries that is allowed.
Q = 0.01
#: Histogram of -log10 p: steps per unit, and the last step.
STEPS, LAST = 10, 400
_CODE = np.full(129, -1, dtype=np.int32)
for _i, _c in enumerate(SYMBOLS):
    _CODE[ord(_c)] = _CODE[ord(_c.upper())] = _i
_OF = {c: i for i, c in enumerate(SYMBOLS)}


def encoding(token: str) -> tuple[str, str]:
    for name, pattern, alphabet in ENCODINGS:
        if pattern.fullmatch(token):
            return name, alphabet
    raise AssertionError("the last pattern fits all")


def _bare(token: str) -> str:
    return token.rstrip("=") or token


def battery(token: str) -> tuple[float, float, float]:
    """P-values of the chi-squared, runs and serial tests, if the token is uniform over its alphabet."""
    token = _bare(token)
    name, alphabet = encoding(token)
    index = {c: i for i, c in enumerate(alphabet)}
    plain = token.lower() if name == "hex" else token.replace("-", "+").replace("_", "/")
    values = [index.get(c, len(alphabet) - 1) for c in plain]
    n, a = len(values), len(alphabet)
    counts: dict[int, int] = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    chi2 = sum(c * c for c in counts.values()) * a / n - n
    # A gamma variable with the moments of Pearson's statistic for n draws, made normal by its cube root.
    mean, var = a - 1, max(2 * (a - 1) * (n - 1) / n, 1e-9)
    shape = mean * mean / var
    z_chi = (max(chi2, 0.0) / mean) ** (1 / 3) * 3 * math.sqrt(shape) - (1 - 1 / (9 * shape)) * 3 * math.sqrt(shape)
    high = [2 * v >= a for v in values]
    ups = sum(high)
    runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
    # The runs of n fair draws: 1 + a binomial of n - 1 halves.
    z_runs = max(0.0, abs(runs - (n + 1) / 2) - 0.5) / (math.sqrt(n - 1) / 2) if n > 1 and 0 < ups < n else math.sqrt(n)
    middle = sum(values) / n
    total = sum((v - middle) ** 2 for v in values)
    serial = sum((x - middle) * (y - middle) for x, y in zip(values, values[1:], strict=False))
    z_serial = (serial / total + 1 / n) * math.sqrt(n) if total else math.sqrt(n)
    return math.erfc(z_chi / math.sqrt(2)) / 2, math.erfc(z_runs / math.sqrt(2)), math.erfc(abs(z_serial) / math.sqrt(2))


def looks_random(token: str) -> bool:
    return 3 * min(battery(token)) >= ALPHA


def word_model(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural logarithms of the first and of the next character's probability, from bigram counts."""
    k = len(SYMBOLS)
    counts = np.asarray(counts, dtype=float).reshape(k, k)
    first = (counts.sum(axis=1) + 1) / (counts.sum() + k)
    following = (counts + k * first[None, :]) / (counts.sum(axis=1, keepdims=True) + k)
    return np.log((1 - EVEN) * first + EVEN / k), np.log((1 - EVEN) * following + EVEN / k)


def _case(token: str) -> float:
    """The natural logarithm of the probability of the letters' cases, each told by the one before, learned within the token (Krichevsky-Trofimov)."""
    seen, before, total = {}, None, 0.0
    for upper in (c.isupper() for c in token if c.isalpha()):
        same, all_ = seen.get((before, upper), 0), seen.get(before, 0)
        total += math.log((same + 0.5) / (all_ + 1))
        seen[before, upper], seen[before], before = same + 1, all_ + 1, upper
    return total


def level(token: str, model: tuple[np.ndarray, np.ndarray]) -> float:
    """-log10 of the bound on the chance that a word-like token is as random as this one."""
    token = _bare(token)
    at = [_OF[c] for c in token.lower()]
    words = model[0][at[0]] + model[1][at[:-1], at[1:]].sum() + _case(token)
    ratio = -len(at) * math.log(len(encoding(token)[1])) - words
    return max(0.0, (ratio - math.log(len(ENCODINGS))) / math.log(10))  # the alphabet was chosen


def length_class(n: int) -> int:
    """Length classes: 16-22, 23-31, 32-45, 46-63 and so on, at most 20."""
    k = int(2 * math.log2(n / MIN_LENGTH))
    return min(k, 19)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def bigrams(text: str, without: list[tuple[int, int]]) -> np.ndarray:
    """Counts of neighbouring key-like characters outside the given spans."""
    k, counts, last = len(SYMBOLS), np.zeros(len(SYMBOLS) ** 2, dtype=np.int64), -1
    for at in range(0, len(text), PART):
        codes = _CODE[np.minimum(np.frombuffer(text[at : at + PART].encode("utf-32-le", "surrogatepass"), dtype="<u4"), 128)]
        for start, end in without:
            if start < at + PART and end > at:
                codes[max(0, start - at) : end - at] = -1
        codes = np.concatenate(([last], codes))
        last = codes[-1]
        pairs = codes[:-1] * k + codes[1:]
        counts += np.bincount(pairs[(codes[:-1] >= 0) & (codes[1:] >= 0)], minlength=k * k)
    return counts


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans and candidates."""
    base = base_spans(text)
    runs = [m.span() for m in RUN.finditer(text) if LETTER.search(m.group())]
    return base, [(a, b) for a, b in runs if not any(start < b and a < end for start, _, end in base)]


_SPAN = "array<struct<start:int,kind:int,end:int>>"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, base, candidates, bigrams``: one row per row, with null bigrams, and one further row per task that has only these."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    candidate = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("token", pa.string()), ("random", pa.bool_())]))
    sums = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, names, id_type = np.zeros(len(SYMBOLS) ** 2, dtype=np.int64), ["id", "base", "candidates", "bigrams"], None
        for batch in batches:
            id_type, bases, candidates = batch.column(0).type, [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base, runs = scan_text(text)
                bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                candidates.append([{"start": s, "end": e, "token": text[s:e], "random": looks_random(text[s:e])} for s, e in runs])
                total += bigrams(text, [(s, e) for s, _, e in base] + runs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, span), pa.array(candidates, candidate), pa.nulls(batch.num_rows, sums)], names=names)
        if id_type is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.array([[]], span), pa.array([[]], candidate), pa.array([total], sums)], names=names)
        trim()

    return bounded_batches(src).mapInArrow(run, f"id {kind.simpleString()}, base {_SPAN}, candidates array<struct<start:int,end:int,token:string,random:boolean>>, bigrams array<long>")


def levels(found: DataFrame) -> DataFrame:
    """What ``scan`` returns to ``id, base, candidates``, these with their length class and step of -log10 p; what the battery rejects has step 0."""
    sums = found.where("bigrams IS NOT NULL").select(F.posexplode("bigrams").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()  # a fixed number of rows
    counts = np.zeros(len(SYMBOLS) ** 2)
    for r in sums:
        counts[r["at"]] = r["n"]
    model = word_model(counts)
    candidate = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("class", pa.int32()), ("step", pa.int32())]))

    def judged(c: dict) -> dict:
        step = min(LAST, math.floor(level(c["token"], model) * STEPS)) if c["random"] else 0
        return {"start": c["start"], "end": c["end"], "class": length_class(c["end"] - c["start"]), "step": step}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[judged(c) for c in row] for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, candidate)], names=["id", "base", "candidates"])

    rows = found.where("bigrams IS NULL").select("id", "base", "candidates")
    return bounded_batches(rows).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, base {_SPAN}, candidates array<struct<start:int,end:int,class:int,step:int>>")


def cuts(judged: DataFrame, q: float = Q) -> dict[int, int]:
    """Per length class the least step that is a discovery (Benjamini-Hochberg); a table of fixed size, whatever the corpus."""
    steps = judged.select(F.explode("candidates").alias("c")).groupBy("c.class", "c.step").count().collect()
    found = {}
    for k in {r["class"] for r in steps}:
        ordered = sorted(((r["step"], r["count"]) for r in steps if r["class"] == k), reverse=True)
        total, seen = sum(c for _, c in ordered), 0
        for step, count in ordered:
            seen += count
            if 10 ** (-step / STEPS) * total <= q * seen:
                found[k] = step
    return found


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = Q) -> DataFrame:
    """``id_col, base, spans``: arrays of ``(start, kind, end)``, ``kind`` an index of ``KINDS``."""
    judged = written(levels(written(scan(df, id_col, text_col), "secrets")), "secret-levels")
    least = cuts(judged, q)
    floor = F.create_map(*(F.lit(x) for k in range(20) for x in (k, least.get(k, LAST + 1))))
    more = F.transform(
        F.filter("candidates", lambda c: c["step"] >= floor[c["class"]]),
        lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")),
    )
    return judged.select(F.col("id").alias(id_col), "base", F.sort_array(F.concat("base", more)).alias("spans"))


def spelled(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")


def op6_secrets(documents: DataFrame) -> DataFrame:
    found = find_secrets(documents)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
