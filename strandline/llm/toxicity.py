"""Operator 7: toxicity by Levenshtein automata over a lexicon trie.

The lexicon is learned from labelled rows: words, and stems (word beginnings)
for languages that compound, whose documents are mostly toxic.  The rows that it
is learned from are bounded by ``max_rows``, drawn by a hash of the id; a term
must occur in a fixed share of the toxic ones, which bounds the lexicon too.  All
counting is distributed; the driver sees lexicon entries and, to fit eight
weights, one short feature row per sampled document, in a fixed order, so that
the model does not depend on how the tables are partitioned.

Scoring walks each word once through the product of the lexicon's trie with a
Levenshtein automaton of one edit or one swap, in words and in stems, made deterministic as it is
needed.  Each hit is weighed in a window of words around it: inside quotation
marks or beside a reporting word it counts as quoted, else as direct.  A
logistic model over direct, misspelled and quoted hits gives the score.

The weights are fitted with lexicons of the *other* half of the rows, so that a
term does not vouch for the document that it was learned from.

Cases: words over 64 letters are never terms; null and empty texts have no words and get the score of a document
without hits; no labels at all give score 0 throughout; several labels of one id
count by their maximum; repeated rows each keep their row.  Inputs of a score are
the text only.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import bounded_batches, trim, worker_table, written

WORD = re.compile(r"[^\W_]+")
#: Lengths of the stems that are considered.
STEMS = (3, 4, 5, 6, 7, 8)
#: A term must be this long to match with an edit.
FUZZY_FROM = 5
#: Words on each side that are looked at.
WINDOW = 4
#: Words that report what somebody else said. Fixed values.
REPORTING = frozenset("said says say called calls call quoted quote wrote word term sagte sagt wort nannte dit mot dijo dice palabra".split())
#: Marks of quotations; apostrophes are none.
QUOTE = re.compile("[\"“”„«»‘]")
MAX_ROWS = 40_000
#: Longer words are no terms.
LONGEST = 64
#: Words whose match a worker remembers.
MEMO = 60_000
#: Features of a document; the last two need the length alone.
N_FEATURES = 8


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


# -- learning the lexicon ------------------------------------------------------------


def terms_of(text: str) -> set[str]:
    """Whole words as themselves, stems with a trailing star."""
    found = set()
    for word in set(WORD.findall(text.lower())):
        if len(word) >= 3:
            if len(word) <= LONGEST:
                found.add(word)
            found.update(f"{word[:k]}*" for k in STEMS if k < len(word))
    return found


def _counted(rows: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """``term, half, n``: in how many documents of each half a term occurs, summed per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, int]] = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], names=["term", "half", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text, half in zip(batch.column("text"), batch.column("half").to_pylist(), strict=True):
                found = terms_of(text.as_py() or "")
                counts.update((t, half) for t in (found if only is None else found & only))
                if len(counts) > 50_000:
                    yield flush()
        yield flush()

    return bounded_batches(rows.select("text", "half")).mapInArrow(run, "term string, half int, n long").groupBy("term", "half").agg(F.sum("n").alias("n"))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, max_rows: int) -> DataFrame:
    """At most about ``max_rows`` labelled rows outside the held-out fold: ``text, toxic, half``; copies of a text count once."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    total = usable.count()
    at = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1_000_000))
    chosen = usable.where(at < int(1_000_000 * min(1.0, max_rows / max(total, 1))))
    half = F.pmod(F.xxhash64(F.col(id_col), F.lit("half")), F.lit(2)).cast("int")
    marked = docs.select(id_col, "text").join(F.broadcast(chosen), id_col).select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"), half.alias("half"))
    return marked.groupBy("text", "toxic").agg(F.min("half").alias("half"))  # the least, so that a copy's half does not depend on the order of rows


def choose(n1: int, n0: int, total1: int, total0: int) -> float:
    """The weight of a term: its smoothed log ratio of document rates, 0 if it is not telling."""
    if n1 < 3 or total1 == 0:
        return 0.0
    ratio = math.log(((n1 + 0.5) / (total1 + 1)) / ((n0 + 0.5) / (total0 + 1)))
    return ratio if ratio >= 2.0 and n1 >= 2 * n0 else 0.0


def learn_lexicon(rows: DataFrame) -> dict[int, dict[str, float]]:
    """Three lexicons, term to weight: of half 0, of half 1, and of both (2)."""
    totals = Counter()
    for r in rows.groupBy("half", "toxic").count().collect():
        totals[r["half"], r["toxic"]] = r["count"]
    least = max(3, math.ceil(0.004 * (totals[0, 1] + totals[1, 1])))
    toxic = _counted(rows.where("toxic = 1"), None).groupBy("term").agg(F.sum(F.when(F.col("half") == 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("half") == 1, F.col("n")).otherwise(0)).alias("b"))
    # Terms of a fixed share of at most max_rows documents: their number is bounded by the sample.
    kept = sorted(toxic.where(F.col("a") + F.col("b") >= least).collect(), key=lambda r: r["term"])
    candidates = frozenset(r["term"] for r in kept)
    clean: Counter[tuple[str, int]] = Counter()
    for r in _counted(rows.where("toxic = 0"), candidates).collect():  # two rows for each candidate at most
        clean[r["term"], r["half"]] = r["n"]
    out: dict[int, dict[str, float]] = {}
    for which, halves in ((0, (0,)), (1, (1,)), (2, (0, 1))):
        total1, total0 = (sum(totals[h, t] for h in halves) for t in (1, 0))
        weights = {}
        for r in kept:
            n1, n0 = (r["a"], r["b"], r["a"] + r["b"])[which], sum(clean[r["term"], h] for h in halves)
            if weight := choose(n1, n0, total1, total0):
                weights[r["term"]] = weight
        short = _pruned(weights, {r["term"]: (r["a"], r["b"], r["a"] + r["b"])[which] for r in kept})
        out[which] = dict(sorted(short.items(), key=lambda x: (-x[1], x[0])))
    return out


def _pruned(weights: dict[str, float], counts: dict[str, int]) -> dict[str, float]:
    """Drop stems that one longer stem or word accounts for, then what a shorter stem that is left covers."""
    longest: dict[str, int] = {}
    for term, n in counts.items():
        letters = term.rstrip("*")
        for k in STEMS:
            if k < len(letters):
                stem = f"{letters[:k]}*"
                longest[stem] = max(longest.get(stem, 0), n)
    left = {t: w for t, w in weights.items() if not t.endswith("*") or longest.get(t, 0) < 0.9 * counts[t]}
    return {t: w for t, w in left.items() if not any(left.get(f"{t[:k]}*", 0) >= w - 1.0 for k in STEMS if k < len(t.rstrip("*")))}


# -- matching ----------------------------------------------------------------------


class Automaton:
    """The lexicon's trie times a Levenshtein automaton (one edit or swap), determinised lazily.

    A state is a set of ``(trie node, edits, expected)``; ``expected`` is the first
    letter of a swap whose second has been read.
    """

    #: Determinised states that are kept; beyond, the table starts anew.
    MAX_STATES = 20_000

    def __init__(self, lexicon: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[float] = [0.0]
        self.stem: list[float] = [0.0]
        self.depth: list[int] = [0]
        self.longest: list[int] = [0]  # of the terms below, for the rule on short terms
        for term, weight in lexicon.items():
            letters = term.rstrip("*")
            node, path = 0, [0]
            for c in letters:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(0.0)
                    self.stem.append(0.0)
                    self.depth.append(self.depth[node] + 1)
                    self.longest.append(0)
                node = self.children[node][c]
                path.append(node)
            if term.endswith("*"):
                self.stem[node] = weight
            else:
                self.word[node] = weight
            for x in path:
                self.longest[x] = max(self.longest[x], len(letters))
        self._reset()

    def _reset(self) -> None:
        start = frozenset(self._closed({(0, 0, "")}))
        self.ids: dict[frozenset, int] = {frozenset(): -1, start: 0}
        self.sets = [start]
        self.moves: list[dict[str, int]] = [{}]
        self.stems: list[tuple[float, float] | None] = [None]

    def _closed(self, states: set) -> set:
        """Add the states after leaving out one letter of a term."""
        more = {(child, 1, "") for node, edits, expected in states if not edits and not expected for child in self.children[node].values() if self.longest[child] >= FUZZY_FROM}
        return states | more

    def _step(self, states: frozenset, c: str) -> frozenset:
        found = set()
        for node, edits, expected in states:
            here = self.children[node]
            if expected:
                if c == expected[0]:
                    found.add((int(expected[1:]), 1, ""))
                continue
            if c in here:
                found.add((here[c], edits, ""))
            if not edits and self.longest[node] >= FUZZY_FROM:
                found.add((node, 1, ""))  # a letter too many
                for first, child in here.items():
                    if first != c and self.longest[child] >= FUZZY_FROM:
                        found.add((child, 1, ""))  # another letter
                        if c in self.children[child]:
                            found.add((node, 1, f"{first}{self.children[child][c]}"))  # two letters swapped
        return frozenset(self._closed(found))

    def match(self, word: str) -> tuple[float, int]:
        """``(weight, edits)`` of the best match of a lowered word; weight 0: none. An exact word or stem, then either with an edit."""
        state, stem, near = 0, 0.0, 0.0
        for c in word:
            moves = self.moves[state]
            following = moves.get(c)
            if following is None:
                reached = self._step(self.sets[state], c)
                following = self.ids.get(reached)
                if following is None:
                    if len(self.sets) >= self.MAX_STATES:
                        self._reset()
                        return self.match(word)
                    following = self.ids[reached] = len(self.sets)
                    self.sets.append(reached)
                    self.moves.append({})
                    self.stems.append(None)
                moves[c] = following
            if following < 0:
                return (near, 1) if near and not stem else (stem, 0)
            state = following
            if self.stems[state] is None:
                self.stems[state] = self._stems_at(state)
            reach, near_reach = self.stems[state]
            stem, near = max(stem, reach), max(near, near_reach)
        exact, fuzzy = 0.0, near
        for node, edits, expected in self.sets[state]:
            weight = 0.0 if expected else self.word[node]
            if weight and not edits:
                exact = max(exact, weight)
            elif weight and self.depth[node] >= FUZZY_FROM:
                fuzzy = max(fuzzy, weight)
        if exact or stem:
            return max(exact, stem), 0
        return (fuzzy, 1) if fuzzy and len(word) >= FUZZY_FROM - 1 else (0.0, 0)

    def _stems_at(self, state: int) -> tuple[float, float]:
        """The best stem that ends here, and the best long enough one that ends here with an edit."""
        best = near = 0.0
        for node, edits, expected in self.sets[state]:
            if not expected and not edits:
                best = max(best, self.stem[node])
            elif not expected and self.depth[node] >= FUZZY_FROM:
                near = max(near, self.stem[node])
        return best, near


class Marks:
    """Where a text's quotation marks and line feeds are."""

    def __init__(self, text: str):
        self.quotes = [m.start() for m in QUOTE.finditer(text)]
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    def around(self, start: int, end: int) -> bool:
        """Whether the span stands within a pair of quotation marks on its line: an odd number of marks before it and one after."""
        k = bisect.bisect_left(self.breaks, start)
        left = self.breaks[k - 1] if k else -1
        k = bisect.bisect_left(self.breaks, end)
        right = self.breaks[k] if k < len(self.breaks) else math.inf
        at = bisect.bisect_left(self.quotes, start)
        after = bisect.bisect_left(self.quotes, end)
        return (at - bisect.bisect_right(self.quotes, left)) % 2 == 1 and after < len(self.quotes) and self.quotes[after] < right


def quoted(marks: Marks, start: int, end: int, before: list[str], after: list[str]) -> bool:
    """Whether a hit is cited: within a pair of quotation marks on its line, or beside a reporting word."""
    return marks.around(start, end) or any(w in REPORTING for w in before) or any(w in REPORTING for w in after)


def features(text: str, automaton: Automaton, memo: dict[str, tuple[float, int]]) -> list[float]:
    lowered = text.lower()
    if len(lowered) != len(text):  # a letter that grows when lowered: offsets must hold
        text = lowered
    words = WORD.findall(lowered)
    known = memo.get
    hit: dict[str, tuple[float, int]] = {}
    for word in set(words):
        found = known(word)
        if found is None:
            found = automaton.match(word)
            if len(memo) < MEMO and len(word) <= LONGEST:
                memo[word] = found
        if found[0]:
            hit[word] = found
    direct = fuzzy = cited = 0
    total = best = 0.0
    if hit:
        marks = Marks(text)
        for i, m in enumerate(WORD.finditer(lowered)):
            if found := hit.get(m.group()):
                if quoted(marks, m.start(), m.end(), words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]):
                    cited += 1
                else:
                    direct += found[1] == 0
                    fuzzy += found[1]
                    total += found[0] * (0.5 if found[1] else 1.0)
                    best = max(best, found[0] * (0.5 if found[1] else 1.0))
    n = len(words)
    return [1.0, math.log1p(direct), math.log1p(fuzzy), math.log1p(cited), best, math.log1p(total), math.log1p(100 * total / (n + 20)), math.log1p(n)]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method with a ridge on all but the intercept."""
    w = np.zeros(x.shape[1])
    if not len(y) or not 0 < y.sum() < len(y):
        w[0] = -30.0 if not len(y) or not y.sum() else 30.0
        return w
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _automaton(lexicon: tuple[tuple[str, float], ...]) -> tuple[Automaton, dict]:
    return worker_table(("lexicon", lexicon), lambda: (Automaton(dict(lexicon)), {}))


class Model:
    """A fitted scorer; small enough to travel with the tasks."""

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray):
        self.lexicon, self.weights = lexicon, np.asarray(weights)

    def score(self, df: DataFrame, text_col: str = "text", out: str = "score") -> DataFrame:
        """Append the score (0 to 1) to every row."""
        from pyspark.sql import types as T

        base = df.drop(out)
        schema = T.StructType([*base.schema.fields, T.StructField(out, T.DoubleType())])
        names, at = [*base.columns, out], base.columns.index(text_col)
        held = df.sparkSession.sparkContext.broadcast((tuple(self.lexicon.items()), self.weights))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon, weights = held.value
            automaton, memo = _automaton(lexicon)
            for batch in batches:
                x = np.array([features(t.as_py() or "", automaton, memo) for t in batch.column(at)]).reshape(-1, N_FEATURES)
                scores = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=names)
            trim()

        return bounded_batches(base).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", max_rows: int = MAX_ROWS) -> Model:
    rows = written(_sample(docs, labels, id_col, max_rows), "toxicity-sample")
    lexicons = learn_lexicon(rows)
    held = docs.sparkSession.sparkContext.broadcast({h: tuple(lexicons[1 - h].items()) for h in (0, 1)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[]] * batch.num_rows
            halves = batch.column("half").to_pylist()
            both = worker_table(("halves", tuple(held.value.items())), lambda: [(Automaton(dict(held.value[h])), {}) for h in (0, 1)])
            for half, (automaton, memo) in enumerate(both):
                for k, text in enumerate(batch.column("text")):
                    if halves[k] == half:
                        found[k] = features(text.as_py() or "", automaton, memo)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "y"])
        trim()

    # At most max_rows short rows, in a fixed order: sums of floats depend on it.
    sample = sorted(bounded_batches(rows).mapInArrow(run, "x array<double>, y int").collect(), key=lambda r: (r["x"], r["y"]))
    x = np.array([r["x"] for r in sample]).reshape(-1, N_FEATURES)
    return Model(lexicons[2], fit(x, np.array([float(r["y"]) for r in sample])))


def op7_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", "text")
    scored = train(docs, labels).score(docs).drop("text")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_civil(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below one half, unchanged, repeated rows and null texts among them."""
    scored = train(documents.select("doc_id", "text"), labels).score(documents, out="__score")
    return scored.where(F.col("__score") < 0.5).drop("__score")
