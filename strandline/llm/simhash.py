"""Operator 5: SimHash near-duplicates by pigeonhole blocks.

Each document gets a 64-bit fingerprint of its word shingles.  Equal
fingerprints are folded first.  The fingerprint is split into ``2 * bits``
blocks; two fingerprints that differ in at most ``bits`` bits agree on at least
``bits`` whole blocks, so each fingerprint is filed under every choice of
``bits`` blocks and partners meet under one of these keys (for 3 bits: 20 keys
of 31 to 33 bits, few enough chance meetings at billions of fingerprints).

A key with two fingerprints is verified at once.  A key with more is dealt into
cells of bounded size (its members in chunks, one cell for each pair of chunks);
a cell compares its members with vector instructions and returns a spanning
forest of its links, never all pairs.  Links then go through ``components``.

``near_duplicates`` links at a few differing bits.  ``keep_first`` links by the
similarity of shingle sets: candidates by prefix filtering, which holds every pair
at the bound, and each checked on the sets.  Given ``bits`` it links fingerprints
first, as ``near_duplicates`` does, and sets only where these leave texts apart.

Cases: a null or empty text, or one of blanks only, has fingerprint zero and
links like any other; fewer words than a shingle form one shingle; repeated rows
each keep their row; further columns are kept and clashing ones are replaced.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import bounded_batches, drop_path, release_tables, trim, written
from strandline.llm.components import components

SEED = 42
#: Shingles whose bits are counted at once, so that a very long text needs bounded memory.
STEP = 1 << 15
#: Members of a chunk; a cell holds two chunks at most.
CHUNK = 2048
#: Sets of a chunk that share a shingle; sets of it that the others are compared with first.
LONG_CHUNK = 2048
CENTRES = 3
#: Columns of a set's parity map.
MAP = ("b0", "b1", "b2", "b3")
#: Columns of the shingles that stand just before one in a prefix.
LAST = ("last1", "last2")
#: Rounding must not lose a pair at the bound itself.
SLACK = 1e-6
#: The sample that tells common shingles: its rows and share at least; sets that hold a common one; how many are kept.
SAMPLE_ROWS, SAMPLE_SHARE = 20_000, 0.2
COMMON_FROM, MAX_COMMON = 8, 200_000
#: Keys up to which they are broadcast.
BROADCAST_KEYS = 1_000_000


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z, only [\x20\x09-\x0D]
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(words_per_shingle)), strict=False))
        n = len(words) - words_per_shingle + 1
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    while part := [digest(s, SEED) for s in itertools.islice(shingles, STEP)]:
        ones += np.unpackbits(np.array(part, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def with_fingerprints(df: DataFrame, text_col: str = "text", words_per_shingle: int = 3, out: str = "fingerprint", keep_text: bool = False) -> DataFrame:
    """Append the fingerprint as a long; the text itself goes unless ``keep_text``."""
    base = df.drop(out)
    kept = [c for c in base.columns if keep_text or c != text_col]
    schema = T.StructType([*(base.schema[c] for c in kept), T.StructField(out, T.LongType())])
    names = [*kept, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        for batch in batches:
            prints = [fingerprint(t.as_py(), words_per_shingle) for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(prints, pa.int64())], names=names)
        trim()

    return bounded_batches(base).mapInArrow(run, schema)


def block_masks(bits: int) -> list[int]:
    """For each choice of ``bits`` of ``2 * bits`` blocks, their mask as a signed 64-bit integer."""
    n = 2 * bits
    edges = [64 * k // n for k in range(n + 1)]
    blocks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(n)]
    masks = [sum(choice) for choice in itertools.combinations(blocks, bits)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def cell_forest(members: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Star edges (member, least member) of each group that links of at most ``bits`` bits join."""
    left = np.unique(members.astype(np.int64)).view(np.uint64)
    edges = []
    while left.size:
        root, left = left[0], left[1:]
        frontier, found = [root], []
        while frontier and left.size:
            near = np.bitwise_count(left ^ frontier.pop()) <= bits
            if near.any():
                hits = left[near]
                left = left[~near]
                frontier += list(hits)
                found += list(hits)
        edges += [(int(x.view(np.int64)), int(root.view(np.int64))) for x in found]
    return edges


def links(prints: DataFrame, bits: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Distinct fingerprints (column ``fp``) to edges ``(u, v)`` that join all that link."""
    filed = prints.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks(bits)))).alias("choice", "block"))
    met = filed.groupBy("choice", "block").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits
    pairs = met.where((F.col("n") == 2) & near).select("u", "v")
    many = met.where("n > 2").select("choice", "block", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    dealt = (
        filed.join(many, ["choice", "block"])
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .groupBy("choice", "block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .agg(F.collect_list("fp").alias("members"))
        .where(F.size("members") > 1)
        .select("members")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [e for m in batch.column(0) for e in cell_forest(m.values.to_numpy(zero_copy_only=False), bits)]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())], names=["u", "v"])

    return pairs.union(dealt.mapInArrow(run, "u long, v long"))


def _grouped(df: DataFrame, id_col: str, text_col: str, words_per_shingle: int, bits: int) -> DataFrame:
    """``id, mark, fingerprint, component (a fingerprint), component_id`` for every row; ``mark`` is a hash of the text."""
    named = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    prints = written(with_fingerprints(named, "text", words_per_shingle), "prints")
    folded = prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("id").alias("first"))
    groups = components(links(folded.select("fp"), bits))
    least = folded.join(groups, F.col("fp") == F.col("node")).groupBy("component").agg(F.min("first").alias("component_id"))
    joined = groups.join(least, "component").select(F.col("node").alias("fingerprint"), "component", "component_id")
    alone = folded.join(groups, F.col("fp") == F.col("node"), "left_anti").select(F.col("fp").alias("fingerprint"), F.col("fp").alias("component"), F.col("first").alias("component_id"))
    return prints.join(joined.union(alone), "fingerprint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, bits: int = 3) -> DataFrame:
    """``id_col, fingerprint (long), component_id``: one row per input row; the component's least id, null if it has none."""
    found = _grouped(df, id_col, text_col, words_per_shingle, bits)
    return found.select(F.col("id").alias(id_col), "fingerprint", "component_id")


def hex_fingerprint(column="fingerprint"):
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def op5_simhash(documents: DataFrame) -> DataFrame:
    found = near_duplicates(documents)
    return found.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


# -- near copies by similarity ---------------------------------------------------------


def shingle_set(text: str | None, words_per_shingle: int = 5) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, in order."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    k = min(words_per_shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)), dtype=np.uint64, count=len(words) - k + 1))


def prefix_length(n: int, similarity: float) -> int:
    """Of two sets this similar or more, the first so many members of each, in any common order, share one."""
    return n - math.ceil(similarity * n - SLACK) + 1 if n else 0


def _folded(named: DataFrame, words_per_shingle: int, words_per_print: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``id, mark, fp, fingerprint`` of each row, ``fp`` a 128-bit hash of its set; ``fp, node`` and ``node, hashes`` of each distinct set; all stored.

    ``fingerprint`` is null if no ``words_per_print`` are given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables()
        for batch in batches:
            found = [shingle_set(t.as_py(), words_per_shingle) for t in batch.column("text")]
            prints = [xxhash.xxh3_128_digest(s.astype("<u8").tobytes(), SEED) for s in found]
            bits = pa.array([words_per_print and fingerprint(t.as_py(), words_per_print) for t in batch.column("text")], pa.int64())
            hashes = pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(prints, pa.binary()), bits, hashes], names=["id", "mark", "fp", "fingerprint", "hashes"])
        trim()

    schema = T.StructType([named.schema["id"], named.schema["mark"], T.StructField("fp", T.BinaryType()), T.StructField("fingerprint", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType()))])
    rows = written(bounded_batches(named).mapInArrow(run, schema).withColumn("node", F.monotonically_increasing_id()), "shingle-sets")
    prints = written(rows.select("id", "mark", "fp", "fingerprint"), "prints")
    nodes = written(rows.groupBy("fp").agg(F.min("node").alias("node")), "nodes")
    repeats = written(rows.select("fp", "node").join(nodes.select("fp", F.col("node").alias("first")), "fp").where("node <> first").select("node"), "repeats")
    sets = rows.select("node", "hashes").join(_small(repeats), "node", "left_anti")
    return prints, nodes, sets


def _print_links(prints: DataFrame, nodes: DataFrame, bits: int) -> DataFrame:
    """Edges ``(u, v)`` of nodes that join all whose fingerprints are equal or link; stored."""
    own = written(prints.select("fp", "fingerprint").distinct().join(nodes, "fp").select("fingerprint", "node"), "node-prints")
    folded = written(own.groupBy("fingerprint").agg(F.min("node").alias("first"), F.count("*").alias("n")), "folded-prints")
    equal = own.join(_small(folded.where("n > 1")), "fingerprint").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    found = written(links(folded.select(F.col("fingerprint").alias("fp")), bits).distinct(), "print-links").toDF("x", "y")
    firsts = folded.select("fingerprint", "first")
    return written(equal.union(found.join(firsts.toDF("x", "u"), "x").join(firsts.toDF("y", "v"), "y").select("u", "v")), "node-links")


def _small(keys: DataFrame) -> DataFrame:
    """Stored keys, to be broadcast if a count shows that they are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def common_shingles(sets: DataFrame) -> np.ndarray:
    """Hashes that many sets of a sample hold, sorted. They only come last in the order of shingles, so the sample decides on cost and never on a result."""
    total = sets.count()
    share = max(SAMPLE_SHARE, min(1.0, SAMPLE_ROWS / max(total, 1)))
    drawn = sets.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < int(1_000_000 * share))
    counted = written(drawn.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_FROM), "common-shingles")
    least = COMMON_FROM
    while counted.where(F.col("n") >= least).count() > MAX_COMMON:
        least *= 2
    return np.sort(np.array([r["h"] for r in counted.where(F.col("n") >= least).select("h").collect()], dtype=np.int64))


def parity_map(members: np.ndarray) -> np.ndarray:
    """256 bits as four integers: each tells whether an odd number of members falls on it."""
    return np.packbits(np.bincount(members & 255, minlength=256) & 1).view(np.int64)


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """``node, hashes`` to ``node, size, b0, b1, b2, b3, prefix``: a parity map of the set, and the prefix in the order of shingles, by hash, common ones last."""
    common = sets.sparkSession.sparkContext.broadcast(common_shingles(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = common.value
        for batch in batches:
            sizes, maps, firsts = [], [], []
            for members in batch.column("hashes"):
                own = members.values.to_numpy(zero_copy_only=False)
                found = np.searchsorted(last, own)
                is_last = last[np.minimum(found, len(last) - 1)] == own if len(last) else np.zeros(len(own), dtype=bool)
                sizes.append(len(own))
                maps.append(parity_map(own))
                firsts.append(own[np.lexsort((own, is_last))[: prefix_length(len(own), similarity)]])
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sizes, pa.int32()), *(pa.array([m[k] for m in maps], pa.int64()) for k in range(len(MAP))), pa.array(firsts, pa.list_(pa.int64()))], names=["node", "size", *MAP, "prefix"])
        trim()

    return bounded_batches(sets.select("node", "hashes")).mapInArrow(run, f"node long, size int, {', '.join(f'{b} long' for b in MAP)}, prefix array<long>")


def _may_link(a: str, b: str, similarity: float) -> Column:
    """Whether sizes, the places of a shared shingle and the parity maps admit the similarity; true for the first shingle that similar sets share.

    Maps differ in at most as many bits as the sets differ in members.
    """
    size, other, at, place = (F.col(f"{x}.{c}") for c in ("size", "at") for x in (a, b))
    least = similarity / (1 + similarity) * (size + other)
    apart = sum((F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in MAP), F.lit(0))
    near = apart <= (1 - similarity) / (1 + similarity) * (size + other) + SLACK
    return (F.least(size, other) >= similarity * F.greatest(size, other) - SLACK) & (1 + F.least(size - at, other - place) >= least - SLACK) & near


def _met_before(a: str, b: str) -> Column:
    """Whether one of the shingles just before is shared too: then the pair meets there, or before."""
    return F.coalesce(reduce(Column.__or__, (F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{y}")) & F.col(f"{a}.{x}").isNotNull() for x in LAST for y in LAST)), F.lit(False))


def _paired(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """The pairs ``(u, v)``, each with the two rows ``a`` and ``b`` of the table; only rows that are asked for move."""
    needed = written(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "paired-nodes")
    own = written(table.join(_small(needed), "node", "left_semi"), "paired-rows").select("node", F.struct(*table.columns).alias("x"))
    return pairs.join(own.toDF("u", "a"), "u").join(own.toDF("v", "b"), "v")


def verified(pairs: DataFrame, firsts: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``(u, v)`` whose sets are as similar as ``similarity``.

    Similar sets differ in few members, so the prefix that ends first is shared but for
    these; a pair that falls short of that is out before whole sets are compared.
    """
    met = _paired(written(pairs.distinct(), "pairs"), firsts)
    least = F.ceil(similarity / (1 + similarity) * (F.col("a.size") + F.col("b.size")) - SLACK)
    share = F.least(F.size("a.prefix") - F.col("a.size"), F.size("b.prefix") - F.col("b.size")) + least
    likely = written(met.where(F.size(F.array_intersect("a.prefix", "b.prefix")) >= share).select("u", "v"), "likely-pairs")
    both = F.size(F.array_intersect("a.hashes", "b.hashes"))
    known = _paired(likely, sets).select("u", "v", both.alias("both"), (F.size("a.hashes") + F.size("b.hashes") - both).alias("either"))
    return known.where(F.col("both") >= F.lit(similarity) * F.col("either")).select("u", "v")


def similar(sets: DataFrame, similarity: float, linked: DataFrame | None = None) -> DataFrame:
    """``node, hashes`` (distinct sets) to ``node, component`` by all links of this similarity or more, and by the edges ``linked`` (``u, v``); nodes without a link are left out.

    Sets this similar share a member of their prefixes, so no link is lost.  A shingle
    of two sets gives a pair.  One of more first gives pairs with a few of its sets,
    which join what is near; then every pair that is not in one component yet.
    """
    firsts = written(prefixes(sets, similarity), "prefixes")
    placed = firsts.select("node", "size", *MAP, "prefix", F.posexplode("prefix").alias("before", "h"))
    filed = placed.select("h", "node", "size", *MAP, (F.col("before") + 1).alias("at"), *(F.get("prefix", F.col("before") - k - 1).alias(c) for k, c in enumerate(LAST)))
    row, ends = F.struct("node", "size", "at", *MAP), (F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v"))
    met = filed.groupBy("h").agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for c in ("node", "size") for f in (F.min, F.max)))
    met = written(met.where("n > 1"), "met")
    twos = met.where((F.col("n") == 2) & (F.col("min_size") >= similarity * F.col("max_size") - SLACK)).select(F.col("min_node").alias("u"), F.col("max_node").alias("v"))
    hot = written(filed.join(_small(met.where("n > 2").select("h", "n")), "h"), "shared-prefixes")
    centres = hot.groupBy("h").agg(*(F.min_by(row, F.xxhash64("node", F.lit(k))).alias(f"c{k}") for k in range(CENTRES)))
    stars = hot.select("h", row.alias("a")).join(centres, "h").select("a", F.explode(F.array(*(f"c{k}" for k in range(CENTRES)))).alias("b"))
    near = verified(twos.union(stars.where((F.col("a.node") != F.col("b.node")) & _may_link("a", "b", similarity)).select(*ends)), firsts, sets, similarity)
    near = written(near if linked is None else near.union(linked), "links")
    groups = written(components(near), "groups")
    placed = hot.join(groups, "node", "left").select("h", "n", "node", "size", "at", *MAP, *LAST, F.coalesce("component", "node").alias("component"))
    # Every set meets every other once: those of a shingle are dealt into chunks, and each two chunks meet.
    mixed = placed.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("h")
    chunks = F.ceil(F.col("n") / LONG_CHUNK).cast("int")
    open_ = written(placed.join(mixed, "h", "left_semi").withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")), "open-prefixes")
    dealt = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    a, b = dealt.alias("a"), dealt.alias("b")
    meet = (F.col("a.h") == F.col("b.h")) & (F.col("a.own") == F.col("b.other")) & (F.col("a.other") == F.col("b.own")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component"))
    rest = a.join(b, meet & _may_link("a", "b", similarity) & ~_met_before("a", "b")).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    return components(near.union(verified(rest, firsts, sets, similarity)))


def keep_first(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, similarity: float = 0.8, bits: int | None = None, words_per_print: int = 3) -> DataFrame:
    """One document of each group of near copies stays: that with the least id, nulls last; of rows with one id and text, one.

    Copies are texts whose sets of distinct shingles have a Jaccard similarity of
    ``similarity`` or more, and what a chain of these joins.  All such pairs are found
    and each is checked on the sets themselves.  With ``bits``, texts whose fingerprints
    of ``words_per_print`` words link at so many bits are copies too, whatever their sets.
    The texts move once: both joins and the repeats use the same keys.
    """
    named = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    prints, nodes, sets = _folded(named, words_per_shingle, None if bits is None else words_per_print)
    groups = similar(sets, similarity, None if bits is None else _print_links(prints, nodes, bits))
    for path in {f.rsplit("/", 1)[0] for f in sets.inputFiles() if "/shingle-sets-" in f}:  # large, and the texts move next
        drop_path(documents.sparkSession, path)
    placed = nodes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    keyed = lambda df, of: df.withColumns({"__id": F.coalesce(F.col(of), F.lit(0).cast(df.schema[of].dataType)), "__none": F.col(of).isNull()})
    least = prints.join(placed, "fp").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("x")).select("x.id", F.col("x.mark").alias("__mark"))
    marked = keyed(documents.withColumn("__mark", F.xxhash64(text_col)), id_col)
    kept = marked.join(keyed(least, "id").select("__id", "__none", "__mark"), ["__id", "__none", "__mark"], "left_semi")
    return kept.dropDuplicates(["__id", "__none", "__mark"]).select(*documents.columns)
