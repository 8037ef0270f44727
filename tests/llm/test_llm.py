"""The training-data operators against brute force, and their defined results for odd inputs."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.llm import bpe, components, decontaminate, line_dedup, quality_model, quality_rules, registry, secrets, simhash, surrogates, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
LONG = "lorem ipsum dolor " * 20_000
LINE = "this line is long enough to be a key of forty"
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t\n", "en", "a", 4), (4, "one", "en", "a", 3), (4, "one", "en", "a", 3), (5, "One", "en", "b", 3),
    (6, LONG, "en", "b", len(LONG)), (7, f"{LINE}\nx", "de", "b", 10), (8, f"\t{LINE.upper()} \ny", "de", "c", 10), (9, f"{LINE}\n{LINE}\nz", "de", "c", 10),
    (10, f"w\n{LINE}", "de", None, 10), (11, LINE, "de", "c", 10), (None, LINE, "de", "c", 10), (None, "a text without an id", None, "c", 10), (12, "naïve ÉCOLE 日本語 \x1c   end", "fr", "c", 20),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2, 0, 0), (6, 1, 0), (7, 1, 1), (7, 1, 0), (8, None, None), (None, 1, 1)], LABELS)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "Two Words"), (2, None), (3, ""), (4, "a b c d e f g h i j k l"), (5, "b c d e f g h i j k")], "item_id long, text string")


@pytest.fixture(scope="module")
def tables(spark, docs, labels, benchmark, tmp_path_factory):
    """The odd rows, the same tables empty, and both with further columns of clashing names."""
    root = tmp_path_factory.mktemp("tables")
    odd = {c: F.lit(7) for c in ("id", "mark", "w", "h", "at", "gone", "hits", "items", "n_tokens", "token_ids", "decoded", "fingerprint", "component", "n_lines", "n_dropped", "failures", "score", "host", "path", "p", "x", "fp", "k", "batch", "size", "toxic_", "safe_text")}
    for name, cut in (("odd", False), ("empty", True)):
        for t, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
            (df.limit(0) if cut else df).write.parquet(f"{root}/{name}/{t}.parquet")
            (df.limit(0) if cut else df).withColumns(odd).write.parquet(f"{root}/{name}-wide/{t}.parquet")
    return str(root)


def plain(df):
    return sorted((str(r) for r in df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_odd_empty_and_wide_tables(spark, tables, name):
    run = registry.queries()[name]
    got = run(spark, f"{tables}/odd")
    assert got.count() == {"op9_token_counts": sum((t or "").count("\n") + 1 for _, t, *_ in ROWS)}.get(name, len(ROWS))
    empty = run(spark, f"{tables}/empty")
    assert empty.count() == 0 and empty.columns == got.columns
    assert plain(run(spark, f"{tables}/odd-wide")) == plain(got)


def test_whole_table_operators_keep_wide_columns(spark, tables):
    wide, bench = spark.read.parquet(f"{tables}/odd-wide/documents.parquet"), spark.read.parquet(f"{tables}/odd-wide/benchmark.parquet")
    assert line_dedup.drop_shared_lines(wide).select("id", "gone").distinct().count() == 1
    assert simhash.keep_first(wide).columns == wide.columns
    assert decontaminate.drop_documents(wide, bench).columns == wide.columns
    assert decontaminate.remove_spans(wide, bench).count() == len(ROWS)


def test_bpe_is_the_library_and_round_trips(spark):
    coder = bpe.codec(__import__("public_tokenizers").path(bpe.DEFAULT_RANKS))
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "the", " ", "\n", "1", "é", "日本", "'s", "!", "x" * 50, " " * 30, " "]) for _ in range(rng.randint(0, 80))) for _ in range(200)]
    cut, blank, run = bpe.CUT_AT, bpe.LONG_BLANK, bpe._BLANK_RUN
    try:
        bpe.CUT_AT, bpe.LONG_BLANK, bpe._BLANK_RUN = 40, 5, __import__("regex").compile(r"\p{White_Space}{5,}")
        for text in texts:
            ids = coder.encode(text)
            assert ids == coder.encoding.encode_ordinary(text)
            assert coder.encoding.decode_bytes(ids) == text.encode()
    finally:
        bpe.CUT_AT, bpe.LONG_BLANK, bpe._BLANK_RUN = cut, blank, run
    assert len(coder.encode(" \n" * 200_000)) > 0  # the library alone overflows its stack here


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [__import__("xxhash").xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash_components_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 4)
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 500)}" for _ in range(300)]
    texts = {}
    for i in range(60):
        words = list(base) if i % 2 else [f"v{rng.randint(0, 9999)}" for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            if words:
                words[rng.randrange(len(words))] = f"u{rng.randint(0, 99)}"
        texts[i] = " ".join(words)
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op5_simhash(df).collect()}
    assert got == {i: (f"{prints[i]:016x}", root(i)) for i in texts}


def test_keep_first_is_brute_force_on_similar_texts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LONG_CHUNK", 4)
    dealt = random.Random(5)
    word = lambda: f"w{dealt.randrange(4000)}"
    texts = []
    for _ in range(12):
        base = [word() for _ in range(200)]
        texts.append(base)
        for changes in (0, 1, 2):  # five-word similarity 1, 0.95 and 0.9
            copy = list(base)
            for at in dealt.sample(range(10, 190, 12), changes):
                copy[at] = word()
            texts.append(copy)
        texts.append(base[:100] + [word() for _ in range(100)])  # a third: no copy
    shingles = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    firsts = [i for i, a in enumerate(shingles) if not any(len(a & b) >= 0.8 * len(a | b) for b in shingles[:i])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_first(df).collect()) == firsts


def at_similarity(dealt, n, changes):
    """Two texts of ``n`` words; ``changes`` words apart from one another are changed in the second."""
    base = [f"w{dealt.randrange(10**6)}" for _ in range(n)]
    copy = list(base)
    for at in dealt.sample(range(5, n - 5, 5), changes):
        copy[at] = f"w{dealt.randrange(10**6)}"
    return base, copy


def test_keep_first_links_all_pairs_at_the_bar(spark):
    dealt, texts, twins = random.Random(11), [], []
    for _ in range(80):  # 200 five-word shingles, of which 20 are changed: 180 of 220 are shared, 0.818
        base, copy = at_similarity(dealt, 204, 4)
        twins.append(len(texts) + 1)
        texts += [base, copy]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_first(df).collect()) == sorted(set(range(len(texts))) - set(twins))


def test_keep_first_keeps_texts_below_the_bar(spark):
    dealt, texts, firsts = random.Random(13), [], []
    for changes in (2, 3, 4, 5, 6, 7):  # five-word similarity 0.9, 0.86, 0.82, 0.78, 0.74 and 0.7
        for _ in range(20):
            base, copy = at_similarity(dealt, 204, changes)
            firsts += [len(texts)] + [len(texts) + 1] * (changes > 4)
            texts += [base, copy]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_first(df).collect()) == firsts


def test_near_dedup_stage_links_fingerprints_and_sets(spark):
    import corpus_pipeline as c

    dealt, texts = random.Random(17), [[], ["  "], ["one"], ["One"], ["one", "two"]]
    for changes in (2, 4, 5, 6, 7):  # five-word similarity from 0.9 to 0.7
        for _ in range(40):
            base, copy = at_similarity(dealt, 204, changes)
            chained = list(copy)
            chained[-1] = "end"
            texts += [base, copy, chained]
    core = [f"c{k}" for k in range(7)] * 60  # its shingles outweigh the rest: equal fingerprints, sets far apart
    texts += [core + [f"w{dealt.randrange(10**6)}" for _ in range(20)] for _ in range(3)]
    texts = [" ".join(t) for t in texts]
    words = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))} for w in words]
    prints = [brute_fingerprint(t) for t in texts]
    group, links = list(range(len(texts))), {"bits": 0, "sets": 0, "both": 0}
    for j in range(len(texts)):
        for i in range(j):
            by_bits, by_sets = (prints[i] ^ prints[j]).bit_count() <= 3, len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if by_bits or by_sets:
                links["both" if by_bits and by_sets else "bits" if by_bits else "sets"] += 1
                least, other = sorted((group[i], group[j]))
                group = [least if g == other else g for g in group]
    assert min(links.values()) > 3
    df = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in c.drop_near_copies(spark, df, "").collect()) == [i for i, g in enumerate(group) if i == g]


def test_prefixes_of_similar_sets_meet():
    for n in range(1, 200):
        for m in range(n, 200):
            shared = next(k for k in range(m + 1) if k >= 0.8 * (n + m - k))
            if shared <= n:  # the least overlap at the bar, all of it last in both
                assert simhash.prefix_length(n, 0.8) + shared > n and simhash.prefix_length(m, 0.8) + shared > m


def test_parity_maps_differ_no_more_than_sets():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 5, 60, 3000):
        a = rng.integers(-(1 << 63), (1 << 63) - 1, n)
        b = np.concatenate([a[n // 5 :], rng.integers(-(1 << 63), (1 << 63) - 1, n // 4)])
        apart = int(np.bitwise_count(simhash.parity_map(a) ^ simhash.parity_map(b)).sum())
        assert apart <= len(set(a.tolist()) ^ set(b.tolist())) and (n == 3000 or apart > 0 or n < 5)


def test_cells_and_masks():
    import numpy as np

    assert len(simhash.block_masks(3)) == 20
    chain = np.array([0, 7, 63, 511, 0xFFFFFFFF0000], dtype=np.int64)  # each three bits from the one before
    assert len(simhash.cell_forest(chain, 3)) == 3


def test_components_of_a_path_a_hub_and_repeats(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(5, 5), (1, 0), (0, 1)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(50)} == {100}


def test_line_dedup_by_hand(docs):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.drop_shared_lines(docs.where("doc_id IS NOT NULL")).collect()}
    assert got[9] == (3, 2, "z") and got[8] == (2, 1, "y") and got[11] == (1, 0, LINE) and got[1] == (1, 0, "")


def test_line_runs_ingest_batches(spark, docs):
    runs = line_dedup.LineRuns(spark, fanout=2)
    first, second = docs.where("doc_id <= 8"), docs.where("doc_id > 8")
    runs.add(first)
    assert runs.new_lines(second).count() == 0
    runs.add(second)
    assert [len(x) for x in runs.levels] == [0, 1]
    assert [r.max_id for r in runs.shared(5).collect()] == [11]


def test_the_query_ingests_batches_into_levels(spark, docs, monkeypatch):
    levels, ingest = [], line_dedup.LineRuns.ingest

    def watched(self, keys):
        ingest(self, keys)
        levels.append([len(x) for x in self.levels])
        fresh = self.read().where("fresh")
        assert fresh.count() == fresh.select("h1", "h2").distinct().count() == self.read().select("h1", "h2").distinct().count()

    monkeypatch.setattr(line_dedup.LineRuns, "ingest", watched)
    more = docs.union(spark.createDataFrame([(100 + i, f"{LINE}\n{LINE} number {i % 7}\n{LINE} number {i}", "en", "a", 1) for i in range(40)], SCHEMA)).where("doc_id IS NOT NULL")
    got = {r.doc_id: r.n_dropped for r in line_dedup.op3_line_dedup(more).collect()}
    assert levels == [[1], [0, 1], [1, 1]]
    assert got[139] == 0 and got[138] == 1 and got[110] == 2  # 133 to 139 hold the last of the seven numbered lines


def test_line_dedup_without_broadcast(docs, monkeypatch):
    want = plain(line_dedup.op3_line_dedup(docs))
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    assert plain(line_dedup.op3_line_dedup(docs)) == want


def test_decontamination_spans(spark, benchmark):
    docs = spark.createDataFrame([(1, "x TWO, words! y"), (2, "a b c d e f g h i j k l"), (3, "clean")], "doc_id long, text string")
    found = {r.doc_id: r for r in decontaminate.contamination(docs, benchmark).collect()}
    assert (found[1].n_hit, found[1]["items"]) == (2, [1]) and (found[2].n_hit, sorted(found[2]["items"])) == (12, [4, 5]) and found[3].n_hit == 0
    clean = {r.doc_id: r.clean_text for r in decontaminate.remove_spans(docs, benchmark).collect()}
    assert clean == {1: "x! y", 2: "", 3: "clean"}
    assert [r.doc_id for r in decontaminate.drop_documents(docs, benchmark).collect()] == [3]


def test_decontamination_without_broadcast(docs, benchmark, spark, monkeypatch):
    again = [(20, "A b c d e f g h i j two words", "en", "a", 1)] * 3 + [(21, "clean", "en", "a", 1)] * 2 + [(22, None, "en", "a", 1)] * 2
    more = docs.union(spark.createDataFrame(again, SCHEMA))
    want = plain(decontaminate.op4_decontaminate(more, benchmark))
    assert len(want) == more.count()
    one_size = benchmark.where("item_id = 4")
    assert decontaminate.op4_decontaminate(more, one_size).count() == len(want) == decontaminate.op4_decontaminate(more, benchmark.limit(0)).count()
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert plain(decontaminate.op4_decontaminate(more, benchmark)) == want


def test_ablation(spark):
    text = " ".join("wor" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(80))
    df = spark.createDataFrame([(1, text), (2, "few"), (3, text + " #" * 60), (4, "few ## ##")], "doc_id long, text string")
    entries = quality_rules.ledger(df)
    table = {r.rule: r for r in quality_rules.ablation(entries).collect()}
    kept = quality_rules.apply_policy(entries).where("kept").count()
    assert kept == 1 and table["few_words"].failed == 2
    for name, r in table.items():
        rest = quality_rules.mask(tuple(x for x in quality_rules.POLICIES["web/1"] if x != name))
        assert r.kept_without == entries.where(F.col("failures").bitwiseAND(F.lit(rest)) == 0).count()


def test_secrets_base_and_random(spark):
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = "".join(rng.choice(letters) for _ in range(40))
    text = f'api_key: "abcdefgh1" PASSWORD=short AKIA{"A" * 12} {"0a" * 16} see {key} or averyveryveryverylongword and {"q1" * 17} ' + "some words about tokens and keys of every kind, a very long word list for the model " * 5
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in secrets.op6_secrets(docs).collect()}
    base = f"assign:0:19,access:{text.index('AKIA')}:{text.index('AKIA') + 16},hex:{text.index('0a')}:{text.index('0a') + 32}"
    assert (found[1].n_assign, found[1].n_access, found[1].n_hex) == (1, 1, 1)
    assert found[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert f"random:{text.index(key)}:{text.index(key) + 40}" in found[1].spans and found[1].spans.count("random") == 1
    assert found[2].spans == ""


ALPHABETS = {"lower36": "abcdefghijklmnopqrstuvwxyz0123456789", "alphanumeric": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}


def test_battery_keeps_its_level():
    rng = random.Random(8)
    for n in (16, 20, 32, 64, 200):
        for alphabet in (*ALPHABETS.values(), "0123456789abcdef"):
            rejected = sum(not secrets.looks_random("".join(rng.choice(alphabet) for _ in range(n))) for _ in range(400))
            assert rejected <= 12, (n, len(alphabet), rejected)  # 3 % where half a per cent is meant


def test_bigrams_are_brute_force(monkeypatch):
    text = "ab c-d\u20ac AB0 password xyz"
    want = {}
    for at, (a, b) in enumerate(zip(text, text[1:])):
        a, b = a.lower(), b.lower()
        if a in secrets.SYMBOLS and b in secrets.SYMBOLS and not (13 <= at < 21 or 13 <= at + 1 < 21):
            want[a + b] = want.get(a + b, 0) + 1
    for part in (3, 1 << 18):
        monkeypatch.setattr(secrets, "PART", part)
        got = secrets.bigrams(text, [(13, 21)]).reshape(len(secrets.SYMBOLS), -1)
        assert {secrets.SYMBOLS[i] + secrets.SYMBOLS[j]: int(got[i, j]) for i, j in zip(*got.nonzero())} == want


def test_rare_planted_keys_are_found(spark):
    rng = random.Random(12)
    base = "the quick brown fox jumps over lazy dogs while seven wizards make toxic brew for evil queen version release update handler getter manager service value index parser module config reader".split()
    spell = lambda w: rng.choice((str.lower, str.title, str.upper))(w)
    rows, keys, n_like = [], {}, 0
    for i in range(2500):
        likes = [rng.choice(("_", "-", "/", "")).join(spell(rng.choice(base)) for _ in range(rng.randint(4, 7))) + rng.choice(("", "2", "_10", "-2024-01-15")) for _ in range(4)]
        n_like += sum(len(x) >= 16 for x in likes)
        text = " ".join(rng.choice(base) for _ in range(60)) + " " + " ".join(likes) + " 2024-01-15 10-20 3000"
        if i % 60 == 0:
            alphabet = ALPHABETS[rng.choice(sorted(ALPHABETS))]
            key = "".join(rng.choice(alphabet) for _ in range((20, 32, 40, 64)[i // 60 % 4]))
            if not any(c.isalpha() for c in key) or secrets.base_spans(key):
                continue
            text += f" {key} end"
            keys[i] = f"random:{text.index(key)}:{text.index(key) + len(key)}"
        rows.append((i, text))
    found = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("random")] for r in secrets.op6_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = sum(keys[i] in found[i] for i in keys)
    false = sum(len(v) for v in found.values()) - hits
    assert n_like > 200 * len(keys) and hits >= 0.9 * len(keys) and false <= 1, (hits, len(keys), false)


def test_automaton_edits():
    a = toxicity.Automaton({"idiot": 5.0, "lowei*": 4.0, "ass": 3.0})
    assert a.match("idiot") == (5.0, 0) and a.match("loweischaft") == (4.0, 0)
    for word in ("idoit", "idiiot", "idot", "id1ot", "xidiot", "idiots"):
        assert a.match(word) == (5.0, 1), word
    for word in ("id10t", "as", "asss", "dioti", "low"):
        assert a.match(word)[0] == 0, word


def test_stems_take_one_edit():
    a = toxicity.Automaton({"idiot*": 5.0, "lump*": 4.0, "schwachkopf": 3.0})
    assert a.match("idiotische") == (5.0, 0) and a.match("lumpen") == (4.0, 0)
    for word in ("idoit", "id1ot", "idoitische", "iidiotische", "diotische", "idxotisches"):
        assert a.match(word) == (5.0, 1), word
    for word in ("id10tische", "lmupen", "lunpen", "odi", "schwach"):
        assert a.match(word)[0] == 0, word


def test_quotation_is_not_abuse():
    a, text = toxicity.Automaton({"idiot": 5.0}), 'they wrote "what an idiot" here'
    assert toxicity.features(text, a, {})[1] == 0 and toxicity.features(text, a, {})[3] > 0
    assert toxicity.features("you are an idiot", a, {})[1] > 0


def test_a_long_quotation_is_one(spark):
    far = "blah " * 60
    a = toxicity.Automaton({"idiot": 5.0})
    assert toxicity.features(f'“{far}idiot {far}”', a, {})[3] > 0
    assert toxicity.features(f'“{far}”\nidiot {far}”', a, {})[1] > 0


def test_toxicity_does_not_depend_on_partitions(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["loser", "scumbag"] * (i % 4 == 0) + [f"w{rng.randint(0, 40)}" for _ in range(12)])) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(100)]  # copies, whose halves differ
    marks = [(i, 1, int(i % 4 == 0)) for i, _ in rows]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, LABELS)
    want = plain(toxicity.op7_toxicity(docs.coalesce(1), labels))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert plain(toxicity.op7_toxicity(docs.repartition(5, "text"), labels.repartition(3))) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def brute_distance(a, b):
    """Edits between two words, a swap of neighbours counting as one (optimal string alignment)."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_is_brute_force():
    rng = random.Random(4)
    word = lambda low, high: "".join(rng.choice("abc") for _ in range(rng.randint(low, high)))
    for _ in range(30):
        terms = {word(5, 8): float(k + 1) for k in range(4)}
        a = toxicity.Automaton(terms)
        for w in [word(4, 9) for _ in range(200)]:
            near = [weight for term, weight in terms.items() if brute_distance(w, term) <= 1]
            want = (terms[w], 0) if w in terms else (max(near), 1) if near else (0.0, 0)
            assert a.match(w) == want, (w, terms)


def test_toxicity_on_rows_it_has_not_seen(spark):
    rng = random.Random(7)
    bad, rows, marks = ["loser", "scumbag", "idiot"], [], []
    for i in range(600):
        words = [f"word{rng.randint(0, 300)}" for _ in range(60)]
        if i % 5 == 0:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(i % 5 == 0)))
    found = toxicity.op7_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, LABELS))
    held = [(r.predicted, r.doc_id % 5 == 0) for r in found.where("held_out").collect()]
    assert held and all(bool(p) == t for p, t in held)


def test_posteriors_are_brute_force(spark):
    rows = [("big", "p", 0.9, 0.5)] * 60 + [("big", "q", 1.0, 1.0)] * 20 + [("tiny", "p", 0.0, 1.0)] + [("low", "q", 0.1, 0.5)] * 40 + [("low", "r", 0.0, 1.0)] * 3
    evidence = spark.createDataFrame(rows, "host string, path string, v double, w double")
    groups, prior, host_k, path_k = quality_model.site_sums(evidence)
    assert prior == pytest.approx(sum(w * v for *_, v, w in rows) / sum(w for *_, w in rows))
    got = {(r.host, r.path): r for r in quality_model.posteriors(evidence.join(groups, ["host", "path"]), prior, host_k, path_k).collect()}
    for (host, path), r in got.items():
        others = list(rows)
        others.remove((host, path, r.v, r.w))  # a document does not speak for itself
        s = lambda keep: (sum(w * v for h, p, v, w in others if keep(h, p)), sum(w for h, p, v, w in others if keep(h, p)))
        of_host, of_path = s(lambda h, p: h == host), s(lambda h, p: (h, p) == (host, path))
        host_post = (of_host[0] + host_k * prior) / (of_host[1] + host_k)
        assert r.host_post == pytest.approx(host_post) and r.path_post == pytest.approx((of_path[0] + path_k * host_post) / (of_path[1] + path_k))
    assert got["tiny", "p"].host_post == pytest.approx(prior)  # nobody else tells
    assert got["big", "p"].host_post > 0.8 and got["low", "q"].host_post < 0.2


def sites_that_tell(spark, n=600):
    """Texts alike everywhere; what tells good from bad is the site."""
    rng, rows, marks = random.Random(21), [], []
    for i in range(n):
        host = f"h{i % 20}"
        rows.append((i, " ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.randint(20, 90))), host, f"p{i % 3}"))
        marks.append((i, int(rng.random() < (0.95 if i % 20 < 10 else 0.05)), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, host string, path string"), spark.createDataFrame(marks, LABELS)


def test_sites_lower_the_held_out_loss(spark):
    docs, labels = sites_that_tell(spark)
    alone, with_sites, n = quality_model.held_out_loss(docs, labels, F.col("host"), F.col("path"))
    assert n > 60 and with_sites < 0.6 * alone


def test_quality_without_broadcast(spark, monkeypatch):
    docs, labels = sites_that_tell(spark, 120)
    want = plain(quality_model.score_quality(docs, labels, F.col("host"), F.col("path")))
    monkeypatch.setattr(quality_model, "BROADCAST_GROUPS", 0)
    assert plain(quality_model.score_quality(docs.repartition(3), labels, F.col("host"), F.col("path"))) == want


def test_sites_of_addresses(spark):
    urls = ["https://A.example.org:80/Blog/x?y", "http://u:p@b.org", None, "no address", "http://c.org/?q"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [tuple(r) for r in df.select(*quality_model.url_site(F.col("url"))).collect()] == [("a.example.org", "blog"), ("b.org", ""), ("", ""), ("", ""), ("c.org", "")]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_share_out_all_tokens(rule):
    coder = bpe.codec(__import__("public_tokenizers").path(bpe.DEFAULT_RANKS))
    text = "a\n\n\n\nnaïve 日本語 text\nend"
    starts = token_counts.line_starts(text)
    total, counts = token_counts.attribute(text, starts, coder, rule)
    assert total == counts.sum() == len(coder.encode(text)) and len(counts) == text.count("\n") + 1
    ends, own = 0, [0] * len(starts)
    for i in coder.encode(text):
        size = len(coder.encoding.decode_single_token_bytes(i))
        spans = [(len(text[:s].encode()), len((text[:e]).encode())) for s, e in zip(starts, [*starts[1:], len(text)], strict=True)]
        if rule == "start":
            k = max(j for j, (s, _) in enumerate(spans) if s <= ends)
        else:
            k = max(range(len(spans)), key=lambda j: (min(spans[j][1], ends + size) - max(spans[j][0], ends), -j))
        own[k] += 1
        ends += size
    assert own == counts.tolist()


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_that_begin_later_get_no_earlier_tokens(rule):
    coder = bpe.codec(__import__("public_tokenizers").path(bpe.DEFAULT_RANKS))
    text = "one two three four five six"
    total, counts = token_counts.attribute(text, [14, 19], coder, rule)
    all_, whole = token_counts.attribute(text, [0, 14, 19], coder, rule)
    assert total == all_ and counts.tolist() == whole[1:].tolist() and whole[0] > 0
    assert token_counts.attribute(text, [], coder, rule)[1].tolist() == []


def test_surrogates(spark):
    text = "Mail Mrs. Maria Keller at maria.keller@mail.example.com or +49 30 1234567, card 4111 1111 1111 1111, host 10.0.0.1; again maria.keller@mail.example.com"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "nothing")], "doc_id long, text string")
    safe = {r.doc_id: r for r in surrogates.replace(docs, b"key").collect()}
    out = safe[1].safe_text
    assert not any(x in out for x in ("maria", "Keller", "1234567", "1111 1111", "10.0.0.1"))
    assert (safe[1].n_email, safe[1].n_card, safe[1].n_phone, safe[1].n_ip, safe[1].n_name) == (2, 1, 1, 1, 1)
    mails = re.findall(r"\S+@\S+", out)
    assert mails[0] == mails[1] and "Mrs. " in out and safe[3].safe_text == "nothing" and safe[2].safe_text is None
    assert surrogates.valid_card(re.search(r"\d{4} \d{4} \d{4} \d{4}", out).group())


def test_permutations_move_all_and_are_one_to_one():
    for n in (2, 3, 21, 100):
        assert sorted(surrogates.permuted(i, n, b"k", "t") for i in range(n)) == list(range(n))
        assert all(surrogates.permuted(surrogates.permuted(i, n, b"k", "t"), n, b"k", "t", back=True) == i for i in range(n))
        out = [surrogates.moved(i, n, b"k", "t") for i in range(n)]
        assert sorted(out) == list(range(n)) and all(i != x for i, x in enumerate(out))


NAMES = [
    ("Frau Dr. Weber", ["Weber"]), ("Prof. Dr. Anna Weber", ["Anna", "Weber"]), ("Dr. J. Smith", ["J", "Smith"]), ("Mr Juan Carlos Garcia", ["Juan", "Carlos", "Garcia"]),
    ("Mr Öz", ["Öz"]), ("Dr Éa", ["Éa"]), ("Sr Ño", ["Ño"]), ("г-н Йё", ["Йё"]), ("Herr von Müller-Lüdenscheidt", ["Müller", "Lüdenscheidt"]), ("Mrs. O'Neil", ["O", "Neil"]), ("Mme Zoë de la Croix", ["Zoë", "Croix"]),
]


@pytest.mark.parametrize("text, words", NAMES)
def test_names_are_found_whole(text, words):
    found = [text[a:b] for a, b, _ in surrogates.detect(f"ask {text}, please"[4:])]
    assert found == words
    for word in words:
        new = surrogates.surrogate("name", word, b"key")
        assert new != word and len(new) == len(word) and new[0].isupper() and (len(word) == 1 or new[-1] == word[-1])


def test_bare_surnames_stay_with_their_name(spark):
    text = "Mr. Hans Keller came. Keller left; Kellers did not. Later Frau Keller spoke with Hans."
    safe = surrogates.replace(spark.createDataFrame([(1, text)], "doc_id long, text string"), b"key").first()
    new = surrogates.surrogate("name", "Keller", b"key")
    assert safe.safe_text == text.replace("Hans Keller", f"{surrogates.surrogate('name', 'Hans', b'key')} {new}").replace(". Keller left", f". {new} left").replace("Frau Keller", f"Frau {new}")
    assert safe.n_name == 3


def test_what_is_no_telephone_number():
    for text in ("on 2024-01-15.", "15.01.2024", "078-05-1120 is its number", "ISBN 978-3-16-148410-0", "order 12345-67890", "order 123456789", "12 34 56"):
        assert [k for *_, k in surrogates.detect(text) if k == "phone"] == [], text
    for text in ("+49 30 1234567", "+1 (017) 555-7713", "030 1234567", "tel. 12345678", "call 555-1234567", "415 555 2671", "+491701234567", "Tel: 0301234567"):
        assert [k for *_, k in surrogates.detect(text)] == ["phone"], text
    assert [k for *_, k in surrogates.detect("to josé@x.org or müller.é@straße.example.de now")] == ["email", "email"]


def test_no_entity_survives_and_all_stay_distinct(spark):
    rng = random.Random(31)
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(1, 3)))
    formats = [
        lambda: ("email", f"{word('abé')}.{word('xy1')}@{word('ab')}.org"), lambda: ("email", f"{word('ñü')}@x.com"), lambda: ("ip", f"{rng.randint(0, 255)}.0.0.{rng.randint(0, 9)}"),
        lambda: ("card", "4" + digit(15)), lambda: ("card", f"{digit(4)} {digit(4)} {digit(4)} {digit(4)}"), lambda: ("card", "12" + digit(14)), lambda: ("phone", f"+49 {digit(3)} {digit(2)}"),
        lambda: ("phone", f"+1 ({digit(3)}) {digit(3)}-{digit(4)}"), lambda: ("phone", f"0{digit(2)} {digit(2)}"), lambda: ("phone", f"{digit(2)} {digit(1)}"), lambda: ("phone", f"+{digit(9)}"),
        lambda: ("name", word("AB").title()), lambda: ("name", "É" + word("éabz")), lambda: ("name", "Й" + word("ёйбв")), lambda: ("name", rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ")), lambda: ("name", "Ab" + word("aß")),
        lambda: ("name", "Ω" + word("αβς")), lambda: ("name", "李" + word("小明")), lambda: ("email", f"{digit(2)}@{digit(1)}.net"), lambda: ("name", "Ñu" + word("zx")), lambda: ("id", f"0{digit(2)}-{digit(2)}-0000"),
    ]
    pairs = {f() for f in formats for _ in range(400)}
    made = [(kind, e, surrogates.surrogate(kind, e, b"secret")) for kind, e in pairs]
    assert all(e != s for _, e, s in made) and len({(k, s) for k, _, s in made}) == len(made)
    assert all(surrogates.valid_card(e) == surrogates.valid_card(s) for k, e, s in made if k == "card")
    surrogates.checked(spark.createDataFrame(made, "kind string, entity string, surrogate string"))
    with pytest.raises(RuntimeError, match="one to one"):
        surrogates.checked(spark.createDataFrame([("name", "A", "X"), ("name", "B", "X")], "kind string, entity string, surrogate string"))
    with pytest.raises(ValueError):
        surrogates.replace(spark.createDataFrame([(1, "x")], "doc_id long, text string"), b"")


def test_pipeline_stages(spark, tables):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{tables}/odd/documents.parquet")
    for name, stage in c.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, f"{tables}/odd")
        assert docs.columns == before.columns, name
        assert docs.count() <= before.count()
    tokens = c.STAGES[-1][1](spark, docs, f"{tables}/odd")
    assert tokens.where("NOT round_trip").count() == 0
    assert plain(c.run(spark, f"{tables}/odd")) == plain(tokens)
    assert c.run(spark, f"{tables}/empty").count() == 0
