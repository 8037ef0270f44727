"""Miniatures: the shapes that are easy to get wrong."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.operators import checks, deliberations, graph, ledgers, mappings, reviews, rules, search
from strandline.sources import stores


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def diamond(spark):
    return spark.createDataFrame([("a", "b", "produces"), ("a", "c", "produces"), ("b", "d", "cites"), ("d", "c", "reads"), ("d", "a", "related"), ("x", "", "cites"), ("d", "e", "unknown")], "src string, dst string, rel string")


def test_closure_reverses_reads_and_skips_annotations(spark, diamond):
    deps = graph.dependencies(diamond)
    seed = spark.createDataFrame([("a",)], "id string")
    assert rows(graph.closure(seed, deps), "id", "depth") == [("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    assert rows(graph.closure(seed, deps, 1), "id") == [("b",), ("c",)]
    assert rows(graph.closure(spark.createDataFrame([("e",)], "id string"), deps), "id") == []


def test_closure_has_its_start_only_on_a_cycle(spark):
    deps = spark.createDataFrame([("a", "b", "cites"), ("b", "a", "cites")], "up string, down string, rel string")
    assert rows(graph.closure(spark.createDataFrame([("a",)], "id string"), deps), "id", "depth") == [("a", 2), ("b", 1)]
    assert rows(graph.cycle_core(deps), "id") == [("a",), ("b",)]


def test_cycle_core_of_a_diamond_is_empty(diamond):
    assert graph.cycle_core(graph.dependencies(diamond)).count() == 0


def test_layers_take_the_longest_path(spark, diamond):
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    assert rows(graph.layers(nodes, graph.dependencies(diamond)), "id", "layer") == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3), ("f", 0)]
    loop = spark.createDataFrame([("a", "b", "cites"), ("b", "a", "cites")], "up string, down string, rel string")
    with pytest.raises(ValueError):
        graph.layers(nodes, loop, max_rounds=5)


def test_first_root_is_the_least(spark):
    deps = spark.createDataFrame([("b", "c", "x"), ("a", "z", "x"), ("z", "c", "x"), ("c", "d", "x")], "up string, down string, rel string")
    seeds = spark.createDataFrame([("a",), ("b",)], "id string")
    assert rows(graph.first_root(seeds, deps), "id", "root") == [("c", "a"), ("d", "a"), ("z", "a")]


def test_impact_marks_bound_and_dependent_nodes(spark):
    nodes = spark.createDataFrame([("a", "data", "current"), ("b", "claim", "current"), ("c", "claim", "deprecated")], "id string, type string, status string")
    deps = spark.createDataFrame([("a", "b", "supports"), ("c", "b", "supports")], "up string, down string, rel string")
    bound = spark.createDataFrame([("a", "k", "old"), ("b", "k", "new"), ("c", "k", "old")], "id string, concept string, value string")
    assert rows(graph.impact(nodes, deps, bound, "k", "new"), "id", "direct", "root") == [("a", True, "a"), ("b", False, "a")]


def test_bounded_context_keeps_seeds_and_budget(spark, diamond):
    seeds = spark.createDataFrame([("a",), ("nowhere",)], "id string")
    assert rows(graph.bounded_context(diamond, seeds, 1, 3), "id", "hop") == [("a", 0), ("b", 1), ("nowhere", 0)]
    assert graph.bounded_context(diamond, seeds, 1, 1).count() == 2


def test_structural_findings(spark):
    nodes = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "a", "cites"), ("a", "q", "cites"), (None, "b", "cites")], "src string, dst string, rel string")
    assert rows(checks.duplicate_id(nodes), "node_id") == [("a",)]
    assert rows(checks.self_edge(edges), "node_id") == [("a",)]
    assert rows(checks.malformed_edge(edges), "detail") == [("? cites b",)]
    assert ("q",) in rows(checks.dangling_edge(nodes, edges), "node_id")


def test_merged_findings_take_the_gravest_and_null_is_empty(spark):
    found = spark.createDataFrame([("warning", "X", None, "d"), ("error", "X", "", "d"), ("info", "Y", "n", None)], "severity string, code string, node_id string, detail string")
    assert rows(checks.merged(found), "severity", "code", "node_id", "sources", "blocking") == [("error", "X", "", 2, True), ("info", "Y", "n", 1, False)]


def test_pairing(spark):
    events = spark.createDataFrame([(1, 1, "run.started", 1, 0), (2, 1, "run.started", 0, 0), (3, 1, "run.finished", 5, 0), (4, 2, "run.finished", 5, 0), (5, 3, "run.started", 9, 0), (6, 4, "run.started", 9, 0), (7, 4, "run.finished", 2, 0)], "event_id long, run_id long, type string, at long, version int")
    assert rows(ledgers.pair_runs(events).where("run_id = 1"), "start_id", "finish_id") == [(2, 3)]
    assert rows(ledgers.link_issues(events), "code", "run_id") == [("DUPLICATE_START", 1), ("FINISH_BEFORE_START", 4), ("FINISH_WITHOUT_START", 2), ("RUN_INCOMPLETE", 3)]


def test_window_delta(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    after = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string")
    assert rows(ledgers.window_delta(before, after), "path", "transition") == [("b", "content_changed"), ("c", "deleted"), ("d", "created")]


def test_chains(spark):
    docs = spark.createDataFrame([("1", None), ("2", "1"), ("3", "1"), ("4", "gone")], "id string, supersedes string")
    assert rows(reviews.leaves(docs), "id") == [("2",), ("3",), ("4",)]
    assert rows(reviews.chain_issues(docs), "code", "id") == [("BRANCHED_CHAIN", "1"), ("MISSING_PREDECESSOR", "4")]


def test_panel(spark):
    ballots = spark.createDataFrame([("c", "g1", "endorse"), ("c", "g1", "abstain"), ("c", "g2", "endorse"), ("c", "g3", "endorse"), ("c", "g3", "reject"), ("c", "g4", "endorse")], "candidate string, grp string, decision string")
    assert rows(reviews.panel_vote(ballots), "endorse", "reject", "abstain", "status") == [(2, 1, 1, "recommended")]
    same = spark.createDataFrame([("c", "g1", "a"), ("c", "g1", "b"), ("c", "g2", "b"), ("c", "g2", "c")], "candidate string, grp string, role string")
    assert rows(reviews.role_coverage(same, ("a", "b", "c")), "covered") == [(False,)]


def test_rules_recursion_and_states(spark):
    edge = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a int, b int")
    pack = [
        {"id": "r1", "when": [("e", True, {"a": "?x", "b": "?y"})], "then": ("p", True, {"a": "?x", "b": "?y"})},
        {"id": "r2", "when": [("p", True, {"a": "?x", "b": "?y"}), ("e", True, {"a": "?y", "b": "?z"})], "then": ("p", True, {"a": "?x", "b": "?z"})},
        {"id": "r3", "when": [("p", True, {"a": "?x", "b": "?x"})], "where": [("gt", "?x", 2)], "then": ("p", False, {"a": "?x", "b": "?x"})},
    ]
    known = rules.fixpoint({("e", True): edge}, pack)
    assert known["p", True].count() == 9
    targets = spark.createDataFrame([(1, 1), (3, 3), (7, 7)], "a int, b int")
    assert rows(rules.states(targets, known, "p"), "a", "state") == [(1, "derivable"), (3, "conflict"), (7, "unknown")]


def test_diff_is_null_safe(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "z"), (4, "y")], "k int, v string")
    assert rows(search.diff(a, b, ["k"]), "k", "change") == [(2, "changed"), (3, "removed"), (4, "added")]


def test_scalars(spark):
    one = spark.range(1)
    got = one.select(
        scalars.normal_decimal(F.lit("1.500")), scalars.normal_decimal(F.lit("-0.0")), scalars.normal_decimal(F.lit("1e3")),
        scalars.json_pointer(F.lit('{"a/b": [1, 2]}'), "/a~1b/1"), scalars.portable_path(F.lit("a/../b")), scalars.portable_path(F.lit("a/b")),
    ).first()
    assert tuple(got) == ("1.5", "0", None, "2", False, True)


def test_store_fails_closed(spark, tmp_path):
    text = json.dumps({"kind": "x"})
    (tmp_path / f"{hashlib.sha256(text.encode()).hexdigest()}.json").write_text(text)
    store = stores.read_store(spark, str(tmp_path))
    assert stores.documents(store, "kind string").count() == 1
    (tmp_path / f"{'0' * 64}.json").write_text(text)
    store = stores.read_store(spark, str(tmp_path))
    assert rows(store.where("issue IS NOT NULL"), "issue") == [("HASH_MISMATCH",)]
    assert stores.documents(store, "kind string").count() == 0


def test_append_is_create_only(spark, tmp_path):
    new = spark.createDataFrame([("a",), ("b",), ("a",)], "text string")
    for _ in range(2):
        stores.append(new, f"{tmp_path}/ledger")
    assert spark.read.parquet(f"{tmp_path}/ledger").count() == 2


def test_read_graph_last_definition_wins(spark, tmp_path):
    path = tmp_path / "graph.json"
    path.write_text(json.dumps({"nodes": [{"id": "a", "type": "data"}, {"id": "a", "type": "claim"}], "edges": [{"from": "a", "to": "b", "rel": "cites"}], "concepts": {"k": {"canonical": "v"}}}))
    nodes, edges, concepts = stores.read_graph(spark, str(path))
    assert rows(nodes, "id", "type") == [("a", "claim")]
    assert rows(edges, "src", "dst", "rel") == [("a", "b", "cites")]
    assert rows(concepts, "name", "canonical") == [("k", "v")]


def test_deliberation_issues(spark):
    frame = spark.createDataFrame
    proposals = frame([("t", "a", "ann", "g1"), ("t", "b", "bob", "g2"), ("u", "c", "cas", "g3")], "topic string, candidate string, actor string, grp string")
    sets = frame([("s", "t"), ("v", "u")], "id string, topic string")
    members = frame([("s", "a"), ("s", "b"), ("v", "x")], "set_id string, candidate string")
    ballots = frame([("b1", "s", "dan", "g4", "r", 5), ("b2", "s", "eve", "g1", "r", 6), ("b3", "s", "eve", "g1", "r", 6), ("b4", "none", "dan", "g4", "r", 5)], "id string, set_id string, voter string, grp string, role string, at int")
    evaluations = frame([("b1", "a"), ("b1", "b"), ("b2", "b"), ("b3", "a"), ("b3", "z")], "ballot_id string, candidate string")
    decisions = frame([("d1", "s", "fay", 4), ("d2", "v", "cas", 1), ("d3", "none", "fay", 9)], "id string, set_id string, actor string, at int")
    pins = frame([("d1", "b1"), ("d1", "b2"), ("d1", "b3"), ("d2", "b1")], "decision_id string, ballot_id string")
    found = deliberations.issues(proposals, sets, members, ballots, evaluations, decisions, pins)
    assert rows(found, "code", "id") == sorted([
        ("SET_LACKS_PROPOSAL", "v"), ("SET_UNPROPOSED_CANDIDATE", "v"), ("BALLOT_WITHOUT_SET", "b4"), ("BALLOT_REPEATED", "b2"), ("BALLOT_REPEATED", "b3"),
        ("BALLOT_UNKNOWN_CANDIDATE", "b3"), ("BALLOT_OWN_CANDIDATE", "b3"), ("BALLOT_LACKS_CANDIDATE", "b3"),
        ("DECISION_WITHOUT_SET", "d3"), ("DECISION_EARLY", "d1"), ("DECISION_NOT_INDEPENDENT", "d2"), ("DECISION_STALE_BALLOTS", "d2"), ("DECISION_STALE_BALLOTS", "d3"),
    ], key=str)


def test_mappings_and_policies(spark):
    frame = spark.createDataFrame
    given = frame([(1, None, "t", "exact", "x", "accepted"), (2, 1, "t", "exact", "y", "accepted"), (3, None, "t", "close", "y", "accepted"), (4, None, "u", "exact", "gone", "accepted"), (5, None, "v", "exact", "old", "proposed"), (6, None, "w", "exact", "x", "accepted")], "id int, supersedes int, term string, relation string, target string, state string")
    terms = frame([("t", "k"), ("u", "k"), ("v", "k"), ("w", "k")], "term string, kind string")
    targets = frame([("x", "k", False), ("y", "other", False), ("old", "k", True)], "target string, kind string, deprecated boolean")
    judged = mappings.eligibility(given, terms, targets)
    assert rows(judged, "id", "findings", "eligible") == [(2, "KIND_MISMATCH,CONFLICT", False), (3, "KIND_MISMATCH,CONFLICT", False), (4, "TARGET_MISSING", False), (5, "TARGET_DEPRECATED", False), (6, "", True)]
    policy = frame([("p", 1), ("p", 2), ("p", 3), ("p", 6), ("p", 9)], "policy string, mapping int")
    assert rows(mappings.policy_issues(policy, given, judged), "mapping", "code") == [(1, "MAPPING_SUPERSEDED"), (2, "MAPPING_NOT_ELIGIBLE"), (2, "TERM_REPEATED"), (3, "MAPPING_NOT_ELIGIBLE"), (3, "TERM_REPEATED"), (9, "MAPPING_MISSING")]


def test_fitted_context_keeps_seeds_and_drops_edges_first(spark):
    context = spark.createDataFrame([("s", 0), ("a", 1), ("b", 2)], "id string, hop int")
    edges = spark.createDataFrame([("s", "a", "cites"), ("a", "b", "cites"), ("b", "z", "cites")], "src string, dst string, rel string")
    fitted = lambda budget: rows(graph.fitted_context(context, edges, F.lit(10), F.lit(4), budget), "kind", "id", "other")
    assert fitted(38) == [("edge", "a", "b"), ("edge", "s", "a"), ("node", "a", None), ("node", "b", None), ("node", "s", None)]
    assert fitted(34) == [("edge", "s", "a"), ("node", "a", None), ("node", "b", None), ("node", "s", None)]
    assert fitted(24) == [("edge", "s", "a"), ("node", "a", None), ("node", "s", None)]
    assert fitted(5) == [("node", "s", None)]


def test_streams_run_to_their_end(spark, tmp_path, monkeypatch):
    from pyspark.sql.streaming.query import StreamingQuery

    from strandline.streaming import pairing

    wait = StreamingQuery.awaitTermination

    def whole(self, timeout=None):
        assert timeout is None
        return wait(self)

    monkeypatch.setattr(StreamingQuery, "awaitTermination", whole)
    events = spark.createDataFrame([(1, "2024-01-01", 7, "view", 0.0, ""), (2, "2024-01-02", 7, "purchase", 0.0, "")], "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/written")
    (tmp_path / "in").mkdir()
    next((tmp_path / "written").glob("part-*.parquet")).rename(tmp_path / "in/events.parquet")
    stream = pairing.pair_stream(pairing.event_stream(spark, f"{tmp_path}/in"), "view", "purchase")
    found = pairing.run_to_end(stream, "whole_run", f"file://{tmp_path}/state")
    assert rows(found, "run_id", "start_id", "finish_id") == [(7, 1, 2)]
    assert found.inputFiles() and all("/state-table/" in f for f in found.inputFiles())


def test_cycles_leave_out_what_lies_between(spark):
    pairs = [("a", "b"), ("b", "a"), ("b", "m"), ("m", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("s", "s"), ("z", "end")]
    deps = spark.createDataFrame([(u, v, "cites") for u, v in pairs], "up string, down string, rel string")
    assert rows(graph.on_cycles(deps), "id") == [(x,) for x in "absxyz"]


def test_redaction_and_pointers(spark):
    one = spark.range(1)
    argv = F.array(*map(F.lit, ("--TOKEN", "--password", "kept", "--Private-Key=x=y", "--authorization")))
    assert one.select(scalars.redact_argv(argv)).first()[0] == ["--TOKEN", "[REDACTED]", "kept", "--Private-Key=[REDACTED]", "--authorization"]
    text = F.lit('{"0": "key", "a": [5, null], "it\'s": 1}')
    at = lambda p: one.select(scalars.json_pointer(text, p)).first()[0]
    assert [at(p) for p in ("/0", "/a/0", "/a/00", "/a/1", "/a/2", "/it's")] == ["key", "5", None, "null", None, "1"]


def test_impact_keeps_nodes_without_status(spark):
    nodes = spark.createDataFrame([("a", "data", None), ("b", "claim", "current")], "id string, type string, status string")
    deps = spark.createDataFrame([("a", "b", "supports")], "up string, down string, rel string")
    assert rows(graph.impact(nodes, deps, spark.createDataFrame([("a", "k", "old")], "id string, concept string, value string"), "k", "new"), "id") == [("a",), ("b",)]
