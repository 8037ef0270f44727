"""Contracts, journals, replays and proofs on small cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import graph, pipelines, proofs, replays, rules, search


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def made(spark, names, *values):
    return spark.createDataFrame(list(values), names)


STAGES = "contract string, stage string, method string, step string"
NEEDS = "contract string, stage string, parent string"
STEPS = "method string, step string, required boolean"
USES = "contract string, stage string, node string, way string"
ROLES = "contract string, node string, role string"


def test_stage_issues(spark):
    stages = made(spark, STAGES, ("k", "a", "m", "1"), ("k", "b", "m", "1"), ("k", "c", "m", "9"), ("k", "c", "m", "9"), ("ok", "a", "m", "1"), ("ok", "b", "m", "2"))
    needs = made(spark, NEEDS, ("k", "a", "b"), ("k", "b", "a"), ("k", "c", "gone"), ("ok", "b", "a"))
    steps = made(spark, STEPS, ("m", "1", True), ("m", "2", True), ("m", "3", False))
    assert rows(pipelines.stage_issues(stages, needs, steps), "code", "contract", "detail") == [
        ("DUPLICATE_STAGE", "k", "c"), ("REQUIRED_STEP_ABSENT", "k", "m 2"), ("STAGE_CYCLE", "k", "a"), ("STAGE_CYCLE", "k", "b"),
        ("STEP_MAPPED_TWICE", "k", "m 1"), ("UNKNOWN_METHOD_STEP", "k", "c m 9"), ("UNKNOWN_PARENT", "k", "c gone"),
    ]


def test_flow_issues(spark):
    """Two parents, an ancestor over another stage, and a stage that takes what it does not wait for."""
    stages = made(spark, STAGES, *((k, s, "m", s) for k in ("ok", "bad") for s in "abcd"))
    links = [("c", "a"), ("c", "b"), ("d", "c")]
    needs = made(spark, NEEDS, *(("ok", *x) for x in links), *(("bad", *x) for x in links[:2]))
    flow = [("a", "raw", "consumes"), ("a", "x", "produces"), ("b", "y", "produces"), ("c", "y", "consumes"), ("d", "x", "consumes"), ("d", "z", "produces")]
    uses = made(spark, USES, *((k, *u) for k in ("ok", "bad") for u in flow))
    roles = made(spark, ROLES, ("ok", "raw", "input"), ("ok", "z", "output"), ("bad", "other", "input"), ("bad", "z", "output"), ("bad", "z", "code"))
    assert rows(pipelines.flow_issues(stages, needs, uses, roles), "code", "contract", "detail") == [("CONSUMES_WITHOUT_DEPENDING", "bad", "d x a"), ("INPUT_MISMATCH", "bad", "other"), ("INPUT_MISMATCH", "bad", "raw"), ("ROLE_OVERLAP", "bad", "z")]
    nodes = made(spark, "id string, status string", ("raw", None), ("x", "stale"), ("y", "current"), ("z", "confirmed"))
    assert rows(pipelines.inactive_nodes(uses.union(made(spark, USES, ("ok", "a", "w", "produces"))), nodes), "code", "contract", "detail") == [("INACTIVE_NODE", "bad", "x stale"), ("INACTIVE_NODE", "ok", "x stale"), ("MISSING_NODE", "ok", "w")]


def traces(spark, points, launched=True, limit=None):
    stages = made(spark, "contract string, stage string", *(("k", s) for s in "abc"))
    needs = made(spark, NEEDS, ("k", "c", "a"), ("k", "c", "b"))
    anchors = made(spark, "contract string, stage string, code string, path string, first int, last int", *(("k", s, "n", "f.py", 10, 20) for s in "abc"), ("k", "c", "n", "g.py", 1, 1))
    runs = made(spark, "run string, contract string, nonce string, reporter int, launched boolean", *((r, "k", "n", 7, launched) for r in {p[0] for p in points} | {"idle"}))
    found = pipelines.stage_traces(runs, made(spark, "run string, line int, contract string, nonce string, reporter int, stage string, path string, at int", *points), stages, needs, anchors)
    return {r.run: (r.state.removeprefix("cooperative_report_"), "".join(r.accepted), [i.code.removeprefix("STAGE_TRACE_") for i in r.issues], r.missing) for r in found.collect()}


def test_traces(spark):
    point = lambda run, line, stage, path="f.py", at=10, contract="k", nonce="n", reporter=7: (run, line, contract, nonce, reporter, stage, path, at)
    found = traces(spark, [
        point("whole", 1, "b", at=20), point("whole", 2, "a"), point("whole", 3, "c", "g.py", 1),
        point("half", 1, "a"), point("half", 2, "b"),
        point("early", 2, "c"), point("early", 1, "a"), point("early", 3, "b"), point("early", 4, "c"),
        point("again", 1, "a", at=21), point("again", 2, "a"), point("again", 3, "a"), point("again", 4, "b"), point("again", 5, "c"),
        point("odd", 1, "a", nonce="m"), point("odd", 2, "a", contract=None), point("odd", 3, "a", reporter=None), point("odd", 4, "a", reporter=8), point("odd", 5, None), point("odd", 6, "z"), point("odd", 7, "a", path=None), point("odd", 8, "a", at=0),
        *(point("long", k, s) for k, s in enumerate("abc", 1)), point("long", pipelines.MAX_RECORDS + 1, "a"),
    ])
    assert found == {
        "whole": ("complete", "bac", [], []),
        "half": ("incomplete", "ab", [], ["c"]),
        "early": ("invalid", "abc", ["DEPENDENCY_ORDER"], []),
        "again": ("invalid", "abc", ["CALLSITE_UNANCHORED", "DUPLICATE_STAGE"], []),
        "odd": ("invalid", "", ["BINDING_MISMATCH", "BINDING_MISMATCH", "REPORTER_PROCESS_INVALID", "REPORTER_PROCESS_MISMATCH", "UNKNOWN_STAGE", "UNKNOWN_STAGE", "CALLSITE_INVALID", "CALLSITE_INVALID"], ["a", "b", "c"]),
        "long": ("invalid", "abc", ["RECORD_LIMIT"], []),
        "idle": ("incomplete", "", [], ["a", "b", "c"]),
    }
    assert traces(spark, [point("r", 1, "a")], launched=False)["idle"][0] == "not_attempted"


def test_control_changes(spark):
    files = lambda *x: made(spark, "run int, path string, hash string", *x)
    events = lambda *x: made(spark, "run int, event_id int", *x)
    found = pipelines.control_changes(files((1, "p", "h"), (2, "p", "h"), (3, "p", None)), files((1, "p", "h"), (2, "p", "i"), (3, "p", None)), events((1, 1), (3, 1)), events((1, 1), (1, 2), (1, 2)))
    assert rows(found, "run", "changed", "appended") == [(1, False, 1), (2, True, 0), (3, True, 0)]


ATTEMPTS = "cert string, attempt int, launch_error boolean, code int, stdout string, stderr string, writes string, trace string"
OUTPUTS = "cert string, attempt int, path string, state string, hash string"


def test_replays(spark):
    good = (None, 0, "o", "e", None, pipelines.COMPLETE)
    of = lambda cert, *two: [(cert, k, *a) for k, a in enumerate(two, 1)]
    attempts = made(spark, ATTEMPTS, *of("same", good, good), *of("off", good, good), *of("less", good, good), *of("loud", good, (None, 0, "x", "e", None, pipelines.COMPLETE)), *of("wrote", *[(None, 0, "o", "e", "w", pipelines.COMPLETE)] * 2), *of("slow", good, (None, None, "o", "e", None, None)), *of("bare", good), *of("torn", good, good), *of("untraced", good, (None, 0, "o", "e", None, None)))
    certs = ("same", "off", "loud", "wrote", "slow", "torn", "untraced")
    out = [(c, k, "p", "stable", "h") for c in certs for k in (1, 2) if (c, k) not in (("off", 2), ("torn", 2))] + [("off", 2, "p", "stable", "i"), ("torn", 2, "p", None, "h"), ("less", 1, "p", "stable", "h")]
    source = made(spark, "cert string, path string, hash string", *((c, "p", "h") for c in (*certs, "less")))
    compared = replays.compare(attempts, made(spark, OUTPUTS, *out), source, traced=True)
    assert dict(rows(compared, "cert", "outcome")) == {"same": "byte_repeatable", "wrote": "byte_repeatable", "bare": "byte_repeatable", "slow": "replay_failed", "torn": "replay_failed"} | dict.fromkeys(("off", "less", "loud", "untraced"), "repeatability_mismatch")
    second = dict(rows(replays.attempt_outcomes(attempts, made(spark, OUTPUTS, *out)).where("attempt = 2"), "cert", "outcome"))
    assert second == dict.fromkeys(("same", "off", "less", "loud", "wrote", "untraced"), "succeeded") | {"slow": "timed_out", "torn": "output_missing_or_unstable"}
    one = lambda *x: spark.range(1).select(replays.attempt_outcome(*map(F.lit, x))).first()[0]
    assert [one(True, None, False), one(False, 3, True), one(False, 0, True)] == ["launch_error", "failed", "output_missing_or_unstable"]
    found = made(spark, "code string, cert string, detail string", ("REPLAY_INPUT_DRIFT", "bare", "f"))
    now = {r.cert: tuple(r)[1:] for r in replays.currentness(compared, found).collect()}
    assert [now[c] for c in ("same", "wrote", "bare", "off")] == [(True, True, True), (True, True, False), (False, False, False), (True, False, False)]


def test_replay_findings(spark):
    certs = made(spark, "cert string, run int, start_id string, finish_id string, computation string, contract string", ("ok", 1, "s", "f", "c", "k"), ("gone", 2, "s", "f", "c", "k"), ("moved", 3, "s", "f", "c", "k"))
    runs = made(spark, "run int, start_id string, finish_id string, outcome string, computation string, contract string", (1, "s", "f", "succeeded", "c", "k"), (3, "s", "f", "succeeded", "d", "old"))
    inputs = made(spark, "run int, path string, hash string", (1, "p", "h"), (3, "q", "h"), (3, "r", "h"))
    files = made(spark, "path string, hash string", ("p", "h"), ("q", "i"))
    found = rows(replays.findings(certs, runs, inputs, files, made(spark, "contract string", ("k",))), "cert", "code", "detail")
    assert [x for x in found if x[0] == "gone"] == [("gone", "REPLAY_CONTRACT_DRIFT", "none"), *(("gone", "REPLAY_SOURCE_STALE", d) for d in ("another computation or contract", "other events", "the run did not succeed"))]
    assert [x for x in found if x[0] == "moved"] == [("moved", "REPLAY_CONTRACT_DRIFT", "old"), ("moved", "REPLAY_INPUT_DRIFT", "q"), ("moved", "REPLAY_INPUT_DRIFT", "r"), ("moved", "REPLAY_SOURCE_STALE", "another computation or contract")]
    assert not [x for x in found if x[0] == "ok"]


def test_steps_of_a_closure(spark):
    pack = [
        {"id": "base", "when": [("edge", True, {"a": "?x", "b": "?y"})], "then": ("path", True, {"a": "?x", "b": "?y"})},
        {"id": "grow", "when": [("path", True, {"a": "?x", "b": "?y"}), ("edge", True, {"a": "?y", "b": "?z"})], "then": ("path", True, {"a": "?x", "b": "?z"})},
        {"id": "idle", "when": [("other", True, {"a": "?x"})], "then": ("path", True, {"a": "?x", "b": "?x"})},
    ]
    known = rules.fixpoint({("edge", True): made(spark, "a string, b string", ("1", "2"), ("2", "3"), ("1", "3"))}, pack)
    found = proofs.steps(known, pack)
    assert found.groupBy("rule").count().orderBy("rule").collect() == [("base", 3), ("grow", 1)]
    facts = {r.fact for r in proofs.facts_of(known).collect()}
    assert len(facts) == 6 and {f for r in found.collect() for f in (*r.premises, r.conclusion)} == facts
    with pytest.raises(ValueError):
        proofs.steps(known, pack[2:])


def brute(firings, inputs, goals, subjects):
    """The best proof over all sets of inputs and steps that derive the goals, by size and name."""
    best = None
    for n in range(len(firings) + 1):
        for chosen in itertools.combinations(range(len(firings)), n):
            used = sorted(f for f in inputs if any(f in firings[k][1] for k in chosen) or f in goals)
            have, left = set(used), [firings[k] for k in chosen]
            while ready := [s for s in left if set(s[1]) <= have]:
                have |= {s[2] for s in ready}
                left = [s for s in left if s not in ready]
            if left or not set(goals) <= have:
                continue
            rank = (sum(inputs[f][0] for f in used), len(subjects - set().union(*(inputs[f][1] for f in used))), n)
            best = rank if best is None or rank < best else best
    return best


def test_best_proofs_are_the_least(spark):
    """Facts with one or two rules each, in layers: the least proof is found among all sets of steps."""
    rng, firings, inputs, goals, want = random.Random(5), [], [], [], {}
    for d in range(12):
        given = {f"i{k}": (rng.random() < 0.5, {f"r{rng.randrange(3)}"}) for k in range(4)}
        own = [(f"rule{k}{j}", tuple(sorted(rng.sample([*given, *(f"m{x}" for x in range(k))], 2))), f"m{k}") for k in range(3) for j in range(2)]
        subjects = {"r0", "r1"}
        firings += [(d, r, list(p), c) for r, p, c in own]
        inputs += [(d, f, a, sorted(res)) for f, (a, res) in given.items()]
        goals.append((d, "m2", sorted(subjects)))
        want[d] = brute(own, given, ["m2"], subjects)
    goals += [(99, "none", []), (100, None, None)]
    found = proofs.best_proofs(made(spark, "derivation int, rule string, premises array<string>, conclusion string", *firings), made(spark, "derivation int, fact string, assumed boolean, results array<string>", *inputs), made(spark, "derivation int, fact string, subjects array<string>", *goals))
    got = {r.derivation: None if r.rules is None else (r.assumptions, r.uncovered, len(r.rules)) for r in found.collect()}
    assert got.pop(99) is None and got.pop(100) is None
    for d, rank in want.items():  # shared parts may make a whole proof shorter than its best parts, never better in assumptions
        assert got[d][0] >= rank[0] and got[d] >= rank
    assert sum(got[d] == rank for d, rank in want.items()) >= 10


def test_proofs_through_a_cycle_end(spark):
    firings = made(spark, "derivation int, rule string, premises array<string>, conclusion string", (1, "ab", ["a"], "b"), (1, "ba", ["b"], "a"), (1, "xa", ["x"], "a"), (1, "bb", ["b"], "b"))
    inputs = made(spark, "derivation int, fact string, assumed boolean, results array<string>", (1, "x", False, ["r"]), (1, "x", True, []))
    r = proofs.best_proofs(firings, inputs, made(spark, "derivation int, fact string, subjects array<string>", (1, "b", ["r"]))).first()
    assert (r.inputs, r.rules, r.conclusions, r.assumptions, r.uncovered) == (["x"], ["ab", "xa"], ["b", "a"], 0, 0)


def test_places_within_groups(spark):
    held = [("big", k) for k in range(500)] + [(None, k) for k in (3, 1, 2)] + [("one", 7)]
    random.Random(1).shuffle(held)
    found = search.numbered(made(spark, "kind string, n int", *held).repartition(7), "kind", "n")
    assert {tuple(r) for r in found.collect()} == {("big", k, k + 1) for k in range(500)} | {(None, k, k) for k in (1, 2, 3)} | {("one", 7, 1)}
    assert search.numbered(made(spark, "kind string, n int"), "kind", "n").count() == 0


def test_layers_leave_out_what_is_no_node(spark):
    nodes = made(spark, "id string", ("a",), ("b",), ("c",), ("d",))
    deps = made(spark, "up string, down string", ("a", "b"), ("b", "c"), ("a", "c"), ("c", "gone"), ("gone", "d"), ("a", "b"))
    assert rows(graph.layers(nodes, deps), "id", "layer") == [("a", 0), ("b", 1), ("c", 2), ("d", 0)]
    with pytest.raises(ValueError):
        graph.layers(nodes, deps.union(made(spark, "up string, down string", ("c", "a"))), max_rounds=9)
