"""Judgements, declarations, projections, releases and journals on small cases."""

import hashlib
import itertools
import random

from pyspark.sql import functions as F

from strandline.functions import canonical
from strandline.operators import assessments, checks, declarations, graph, projections, records, releases, vocabularies
from strandline.streaming import journals


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def made(spark, names, *values):
    return spark.createDataFrame(list(values), names)


def assessment(spark, verdict="supports_as_written", claim=(), result=(), **alignment):
    frame = lambda given: {d: dict(given).get(d) for d in assessments.DIMENSIONS}
    words = {d: alignment.get(d, "match") for d in assessments.DIMENSIONS}
    struct = "struct<" + ",".join(f"{d}:string" for d in assessments.DIMENSIONS) + ">"
    base = {"inference_level": "causal", "direction": "up"}
    return made(spark, f"id int, verdict string, state string, claim {struct}, result {struct}, alignment {struct}", (1, verdict, "accepted", frame(base | dict(claim)), frame(base | dict(result)), words))


def codes(frame):
    return rows(assessments.semantic_findings(frame), "code", "severity")


def test_semantic_findings(spark):
    assert codes(assessment(spark)) == []
    assert codes(assessment(spark, result={"inference_level": "associational"})) == [("ALIGNMENT_INCONSISTENT", "error"), ("CAUSAL_MODALITY_MISMATCH", "error")]
    assert codes(assessment(spark, claim={"inference_level": None})) == [("ALIGNMENT_INCONSISTENT", "error"), ("INFERENCE_LEVEL_INADEQUATE", "error")]
    assert codes(assessment(spark, "supports_narrower_claim", population="mismatch")) == [("CLAIM_SCOPE_MISMATCH", "warning")]
    assert codes(assessment(spark, "contradicts_as_written")) == [("CONTRADICTION_DIRECTION_NOT_ESTABLISHED", "error")]
    assert codes(assessment(spark, "contradicts_as_written", direction="mismatch")) == []
    assert codes(assessment(spark, magnitude="not_stated")) == [("CLAIM_ALIGNMENT_INCOMPLETE", "error")]
    assert codes(assessment(spark, result={"magnitude": "2"}, magnitude="not_stated")) == []
    assert codes(assessment(spark, claim={"direction": " "}, result={"magnitude": "2"}, magnitude="not_stated")) == [("CLAIM_ALIGNMENT_INCOMPLETE", "error")]


def test_derived(spark):
    docs = made(spark, "id int, verdict string, state string", (1, "supports_as_written", "accepted"), (2, "supports_narrower_claim", "accepted"), (3, "contradicts_as_written", "proposed"), (4, "supports_as_written", "accepted"), (5, "unrelated", "accepted"))
    found = made(spark, "id int, severity string, code string", (2, "error", "CLAIM_SCOPE_MISMATCH"), (4, "error", "ASSESSMENT_CONTESTED"), (5, "info", "ASSESSMENT_NOTE"))
    assert rows(assessments.derived(docs, found), "id", "effective_state", "proposed_relation", "active_relation", "acceptable") == [
        (1, "accepted", "supports", "supports", True), (2, "accepted", "related", None, True), (3, "proposed", "refutes", None, True), (4, "contested", None, None, False), (5, "accepted", None, None, True),
    ]


def test_method_without_alignments_and_steps(spark):
    docs = made(spark, "id int, contract int, method string, verdict string, state string", (1, 1, "m", "implements", "accepted"), (2, 1, "m", "contradicts", "accepted"), (3, 2, "m", "implements", "accepted"))
    alignments = made(spark, "id int, step string, stage string, alignment string", (3, "a", "s", "match"), (3, "b", "t", "partial"))
    stages = made(spark, "contract int, stage string, method string, step string", (1, "s", "m", "a"), (2, "s", "m", "a"), (2, "t", "m", "a"))
    steps = made(spark, "method string, step string, required boolean", ("m", "a", True), ("m", "b", False))
    found = assessments.method_findings(docs, alignments, stages, steps)
    assert rows(found, "id", "code", "detail") == [(2, "METHOD_VERDICT_ALIGNMENT_INCONSISTENT", "contradicts"), (3, "METHOD_IMPLEMENTATION_ALIGNMENT_INCOMPLETE", "implements"), (3, "METHOD_REQUIRED_STEP_MAPPING_INVALID", "a")]
    judged = assessments.method_derived(docs, alignments, found)
    assert rows(judged, "id", "eligible", "active_verdict", "implementation_current") == [(1, True, "implements", True), (2, False, None, False), (3, False, None, False)]


def test_method_stale(spark):
    names = "id int, source int, method int, code int, stages int, whole int"
    then = made(spark, names, (1, 1, 1, 1, 1, 1), (2, 1, 1, 1, 1, 1), (3, 1, 1, 1, 1, 1), (4, 1, 1, 1, 1, 1))
    now = made(spark, names, (1, 1, 1, 1, 1, 1), (2, 2, 1, 1, 2, 9), (3, 1, 1, 1, 1, 9))
    assert rows(assessments.method_stale(then, now), "id", "detail") == [(2, "source, stages"), (3, "another dependency"), (4, "unavailable")]


def test_carried_is_brute_force(spark):
    """The least and the largest seed above each node, cycles and repeated edges included."""
    draw = random.Random(5)
    links = [(draw.randrange(30), draw.randrange(30)) for _ in range(45)]
    seeds = {draw.randrange(30): draw.randrange(9) for _ in range(8)}
    above = {n: set() for n in range(30)}
    for start in seeds:
        front, seen = {start}, set()
        while front:
            front = {b for a, b in links if a in front} - seen
            seen |= front
        for node in seen:
            above[node].add(seeds[start])
    deps = made(spark, "up string, down string, rel string", *((str(a), str(b), "cites") for a, b in links + links[:5]))
    given = made(spark, "id string, best int", *((str(k), v) for k, v in seeds.items()))
    assert rows(graph.carried(given, deps), "id", "best") == sorted((str(n), min(v)) for n, v in above.items() if v)
    assert rows(graph.carried(given, deps, largest=True), "id", "best") == sorted((str(n), max(v)) for n, v in above.items() if v)
    assert graph.carried(given.limit(0), deps).count() == 0


def test_stale_render_takes_live_inputs(spark):
    nodes = made(spark, "id string, type string, status string", ("raw", "data", None), ("old", "data", "deprecated"), ("note", "doc", "current"), ("fig", "figure", "current"), ("mid", "artifact", "current"))
    deps = made(spark, "up string, down string, rel string", ("raw", "mid", "produces"), ("mid", "fig", "renders"), ("old", "fig", "renders"), ("note", "fig", "cites"))
    stale = lambda raw: rows(checks.stale_render(nodes.where("type = 'figure'").select("id"), nodes, deps, made(spark, "id string, mtime double", ("raw", raw), ("old", 99.0), ("note", 99.0), ("fig", 10.0), ("mid", 5.0))), "node_id", "detail")
    assert stale(12.0) == [] and stale(12.5) == [("fig", "raw")]


def test_declarations(spark):
    assert rows(declarations.overlapping_roles(made(spark, "id int, role string, value string", (1, "code", "x"), (1, "input", "x"), (1, "code", "y"), (1, "code", "y"))), "value", "roles") == [("x", "code,input")]
    twice = declarations.overlapping_roles(made(spark, "id int, role string, value string", (1, "code", "y"), (1, "code", "y"), (2, "code", "y")), within=True)
    assert rows(twice, "id", "value") == [(1, "y")]
    requests = made(spark, "id int, base_hash string", (1, "h"), (2, "h"), (3, None))
    changes = made(spark, "id int, operation string, key string", (1, "add_nodes", "a"), (1, "remove_nodes", "a"), (1, "add_edges", "a"), (3, "set_concepts", "a"), (3, "set_concepts", "a"), (3, "rename", "a"))
    assert rows(declarations.change_issues(requests, changes, "h", 2), "code", "id") == [("BASE_CHANGED", 3), ("EMPTY_REQUEST", 2), ("OVERLAPPING_OPERATIONS", 1), ("REPEATED_OPERATION", 3), ("TOO_MANY_OPERATIONS", 1), ("TOO_MANY_OPERATIONS", 3), ("UNKNOWN_OPERATION", 3)]


SOUND = {
    "pos": ("positive", "derivable", ["a:1:kg", "b:1:"]), "neg": ("explicit_negative", "refutable", ["c:1:"]), "miss": ("missing_premise", "unknown", ["b:1:"]), "edge": ("boundary", "refutable", ["a:2:kg", "b:1:"]),
    "unit": ("unit_mismatch", "input_rejected", ["a:1:g", "b:1:"]), "both": ("conflict", "conflict", ["a:1:kg", "b:1:", "c:1:"]), "counter": ("counterexample", "refutable", ["c:1:", "a:3:kg"]),
}


def competency(spark, cases):
    given = [("p", name, category, "t", state, state, not any("~" in a for a in held)) for name, (category, state, held) in cases.items()]
    atoms = [("p", name, atom, atom.split(":")[0], atom.rsplit(":", 1)[0], "~" not in atom) for name, (_, _, held) in cases.items() for atom in held]
    found = declarations.competency_issues(made(spark, "pack string, id string, category string, target string, expected string, observed string, terms boolean", *given), made(spark, "pack string, id string, atom string, predicate string, unitless string, terms boolean", *atoms))
    return [tuple(r) for r in rows(found, "code", "detail")]


def relations(cases):
    """The same rules on sets, in plain Python."""
    held = {n: set(a) for n, (_, _, a) in cases.items()}
    of = lambda kind: [n for n, c in cases.items() if c[0] == kind]
    pos, neg = of("positive"), of("explicit_negative")
    found = []
    for n in of("missing_premise"):
        found += [("NOT_A_MISSING_PREMISE", n)] * (not any(held[n] < held[p] for p in pos))
    for n in of("boundary"):
        found += [("NOT_A_BOUNDARY", n)] * (not any(len(held[n]) == len(held[p]) and len(held[n] ^ held[p]) == 2 for p in pos))
    for n in of("conflict"):
        found += [("NOT_A_CONFLICT", n)] * (not any(held[p] | held[q] == held[n] for p in pos for q in neg))
    for n in of("unit_mismatch"):
        one = lambda p: sum(a != b for a, b in zip(sorted(held[n]), sorted(held[p]))) == 1 and sorted(x.rsplit(":", 1)[0] for x in held[n]) == sorted(x.rsplit(":", 1)[0] for x in held[p])
        found += [("NOT_A_UNIT_MISMATCH", n)] * (not any(len(held[n]) == len(held[p]) and one(p) for p in pos))
    for n in of("counterexample"):
        fits = any(held[q] < held[n] and {a.split(":")[0] for a in held[n] - held[q]} <= {a.split(":")[0] for a in held[p]} for p, q in itertools.product(pos, neg))
        found += [("NOT_A_COUNTEREXAMPLE", n)] * (not fits)
    return found


def test_competency_cases(spark):
    assert competency(spark, SOUND) == []
    assert competency(spark, {k: v for k, v in SOUND.items() if k != "unit"}) == [("CATEGORY_ABSENT", "unit_mismatch")]
    assert competency(spark, SOUND | {"pos2": ("positive", "unknown", ["a:1:kg", "b:1:"])}) == [("CASE_RELABELLED", "pos"), ("EXPECTED_STATE_INVALID", "pos2")]
    assert ("NOT_A_BOUNDARY", "edge") in competency(spark, SOUND | {"edge": ("boundary", "refutable", ["a:2:kg~", "b:1:"])})
    assert ("CASE_WITHOUT_INPUTS", "neg") in competency(spark, SOUND | {"neg": ("explicit_negative", "refutable", [])})


def test_competency_is_brute_force(spark):
    draw = random.Random(11)
    pool = [f"{p}:{v}:{u}" for p in "abc" for v in "12" for u in ("kg", "g")]
    cases = {}
    for kind, (state, *_) in declarations.CASES.items():
        for n in range(6 if kind in ("positive", "explicit_negative") else 25):
            cases[f"{kind}{n}"] = (kind, state, draw.sample(pool, draw.randrange(1, 5)))
    wanted = sorted(relations(cases))
    got = [x for x in competency(spark, cases) if x[0].startswith("NOT_A")]
    assert got == wanted and len({c for c, _ in wanted}) == 5 and len(wanted) < 125


def test_projection(spark):
    nodes = made(spark, "id string, kind string", ("b", "run"), ("a", "finding"), ("c", "semantic"), ("d", "odd"))
    assert [r.id for r in projections.in_order(nodes).collect()] == ["c", "b", "a", "d"]
    edges = made(spark, "src string, dst string, rel string, kind string", ("a", "b", "cites", "semantic"), ("a", "b", "cites", "semantic"), ("a", "x", "cites", "run_binding"), ("y", "x", "cites", "proof"))
    assert rows(projections.resolved(edges, nodes), "src", "dst") == [("a", "b")]
    assert rows(projections.unresolved(edges, nodes), "owner_id", "missing_id", "edge_kind") == [("a", "x", "run_binding"), ("y", "x", "proof"), ("y", "y", "proof")]
    ids = rows(projections.with_edge_ids(edges), "edge_id")
    assert len(set(ids)) == 3


def test_labels_and_matches(spark):
    names = made(spark, "term string, kind string, text string, language string", ("t", "preferred_label", "Haus", "de"), ("t", "synonym", "house", "en"), ("t", "iri", "x:House", None), ("u", "synonym", "HOUSE", None))
    labels = names.select("term", "text", "language")
    assert rows(projections.display_labels(labels.where("text <> 'x:House'"), "de"), "term", "text") == [("t", "Haus"), ("u", "HOUSE")]
    asked = made(spark, "query string", (" House ",), ("x:House",), ("x:house",))
    assert rows(projections.matches(asked, names), "query", "term", "tier") == [(" House ", "t", 2), (" House ", "u", 2), ("x:House", "t", 0)]


def test_release(spark):
    digest = "0" * 64
    names = "at long, location string, path string, roles array<string>, ids array<string>, sha256 string, size long"
    files = made(spark, names, (1, "project", "a", ["config"], [], digest, 1), (2, "project", "b", ["graph"], [], digest, 1))
    counts, stores = made(spark, "role string, n long", ("config", 1), ("graph", 1)), made(spark, "at long, role string, records long", (1, "event", 0))
    assert rows(releases.issues(files, stores, counts), "code") == []
    bad = files.union(made(spark, names, (3, "project", "b", ["graph", "graph"], [], "x", None)))
    assert rows(releases.issues(bad, stores, counts, required=("policy",)), "code") == [("FILES_OUT_OF_ORDER",), ("FILE_MALFORMED",), ("ROLES_NOT_CANONICAL",), ("ROLE_COUNT_MISMATCH",), ("ROLE_NOT_SINGLE",), ("STORE_MISSING",)]
    assert releases.verified(files, files).first().valid
    assert tuple(releases.verified(files, files.where("at = 1").withColumn("size", F.lit(2).cast("long"))).first()) == (0, 1, 1, False)


def test_journal_over_batches_is_one_batch(spark, tmp_path):
    """Files that come one after another: the state carries on, and a restart adds only what is new."""
    parents = {"a": (), "b": ("a",), "c": ("a", "b")}
    draw = random.Random(3)
    events = [(draw.randrange(6), draw.choice("abcx"), at, at) for at in range(120)]
    schema = "run_id long, stage string, at long, event_id long"
    accepted, wanted = {}, []
    for run, stage, at, event in events:
        if stage not in parents:
            state = "unknown"
        elif (run, stage) in accepted:
            state = "repeated"
        elif all((run, p) in accepted for p in parents[stage]):
            state, accepted[run, stage] = "accepted", at
        else:
            state = "out_of_order"
        wanted.append((run, stage, at, event, state))
    source, path = str(tmp_path / "in"), f"file://{tmp_path}/journal"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    for part in range(4):
        made(spark, schema, *events[part * 30 : part * 30 + 30]).coalesce(1).write.mode("append").parquet(source)
        if part in (1, 3):
            found = journals.stage_journal(stream(), parents, path)
            assert rows(found, "run_id", "stage", "at", "event_id", "state") == sorted(wanted[: part * 30 + 30])


VOCABULARY = {
    "types": ("vocabulary string, id string, base string", [("v", "mass", "ct:decimal")]),
    "units": ("vocabulary string, unit string", [("v", "kg")]),
    "predicates": ("vocabulary string, id string, kind string", [("v", "weighs", "input"), ("v", "heavy", "derived"), ("v", "named", "input")]),
    "arguments": ("vocabulary string, predicate string, name string, type string, unit string", [("v", "weighs", "who", "ct:symbol", None), ("v", "weighs", "much", "mass", "kg"), ("v", "heavy", "who", "ct:symbol", None), ("v", "named", "who", "ct:symbol", None), ("v", "named", "flag", "ct:boolean", None)]),
}


def rule_issues(spark, atoms, terms, constraints=()):
    side = "struct<var:string,type:string,value:string,unit:string>"
    tables = [made(spark, names, *values) for names, values in VOCABULARY.values()]
    given = lambda names, values: spark.createDataFrame([("v", "r", *x) for x in values], f"vocabulary string, rule string, {names}")
    found = vocabularies.rule_issues(*tables, given("at int, head boolean, predicate string, polarity string", atoms), given("at int, name string, var string, type string, value string, unit string", terms), given(f"op string, left {side}, right {side}", constraints))
    return [tuple(r) for r in rows(found, "code", "detail")]


def test_rule_issues(spark):
    atoms = [(0, True, "heavy", "positive"), (1, False, "weighs", "positive"), (2, False, "named", "negative")]
    terms = [(0, "who", "x", None, None, None), (1, "who", "x", None, None, None), (1, "much", "m", None, None, None), (2, "who", "x", None, None, None), (2, "flag", None, "ct:boolean", "true", None)]
    var, const = lambda name: (name, None, None, None), lambda *x: (None, *x)
    assert rule_issues(spark, atoms, terms, [("gte", var("m"), const("mass", "5", "kg"))]) == []
    assert rule_issues(spark, atoms, terms, [("gte", var("m"), const("ct:decimal", "5", "kg")), ("lt", var("x"), const("ct:symbol", "b", None)), ("near", var("z"), const("odd", "5", "lb"))]) == [
        ("COMPARATOR_UNKNOWN", "r near"), ("COMPARISON_NOT_NUMERIC", "r lt"), ("CONSTRAINT_KINDS_DIFFER", "r gte"), ("CONSTRAINT_TYPE_UNKNOWN", "r odd"), ("CONSTRAINT_UNIT_UNKNOWN", "r lb"), ("CONSTRAINT_VARIABLE_UNBOUND", "r z"),
    ]
    assert rule_issues(spark, atoms, terms[:4] + [(2, "flag", None, "ct:boolean", "yes", None)]) == [("CONSTANT_VALUE_INVALID", "r 2 flag")]
    assert rule_issues(spark, atoms, terms[:4] + [(2, "flag", None, "ct:string", "true", None)]) == [("CONSTANT_KIND_DIFFERS", "r 2 flag")]
    assert rule_issues(spark, atoms, terms[:4]) == [("RULE_ARGUMENTS_DIFFER", "r 2 flag")]
    assert rule_issues(spark, atoms, [*terms, (1, "why", "x", None, None, None)]) == [("RULE_ARGUMENTS_DIFFER", "r 1 why")]
    assert rule_issues(spark, atoms, [(0, "who", "q", None, None, None), *terms[1:]]) == [("VARIABLE_UNBOUND", "r q")]
    assert rule_issues(spark, atoms, [*terms[:2], (1, "much", "x", None, None, None), *terms[3:]]) == [("VARIABLE_OF_SEVERAL_KINDS", "r x")]
    assert rule_issues(spark, [(0, True, "weighs", "positive"), atoms[1]], [(0, "who", "x", None, None, None), (0, "much", "m", None, None, None), *terms[1:3]]) == [("RULE_HEAD_NOT_DERIVED", "r weighs")]
    assert rule_issues(spark, [(0, True, "lost", "maybe")], []) == [("RULE_POLARITY_INVALID", "r 0"), ("RULE_PREDICATE_UNKNOWN", "r lost"), ("RULE_WITHOUT_BODY", "r")]


def test_records(spark):
    shape = records.Shape("note", ("kind", "body"), allowed={"kind": ("a",)}, arrays=("body",))
    digest = hashlib.sha256(canonical.canonical('{"kind":"a","body":[]}').encode()).hexdigest()
    sound = f'{{"id": "note:sha256:{digest}", "kind": "a", "body": []}}'
    store = made(spark, "name string, text string", (f"{digest}.json", sound), ("x.json", sound), ("y", "[]"), ("z", None), ("w", '{"id": 5, "kind": 1, "body": {}}'))
    assert rows(records.issues(store, shape), "code", "name") == sorted([
        ("ID_REPEATED", f"{digest}.json"), ("NAME_DIFFERS", "x.json"), ("INVALID_JSON", "z"), ("NOT_AN_OBJECT", "y"), ("VALUE_NOT_ALLOWED", "y"), ("NOT_AN_ARRAY", "y"), ("ID_MALFORMED", "y"),
        ("VALUE_NOT_ALLOWED", "w"), ("NOT_AN_ARRAY", "w"), ("ID_MALFORMED", "w"),
    ])
