"""Registered queries over judgements, declarations, projections, releases and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import assessments, declarations, projections, records, releases, vocabularies
from strandline.plans.registry import _LINE, GRAPH, _line, query
from strandline.sources import tables as t
from strandline.sources.scratch import scratch_path
from strandline.streaming import journals, pairing


def _of(df, **columns):
    return df.select(*(F.expr(e).alias(name) for name, e in columns.items()))


# -- judgements of claims: each order line is one ----------------------------------------

_ID, _LEVEL = "l_orderkey * 10 + l_linenumber", "CASE {} % 6 WHEN 0 THEN 'descriptive' WHEN 1 THEN 'associational' WHEN 2 THEN 'predictive' WHEN 3 THEN 'causal' WHEN 4 THEN 'mechanistic' ELSE 'not_stated' END"
_WORD = "CASE WHEN (l_partkey + {0} * l_suppkey) % 40 < 36 THEN 'match' WHEN (l_partkey + {0} * l_suppkey) % 40 = 37 THEN 'partial' WHEN (l_partkey + {0} * l_suppkey) % 40 = 38 THEN 'mismatch' ELSE 'not_stated' END"
_VERDICT = "CASE l_linenumber % 4 WHEN 0 THEN 'supports_as_written' WHEN 1 THEN 'supports_narrower_claim' WHEN 2 THEN 'contradicts_as_written' ELSE 'unrelated' END"
_STATE = "CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'proposed' ELSE 'contested' END"
_FRAME = {"direction": "CASE WHEN l_quantity > 3 THEN l_returnflag ELSE ' ' END", "magnitude": "CASE WHEN l_linenumber > 4 THEN 'large' END", "inference_level": _LEVEL.format("(l_suppkey // 3)")}
_MODE = "CASE l_suppkey % 4 WHEN 0 THEN 'MAIL' WHEN 1 THEN 'REG AIR' WHEN 2 THEN 'RAIL' ELSE 'rail' END"
_RESULT = {"direction": "l_linestatus", "magnitude": f"CASE WHEN l_tax > 0.01 THEN {_MODE} END", "inference_level": _LEVEL.format("(l_partkey // 2)")}
_DIRECTION = "CASE WHEN l_linenumber % 4 = 2 AND l_suppkey % 5 > 0 THEN 'mismatch' ELSE " + _WORD.format(5) + " END"
_ALIGN = {d: _DIRECTION if d == "direction" else _WORD.format(n) for n, d in enumerate(assessments.DIMENSIONS, 1)}
_STRICT = "verdict IN ('supports_as_written', 'contradicts_as_written')"

_JUDGED = f"""{_LINE}, docs AS (SELECT {_ID} AS id, {_VERDICT} AS verdict, {_STATE} AS state, {', '.join(f'{e} AS c_{n}' for n, e in _FRAME.items())}, {', '.join(f'{e} AS r_{n}' for n, e in _RESULT.items())}, {', '.join(f'{e} AS {n}' for n, e in _ALIGN.items())} FROM line),
levels AS (SELECT *, {_STRICT} AS strict, CASE WHEN {_STRICT} THEN 'error' ELSE 'warning' END AS grave, verdict = 'contradicts_as_written' AS against,
  list_contains(CASE c_inference_level WHEN 'descriptive' THEN ['descriptive', 'associational', 'predictive', 'causal', 'mechanistic'] WHEN 'associational' THEN ['associational', 'predictive', 'causal', 'mechanistic'] WHEN 'predictive' THEN ['predictive']
    WHEN 'causal' THEN ['causal', 'mechanistic'] WHEN 'mechanistic' THEN ['mechanistic'] ELSE [] END, r_inference_level) AS adequate, concat_ws(' ', r_inference_level, 'evidence for a', c_inference_level, 'claim') AS weak FROM docs),
words AS (SELECT id, unnest(['population', 'exposure', 'comparator', 'outcome', 'direction', 'magnitude', 'time_scope', 'inference_level']) AS d, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS k, unnest([population, exposure, comparator, outcome, direction, magnitude, time_scope, inference_level]) AS w FROM docs),
scope AS (SELECT l.id, any_value(grave) AS grave, string_agg(d, ', ' ORDER BY k) AS detail FROM words JOIN levels l USING (id) WHERE w = 'mismatch' AND d <> 'inference_level' AND NOT (against AND d = 'direction') GROUP BY l.id),
partly AS (SELECT l.id, any_value(grave) AS grave, string_agg(d, ', ' ORDER BY k) AS detail FROM words JOIN levels l USING (id) WHERE w IN ('partial', 'not_stated')
  AND NOT (d = 'magnitude' AND w = 'not_stated' AND c_magnitude IS NULL AND r_magnitude IS NOT NULL AND trim(c_direction) <> '' AND trim(r_direction) <> '' AND (l.direction = 'match' OR against AND l.direction = 'mismatch')) GROUP BY l.id),
findings AS (SELECT id, grave AS severity, CASE WHEN c_inference_level IN ('causal', 'mechanistic') THEN 'CAUSAL_MODALITY_MISMATCH' ELSE 'INFERENCE_LEVEL_INADEQUATE' END AS code, weak AS detail FROM levels WHERE NOT adequate
  UNION ALL SELECT id, grave, 'INFERENCE_LEVEL_MISMATCH', 'declared' FROM levels WHERE adequate AND inference_level = 'mismatch'
  UNION ALL SELECT id, 'error', 'ALIGNMENT_INCONSISTENT', 'a match despite inadequate evidence' FROM levels WHERE NOT adequate AND inference_level = 'match'
  UNION ALL SELECT id, 'error', 'CONTRADICTION_DIRECTION_NOT_ESTABLISHED', 'no direction mismatch' FROM levels WHERE against AND direction <> 'mismatch'
  UNION ALL SELECT id, grave, 'CLAIM_SCOPE_MISMATCH', detail FROM scope UNION ALL SELECT id, grave, 'CLAIM_ALIGNMENT_INCOMPLETE', detail FROM partly)"""

_HASH = "l_partkey % 17 + l_linenumber"
_STORED = f"""stored AS (SELECT {_ID} AS id, 'claim node' AS part, l_orderkey AS node, l_orderkey % 3 AS hash FROM line UNION ALL SELECT {_ID}, 'result node', l_partkey, 1 FROM line UNION ALL SELECT {_ID}, 'result artifact', l_partkey, l_partkey % 5 FROM line),
now AS (SELECT 'claim node' AS part, o_orderkey AS node, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE o_orderkey % 3 END AS hash FROM orders WHERE o_totalprice > 2000 UNION ALL SELECT 'result node', p_partkey, 1 FROM part WHERE p_size > 1
  UNION ALL SELECT 'result artifact', p_partkey, CASE WHEN p_size = 50 THEN -1 ELSE p_partkey % 5 END FROM part),
old AS (SELECT id, 'error' AS severity, 'ASSESSMENT_STALE' AS code, string_agg(s.part || CASE WHEN n.node IS NULL THEN ' unavailable: ' ELSE ' changed: ' END || s.node, '; ' ORDER BY s.part || CASE WHEN n.node IS NULL THEN ' unavailable: ' ELSE ' changed: ' END || s.node) AS detail
  FROM stored s LEFT JOIN now n ON n.part = s.part AND n.node = s.node WHERE n.hash IS DISTINCT FROM s.hash GROUP BY id)"""


def _spark_sql(text: str) -> str:
    return text.replace("//", "DIV")


def _documents(s, d):
    parts = lambda columns: "named_struct(" + ", ".join(f"'{n}', {_spark_sql(e)}" for n, e in columns.items()) + ")"
    return _of(_line(s, d), id=_ID, verdict=_VERDICT, state=_STATE, subject="l_partkey", claim=parts(_FRAME), result=parts(_RESULT), alignment=parts(_ALIGN))


def _stale(s, d):
    line, orders, part = _line(s, d), t.table(s, d, "orders"), t.table(s, d, "part")
    stored = _of(line, id=_ID, part="'claim node'", node="l_orderkey", hash="l_orderkey % 3").union(_of(line, id=_ID, part="'result node'", node="l_partkey", hash="1L")).union(_of(line, id=_ID, part="'result artifact'", node="l_partkey", hash="l_partkey % 5"))
    now = _of(orders.where("o_totalprice > 2000"), part="'claim node'", node="o_orderkey", hash="if(o_orderstatus = 'P', -1, o_orderkey % 3)").union(_of(part.where("p_size > 1"), part="'result node'", node="p_partkey", hash="1L"))
    return assessments.stale(stored, now.union(_of(part, part="'result artifact'", node="p_partkey", hash="if(p_size = 50, -1, p_partkey % 5)")))


@query(f"WITH {_JUDGED} SELECT * FROM findings")
def assessment_findings(s, d):
    return assessments.semantic_findings(_documents(s, d))


@query(f"WITH {_LINE}, {_STORED} SELECT * FROM old")
def assessment_stale(s, d):
    return _stale(s, d)


@query(f"""WITH {_JUDGED}, {_STORED}, accepted AS (SELECT {_ID} AS id, l_partkey AS subject, {_VERDICT} AS verdict FROM line WHERE {_STATE} = 'accepted'),
split AS (SELECT subject FROM accepted GROUP BY 1 HAVING count(DISTINCT verdict) > 1), f AS (SELECT id, severity, code FROM findings UNION ALL SELECT id, severity, code FROM old UNION ALL SELECT id, 'error', 'ASSESSMENT_CONTESTED' FROM accepted WHERE subject IN (FROM split)),
y AS (SELECT docs.id, verdict, state, bool_or(severity = 'error') IS TRUE AS e, bool_or(severity = 'error' AND code IN ('EVIDENCE_ANCHOR_INVALID', 'ASSESSMENT_STALE', 'ASSESSMENT_CONTESTED', 'ASSESSMENT_STORE_INTEGRITY', 'ALIGNMENT_INCONSISTENT')) IS TRUE AS h,
  bool_or(code = 'ASSESSMENT_STALE') IS TRUE AS stale, bool_or(code = 'ASSESSMENT_CONTESTED') IS TRUE AS split FROM docs LEFT JOIN f ON f.id = docs.id GROUP BY ALL),
z AS (SELECT *, CASE WHEN verdict = 'supports_as_written' AND NOT e THEN 'supports' WHEN verdict = 'supports_narrower_claim' AND NOT h THEN 'related' WHEN verdict = 'contradicts_as_written' AND NOT e THEN 'refutes' END AS p, CASE WHEN split THEN 'contested' ELSE state END AS now FROM y)
SELECT id, now AS effective_state, p AS proposed_relation, CASE WHEN now = 'accepted' AND NOT e THEN p END AS active_relation, stale, NOT CASE WHEN {_STRICT} THEN e ELSE h END AS acceptable FROM z""")
def assessment_derived(s, d):
    docs = _documents(s, d)
    findings = assessments.semantic_findings(docs).union(_stale(s, d)).union(assessments.contested(docs.select("id", "subject", "verdict", "state")))
    return assessments.derived(docs, findings)


# -- judgements of methods: an order is one, its lines are stages -------------------------

_METHOD_VERDICT = "CASE o_orderkey % 3 WHEN 0 THEN 'implements' WHEN 1 THEN 'partially_implements' ELSE 'contradicts' END"
_MATCH = "CASE WHEN l_returnflag = 'R' AND l_quantity > 30 THEN 'mismatch' WHEN l_tax >= 0.08 THEN 'partial' ELSE 'match' END"
_HASHES = {"source": "o_custkey % 7", "method": "o_custkey % 5", "code": "length(o_orderpriority)", "stages": "o_orderkey % 4"}
_METHODS = f"""{_LINE}, docs AS (SELECT o_orderkey AS id, o_orderkey AS contract, o_orderstatus AS method, {_METHOD_VERDICT} AS verdict, CASE WHEN o_orderpriority < '4' THEN 'accepted' ELSE 'proposed' END AS state, o_custkey AS subject FROM orders),
alignments AS (SELECT l_orderkey AS id, l_linenumber % 4 AS step, l_linenumber AS stage, {_MATCH} AS alignment FROM line), stages AS (SELECT l_orderkey AS contract, l_linenumber AS stage, o_orderstatus AS method, l_linenumber % 4 AS step FROM line JOIN orders ON o_orderkey = l_orderkey),
steps AS (SELECT m AS method, k AS step, k = CASE m WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 9 END AS required FROM (VALUES ('O'), ('F'), ('P')) a(m), (VALUES (0), (1), (2), (3), (9)) b(k)),
due AS (SELECT docs.id, step, (SELECT count(*) FROM stages x WHERE x.contract = docs.contract AND x.method = docs.method AND x.step = steps.step) AS n FROM docs JOIN steps USING (method) WHERE required),
w AS (SELECT docs.id, verdict, coalesce(bool_and(alignment = 'match'), true) AS m, coalesce(bool_or(alignment = 'mismatch'), false) AS x FROM docs LEFT JOIN alignments USING (id) GROUP BY ALL),
findings AS (SELECT id, 'error' AS severity, 'METHOD_REQUIRED_STEP_MAPPING_INVALID' AS code, string_agg(step, ', ' ORDER BY step) AS detail FROM due WHERE n <> 1 GROUP BY id
  UNION ALL SELECT id, 'error', 'METHOD_IMPLEMENTATION_ALIGNMENT_INCOMPLETE', verdict FROM w WHERE verdict = 'implements' AND NOT m
  UNION ALL SELECT id, 'error', 'METHOD_VERDICT_ALIGNMENT_INCONSISTENT', verdict FROM w WHERE verdict = 'partially_implements' AND m OR verdict = 'contradicts' AND NOT x),
changed AS (SELECT id, 'error' AS severity, 'METHOD_CONFORMANCE_STALE' AS code, CASE WHEN z = 1 THEN 'unavailable' WHEN z = 2 THEN 'another dependency' ELSE concat_ws(', ', CASE WHEN z = 3 THEN 'source' END, 'code') END AS detail FROM (SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 50 = 7 THEN 1 WHEN o_orderkey % 50 = 14 THEN 2 WHEN o_orderkey % 50 = 21 THEN 3 WHEN o_orderkey % 50 = 28 THEN 4 ELSE 0 END AS z FROM orders) WHERE z > 0),
split AS (SELECT subject FROM docs WHERE state = 'accepted' GROUP BY 1 HAVING count(DISTINCT verdict) > 1), f AS (SELECT * FROM findings UNION ALL SELECT * FROM changed UNION ALL SELECT id, 'error', 'METHOD_ASSESSMENT_CONTESTED', '' FROM docs WHERE state = 'accepted' AND subject IN (FROM split)),
y AS (SELECT docs.id, docs.verdict, docs.state, any_value(m) AS m, bool_or(severity = 'error') IS TRUE AS e, bool_or(code = 'METHOD_ASSESSMENT_CONTESTED') IS TRUE AS c, bool_or(code = 'METHOD_CONFORMANCE_STALE') IS TRUE AS stale FROM docs JOIN w USING (id) LEFT JOIN f ON f.id = docs.id GROUP BY ALL),
derived AS (SELECT id, CASE WHEN c THEN 'contested' ELSE state END AS effective_state, verdict = 'implements' AND m AND NOT e AS eligible, CASE WHEN state = 'accepted' AND NOT c AND NOT e THEN verdict END AS active_verdict, verdict = 'implements' AND state = 'accepted' AND NOT c AND m AND NOT e AS implementation_current, stale FROM y)"""


def _methods(s, d):
    orders, line = t.table(s, d, "orders"), _line(s, d)
    stages = _of(line.join(orders, F.expr("o_orderkey = l_orderkey")), contract="l_orderkey", stage="l_linenumber", method="o_orderstatus", step="l_linenumber % 4")
    steps = s.createDataFrame([(m, k, k == r) for m, r in (("O", 1), ("F", 2), ("P", 9)) for k in (0, 1, 2, 3, 9)], "method string, step int, required boolean")
    docs = _of(orders, id="o_orderkey", contract="o_orderkey", method="o_orderstatus", verdict=_METHOD_VERDICT, state="if(o_orderpriority < '4', 'accepted', 'proposed')", subject="o_custkey")
    alignments = _of(line, id="l_orderkey", step="l_linenumber % 4", stage="l_linenumber", alignment=_MATCH)
    whole = _of(orders, id="o_orderkey", **_HASHES, whole="o_orderkey % 11")
    later = lambda n, c: F.when((F.col("id") % 50).isin(*n), -1).otherwise(F.col(c)).alias(c)
    now = whole.where("id % 50 <> 7").select("id", later((21,), "source"), "method", later((21, 28), "code"), "stages", later((14, 21, 28), "whole"))
    findings = assessments.method_findings(docs, alignments, stages, steps)
    more = assessments.method_stale(whole, now).union(assessments.contested(docs, "METHOD_ASSESSMENT_CONTESTED"))
    return docs, alignments, stages, findings, more


@query(f"WITH {_METHODS} SELECT * FROM findings UNION ALL SELECT * FROM changed")
def method_findings(s, d):
    _, _, _, findings, more = _methods(s, d)
    return findings.union(more.where("code = 'METHOD_CONFORMANCE_STALE'"))


@query(f"WITH {_METHODS} SELECT * FROM derived")
def method_derived(s, d):
    docs, alignments, _, findings, more = _methods(s, d)
    return assessments.method_derived(docs, alignments, findings.union(more))


@query(f"""WITH {_METHODS} SELECT contract, stage, bool_and(EXISTS (SELECT 1 FROM derived v JOIN docs o ON o.id = v.id JOIN alignments a ON a.id = v.id WHERE implementation_current AND o.contract = s.contract AND o.method = s.method AND a.stage = s.stage AND a.step = s.step AND alignment = 'match')) AS covered
FROM stages s GROUP BY ALL""")
def method_stage_coverage(s, d):
    docs, alignments, stages, findings, more = _methods(s, d)
    judged = assessments.method_derived(docs, alignments, findings.union(more)).join(docs.select("id", "contract", "method"), "id")
    return assessments.stage_coverage(stages, judged, alignments)


@query(f"""WITH {_LINE}, k AS (SELECT l_orderkey AS run, l_linenumber, l_discount < 0.05 AS role, l_tax > 0.005 AND l_quantity > 1 AND l_returnflag || l_linestatus <> 'AF' AS ok FROM line),
r AS (SELECT run, bool_and(ok) AS ok FROM k WHERE role GROUP BY run) SELECT DISTINCT k.run, CASE WHEN r.ok IS NULL THEN 'not_required' WHEN r.ok THEN 'current' ELSE 'missing_or_stale' END AS state FROM k LEFT JOIN r USING (run)""")
def claim_intermediates(s, d):
    line = _line(s, d).withColumn("path", F.concat_ws("/", "l_orderkey", "l_linenumber")).withColumn("sha", F.sha2("path", 256))
    roles = _of(line.where("l_discount < 0.05"), run="l_orderkey", node="l_linenumber", path="path")
    receipts = _of(line.where("l_tax > 0.005"), run="l_orderkey", node="l_linenumber", path="path", state="if(l_quantity > 1, 'stable', 'changed')", sha256="sha", version="concat('file:sha256:', sha)", size="l_partkey", current="concat(l_returnflag, l_linestatus) <> 'AF'")
    return assessments.intermediates(_of(line, run="l_orderkey", node="l_linenumber"), roles, receipts)


@query("SELECT l_partkey AS proof, min(l_orderkey) AS derivation, count(DISTINCT l_orderkey) AS derivations FROM lineitem GROUP BY 1")
def proof_groups(s, d):
    return assessments.proof_groups(_of(t.table(s, d, "lineitem"), proof="l_partkey", derivation="l_orderkey"))


# -- declarations ------------------------------------------------------------------------

_STEPS = """n AS (SELECT 'p' || p_partkey AS id, CASE WHEN p_size < 45 THEN 'method' ELSE 'code' END AS type, CASE p_size % 5 WHEN 0 THEN 'stale' WHEN 1 THEN 'current' WHEN 2 THEN 'confirmed' END AS status FROM part UNION ALL SELECT 'o' || o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'data' ELSE 'claim' END, CASE WHEN o_orderpriority < '3' THEN 'planned' END FROM orders),
steps AS (SELECT 'p' || ps AS id, CASE WHEN k = 3 AND ps % 9 = 0 THEN '' ELSE 's' || (k % CASE WHEN ps % 7 = 0 THEN 3 ELSE 4 END) END AS step, CASE WHEN ps % 31 = 0 THEN '  ' ELSE 'text' END AS statement, CASE WHEN ps % 37 > 0 THEN true END AS required FROM (SELECT p_partkey AS ps, unnest([0, 1, 2, 3]) AS k FROM part WHERE p_size > 4)),
requires AS (SELECT 'o' || l_orderkey AS id, 'p' || CASE WHEN l_tax >= 0.08 THEN -l_partkey ELSE l_partkey END AS method, 's' || l_linenumber % 5 AS step FROM lineitem)"""


def _declared(s, d):
    part, orders, line = (t.table(s, d, n) for n in ("part", "orders", "lineitem"))
    status = "CASE p_size % 5 WHEN 0 THEN 'stale' WHEN 1 THEN 'current' WHEN 2 THEN 'confirmed' END"
    nodes = _of(part, id="concat('p', p_partkey)", type="if(p_size < 45, 'method', 'code')", status=status).union(_of(orders, id="concat('o', o_orderkey)", type="if(o_orderstatus = 'P', 'data', 'claim')", status="if(o_orderpriority < '3', 'planned', NULL)"))
    each = part.where("p_size > 4").select(F.col("p_partkey").alias("ps"), F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    steps = _of(each, id="concat('p', ps)", step="if(k = 3 AND ps % 9 = 0, '', concat('s', k % if(ps % 7 = 0, 3, 4)))", statement="if(ps % 31 = 0, '  ', 'text')", required="if(ps % 37 > 0, true, NULL)")
    return nodes, steps, _of(line, id="concat('o', l_orderkey)", method="concat('p', if(l_tax >= 0.08, -l_partkey, l_partkey))", step="concat('s', l_linenumber % 5)")


@query(f"""WITH {_STEPS} SELECT DISTINCT 'STEPS_ON_OTHER_NODE' AS code, id, '' AS detail FROM steps WHERE id NOT IN (SELECT id FROM n WHERE type = 'method') UNION ALL SELECT 'DUPLICATE_STEP', id, step FROM steps GROUP BY id, step HAVING count(*) > 1
UNION ALL SELECT 'MALFORMED_STEP', id, step FROM steps WHERE step = '' OR trim(statement) = '' OR required IS NULL""")
def declared_methods(s, d):
    nodes, steps, _ = _declared(s, d)
    return declarations.method_issues(nodes, steps)


@query(f"""WITH {_STEPS}, a AS (SELECT DISTINCT r.id, r.method, c.type AS ct, c.status AS cs, m.type AS mt, m.status AS ms, m.id IS NOT NULL AS there, r.method IN (SELECT id FROM steps) AS has FROM requires r LEFT JOIN n c ON c.id = r.id LEFT JOIN n m ON m.id = r.method),
j AS (SELECT *, CASE WHEN NOT there THEN 'MISSING_METHOD' WHEN mt <> 'method' THEN 'NOT_A_METHOD' WHEN (cs IS NULL OR cs IN ('current', 'confirmed')) AND ms NOT IN ('current', 'confirmed') THEN 'INACTIVE_METHOD' WHEN NOT has THEN 'METHOD_WITHOUT_STEPS' END AS code FROM a)
SELECT code, id, method AS detail FROM j WHERE code IS NOT NULL UNION ALL SELECT DISTINCT 'REQUIREMENTS_ON_OTHER_NODE', id, '' FROM j WHERE ct IS DISTINCT FROM 'claim' UNION ALL SELECT 'REPEATED_STEP_REFERENCE', id, method || ' ' || step FROM requires GROUP BY id, method, step HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'UNKNOWN_METHOD_STEP', r.id, r.method || ' ' || r.step FROM requires r JOIN j ON j.id = r.id AND j.method = r.method WHERE j.code IS NULL AND (r.method, r.step) NOT IN (SELECT id, step FROM steps)""")
def declared_requirements(s, d):
    return declarations.requirement_issues(*(_declared(s, d)[i] for i in (0, 2, 1)))


@query("""SELECT l_orderkey AS id, l_suppkey AS value, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS roles FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) > 1""")
def role_overlaps(s, d):
    return declarations.overlapping_roles(_of(t.table(s, d, "lineitem"), id="l_orderkey", role="l_returnflag", value="l_suppkey"))


_CHANGES = "CASE l_linenumber WHEN 1 THEN 'add_nodes' WHEN 2 THEN 'replace_nodes' WHEN 3 THEN 'remove_nodes' WHEN 4 THEN 'add_edges' WHEN 5 THEN 'remove_edges' WHEN 6 THEN 'set_concepts' ELSE 'rename' END"


@query(f"""WITH c AS (SELECT l_orderkey AS id, {_CHANGES} AS op, l_suppkey % 6 AS k FROM lineitem), r AS (SELECT o_orderkey AS id, 'h' || o_orderkey % 100 AS base FROM orders UNION ALL SELECT -c_custkey, 'h1' FROM customer),
g AS (SELECT *, CASE WHEN op LIKE '%nodes' THEN 'node' WHEN op LIKE '%edges' THEN 'edge' WHEN op LIKE '%concepts' THEN 'concept' END AS kind FROM c)
SELECT 'UNKNOWN_OPERATION' AS code, id, op AS detail FROM g WHERE kind IS NULL UNION ALL SELECT 'REPEATED_OPERATION', id, op || ' ' || k FROM g WHERE kind IS NOT NULL GROUP BY id, op, k HAVING count(*) > 1
UNION ALL SELECT 'OVERLAPPING_OPERATIONS', id, kind || ' ' || k FROM g WHERE kind IS NOT NULL GROUP BY id, kind, k HAVING count(DISTINCT op) > 1 UNION ALL SELECT 'EMPTY_REQUEST', id, '' FROM r WHERE id NOT IN (SELECT id FROM c)
UNION ALL SELECT 'TOO_MANY_OPERATIONS', id, count(*)::VARCHAR FROM c WHERE id IN (SELECT id FROM r) GROUP BY id HAVING count(*) > 6 UNION ALL SELECT 'BASE_CHANGED', id, base FROM r WHERE base <> 'h1'""")
def change_requests(s, d):
    requests = _of(t.table(s, d, "orders"), id="o_orderkey", base_hash="concat('h', o_orderkey % 100)").union(_of(t.table(s, d, "customer"), id="-c_custkey", base_hash="'h1'"))
    return declarations.change_issues(requests, _of(t.table(s, d, "lineitem"), id="l_orderkey", operation=_CHANGES, key="l_suppkey % 6"), "h1", 6)


_REASONS = ("CLAIM_NOT_ATOMIC", "CRITICAL_ABSTENTION", "MATERIAL_DISSENT")


@query("""WITH e AS (SELECT l_orderkey AS id, l_partkey AS candidate, CASE l_linenumber % 4 WHEN 0 THEN 'maybe' WHEN 1 THEN 'endorse' WHEN 2 THEN 'reject' ELSE 'abstain' END AS decision, l_discount >= 0.05 AS blocking,
  CASE l_suppkey % 6 WHEN 0 THEN [] WHEN 1 THEN ['CLAIM_NOT_ATOMIC'] WHEN 2 THEN ['CLAIM_NOT_ATOMIC', 'MATERIAL_DISSENT'] WHEN 3 THEN ['MATERIAL_DISSENT', 'CLAIM_NOT_ATOMIC'] WHEN 4 THEN ['OTHER'] ELSE ['CRITICAL_ABSTENTION'] END AS r FROM lineitem)
SELECT 'UNKNOWN_DECISION' AS code, id, candidate::VARCHAR AS detail FROM e WHERE decision = 'maybe' UNION ALL SELECT 'REASONS_NOT_CANONICAL', id, candidate::VARCHAR FROM e WHERE list_contains(r, 'OTHER') OR r <> list_sort(list_distinct(r)) UNION ALL SELECT 'REASON_MISSING', id, candidate::VARCHAR FROM e WHERE decision IN ('reject', 'abstain') AND len(r) = 0
UNION ALL SELECT 'ENDORSEMENT_WITH_OBJECTIONS', id, candidate::VARCHAR FROM e WHERE decision = 'endorse' AND (len(r) > 0 OR blocking) UNION ALL SELECT 'MUST_BLOCK', id, candidate::VARCHAR FROM e WHERE list_has_any(r, ['MATERIAL_DISSENT', 'CRITICAL_ABSTENTION']) AND NOT blocking""")
def ballot_evaluations(s, d):
    reasons = "CASE l_suppkey % 6 WHEN 0 THEN cast(array() AS array<string>) WHEN 1 THEN array('CLAIM_NOT_ATOMIC') WHEN 2 THEN array('CLAIM_NOT_ATOMIC', 'MATERIAL_DISSENT') WHEN 3 THEN array('MATERIAL_DISSENT', 'CLAIM_NOT_ATOMIC') WHEN 4 THEN array('OTHER') ELSE array('CRITICAL_ABSTENTION') END"
    decision = "CASE l_linenumber % 4 WHEN 0 THEN 'maybe' WHEN 1 THEN 'endorse' WHEN 2 THEN 'reject' ELSE 'abstain' END"
    return declarations.evaluation_issues(_of(t.table(s, d, "lineitem"), id="l_orderkey", candidate="l_partkey", decision=decision, reasons=reasons, blocking="l_discount >= 0.05"), _REASONS)


# -- projections and releases --------------------------------------------------------------


@query(f"""WITH {GRAPH}, kept AS (SELECT id FROM nodes WHERE status <> 'deprecated'), e AS (SELECT DISTINCT src, dst, rel FROM edges)
SELECT src AS owner_id, src AS missing_id, rel AS relation, 'semantic' AS edge_kind FROM e WHERE src NOT IN (FROM kept) UNION ALL SELECT src, dst, rel, 'semantic' FROM e WHERE dst NOT IN (FROM kept)""")
def projection_missing(s, d):
    return projections.unresolved(t.edges(s, d).withColumn("kind", F.lit("semantic")), t.nodes(s, d).where("status <> 'deprecated'"))


@query(f"""WITH {GRAPH}, kept AS (SELECT id FROM nodes WHERE status <> 'deprecated') SELECT DISTINCT src, dst, rel, 'edge:sha256:' || sha256('{{"dst":"' || dst || '","kind":"semantic","rel":"' || rel || '","src":"' || src || '"}}') AS edge_id FROM edges WHERE src IN (FROM kept) AND dst IN (FROM kept)""")
def projection_edges(s, d):
    edges = t.edges(s, d).withColumn("kind", F.lit("semantic"))
    return projections.with_edge_ids(projections.resolved(edges, t.nodes(s, d).where("status <> 'deprecated'"))).select("src", "dst", "rel", "edge_id")


@query(f"""WITH n AS (SELECT l_partkey AS term, {_MODE} AS text, CASE l_returnflag WHEN 'A' THEN 'de' WHEN 'N' THEN 'en' END AS language FROM lineitem)
SELECT term, text, language FROM n QUALIFY row_number() OVER (PARTITION BY term ORDER BY CASE WHEN language = 'en' THEN 0 WHEN language IS NULL THEN 1 ELSE 2 END, coalesce(language, ''), text) = 1""")
def display_labels(s, d):
    names = _of(t.table(s, d, "lineitem"), term="l_partkey", text=_MODE, language="CASE l_returnflag WHEN 'A' THEN 'de' WHEN 'N' THEN 'en' END")
    return projections.display_labels(names, "en")


_TERMS = "CASE l_linenumber % 3 WHEN 0 THEN 'iri' WHEN 1 THEN 'preferred_label' ELSE 'synonym' END"


@query(f"""WITH n AS (SELECT l_partkey AS term, {_TERMS} AS kind, {_MODE} AS text, l_returnflag AS language FROM lineitem), q AS (SELECT 'MAIL' AS query UNION ALL SELECT '  reg   air ' UNION ALL SELECT 'rail'),
m AS (SELECT query, term, kind, text, language FROM n JOIN q ON CASE WHEN kind = 'iri' THEN text = query ELSE lower(text) = lower(trim(regexp_replace(query, '\\s+', ' ', 'g'))) END)
SELECT query, term, CASE kind WHEN 'iri' THEN 0 WHEN 'preferred_label' THEN 1 ELSE 2 END AS tier, kind AS matched_on, text, language FROM m
QUALIFY row_number() OVER (PARTITION BY query, term ORDER BY CASE kind WHEN 'iri' THEN 0 WHEN 'preferred_label' THEN 1 ELSE 2 END, language <> 'N', language, text) = 1""")
def term_matches(s, d):
    asked = s.createDataFrame([("MAIL",), ("  reg   air ",), ("rail",)], "query string")
    return projections.matches(asked, _of(t.table(s, d, "lineitem"), term="l_partkey", kind=_TERMS, text=_MODE, language="l_returnflag"), "N")


_FILES = """files AS (SELECT o_orderkey AS "at", 'project' AS location, 'f' || lpad((CASE WHEN o_orderkey % 97 = 5 THEN o_orderkey - 2 ELSE o_orderkey END)::VARCHAR, 9, '0') AS path, CASE o_orderstatus WHEN 'P' THEN ['graph', 'config'] WHEN 'F' THEN ['event'] ELSE ['event', 'policy'] END AS roles,
  CASE WHEN o_custkey % 41 = 0 THEN 'x' ELSE sha256(o_custkey::VARCHAR) END AS sha256, o_custkey AS size FROM orders),
counts AS (SELECT 'event' AS role, 3 AS n UNION ALL SELECT 'policy', (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT 'extra', 1), own AS (SELECT role, count(*) AS n FROM (SELECT unnest(roles) AS role FROM files) GROUP BY 1)"""


def _files(s, d):
    roles = "CASE o_orderstatus WHEN 'P' THEN array('graph', 'config') WHEN 'F' THEN array('event') ELSE array('event', 'policy') END"
    path = "concat('f', lpad(if(o_orderkey % 97 = 5, o_orderkey - 2, o_orderkey), 9, '0'))"
    return _of(t.table(s, d, "orders"), at="o_orderkey", location="'project'", path=path, roles=roles, ids="array(o_custkey)", sha256="if(o_custkey % 41 = 0, 'x', sha2(cast(o_custkey AS string), 256))", size="o_custkey")


@query(f"""WITH {_FILES} SELECT 'FILE_MALFORMED' AS code, path AS item, '' AS detail FROM files WHERE sha256 = 'x' UNION ALL SELECT 'ROLES_NOT_CANONICAL', path, '' FROM files WHERE roles <> list_sort(list_distinct(roles))
UNION ALL SELECT 'FILES_OUT_OF_ORDER', b.path, '' FROM files a JOIN files b ON b."at" = a."at" + 1 WHERE b.path <= a.path UNION ALL SELECT 'STORES_OUT_OF_ORDER', 'event', ''
UNION ALL SELECT 'ROLE_COUNT_MISMATCH', coalesce(c.role, o.role), coalesce(o.n, 0)::VARCHAR FROM counts c FULL JOIN own o ON o.role = c.role WHERE c.n IS DISTINCT FROM o.n
UNION ALL SELECT 'ROLE_NOT_SINGLE', role, n::VARCHAR FROM own WHERE role IN ('config', 'graph') AND n <> 1 UNION ALL SELECT 'STORE_COUNT_MISMATCH', 'event', n::VARCHAR FROM own WHERE role = 'event' AND n <> 3 UNION ALL SELECT 'STORE_MISSING', 'derivation', ''""")
def release_issues(s, d):
    files = _files(s, d)
    policies = files.where(F.array_contains("roles", "policy")).count()
    stores = s.createDataFrame([(1, "policy", policies), (2, "event", 3)], "at long, role string, records long")
    counts = s.createDataFrame([("event", 3), ("policy", policies), ("extra", 1)], "role string, n long")
    return releases.issues(files, stores, counts, required=("derivation", "event"))


def _recollected(files):
    later = files.where("at % 10 <> 1 AND path NOT LIKE '%7'")
    changed = later.withColumn("size", F.expr("if(at % 10 = 4, size + 1, size)")).withColumn("sha256", F.expr("if(at % 20 = 4, 'x', sha256)"))
    return changed.union(files.where("path LIKE '%7'").withColumn("path", F.concat(F.lit("g"), "path")))


@query(f"""WITH {_FILES}, a AS (SELECT * FROM files WHERE "at" % 97 <> 5), b AS (SELECT "at", path, CASE WHEN "at" % 20 = 4 THEN 'x' ELSE sha256 END AS sha256, CASE WHEN "at" % 10 = 4 THEN size + 1 ELSE size END AS size FROM a WHERE "at" % 10 <> 1 AND path NOT LIKE '%7' UNION ALL SELECT "at", 'g' || path, sha256, size FROM a WHERE path LIKE '%7')
SELECT 'project' AS location, coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change,
CASE WHEN a.path IS NULL OR b.path IS NULL THEN '' WHEN a.sha256 <> b.sha256 THEN 'sha256,size' ELSE 'size' END AS fields FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.sha256 <> b.sha256 OR a.size <> b.size""")
def release_changes(s, d):
    files = _files(s, d).where("at % 97 <> 5")
    return releases.changed_fields(files, _recollected(files))


# -- streams ---------------------------------------------------------------------------------


@query("""WITH b AS (SELECT max(ts) AS last FROM events), a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view')
SELECT user_id AS run_id, event_id AS start_id, ts::TIMESTAMP AS started FROM a, b WHERE ts + INTERVAL 1 DAY < last AND NOT EXISTS (SELECT 1 FROM events f WHERE f.event_type = 'purchase' AND f.user_id = a.user_id AND f.ts BETWEEN a.ts AND a.ts + INTERVAL 1 DAY)""")
def stream_incomplete_runs(s, d):
    late = journals.incomplete_runs(pairing.event_stream(s, d), "view", "purchase", "1 DAY")
    return journals.appended(late, scratch_path(s, "late")).withColumn("started", F.col("started").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT user_id AS run_id, event_type AS stage, ts AS "at", event_id, (ts, event_id) AS k FROM events), a AS (SELECT run_id, min(k) AS k FROM e WHERE stage = 'signup' GROUP BY 1), b AS (SELECT e.run_id, min(e.k) AS k FROM e JOIN a ON a.run_id = e.run_id AND e.k > a.k WHERE stage = 'view' GROUP BY 1),
c AS (SELECT e.run_id, min(e.k) AS k FROM e JOIN b ON b.run_id = e.run_id AND e.k > b.k WHERE stage = 'click' GROUP BY 1), p AS (SELECT e.run_id, min(e.k) AS k FROM e JOIN c ON c.run_id = e.run_id AND e.k > c.k WHERE stage = 'purchase' GROUP BY 1),
x AS (SELECT 'signup' AS stage, * FROM a UNION ALL SELECT 'view', * FROM b UNION ALL SELECT 'click', * FROM c UNION ALL SELECT 'purchase', * FROM p)
SELECT e.run_id, e.stage, "at"::TIMESTAMP AS "at", event_id, CASE WHEN e.stage NOT IN ('signup', 'view', 'click', 'purchase') THEN 'unknown' WHEN x.k IS NULL OR e.k < x.k THEN 'out_of_order' WHEN e.k = x.k THEN 'accepted' ELSE 'repeated' END AS state
FROM e LEFT JOIN x ON x.run_id = e.run_id AND x.stage = e.stage""")
def stream_stage_journal(s, d):
    records = _of(pairing.event_stream(s, d), run_id="user_id", stage="event_type", at="ts", event_id="event_id")
    return journals.stage_journal(records, {"signup": (), "view": ("signup",), "click": ("view",), "purchase": ("click",)}, scratch_path(s, "journal"))


# -- vocabularies, rule packs and records --------------------------------------------------------

_PREDICATE = "concat('p', l_partkey % 20)"
_ARGUMENT_TYPE = "CASE l_linenumber % 5 WHEN 0 THEN 'ct:decimal' WHEN 1 THEN 'ct:string' WHEN 2 THEN 't1' WHEN 3 THEN 't9' ELSE 'ct:symbol' END"
_UNIT = "CASE l_partkey % 3 WHEN 1 THEN 'kg' WHEN 2 THEN 'mile' END"
_KIND = "CASE WHEN l_returnflag = 'A' THEN 'input' WHEN l_quantity > 3 THEN 'derived' ELSE 'odd' END"
_POLARITY = "CASE WHEN l_tax < 0.07 THEN 'positive' ELSE 'both' END"
_VOCABULARY = f"""{_LINE}, types AS (SELECT s_suppkey AS v, 't1' AS id, CASE s_nationkey % 5 WHEN 0 THEN 'ct:float' ELSE 'ct:decimal' END AS base FROM supplier UNION ALL SELECT s_suppkey, 'ct:string', 'ct:string' FROM supplier WHERE s_nationkey % 4 = 1 UNION ALL SELECT s_suppkey, 't1', 'ct:decimal' FROM supplier WHERE s_nationkey % 6 = 1),
units AS (SELECT s_suppkey AS v, 'kg' AS unit FROM supplier UNION ALL SELECT s_suppkey, 'kg' FROM supplier WHERE s_nationkey % 3 = 0), predicates AS (SELECT l_suppkey AS v, {_PREDICATE} AS id, {_KIND} AS kind FROM line WHERE l_linenumber < 3),
arguments AS (SELECT l_suppkey AS v, {_PREDICATE} AS p, 'n' || l_linenumber % 3 AS name, {_ARGUMENT_TYPE} AS type, {_UNIT} AS unit FROM line),
renderers AS (SELECT l_suppkey AS v, 'r' || l_orderkey % 50 AS id, {_PREDICATE} AS p, {_POLARITY} AS polarity, l_returnflag AS language, CASE WHEN l_discount < 0.05 THEN '{{n0}} is {{n1}}' ELSE '{{n2}}, {{n1}}, {{n0}}, {{n1}}' END AS template, CASE WHEN l_discount < 0.05 THEN ['n0', 'n1'] ELSE ['n0', 'n1', 'n2'] END AS fields FROM line WHERE l_quantity > 40)"""


@query(f"""WITH {_VOCABULARY} SELECT 'TYPE_RESERVED' AS code, v AS vocabulary, id AS detail FROM types WHERE id LIKE 'ct:%' UNION ALL SELECT 'TYPE_REPEATED', v, id FROM types GROUP BY v, id HAVING count(*) > 1 UNION ALL SELECT 'TYPE_BASE_UNKNOWN', v, id FROM types WHERE base = 'ct:float'
UNION ALL SELECT 'UNIT_REPEATED', v, unit FROM units GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT 'PREDICATE_REPEATED', v, id FROM predicates GROUP BY v, id HAVING count(*) > 1 UNION ALL SELECT 'PREDICATE_KIND_INVALID', v, id FROM predicates WHERE kind = 'odd'
UNION ALL SELECT 'ARGUMENT_REPEATED', v, p || ' ' || name FROM arguments GROUP BY v, p, name HAVING count(*) > 1 UNION ALL SELECT 'ARGUMENT_TYPE_UNKNOWN', v, p || ' ' || name || ' ' || type FROM arguments WHERE type = 't9' OR type = 't1' AND v NOT IN (SELECT v FROM types WHERE id = 't1')
UNION ALL SELECT 'ARGUMENT_UNIT_UNKNOWN', v, p || ' ' || name || ' ' || unit FROM arguments WHERE unit IS NOT NULL AND (v, unit) NOT IN (FROM units)
UNION ALL SELECT 'RENDERER_REPEATED', v, id FROM renderers GROUP BY v, id HAVING count(*) > 1 UNION ALL SELECT 'RENDERER_KEY_REPEATED', v, p || ' ' || polarity || ' ' || language FROM renderers GROUP BY v, p, polarity, language HAVING count(*) > 1
UNION ALL SELECT 'RENDERER_POLARITY_INVALID', v, id FROM renderers WHERE polarity = 'both' UNION ALL SELECT 'RENDERER_PREDICATE_UNKNOWN', v, id || ' ' || p FROM renderers WHERE (v, p) NOT IN (SELECT v, id FROM predicates)
UNION ALL SELECT 'RENDERER_FIELDS_DIFFER', r.v, r.id FROM renderers r WHERE (r.v, r.p) IN (SELECT v, id FROM predicates) AND r.fields IS DISTINCT FROM (SELECT list_sort(list(DISTINCT name)) FROM arguments a WHERE a.v = r.v AND a.p = r.p)""")
def vocabulary_issues(s, d):
    line, supplier = _line(s, d), t.table(s, d, "supplier")
    base = _of(supplier, vocabulary="s_suppkey", id="'t1'", base="if(s_nationkey % 5 = 0, 'ct:float', 'ct:decimal')")
    types = base.union(_of(supplier.where("s_nationkey % 4 = 1"), vocabulary="s_suppkey", id="'ct:string'", base="'ct:string'")).union(_of(supplier.where("s_nationkey % 6 = 1"), vocabulary="s_suppkey", id="'t1'", base="'ct:decimal'"))
    units = _of(supplier, vocabulary="s_suppkey", unit="'kg'").union(_of(supplier.where("s_nationkey % 3 = 0"), vocabulary="s_suppkey", unit="'kg'"))
    arguments = _of(line, vocabulary="l_suppkey", predicate=_PREDICATE, name="concat('n', l_linenumber % 3)", type=_ARGUMENT_TYPE, unit=_UNIT)
    renderers = _of(line.where("l_quantity > 40"), vocabulary="l_suppkey", id="concat('r', l_orderkey % 50)", predicate=_PREDICATE, polarity=_POLARITY, language="l_returnflag", template="if(l_discount < 0.05, '{n0} is {n1}', '{n2}, {n1}, {n0}, {n1}')")
    return vocabularies.vocabulary_issues(types, units, _of(line.where("l_linenumber < 3"), vocabulary="l_suppkey", id=_PREDICATE, kind=_KIND), arguments, renderers)


_RECORD = records.Shape("event", ("schema_version", "type", "run_id", "recorded_at", "payload"), allowed={"schema_version": ("event/1",), "type": ("run", "view", "click", "purchase", "signup")}, patterns={"run_id": "^run:[0-9]+$"}, objects=("payload",), times=("recorded_at",))


@query("""WITH e AS (SELECT *, event_id % 40 AS z, '{"payload":{"k":1},"recorded_at":"2024-01-01T00:00:00Z","run_id":"run:' || user_id || '","schema_version":"event/1","type":"' || event_type || '"}' AS core FROM events), n AS (SELECT *, 'e' || event_id AS fallback FROM e)
SELECT 'INVALID_JSON' AS code, fallback AS name, '' AS detail FROM n WHERE z IN (1, 2) UNION ALL SELECT 'KEYS_MISSING', fallback, 'recorded_at' FROM n WHERE z = 3 UNION ALL SELECT 'TIME_MALFORMED', fallback, 'recorded_at' FROM n WHERE z IN (3, 4) UNION ALL SELECT 'KEYS_UNKNOWN', fallback, 'more' FROM n WHERE z = 5
UNION ALL SELECT 'HASH_MISMATCH', fallback, 'id' FROM n WHERE z IN (3, 4, 6, 7, 8) UNION ALL SELECT 'VALUE_MALFORMED', fallback, 'run_id' FROM n WHERE z = 6 UNION ALL SELECT 'NOT_AN_OBJECT', fallback, 'payload' FROM n WHERE z = 7 UNION ALL SELECT 'VALUE_NOT_ALLOWED', fallback, 'schema_version' FROM n WHERE z = 8
UNION ALL SELECT 'VALUE_NOT_ALLOWED', fallback, 'type' FROM n WHERE z NOT IN (1, 2) AND event_type NOT IN ('view', 'click', 'purchase', 'signup') UNION ALL SELECT 'NAME_DIFFERS', fallback, 'id' FROM n WHERE z NOT IN (1, 2)
UNION ALL SELECT 'ID_REPEATED', min(fallback), 'event:sha256:' || sha256(core) FROM n WHERE z NOT IN (1, 2) GROUP BY core HAVING count(*) > 1""")
def record_issues(s, d):
    """Events as records whose text is not canonical, some of them spoiled after they were named."""
    z = F.col("event_id") % 40
    pick = lambda default, **by: F.coalesce(*(F.when(z == int(k[1:]), v) for k, v in by.items()), F.lit(default))
    core = F.concat(F.lit('{"payload":{"k":1},"recorded_at":"2024-01-01T00:00:00Z","run_id":"run:'), F.col("user_id").cast("string"), F.lit('","schema_version":"event/1","type":"'), "event_type", F.lit('"}'))
    time = pick('"recorded_at":"2024-01-01T00:00:00Z", ', z1='"recorded_at":NaN, ', z2='"recorded_at":"", "recorded_at":"2024-01-01T00:00:00Z", ', z3="", z4='"recorded_at":"2024-01-01 00:00:00", ', z5='"recorded_at":"2024-01-01T00:00:00Z", "more": null, ')
    text = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "id":"event:sha256:'), F.sha2(core, 256), F.lit('", '), time, pick('"run_id" : "run:', z6='"run_id" : "walk:'), F.col("user_id").cast("string"), pick('", "payload":{"k":1},', z7='", "payload":[1],'), pick('"schema_version":"event/1"}', z8='"schema_version":"event/0"}'))
    return records.issues(t.table(s, d, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("name"), text.alias("text")), _RECORD)
