"""The registered queries over the star-schema adapters, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import canonical, scalars
from strandline.functions.vocab import NODE_TYPES
from strandline.operators import checks, deliberations, graph, ledgers, manifests, mappings, reviews, rules, search
from strandline.sources import tables as t
from strandline.sources.scratch import settled
from strandline.streaming import pairing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
GRAPH = f"{t.NODES_SQL}, {t.EDGES_SQL}, {t.BINDINGS_SQL}"


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def _deps(s: SparkSession, d: str) -> DataFrame:
    return graph.dependencies(t.edges(s, d))


def _seed(s: SparkSession, name: str) -> DataFrame:
    return s.range(1).select(F.lit(name).alias("id"))


def _constants(s: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    return s.createDataFrame(rows, names)


# -- graph ---------------------------------------------------------------------------

_WALK = """SELECT w.id, type, status, depth FROM (SELECT id, min(depth) AS depth FROM walk WHERE depth > 0 GROUP BY id) w JOIN nodes ON nodes.id = w.id"""


@query(f"""WITH RECURSIVE {GRAPH}, walk AS (SELECT 'region:0' AS id, 0 AS depth UNION SELECT down, depth + 1 FROM walk JOIN deps ON up = walk.id WHERE depth < 9) {_WALK}""")
def graph_downstream(s, d):
    return graph.closure(_seed(s, "region:0"), _deps(s, d)).join(t.nodes(s, d), "id").select("id", "type", "status", "depth")


@query(f"""WITH RECURSIVE {GRAPH}, walk AS (SELECT 'orders:1' AS id, 0 AS depth UNION SELECT up, depth + 1 FROM walk JOIN deps ON down = walk.id WHERE depth < 9) {_WALK}""")
def graph_upstream(s, d):
    return graph.closure(_seed(s, "orders:1"), graph.reverse(_deps(s, d))).join(t.nodes(s, d), "id").select("id", "type", "status", "depth")


@query(f"""WITH RECURSIVE {GRAPH}, bound AS (
  SELECT DISTINCT b.id FROM bindings b JOIN nodes n ON n.id = b.id WHERE concept = 'market' AND value <> 'BUILDING' AND status <> 'deprecated'
), walk AS (SELECT id AS root, id FROM bound UNION SELECT root, down FROM walk JOIN deps ON up = walk.id
), reached AS (SELECT id, min(root) AS root FROM walk GROUP BY id)
SELECT n.id, type, status, n.id IN (SELECT id FROM bound) AS direct, root FROM reached r JOIN nodes n ON n.id = r.id""")
def graph_impact(s, d):
    return graph.impact(t.nodes(s, d), _deps(s, d), t.bindings(s, d), "market", "BUILDING")


@query(f"""WITH RECURSIVE {GRAPH}, walk AS (SELECT id, 0 AS layer FROM nodes UNION SELECT down, layer + 1 FROM walk JOIN deps ON up = walk.id),
deepest AS (SELECT id, max(layer) AS layer FROM walk GROUP BY id) SELECT layer, type, count(*) AS n FROM deepest JOIN nodes USING (id) GROUP BY layer, type""")
def graph_layers(s, d):
    return graph.layers(t.nodes(s, d), _deps(s, d)).join(t.nodes(s, d), "id").groupBy("layer", "type").agg(F.count("*").alias("n"))


@query(f"WITH {GRAPH} SELECT type, status, count(*) AS n FROM nodes GROUP BY GROUPING SETS ((type), (status))")
def graph_summary(s, d):
    return t.nodes(s, d).groupingSets([["type"], ["status"]], "type", "status").agg(F.count("*").alias("n"))


@query(f"WITH {GRAPH} SELECT d.down AS id, n.type AS input_type, count(*) AS n FROM deps d JOIN nodes n ON n.id = d.up WHERE d.down LIKE 'orders:%' GROUP BY ALL")
def graph_direct_inputs(s, d):
    inputs = t.nodes(s, d).select(F.col("id").alias("up"), F.col("type").alias("input_type"))
    return _deps(s, d).where(F.col("down").startswith("orders:")).join(inputs, "up").groupBy(F.col("down").alias("id"), "input_type").agg(F.count("*").alias("n"))


@query(f"""WITH {GRAPH} SELECT 'supplier:1' AS id, 'out' AS direction, rel, dst AS other FROM edges WHERE src = 'supplier:1' UNION ALL SELECT 'supplier:1', 'in', rel, src FROM edges WHERE dst = 'supplier:1'""")
def graph_incident_edges(s, d):
    e = t.edges(s, d)
    return e.where("src = 'supplier:1'").select(F.col("src").alias("id"), F.lit("out").alias("direction"), "rel", F.col("dst").alias("other")).union(e.where("dst = 'supplier:1'").select("dst", F.lit("in"), "rel", "src"))


@query(f"""WITH {GRAPH} SELECT a.id AS up, b.id AS down, a.concept AS concept FROM deps JOIN bindings a ON a.id = up JOIN bindings b ON b.id = down AND a.concept = b.concept WHERE a.value <> b.value""")
def graph_binding_conflicts(s, d):
    b = t.bindings(s, d)
    left, right = b.toDF("up", "concept", "l"), b.toDF("down", "concept", "r")
    return _deps(s, d).join(left, "up").join(right, ["down", "concept"]).where("l <> r").select("up", "down", "concept")


@query(f"""WITH {GRAPH}, ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), h0 AS (SELECT 'region:0' AS id, 0 AS hop),
n1 AS (SELECT DISTINCT dst AS id FROM ways JOIN h0 ON src = h0.id WHERE dst NOT IN (SELECT id FROM h0)),
h1 AS (SELECT * FROM h0 UNION ALL (SELECT id, 1 FROM n1 ORDER BY id LIMIT 63)),
n2 AS (SELECT DISTINCT dst AS id FROM ways JOIN h1 ON src = h1.id WHERE hop = 1 AND dst NOT IN (SELECT id FROM h1))
SELECT * FROM h1 UNION ALL (SELECT id, 2 FROM n2 ORDER BY id LIMIT (SELECT 64 - count(*) FROM h1))""")
def bounded_context_k2(s, d):
    return graph.bounded_context(t.edges(s, d), _seed(s, "region:0"), 2, 64)


@query(f"""WITH {GRAPH}, ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), h0 AS (SELECT 'region:0' AS id, 0 AS hop),
n1 AS (SELECT DISTINCT dst AS id FROM ways JOIN h0 ON src = h0.id WHERE dst NOT IN (SELECT id FROM h0)),
h1 AS (SELECT * FROM h0 UNION ALL (SELECT id, 1 FROM n1 ORDER BY id LIMIT 63)),
n2 AS (SELECT DISTINCT dst AS id FROM ways JOIN h1 ON src = h1.id WHERE hop = 1 AND dst NOT IN (SELECT id FROM h1)),
c AS (SELECT * FROM h1 UNION ALL (SELECT id, 2 FROM n2 ORDER BY id LIMIT (SELECT 64 - count(*) FROM h1))),
k AS (SELECT *, sum(length(id)) OVER (ORDER BY hop, id) AS used FROM c QUALIFY hop = 0 OR used <= 1000),
e AS (SELECT src, dst, rel, sum(length(src) + length(dst)) OVER (ORDER BY greatest(a.hop, b.hop), src, dst, rel) + (SELECT max(used) FROM k) AS used FROM (SELECT DISTINCT src, dst, rel FROM edges) JOIN k a ON a.id = src JOIN k b ON b.id = dst)
SELECT 'node' AS kind, id, NULL AS other, NULL AS rel FROM k UNION ALL SELECT 'edge', src, dst, rel FROM e WHERE used <= 1000""")
def bounded_context_bytes(s, d):
    context = graph.bounded_context(t.edges(s, d), _seed(s, "region:0"), 2, 64)
    return graph.fitted_context(context, t.edges(s, d), F.length("id"), F.length("src") + F.length("dst"), 1000)


# -- checks --------------------------------------------------------------------------


@query("""SELECT 'error' AS severity, 'DUPLICATE_ID' AS code, 'line:' || l_orderkey || ':' || l_linenumber AS node_id, count(*) || ' declarations' AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def check_duplicate_id(s, d):
    return checks.duplicate_id(t.table(s, d, "lineitem").select(F.concat_ws(":", F.lit("line"), "l_orderkey", "l_linenumber").alias("id")))


@query(f"""WITH {GRAPH}, kept AS (SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM bindings WHERE value = 'Brand#13')), ends AS (
  SELECT src AS e, dst AS other, rel FROM edges UNION ALL SELECT dst, src, rel FROM edges)
SELECT 'error' AS severity, 'DANGLING_EDGE' AS code, e AS node_id, rel || ' ' || other AS detail FROM ends WHERE e NOT IN (SELECT id FROM kept)""")
def check_dangling_edge(s, d):
    kept = t.nodes(s, d).join(t.bindings(s, d).where("value = 'Brand#13'"), "id", "left_anti")
    return checks.dangling_edge(kept, t.edges(s, d))


_BAD_EDGES_SQL = """bad AS (SELECT 'supplier:' || l_suppkey AS src, 'supplier:' || l_partkey AS dst, 'cites' AS rel FROM lineitem WHERE l_suppkey = l_partkey
  UNION ALL SELECT 'orders:' || o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '' END, 'cites' FROM orders WHERE o_orderpriority = '5-LOW'
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'derives_from' FROM nation WHERE n_nationkey % 3 = 0
  UNION ALL SELECT 'part:' || p_partkey, 'part:' || (p_partkey + 1), 'resembles' FROM part WHERE p_size = 7)"""


def _worse(s, d):
    """The edges and such as should not be: of a node to itself, without a target, back to what a node comes from, of an unknown relation."""
    itself = t.table(s, d, "lineitem").where("l_suppkey = l_partkey").select(t.key("supplier", "l_suppkey"), t.key("supplier", "l_partkey"), F.lit("cites"))
    short = t.table(s, d, "orders").where("o_orderpriority = '5-LOW'").select(t.key("orders", "o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, ""), F.lit("cites"))
    back = t.table(s, d, "nation").where("n_nationkey % 3 = 0").select(t.key("nation", "n_nationkey"), t.key("region", "n_regionkey"), F.lit("derives_from"))
    odd = t.table(s, d, "part").where("p_size = 7").select(t.key("part", "p_partkey"), F.concat(F.lit("part:"), (F.col("p_partkey") + 1).cast("string")), F.lit("resembles"))
    return reduce(DataFrame.union, (t.edges(s, d), itself, short, back, odd))


@query(f"""WITH {GRAPH}, {_BAD_EDGES_SQL}, a AS (SELECT * FROM edges UNION ALL SELECT * FROM bad) SELECT 'error' AS severity, 'SELF_EDGE' AS code, src AS node_id, rel AS detail FROM a WHERE src = dst""")
def check_self_edge(s, d):
    return checks.self_edge(_worse(s, d))


@query(f"""WITH {GRAPH}, {_BAD_EDGES_SQL}, a AS (SELECT * FROM edges UNION ALL SELECT * FROM bad) SELECT 'error' AS severity, 'MALFORMED_EDGE' AS code, coalesce(src, '') AS node_id,
coalesce(src, '?') || ' ' || coalesce(rel, '?') || ' ' || coalesce(dst, '?') AS detail FROM a WHERE NOT coalesce(src <> '' AND dst <> '' AND rel <> '', false)""")
def check_malformed_edge(s, d):
    return checks.malformed_edge(_worse(s, d))


@query(f"""WITH RECURSIVE {GRAPH}, {_BAD_EDGES_SQL}, a AS (SELECT up, down FROM deps UNION SELECT src, dst FROM bad WHERE src <> '' AND dst <> ''),
places AS (SELECT * FROM a WHERE down LIKE 'region:%' OR down LIKE 'nation:%'), walk AS (SELECT up AS root, down AS id FROM places UNION SELECT root, down FROM walk JOIN places ON up = walk.id)
SELECT DISTINCT 'error' AS severity, 'CYCLE' AS code, root AS node_id, 'on a dependency cycle' AS detail FROM (SELECT root FROM walk WHERE root = id UNION SELECT up FROM a WHERE up = down)""")
def check_cycle(s, d):
    return checks.cycle(graph.dependencies(_worse(s, d)))


@query(f"""WITH {GRAPH} SELECT 'error' AS severity, 'SILENT_DRIFT' AS code, b.id AS node_id, concept || ' ' || value AS detail FROM bindings b JOIN nodes n ON n.id = b.id
WHERE status = 'current' AND value <> CASE concept WHEN 'market' THEN 'BUILDING' ELSE 'Brand#11' END""")
def check_silent_drift(s, d):
    return checks.silent_drift(t.nodes(s, d), t.bindings(s, d), t.CANONICAL)


@query(f"""WITH {GRAPH} SELECT 'error' AS severity, 'READS_RETIRED' AS code, down AS node_id, up || ' ' || u.status AS detail FROM deps JOIN nodes u ON u.id = up JOIN nodes w ON w.id = down
WHERE w.status = 'current' AND u.status IN ('deprecated', 'retracted', 'dead_end', 'superseded')""")
def check_reads_retired(s, d):
    return checks.reads_retired(t.nodes(s, d), _deps(s, d))


@query(f"""WITH {GRAPH} SELECT 'error' AS severity, 'DEPENDS_ON_PLANNED' AS code, down AS node_id, up AS detail FROM deps JOIN nodes u ON u.id = up JOIN nodes w ON w.id = down
WHERE w.status IN ('current', 'confirmed') AND u.status = 'planned'""")
def check_depends_on_planned(s, d):
    return checks.depends_on_planned(t.nodes(s, d), _deps(s, d))


@query(f"""WITH RECURSIVE {GRAPH}, claims AS (SELECT b.* FROM bindings b JOIN nodes n ON n.id = b.id WHERE type = 'claim'),
walk AS (SELECT id AS root, id FROM claims UNION SELECT root, up FROM walk JOIN deps ON down = walk.id)
SELECT DISTINCT 'error' AS severity, 'CLAIM_CITES_OFFBACKBONE' AS code, w.root AS node_id, w.id AS detail FROM walk w JOIN bindings b ON b.id = w.id JOIN claims c ON c.id = w.root AND c.concept = b.concept
WHERE b.value <> c.value AND w.id <> w.root""")
def check_offbackbone(s, d):
    return checks.off_backbone(t.nodes(s, d), _deps(s, d), t.bindings(s, d))


@query(f"""WITH RECURSIVE {GRAPH}, dirty AS (SELECT DISTINCT b.id FROM bindings b JOIN nodes n ON n.id = b.id WHERE status = 'current' AND value <> CASE concept WHEN 'market' THEN 'BUILDING' ELSE 'Brand#11' END),
walk AS (SELECT id AS root, id FROM dirty UNION SELECT root, down FROM walk JOIN deps ON up = walk.id)
SELECT 'warning' AS severity, 'UPSTREAM_STALE' AS code, w.id AS node_id, min(root) AS detail FROM walk w JOIN nodes n ON n.id = w.id
WHERE w.id <> root AND status NOT IN ('deprecated', 'retracted', 'dead_end', 'superseded', 'planned') GROUP BY w.id""")
def check_upstream_stale(s, d):
    """Below every node that ``check_silent_drift`` reports."""
    dirty = check_silent_drift(s, d).select(F.col("node_id").alias("id")).distinct()
    return checks.upstream_stale(t.nodes(s, d), _deps(s, d), dirty)


@query(f"""WITH {GRAPH}, files AS (SELECT 'orders:' || o_orderkey AS id, epoch(o_orderdate) AS mtime FROM orders
  UNION ALL SELECT 'part:' || l_partkey, max(epoch(l_shipdate)) FROM lineitem GROUP BY l_partkey UNION ALL SELECT 'customer:' || o_custkey, max(epoch(o_orderdate)) FROM orders GROUP BY o_custkey
  UNION ALL SELECT 'nation:' || n_nationkey, epoch(DATE '1998-12-31') FROM nation WHERE n_nationkey % 5 = 0),
above AS (SELECT up, down FROM deps UNION SELECT a.up, b.down FROM deps a JOIN deps b ON b.up = a.down WHERE a.up LIKE 'nation:%'),
newest AS (SELECT down, arg_max(up, (f.mtime, up)) AS up, max(f.mtime) AS mtime FROM above JOIN files f ON f.id = up JOIN nodes n ON n.id = up WHERE type <> 'claim' AND status <> 'deprecated' GROUP BY down)
SELECT 'error' AS severity, 'STALE_RENDER' AS code, down AS node_id, up AS detail FROM newest w JOIN files g ON g.id = down WHERE down LIKE 'orders:%' AND w.mtime > g.mtime + 2""")
def check_stale_render(s, d):
    seconds = lambda day: F.unix_seconds(day.cast("timestamp"))
    orders = t.table(s, d, "orders").select(t.key("orders", "o_orderkey").alias("id"), seconds(F.col("o_orderdate")).alias("mtime"))
    parts = t.table(s, d, "lineitem").groupBy(t.key("part", "l_partkey").alias("id")).agg(F.max(seconds(F.col("l_shipdate"))).alias("mtime"))
    owners = t.table(s, d, "orders").groupBy(t.key("customer", "o_custkey").alias("id")).agg(F.max(seconds(F.col("o_orderdate"))).alias("mtime"))
    homes = t.table(s, d, "nation").where("n_nationkey % 5 = 0").select(t.key("nation", "n_nationkey").alias("id"), seconds(F.lit("1998-12-31")).alias("mtime"))
    return checks.stale_render(orders.select("id"), t.nodes(s, d), _deps(s, d), settled(orders.union(parts).union(owners).union(homes), "files"))


@query(f"""WITH {GRAPH}, {_BAD_EDGES_SQL}, m AS (SELECT 'event:' || event_id AS id, event_type AS type, CASE WHEN value > 50 THEN 'hot' ELSE 'current' END AS status FROM events WHERE event_type <> 'view' UNION ALL SELECT * FROM nodes)
SELECT 'warning' AS severity, 'UNKNOWN_TYPE' AS code, id AS node_id, type AS detail FROM m WHERE type NOT IN ({', '.join(repr(x) for x in NODE_TYPES)})
UNION ALL SELECT 'warning', 'UNKNOWN_STATUS', id, status FROM m WHERE status = 'hot' UNION ALL SELECT 'warning', 'UNKNOWN_REL', src, rel FROM bad WHERE rel = 'resembles'""")
def lint_vocabulary(s, d):
    odd = t.table(s, d, "events").where("event_type <> 'view'").select(t.key("event", "event_id").alias("id"), F.col("event_type").alias("type"), F.when(F.col("value") > 50, "hot").otherwise("current").alias("status"))
    return checks.lint_vocabulary(odd.union(t.nodes(s, d)), _worse(s, d))


@query(f"""WITH {GRAPH}, x AS (SELECT src, dst, 'supports' AS rel FROM edges WHERE rel = 'tried_before') SELECT 'warning' AS severity, 'STATUS_RELATION_MISMATCH' AS code, src AS node_id, 'null ' || dst AS detail FROM x JOIN nodes ON id = src WHERE status = 'null'""")
def lint_status_relation(s, d):
    claimed = t.edges(s, d).where("rel = 'tried_before'").withColumn("rel", F.lit("supports"))
    return checks.status_relation(t.nodes(s, d), claimed)


@query(f"""WITH {GRAPH} SELECT 'warning' AS severity, 'NO_BACKBONE' AS code, id AS node_id, '' AS detail FROM (SELECT id, type, CASE WHEN id LIKE '%7' THEN NULL WHEN id LIKE '%3' THEN 'stale' ELSE status END AS status FROM nodes)
WHERE type IN ('claim', 'figure') AND (status IS NULL OR status IN ('current', 'confirmed')) AND id NOT IN (SELECT id FROM bindings)""")
def lint_no_backbone(s, d):
    status = F.when(F.col("id").endswith("3") & ~F.col("id").endswith("7"), "stale").when(~F.col("id").endswith("7"), F.col("status"))
    return checks.no_backbone(t.nodes(s, d).withColumn("status", status), t.bindings(s, d))


_FOUND_SQL = f"""{GRAPH}, found AS (
  SELECT 1 AS rank, 'SILENT_DRIFT' AS code, b.id AS node_id, concept || ' ' || value AS detail FROM bindings b JOIN nodes n ON n.id = b.id WHERE status = 'current' AND value <> CASE concept WHEN 'market' THEN 'BUILDING' ELSE 'Brand#11' END
  UNION ALL SELECT 2, 'SILENT_DRIFT', b.id, concept || ' ' || value FROM bindings b WHERE value IN ('MACHINERY', 'Brand#23')
  UNION ALL SELECT 1, 'READS_RETIRED', down, up || ' ' || u.status FROM deps JOIN nodes u ON u.id = up JOIN nodes w ON w.id = down WHERE w.status = 'current' AND u.status = 'deprecated'
)"""


def _found(s, d):
    lint = checks.finding(t.bindings(s, d).where(F.col("value").isin("MACHINERY", "Brand#23")), "warning", "SILENT_DRIFT", F.col("id"), F.concat_ws(" ", "concept", "value"))
    return reduce(DataFrame.union, (check_silent_drift(s, d), lint, check_reads_retired(s, d)))


@query(f"""WITH {_FOUND_SQL} SELECT CASE min(rank) WHEN 1 THEN 'error' ELSE 'warning' END AS severity, code, node_id, detail, count(*) AS sources, min(rank) = 1 AS blocking FROM found GROUP BY code, node_id, detail""")
def findings_merged(s, d):
    return checks.merged(_found(s, d))


@query(f"""WITH {_FOUND_SQL}, m AS (SELECT CASE min(rank) WHEN 1 THEN 'error' ELSE 'warning' END AS severity, code, node_id, detail FROM found GROUP BY code, node_id, detail) SELECT severity, code, count(*) AS n, count(DISTINCT node_id) AS n_nodes FROM m GROUP BY ALL""")
def findings_summary(s, d):
    return checks.summary(checks.merged(_found(s, d)))


# -- ledgers -------------------------------------------------------------------------

_PAIRS = f"""{t.LEDGER_SQL}, st AS (SELECT run_id, arg_min(event_id, ("at", event_id)) AS start_id, min("at") AS started, count(*) AS n FROM ledger WHERE type = 'run.started' GROUP BY run_id),
fi AS (SELECT run_id, arg_min(event_id, ("at", event_id)) AS finish_id, min("at") AS finished, count(*) AS n FROM ledger WHERE type = 'run.finished' GROUP BY run_id),
pairs AS (SELECT coalesce(st.run_id, fi.run_id) AS run_id, start_id, started, finish_id, finished FROM st FULL JOIN fi ON st.run_id = fi.run_id)"""


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def ledger_pair_runs(s, d):
    return ledgers.pair_runs(t.ledger(s, d))


@query(f"""WITH {_PAIRS} SELECT CASE WHEN start_id IS NULL THEN 'FINISH_WITHOUT_START' WHEN finish_id IS NULL THEN 'RUN_INCOMPLETE' ELSE 'FINISH_BEFORE_START' END AS code, run_id FROM pairs
WHERE start_id IS NULL OR finish_id IS NULL OR finished < started UNION ALL SELECT 'DUPLICATE_START', run_id FROM st WHERE n > 1 UNION ALL SELECT 'DUPLICATE_FINISH', run_id FROM fi WHERE n > 1""")
def ledger_link_issues(s, d):
    return ledgers.link_issues(t.ledger(s, d))


@query(f"""WITH {t.LEDGER_SQL} SELECT run_id, type, event_id, "at", version, value FROM ledger QUALIFY row_number() OVER (PARTITION BY run_id, type ORDER BY "at" DESC, event_id DESC) = 1""")
def ledger_latest_receipt(s, d):
    return ledgers.latest(t.ledger(s, d), ["run_id", "type"])


@query(f"""WITH {t.LEDGER_SQL} SELECT * FROM (SELECT run_id, type, arg_min(version, ("at", event_id)) AS recorded, arg_max(version, ("at", event_id)) AS current FROM ledger GROUP BY run_id, type) WHERE recorded <> current""")
def ledger_output_drift(s, d):
    return ledgers.drift(t.ledger(s, d), ["run_id", "type"])


@query("""WITH r AS (SELECT o_custkey AS k, o_orderkey AS run_id, o_orderdate AS started, max(l_shipdate) AS finished FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
l AS (SELECT k, arg_max(run_id, (started, run_id)) AS by_id, max(started) AS last FROM r GROUP BY k) SELECT r.k, run_id, by_id AS replaced_by FROM r JOIN l ON l.k = r.k WHERE last > finished""")
def ledger_replacement(s, d):
    finished = t.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.max("l_shipdate").alias("finished"))
    runs = t.table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started")).join(finished, "run_id")
    return ledgers.replacements(runs, ["k"])


@query("""WITH x AS (SELECT l_partkey AS k, sum(l_quantity)::BIGINT AS q FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1), y AS (SELECT l_partkey AS k, sum(l_quantity)::BIGINT AS q FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1)
SELECT coalesce(x.k, y.k) AS path, CASE WHEN x.k IS NULL THEN 'created' WHEN y.k IS NULL THEN 'deleted' ELSE 'content_changed' END AS transition FROM x FULL JOIN y ON x.k = y.k WHERE x.q IS DISTINCT FROM y.q""")
def ledger_window_delta(s, d):
    scan = lambda n: t.table(s, d, "lineitem").where(F.col("l_linenumber") % 2 == n).groupBy(F.col("l_partkey").alias("path")).agg(F.sum("l_quantity").cast("long").alias("hash"))
    return ledgers.window_delta(scan(1), scan(0))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0.09 THEN 'precondition_failed' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'interrupted' WHEN l_tax > 0.07 THEN 'launch_error'
WHEN l_quantity % 7 <> 0 THEN 'failed' WHEN l_returnflag = 'A' THEN 'contract_failed' ELSE 'succeeded' END AS outcome FROM lineitem""")
def ledger_outcome(s, d):
    c = F.col
    return t.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ledgers.outcome(c("l_discount") > 0.09, (c("l_returnflag") == "R") & (c("l_linestatus") == "O"), c("l_tax") > 0.07, c("l_quantity") % 7, c("l_returnflag") == "A").alias("outcome"))


@query("""SELECT l_orderkey, count(*) AS attempts, CASE WHEN count(*) < 2 THEN 'insufficient' WHEN count(DISTINCT l_returnflag) = 1 THEN 'byte_repeatable' ELSE 'differs' END AS outcome FROM lineitem GROUP BY l_orderkey""")
def replay_compare(s, d):
    return ledgers.replay_compare(t.table(s, d, "lineitem"), ["l_orderkey"], "l_returnflag")


@query("""WITH one AS (SELECT user_id AS run_id, event_type AS stage, min((ts, event_id)) AS f, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL),
p AS (SELECT *, CASE stage WHEN 'view' THEN 'signup' WHEN 'click' THEN 'view' WHEN 'purchase' THEN 'click' END AS parent FROM one)
SELECT p.run_id, p.stage, row_number() OVER (PARTITION BY p.run_id ORDER BY p.f) AS seq,
  CASE WHEN p.parent IS NOT NULL AND (a.f IS NULL OR a.f > p.f) THEN 'out_of_order' WHEN p.n > 1 THEN 'repeated' ELSE 'accepted' END AS state FROM p LEFT JOIN one a ON a.run_id = p.run_id AND a.stage = p.parent""")
def stage_trace_fold(s, d):
    events = t.table(s, d, "events").select("event_id", F.col("user_id").alias("run_id"), F.col("event_type").alias("type"), F.col("ts").alias("at"))
    return ledgers.stage_fold(events, {"signup": None, "view": "signup", "click": "view", "purchase": "click"})


@query("SELECT user_id AS run_id, arg_min(CASE WHEN event_type = 'view' THEN event_id END, (ts, event_id)) FILTER (WHERE event_type = 'view') AS start_id, arg_min(event_id, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS finish_id FROM events GROUP BY 1")
def stream_pair_runs(s, d):
    from strandline.sources.scratch import scratch_path

    path = scratch_path(s, "stream")
    return pairing.run_to_end(pairing.pair_stream(pairing.event_stream(s, d), "view", "purchase"), "pairs_" + path[-8:], path)


# -- reviews -------------------------------------------------------------------------

_DOCS = "c AS (SELECT conv_id || ':' || turn AS id, CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS supersedes, role FROM conversations)"


def _chain(s, d):
    name = lambda turn: F.concat_ws(":", F.col("conv_id"), turn)
    return t.table(s, d, "conversations").select(name(F.col("turn")).alias("id"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("supersedes"), "role")


@query(f"WITH {_DOCS} SELECT * FROM c WHERE id NOT IN (SELECT supersedes FROM c WHERE supersedes IS NOT NULL)")
def review_leaves(s, d):
    return reviews.leaves(_chain(s, d))


@query(f"""WITH {_DOCS}, k AS (SELECT id, CASE WHEN role = 'user' AND supersedes IS NOT NULL THEN split_part(id, ':', 1) || ':0' ELSE supersedes END AS supersedes FROM c WHERE NOT (id LIKE '%:1')),
n AS (SELECT * FROM k WHERE supersedes IS NOT NULL)
SELECT 'MISSING_PREDECESSOR' AS code, id FROM n WHERE supersedes NOT IN (SELECT id FROM k) UNION ALL SELECT 'BRANCHED_CHAIN', supersedes FROM n GROUP BY supersedes HAVING count(*) > 1""")
def review_chain_issues(s, d):
    first = F.concat(F.split("id", ":")[0], F.lit(":0"))
    bent = _chain(s, d).where(~F.col("id").like("%:1")).select("id", F.when((F.col("role") == "user") & F.col("supersedes").isNotNull(), first).otherwise(F.col("supersedes")).alias("supersedes"))
    return reviews.chain_issues(bent)


@query("SELECT l_orderkey, l_linenumber, list_sort(list(DISTINCT l_returnflag)) AS verdicts FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL HAVING count(DISTINCT l_returnflag) > 1")
def review_conflicts(s, d):
    return reviews.conflicts(t.table(s, d, "lineitem").where("l_linestatus = 'F'"), ["l_orderkey", "l_linenumber"], "l_returnflag")


@query("""WITH a AS (SELECT l_suppkey AS src, l_partkey AS dst, CASE l_returnflag WHEN 'R' THEN 'refutes' ELSE 'supports' END AS relation, l_linestatus = 'F' AS accepted FROM lineitem),
links AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, 'supports' AS rel FROM lineitem WHERE l_quantity > 25 UNION ALL SELECT s_suppkey, s_suppkey, 'refutes' FROM supplier),
y AS (SELECT src, dst, true AS seen, bool_or(accepted AND relation = 'supports') AS f, bool_or(accepted AND relation = 'refutes') AS g FROM a GROUP BY ALL)
SELECT l.src, l.dst, rel, CASE WHEN seen IS NULL THEN 'unassessed' WHEN f AND g THEN 'conflict' WHEN CASE rel WHEN 'supports' THEN f ELSE g END THEN 'covered' WHEN CASE rel WHEN 'supports' THEN g ELSE f END THEN 'contradicted' ELSE 'pending' END AS status
FROM links l LEFT JOIN y ON y.src = l.src AND y.dst = l.dst""")
def link_coverage(s, d):
    line = t.table(s, d, "lineitem")
    given = line.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.when(F.col("l_returnflag") == "R", "refutes").otherwise("supports").alias("relation"), (F.col("l_linestatus") == "F").alias("accepted"))
    links = line.where("l_quantity > 25").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("supports").alias("rel")).distinct()
    return reviews.link_coverage(links.union(t.table(s, d, "supplier").select("s_suppkey", "s_suppkey", F.lit("refutes"))), given)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'needs_meaning' WHEN n IS NULL THEN 'needs_executed' WHEN o_orderstatus = 'P' THEN 'needs_current'
WHEN NOT coalesce(done, false) THEN 'needs_replayed' WHEN NOT coalesce(c_acctbal > 0, false) THEN 'needs_reviewed' ELSE 'ready' END AS readiness
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, bool_or(l_returnflag <> 'R') AS done FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey""")
def claim_readiness(s, d):
    runs = t.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.lit(True).alias("executed"), F.bool_or(F.col("l_returnflag") != "R").alias("replayed"))
    owner = t.table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") > 0).alias("reviewed"))
    basis = t.table(s, d, "orders").join(runs, "o_orderkey", "left").join(owner, "o_custkey", "left")
    return reviews.readiness(basis.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM").alias("meaning"), "executed", (F.col("o_orderstatus") != "P").alias("current"), "replayed", "reviewed"))


def _ballots(s, d):
    decision = F.when(F.col("l_returnflag") == "N", "endorse").when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40), "reject").otherwise("abstain")
    return t.table(s, d, "lineitem").select(F.col("l_partkey").alias("candidate"), F.col("l_suppkey").alias("grp"), decision.alias("decision"))


@query("""WITH b AS (SELECT l_partkey AS candidate, l_suppkey AS grp, CASE WHEN l_returnflag = 'N' THEN 'endorse' WHEN l_returnflag = 'R' AND l_quantity > 40 THEN 'reject' ELSE 'abstain' END AS decision FROM lineitem),
g AS (SELECT candidate, grp, CASE WHEN bool_or(decision = 'reject') THEN 'reject' WHEN bool_and(decision = 'endorse') THEN 'endorse' ELSE 'abstain' END AS decision FROM b GROUP BY candidate, grp),
c AS (SELECT candidate, count(*) FILTER (WHERE decision = 'endorse') AS endorse, count(*) FILTER (WHERE decision = 'reject') AS reject, count(*) FILTER (WHERE decision = 'abstain') AS abstain FROM g GROUP BY candidate)
SELECT *, CASE WHEN endorse + reject < 2 THEN 'no_quorum' WHEN 3 * endorse >= 2 * (endorse + reject) THEN 'recommended' ELSE 'not_recommended' END AS status FROM c""")
def panel_vote(s, d):
    return reviews.panel_vote(_ballots(s, d))


@query("""WITH e AS (SELECT DISTINCT l_partkey AS c, l_suppkey AS g, l_linenumber % 3 AS r FROM lineitem WHERE l_returnflag = 'N'),
ok AS (SELECT DISTINCT a.c FROM e a JOIN e b ON a.c = b.c JOIN e x ON x.c = a.c WHERE a.r = 0 AND b.r = 1 AND x.r = 2 AND a.g <> b.g AND a.g <> x.g AND b.g <> x.g) SELECT DISTINCT c AS candidate, c IN (SELECT c FROM ok) AS covered FROM e""")
def panel_roles(s, d):
    given = t.table(s, d, "lineitem").where("l_returnflag = 'N'").select(F.col("l_partkey").alias("candidate"), F.col("l_suppkey").alias("grp"), (F.col("l_linenumber") % 3).cast("string").alias("role"))
    return reviews.role_coverage(given, ("0", "1", "2"))


@query("""SELECT round_, phase, list_sort(list(DISTINCT p)) AS proposals FROM (SELECT o_orderpriority AS round_, o_orderstatus AS phase, o_custkey % 50 AS p, o_orderkey FROM orders) WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY ALL""")
def open_proposal_groups(s, d):
    free = t.table(s, d, "orders").join(t.table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    return free.groupBy(F.col("o_orderpriority").alias("round_"), F.col("o_orderstatus").alias("phase")).agg(F.array_sort(F.collect_set(F.col("o_custkey") % 50)).alias("proposals"))


_PANEL = """p AS (SELECT DISTINCT l_partkey % 900 AS set_id, l_partkey AS candidate, l_suppkey % 8 AS grp, l_tax < 0.08 AS passed FROM lineitem WHERE l_linenumber = 7),
b AS (SELECT l_partkey % 900 AS set_id, l_partkey AS candidate, l_suppkey % 8 AS grp, l_linenumber % 3 AS role, CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 'reject' WHEN l_returnflag = 'A' AND l_quantity < 5 THEN 'abstain' ELSE 'endorse' END AS decision,
  l_discount > 0.0995 AS blocking FROM lineitem WHERE l_linenumber < 7), c AS (SELECT p_partkey % 900 AS set_id, p_partkey AS candidate FROM part WHERE p_size > 2)"""


@query(f"""WITH {_PANEL}, n AS (SELECT set_id, count(*) AS n FROM c GROUP BY 1), own AS (SELECT candidate, count(DISTINCT grp) AS proposers, bool_and(passed) AS passed FROM p GROUP BY 1),
g AS (SELECT candidate, grp, bool_and(decision = 'endorse') AS e, bool_or(decision = 'reject') AS j, bool_or(blocking) AS blocking FROM b GROUP BY ALL),
o AS (SELECT * FROM g WHERE (candidate, grp) NOT IN (SELECT candidate, grp FROM p)), k AS (SELECT candidate, count(*) FILTER (WHERE e) AS e, count(*) FILTER (WHERE j) AS j, count(*) AS n FROM o GROUP BY 1),
r AS (SELECT DISTINCT candidate, grp, role FROM b JOIN o USING (candidate, grp) WHERE e), ok AS (SELECT DISTINCT x.candidate FROM r x JOIN r y ON x.candidate = y.candidate JOIN r z ON z.candidate = x.candidate WHERE x.role = 0 AND y.role = 1 AND z.role = 2 AND x.grp <> y.grp AND x.grp <> z.grp AND y.grp <> z.grp),
bl AS (SELECT candidate FROM g WHERE blocking),
a AS (SELECT c.*, n.n AS size, coalesce(passed, false) AS passed, coalesce(proposers, 0) AS proposers, coalesce(k.e, 0) AS e, coalesce(k.j, 0) AS j, coalesce(k.n, 0) AS outside FROM c JOIN n USING (set_id) LEFT JOIN own USING (candidate) LEFT JOIN k USING (candidate))
SELECT set_id, candidate, CASE WHEN size <> 1 THEN 'several_candidates' WHEN NOT passed THEN 'not_validated' WHEN proposers + outside < 3 THEN 'too_few_groups' WHEN NOT (proposers >= 2 AND e >= 1 OR proposers >= 1 AND e >= 2) THEN 'no_quorum'
  WHEN candidate NOT IN (FROM ok) THEN 'roles_open' WHEN candidate IN (FROM bl) THEN 'blocked' WHEN e + j = 0 OR 3 * e < 2 * (e + j) THEN 'no_majority' ELSE 'recommended' END AS status FROM a""")
def panel_recommendation(s, d):
    of = lambda df, **columns: df.select(*(F.expr(e).alias(name) for name, e in columns.items()))
    line = t.table(s, d, "lineitem")
    decision = "CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 'reject' WHEN l_returnflag = 'A' AND l_quantity < 5 THEN 'abstain' ELSE 'endorse' END"
    proposals = of(line.where("l_linenumber = 7"), set_id="l_partkey % 900", candidate="l_partkey", grp="l_suppkey % 8", passed="l_tax < 0.08")
    ballots = of(line.where("l_linenumber < 7"), set_id="l_partkey % 900", candidate="l_partkey", grp="l_suppkey % 8", role="cast(l_linenumber % 3 AS string)", decision=decision, blocking="l_discount > 0.0995")
    return reviews.panel_recommendation(of(t.table(s, d, "part").where("p_size > 2"), set_id="p_partkey % 900", candidate="p_partkey"), proposals, ballots, ("0", "1", "2"))


_REVIEWS = f"""{_DOCS.replace(", role FROM", ", role, turn, CASE turn % 3 WHEN 0 THEN 'proposed' WHEN 1 THEN 'accepted' ELSE 'contested' END AS state, length(text) % 3 AS actor, CASE WHEN length(text) % 7 = 0 THEN role ELSE 'same' END AS body, turn - 2 * (length(text) % 5)  AS \"at\" FROM")}"""


@query(f"""WITH {_REVIEWS}, x AS (SELECT n.*, o.state AS was, o.actor AS by_, o.body AS old, o."at" AS since FROM c n JOIN c o ON o.id = n.supersedes)
SELECT 'TRANSITION_NOT_ALLOWED' AS code, id FROM x WHERE NOT (was = 'proposed' AND state IN ('accepted', 'contested') OR was = 'accepted' AND state = 'contested' OR was = 'contested' AND state = 'accepted')
UNION ALL SELECT 'BODY_CHANGED', id FROM x WHERE body IS DISTINCT FROM old UNION ALL SELECT 'TIME_GOES_BACK', id FROM x WHERE "at" < since UNION ALL SELECT 'REVIEWER_IS_PROPOSER', id FROM x WHERE was = 'proposed' AND by_ = actor""")
def review_transitions(s, d):
    state = F.when(F.col("turn") % 3 == 0, "proposed").when(F.col("turn") % 3 == 1, "accepted").otherwise("contested")
    size = F.length("text")
    name = lambda turn: F.concat_ws(":", F.col("conv_id"), turn)
    docs = t.table(s, d, "conversations").select(name(F.col("turn")).alias("id"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("supersedes"), state.alias("state"), (size % 3).alias("actor"), F.when(size % 7 == 0, F.col("role")).otherwise("same").alias("body"), (F.col("turn") - 2 * (size % 5)).alias("at"))
    return reviews.transition_issues(docs)


# -- files and manifests -------------------------------------------------------------

_MANIFESTS = f"""{t.BINDINGS_SQL}, renders AS (SELECT 'orders:' || o_orderkey AS id, 'out/' || o_orderkey AS path FROM orders),
manifests AS (SELECT 'orders:' || o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'orders:0' ELSE 'orders:' || o_orderkey END AS node, CASE WHEN o_orderkey % 13 = 0 THEN 'out/x' ELSE 'out/' || o_orderkey END AS output,
  CASE WHEN o_orderkey % 17 = 0 THEN 'none' ELSE sha256(o_orderkey::VARCHAR) END AS output_hash, CASE WHEN o_orderkey % 19 = 0 THEN 'other' ELSE 'render-manifest/2' END AS version FROM orders WHERE o_orderkey % 7 <> 0),
inputs AS (SELECT 'orders:' || l_orderkey AS id, 'part/' || l_partkey AS path, sha256(l_returnflag) AS hash, l_linenumber AS "at" FROM lineitem),
expected AS (SELECT 'orders:' || l_orderkey AS id, 'part/' || l_partkey AS path FROM lineitem WHERE l_quantity > 2 UNION ALL SELECT 'orders:' || l_orderkey, 'part/' || (l_partkey + 1) FROM lineitem WHERE l_quantity > 48),
locked AS (SELECT 'orders:' || o_orderkey AS id, 'brand' AS concept, CASE WHEN o_orderstatus = 'P' THEN 'Brand#12' ELSE 'Brand#11' END AS value FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderkey % 9 = 0),
files AS (SELECT 'part/' || p_partkey AS path, sha256(CASE WHEN p_size > 40 THEN 'R' ELSE 'N' END) AS hash FROM part WHERE p_size > 3 UNION ALL SELECT 'out/' || o_orderkey, sha256(CASE WHEN o_orderstatus = 'P' THEN 'x' ELSE o_orderkey::VARCHAR END) FROM orders WHERE o_orderkey % 23 <> 0)"""


def _manifests(s, d) -> dict[str, DataFrame]:
    of = lambda df, **columns: df.select(*(F.expr(e).alias(name) for name, e in columns.items()))
    orders, line, part = (t.table(s, d, n) for n in ("orders", "lineitem", "part"))
    own, out = "concat('orders:', o_orderkey)", "concat('out/', o_orderkey)"
    given = of(line, id="concat('orders:', l_orderkey)", path="concat('part/', l_partkey)", hash="sha2(l_returnflag, 256)", at="l_linenumber", q="l_quantity", p="l_partkey")
    return {
        "renders": of(orders, id=own, path=out),
        "manifests": of(
            orders.where("o_orderkey % 7 <> 0"), id=own, node=f"if(o_orderkey % 11 = 0, 'orders:0', {own})", output=f"if(o_orderkey % 13 = 0, 'out/x', {out})",
            output_hash="if(o_orderkey % 17 = 0, 'none', sha2(cast(o_orderkey AS string), 256))", version=f"if(o_orderkey % 19 = 0, 'other', '{manifests.VERSION}')",
        ),
        "inputs": given.drop("q", "p"),
        "expected": given.where("q > 2").select("id", "path").union(given.where("q > 48").select("id", F.expr("concat('part/', p + 1)"))),
        "locked": of(orders.where("o_orderpriority = '1-URGENT' OR o_orderkey % 9 = 0"), id=own, concept="'brand'", value="if(o_orderstatus = 'P', 'Brand#12', 'Brand#11')"),
        "files": of(part.where("p_size > 3"), path="concat('part/', p_partkey)", hash="sha2(if(p_size > 40, 'R', 'N'), 256)").union(
            of(orders.where("o_orderkey % 23 <> 0"), path=out, hash="sha2(if(o_orderstatus = 'P', 'x', cast(o_orderkey AS string)), 256)")
        ),
    }


@query(f"WITH {_MANIFESTS} SELECT 'error' AS severity, 'MISSING_FILE' AS code, id AS node_id, path AS detail FROM renders WHERE path NOT IN (SELECT path FROM files)")
def check_missing_file(s, d):
    m = _manifests(s, d)
    return checks.missing_file(m["renders"], m["files"])


@query(r"""SELECT 'error' AS severity, 'INVALID_NODE_PATH' AS code, 'page:' || page_id AS node_id, p AS detail FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '../' WHEN 1 THEN 'a/' WHEN 2 THEN '/' ELSE 'a/./' END || page_id AS p FROM pages) WHERE page_id % 4 <> 1""")
def check_invalid_path(s, d):
    lead = F.when(F.col("page_id") % 4 == 0, "../").when(F.col("page_id") % 4 == 1, "a/").when(F.col("page_id") % 4 == 2, "/").otherwise("a/./")
    return checks.invalid_node_path(t.table(s, d, "pages").select(t.key("page", "page_id").alias("id"), F.concat(lead, F.col("page_id").cast("string")).alias("path")))


@query(f"""WITH {GRAPH} SELECT 'error' AS severity, 'UNKNOWN_BACKBONE_CONCEPT' AS code, id AS node_id, concept AS detail FROM bindings WHERE concept <> 'brand'""")
def check_unknown_concept(s, d):
    return checks.unknown_concept(t.bindings(s, d), s.range(1).select(F.lit("brand").alias("name")))


@query(f"""WITH {GRAPH} SELECT 'pending' AS severity, 'PENDING' AS code, n.id AS node_id, coalesce(concept || ':' || value || ' -> ' || CASE concept WHEN 'market' THEN 'BUILDING' ELSE 'Brand#11' END, '') AS detail FROM nodes n LEFT JOIN bindings b ON b.id = n.id WHERE n.id LIKE '%5'""")
def check_pending(s, d):
    stale = t.nodes(s, d).withColumn("status", F.when(F.col("id").endswith("5"), "stale").otherwise(F.col("status")))
    return checks.pending(stale, t.bindings(s, d), t.CANONICAL)


@query(f"WITH {_MANIFESTS} SELECT 'error' AS severity, 'MISSING_MANIFEST' AS code, id AS node_id, path AS detail FROM renders WHERE id NOT IN (SELECT id FROM manifests)")
def manifest_missing(s, d):
    m = _manifests(s, d)
    return manifests.missing(m["renders"], m["manifests"])


@query(f"""WITH {_MANIFESTS}, k AS (SELECT m.*, path, version = 'render-manifest/2' AS known FROM manifests m JOIN renders USING (id)), rep AS (SELECT id FROM inputs GROUP BY id, path HAVING count(*) > 1)
SELECT 'error' AS severity, 'INVALID_MANIFEST' AS code, id AS node_id, w AS detail FROM (
SELECT id, 'unknown version' AS w FROM k WHERE NOT known UNION ALL SELECT id, 'another node' FROM k WHERE known AND node <> id UNION ALL SELECT id, 'another output' FROM k WHERE known AND output <> path
UNION ALL SELECT id, 'no output hash' FROM k WHERE known AND output_hash = 'none' UNION ALL SELECT id, 'repeated or malformed input' FROM k WHERE known AND id IN (FROM rep))""")
def manifest_invalid(s, d):
    m = _manifests(s, d)
    return manifests.invalid(m["renders"], m["manifests"], m["inputs"])


@query(f"""WITH {_MANIFESTS}, a AS (SELECT * FROM locked WHERE id IN (SELECT id FROM manifests)), b AS (SELECT * FROM bindings WHERE id IN (SELECT id FROM manifests))
SELECT 'error' AS severity, 'MANIFEST_BACKBONE_MISMATCH' AS code, coalesce(a.id, b.id) AS node_id, coalesce(a.concept, b.concept) AS detail FROM a FULL JOIN b ON a.id = b.id AND a.concept = b.concept WHERE a.value IS DISTINCT FROM b.value""")
def manifest_backbone_mismatch(s, d):
    m = _manifests(s, d)
    return manifests.backbone_mismatch(m["manifests"], m["locked"], t.bindings(s, d))


@query(f"""WITH {_MANIFESTS}, a AS (SELECT DISTINCT id, path FROM inputs WHERE id IN (SELECT id FROM manifests)), b AS (SELECT DISTINCT id, path FROM expected WHERE id IN (SELECT id FROM manifests))
SELECT 'error' AS severity, 'MANIFEST_INPUT_MISMATCH' AS code, id AS node_id, 'missing: ' || path AS detail FROM (FROM b EXCEPT FROM a) UNION ALL SELECT 'error', 'MANIFEST_INPUT_MISMATCH', id, 'undeclared: ' || path FROM (FROM a EXCEPT FROM b)""")
def manifest_input_mismatch(s, d):
    m = _manifests(s, d)
    return manifests.input_mismatch(m["manifests"], m["inputs"], m["expected"])


@query(f"""WITH {_MANIFESTS} SELECT 'error' AS severity, 'OUTPUT_DRIFT' AS code, m.id AS node_id, r.path AS detail FROM manifests m JOIN renders r USING (id) JOIN files f ON f.path = r.path WHERE output_hash <> 'none' AND hash <> output_hash""")
def manifest_output_drift(s, d):
    m = _manifests(s, d)
    return manifests.output_drift(m["renders"], m["manifests"], m["files"])


@query(f"""WITH {_MANIFESTS}, off AS (SELECT i.id, i.path, i."at", f.hash AS now FROM inputs i LEFT JOIN files f ON f.path = i.path WHERE i.id IN (SELECT id FROM manifests) AND f.hash IS DISTINCT FROM i.hash)
SELECT 'error' AS severity, 'STALE_DATA' AS code, id AS node_id, CASE WHEN now IS NULL THEN 'missing: ' ELSE 'changed: ' END || path AS detail FROM off QUALIFY row_number() OVER (PARTITION BY id ORDER BY "at", path) = 1""")
def manifest_stale_data(s, d):
    m = _manifests(s, d)
    return manifests.stale_data(m["manifests"], m["inputs"], m["files"])


#: Order lines repeat their numbers: one row of each stands for a record.
_LINE = "line AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1)"


def _line(s, d):
    least = F.min_by(F.struct("*"), F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    return t.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(least.alias("x")).select("x.*")


_LEDGER_OF_SETS = f"""{_LINE}, proposals AS (SELECT l_orderkey AS topic, l_partkey AS candidate, l_suppkey AS actor, l_suppkey % 7 AS grp FROM line),
sets AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 64 = 63 THEN o_orderkey - 1 ELSE o_orderkey END AS topic FROM orders),
members AS (SELECT l_orderkey AS set_id, CASE WHEN l_tax >= 0.08 THEN l_partkey + 1 ELSE l_partkey END AS candidate FROM line WHERE l_quantity > 2),
ballots AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_discount >= 0.1 THEN -l_orderkey ELSE l_orderkey END AS set_id, l_suppkey % 5 AS voter, l_suppkey % 7 AS grp, l_returnflag AS role, l_shipdate AS "at" FROM line WHERE l_linenumber <= 3),
evaluations AS (SELECT b.id AS ballot_id, l_partkey AS candidate FROM ballots b JOIN line ON l_orderkey = b.id // 10 WHERE l_linenumber <> b.id % 10),
decisions AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN o_orderkey - 1 ELSE o_orderkey END AS set_id, o_custkey % 11 AS actor, o_orderdate + INTERVAL 60 DAY AS "at" FROM orders),
pins AS (SELECT l_orderkey AS decision_id, l_orderkey * 10 + l_linenumber AS ballot_id FROM line WHERE l_linenumber <= CASE WHEN l_returnflag = 'R' THEN 4 ELSE 3 END)"""


@query(f"""WITH {_LEDGER_OF_SETS}, proposed AS (SELECT DISTINCT s.id AS set_id, candidate FROM proposals p JOIN sets s ON s.topic = p.topic),
own AS (SELECT DISTINCT s.id AS set_id, candidate, grp FROM proposals p JOIN sets s ON s.topic = p.topic), m AS (SELECT DISTINCT set_id, candidate FROM members),
cb AS (SELECT b.* FROM ballots b JOIN sets s ON s.id = b.set_id), j AS (SELECT DISTINCT cb.id, cb.set_id, cb.grp, candidate FROM evaluations e JOIN cb ON cb.id = e.ballot_id),
due AS (SELECT d.id AS decision_id, b.id AS ballot_id FROM decisions d JOIN ballots b ON b.set_id = d.set_id)
SELECT DISTINCT code, id FROM (
SELECT 'SET_REPEATED' AS code, id FROM sets WHERE topic IN (SELECT topic FROM sets GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'SET_LACKS_PROPOSAL', set_id FROM proposed WHERE (set_id, candidate) NOT IN (FROM m)
UNION ALL SELECT 'SET_UNPROPOSED_CANDIDATE', set_id FROM m WHERE (set_id, candidate) NOT IN (FROM proposed)
UNION ALL SELECT 'BALLOT_WITHOUT_SET', id FROM ballots WHERE set_id NOT IN (SELECT id FROM sets)
UNION ALL SELECT 'BALLOT_REPEATED', b.id FROM ballots b JOIN ballots o ON o.set_id = b.set_id AND o.voter = b.voter AND o.role = b.role AND o.id <> b.id
UNION ALL SELECT 'BALLOT_UNKNOWN_CANDIDATE', id FROM j WHERE (set_id, candidate) NOT IN (FROM m)
UNION ALL SELECT 'BALLOT_OWN_CANDIDATE', j.id FROM j JOIN m ON m.set_id = j.set_id AND m.candidate = j.candidate WHERE (j.set_id, j.candidate, j.grp) IN (FROM own)
UNION ALL SELECT 'BALLOT_LACKS_CANDIDATE', cb.id FROM cb JOIN m ON m.set_id = cb.set_id WHERE (cb.set_id, m.candidate, cb.grp) NOT IN (FROM own) AND (cb.id, m.candidate) NOT IN (SELECT id, candidate FROM j)
UNION ALL SELECT 'DECISION_WITHOUT_SET', id FROM decisions WHERE set_id NOT IN (SELECT id FROM sets)
UNION ALL SELECT 'DECISION_REPEATED', id FROM decisions WHERE set_id IN (SELECT set_id FROM decisions GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'DECISION_NOT_INDEPENDENT', d.id FROM decisions d JOIN ballots b ON b.set_id = d.set_id AND b.voter = d.actor
UNION ALL SELECT 'DECISION_NOT_INDEPENDENT', d.id FROM decisions d JOIN sets s ON s.id = d.set_id JOIN proposals p ON p.topic = s.topic AND p.actor = d.actor
UNION ALL SELECT 'DECISION_STALE_BALLOTS', decision_id FROM due WHERE (decision_id, ballot_id) NOT IN (FROM pins)
UNION ALL SELECT 'DECISION_STALE_BALLOTS', decision_id FROM pins WHERE (decision_id, ballot_id) NOT IN (FROM due)
UNION ALL SELECT 'DECISION_EARLY', d.id FROM decisions d JOIN ballots b ON b.set_id = d.set_id WHERE d."at" < b."at")""")
def deliberation_issues(s, d):
    line, orders = _line(s, d), t.table(s, d, "orders")
    of = lambda df, **columns: df.select(*(F.expr(e).alias(name) for name, e in columns.items()))
    ballots = of(line.where("l_linenumber <= 3"), id="l_orderkey * 10 + l_linenumber", set_id="if(l_discount >= 0.1, -l_orderkey, l_orderkey)", voter="l_suppkey % 5", grp="l_suppkey % 7", role="l_returnflag", at="l_shipdate")
    others = line.select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("other"))
    return deliberations.issues(
        of(line, topic="l_orderkey", candidate="l_partkey", actor="l_suppkey", grp="l_suppkey % 7"),
        of(orders, id="o_orderkey", topic="if(o_orderkey % 64 = 63, o_orderkey - 1, o_orderkey)"),
        of(line.where("l_quantity > 2"), set_id="l_orderkey", candidate="if(l_tax >= 0.08, l_partkey + 1, l_partkey)"),
        ballots,
        of(line.where("l_linenumber <= 3").drop("l_partkey").join(others, "l_orderkey").where("other <> l_linenumber"), ballot_id="l_orderkey * 10 + l_linenumber", candidate="l_partkey"),
        of(orders, id="o_orderkey", set_id="if(o_orderstatus = 'P', o_orderkey - 1, o_orderkey)", actor="o_custkey % 11", at="o_orderdate + INTERVAL 60 DAY"),
        of(line.where("l_linenumber <= if(l_returnflag = 'R', 4, 3)"), decision_id="l_orderkey", ballot_id="l_orderkey * 10 + l_linenumber"),
    )


# -- mappings ------------------------------------------------------------------------

_MAPPINGS = f"""{_LINE}, m AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber > 4 THEN l_orderkey * 10 + l_linenumber - 1 END AS supersedes, l_suppkey AS term, CASE WHEN l_tax > 0.04 THEN 'close' ELSE 'exact' END AS relation, l_partkey AS target,
  CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'proposed' ELSE 'accepted' END AS state FROM line),
terms AS (SELECT s_suppkey AS term, s_nationkey % 3 AS kind FROM supplier), targets AS (SELECT p_partkey AS target, p_size % 3 AS kind, p_size > 40 AS deprecated FROM part WHERE p_size > 3),
leaf AS (SELECT * FROM m WHERE id NOT IN (SELECT supersedes FROM m WHERE supersedes IS NOT NULL)),
split AS (SELECT term FROM leaf WHERE state = 'accepted' GROUP BY term HAVING count(DISTINCT (relation, target)) > 1),
f AS (SELECT leaf.id, leaf.term, state, concat_ws(',', CASE WHEN x.target IS NULL THEN 'TARGET_MISSING' END, CASE WHEN deprecated THEN 'TARGET_DEPRECATED' END, CASE WHEN terms.kind <> x.kind THEN 'KIND_MISMATCH' END,
  CASE WHEN state = 'accepted' AND leaf.term IN (FROM split) THEN 'CONFLICT' END) AS findings FROM leaf LEFT JOIN targets x ON x.target = leaf.target LEFT JOIN terms ON terms.term = leaf.term),
judged AS (SELECT id, term, findings, state = 'accepted' AND findings = '' AS eligible FROM f)"""


def _mappings(s, d):
    of = lambda df, **columns: df.select(*(F.expr(e).alias(name) for name, e in columns.items()))
    m = of(
        _line(s, d), id="l_orderkey * 10 + l_linenumber", supersedes="if(l_linenumber > 4, l_orderkey * 10 + l_linenumber - 1, null)",
        term="l_suppkey", relation="if(l_tax > 0.04, 'close', 'exact')", target="l_partkey", state="CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'proposed' ELSE 'accepted' END",
    )
    terms = of(t.table(s, d, "supplier"), term="s_suppkey", kind="s_nationkey % 3")
    targets = of(t.table(s, d, "part").where("p_size > 3"), target="p_partkey", kind="p_size % 3", deprecated="p_size > 40")
    return m, mappings.eligibility(m, terms, targets)


@query(f"WITH {_MAPPINGS} SELECT * FROM judged")
def mapping_eligibility(s, d):
    return _mappings(s, d)[1]


@query(f"""WITH {_MAPPINGS}, p AS (SELECT DISTINCT o_orderpriority AS policy, o_orderkey * 10 + 5 AS mapping FROM orders), x AS (SELECT p.*, term, eligible, mapping IN (SELECT id FROM m) AS known FROM p LEFT JOIN judged ON id = mapping)
SELECT policy, mapping, CASE WHEN NOT known THEN 'MAPPING_MISSING' WHEN eligible IS NULL THEN 'MAPPING_SUPERSEDED' ELSE 'MAPPING_NOT_ELIGIBLE' END AS code FROM x WHERE NOT coalesce(eligible, false)
UNION ALL SELECT policy, mapping, 'TERM_REPEATED' FROM x WHERE term IS NOT NULL QUALIFY count(*) OVER (PARTITION BY policy, term) > 1""")
def policy_issues(s, d):
    m, judged = _mappings(s, d)
    policy = t.table(s, d, "orders").select(F.col("o_orderpriority").alias("policy"), (F.col("o_orderkey") * 10 + 5).alias("mapping"))
    return mappings.policy_issues(policy, m, judged)


# -- rules ---------------------------------------------------------------------------

_RULES = [
    {"id": "direct", "when": [("feeds", True, {"a": "?x", "b": "?y"})], "then": ("affects", True, {"a": "?x", "b": "?y"})},
    {"id": "further", "when": [("affects", True, {"a": "?x", "b": "?y"}), ("feeds", True, {"a": "?y", "b": "?z"})], "then": ("affects", True, {"a": "?x", "b": "?z"})},
    {"id": "risky", "when": [("balance", True, {"id": "?c", "amount": "?m"})], "where": [("lt", "?m", 0.0)], "then": ("sound", False, {"id": "?c"})},
    {"id": "active", "when": [("ordered", True, {"id": "?c", "price": "?p"})], "where": [("gt", "?p", 300000.0)], "then": ("sound", True, {"id": "?c"})},
]


@query(f"""WITH RECURSIVE {t.EDGES_SQL}, f AS (SELECT DISTINCT up AS a, down AS b FROM deps), w AS (SELECT a, b FROM f UNION SELECT w.a, f.b FROM w JOIN f ON f.a = w.b) SELECT * FROM w""")
def rule_closure(s, d):
    feeds = _deps(s, d).select(F.col("up").alias("a"), F.col("down").alias("b"))
    return rules.fixpoint({("feeds", True): feeds}, _RULES[:2])["affects", True]


@query("""WITH y AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000) SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 AND c_custkey IN (FROM y) THEN 'conflict' WHEN c_custkey IN (FROM y) THEN 'derivable' WHEN c_acctbal < 0 THEN 'refutable' ELSE 'unknown' END AS state FROM customer""")
def rule_states(s, d):
    c = t.table(s, d, "customer")
    facts = {("balance", True): c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount")), ("ordered", True): t.table(s, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("price"))}
    return rules.states(c.select(F.col("c_custkey").alias("id")), rules.fixpoint(facts, _RULES[2:]), "sound")


# -- search, diffs, inventories ------------------------------------------------------


@query(r"""WITH tm AS (SELECT 'part:' || p_partkey AS term_id, 1 AS tier, p_type AS text FROM part UNION ALL SELECT 'part:' || p_partkey, 0, p_name FROM part UNION ALL SELECT 'part:' || p_partkey, 2, p_brand FROM part),
q AS (SELECT DISTINCT upper(p_type) || ' ' AS query FROM part UNION SELECT p_brand FROM part), m AS (SELECT query, term_id, min(tier) AS tier FROM q JOIN tm ON lower(trim(regexp_replace(query, '\s+', ' ', 'g'))) = lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) GROUP BY ALL)
SELECT query, term_id, tier, row_number() OVER (PARTITION BY query ORDER BY tier, term_id) AS rank, count(*) OVER (PARTITION BY query) AS matches FROM m QUALIFY rank <= 10""")
def candidate_search(s, d):
    p = t.table(s, d, "part")
    term = lambda tier, c: p.select(t.key("part", "p_partkey").alias("term_id"), F.lit(tier).alias("tier"), F.col(c).alias("text"))
    wanted = p.select(F.concat(F.upper("p_type"), F.lit(" ")).alias("query")).union(p.select("p_brand")).distinct()
    return search.candidates(wanted, term(1, "p_type").union(term(0, "p_name")).union(term(2, "p_brand")), 10)


@query("""WITH b AS (SELECT o_custkey AS k, o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), a AS (SELECT o_custkey AS k, o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.p, b.p) AS p, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a ON a.k = b.k AND a.p = b.p WHERE a.n IS DISTINCT FROM b.n""")
def release_diff(s, d):
    one = lambda x: t.table(s, d, "orders").where(F.col("o_orderstatus") == x).groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    return search.diff(one("F"), one("O"), ["k", "p"])


@query("""SELECT s_suppkey AS id, CASE WHEN s_acctbal > 5000 THEN 'replaced' ELSE 'kept' END AS note FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT -1 - c_custkey, 'added' FROM customer""")
def graph_change_apply(s, d):
    return _changed(s, d, t.table(s, d, "customer"))


def _changed(s: SparkSession, d: str, added: DataFrame) -> DataFrame:
    sup = t.table(s, d, "supplier")
    base = sup.select(F.col("s_suppkey").alias("id"), F.lit("kept").alias("note"))
    add = added.select((-1 - F.col("c_custkey")).alias("id"), F.lit("added").alias("note"))
    return search.apply_changes(base, add, sup.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("id"), F.lit("replaced").alias("note")), sup.where("s_acctbal < 0").select(F.col("s_suppkey").alias("id")), ["id"])


@query("SELECT 'doc:' || l_orderkey AS path, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS roles, count(DISTINCT l_partkey) > 1 AS conflict FROM lineitem GROUP BY l_orderkey")
def release_inventory(s, d):
    return search.role_inventory(t.table(s, d, "lineitem").select(t.key("doc", "l_orderkey").alias("path"), F.col("l_returnflag").alias("role"), F.col("l_partkey").alias("hash")))


@query("SELECT l_returnflag AS role, count(*) AS n, count(DISTINCT l_orderkey) AS files FROM lineitem GROUP BY 1")
def release_role_counts(s, d):
    return t.table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("role")).agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("files"))


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS used FROM orders) WHERE used <= 500000")
def running_budget(s, d):
    priced = t.table(s, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("size"))
    return search.within_budget(priced, ["o_custkey"], ["o_orderkey"], "size", 500000).select("o_custkey", "o_orderkey", F.col("used").cast("decimal(38,2)").alias("used"))


@query("SELECT 'doc:sha256:' || sha256(text) AS content_id, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(s, d):
    named = t.table(s, d, "documents").select("doc_id", scalars.content_id("doc", F.col("text")).alias("content_id"))
    return named.groupBy("content_id").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


@query(f"""WITH {GRAPH} SELECT kind, count(*) AS n FROM (SELECT 'node:' || type AS kind FROM nodes UNION ALL SELECT 'edge:' || rel FROM edges UNION ALL SELECT 'binding:' || concept FROM bindings) GROUP BY 1""")
def projection_counts(s, d):
    kinds = t.nodes(s, d).select(F.concat(F.lit("node:"), "type").alias("kind")).union(t.edges(s, d).select(F.concat(F.lit("edge:"), "rel"))).union(t.bindings(s, d).select(F.concat(F.lit("binding:"), "concept")))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH {GRAPH}, live AS (SELECT id FROM nodes WHERE status NOT IN ('deprecated', 'planned')) SELECT src, dst, rel, src NOT IN (SELECT id FROM live) AS bad_src, dst NOT IN (SELECT id FROM live) AS bad_dst FROM edges WHERE src NOT IN (SELECT id FROM live) OR dst NOT IN (SELECT id FROM live)""")
def projection_unresolved(s, d):
    live = settled(t.nodes(s, d).where(~F.col("status").isin("deprecated", "planned")).select("id"), "live")
    e = t.edges(s, d).join(live.select(F.col("id").alias("src"), F.lit(True).alias("a")), "src", "left").join(live.select(F.col("id").alias("dst"), F.lit(True).alias("b")), "dst", "left")
    return e.where("a IS NULL OR b IS NULL").select("src", "dst", "rel", F.col("a").isNull().alias("bad_src"), F.col("b").isNull().alias("bad_dst"))


@query(f"""WITH {GRAPH} SELECT status, id, row_number() OVER (PARTITION BY status ORDER BY id) AS place FROM nodes WHERE type = 'claim'""")
def journal(s, d):
    return search.numbered(t.nodes(s, d).where("type = 'claim'").select("status", "id"), "status", "id")


# -- scalars -------------------------------------------------------------------------


@query("""SELECT c_custkey, 'run --Token [REDACTED] --API-key=[REDACTED] --authorization [REDACTED] --token [REDACTED] --name ' || c_name || ' --password' AS argv FROM customer""")
def argv_redact(s, d):
    name = F.col("c_name")
    argv = F.array(F.lit("run"), F.lit("--Token"), name, F.concat(F.lit("--API-key="), F.col("c_custkey").cast("string")), F.lit("--authorization"), F.lit("--token"), F.lit("--token"), name, F.lit("--name"), name, F.lit("--password"))
    return t.table(s, d, "customer").select("c_custkey", argv.alias("a")).select("c_custkey", F.array_join(scalars.redact_argv(F.col("a")), " ").alias("argv"))


@query("""SELECT c_custkey, c_custkey % 3 <> 0 AS fits FROM customer""")
def argv_replay(s, d):
    """Commands that may be run again: the mask stands for any text, the rest must agree."""
    stored = F.array(F.lit("run"), F.lit("--token=[REDACTED]"), F.col("c_name"))
    given = F.array(F.lit("run"), F.concat(F.lit("--token="), F.col("c_mktsegment")), F.when(F.col("c_custkey") % 3 == 0, "other").otherwise(F.col("c_name")))
    return t.table(s, d, "customer").select("c_custkey", scalars.resolves_command(stored, given).alias("fits"))


@query("""SELECT o_orderkey, 'at ' || o_orderpriority || ' of ' || o_orderkey AS text, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'src/' || o_orderkey END AS place, o_orderkey % 4 <> 0 AS stamped FROM orders""")
def text_and_paths(s, d):
    """Templates, paths resolved against a folder, and timestamps."""
    key = F.col("o_orderkey").cast("string")
    token = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "../../../").otherwise("../b/../"), key)
    stamp = F.concat(F.lit("2024-02-"), F.when(F.col("o_orderkey") % 4 == 0, "30").otherwise("29"), F.lit("T10:00:00.5Z"))
    text = scalars.rendered(F.lit("at {p} of {k}"), F.create_map(F.lit("p"), F.col("o_orderpriority"), F.lit("k"), key))
    place = F.array_join(scalars.resolved_path(token, F.array(F.lit("src"), F.lit("a"))), "/")
    return t.table(s, d, "orders").select("o_orderkey", text.alias("text"), place.alias("place"), scalars.recorded_at(stamp).isNotNull().alias("stamped"))


@query("""SELECT event_id, sha256('{"a":[1,{"x":null,"y":"' || event_type || '"}],"k":' || regexp_replace(props, '": ', '":', 'g') || '}') AS hash FROM events""")
def canonical_hash(s, d):
    text = F.concat(F.lit(' {"k" : '), F.regexp_replace("props", r'": ', '":'), F.lit(', "a": [1, {"y": "'), F.col("event_type"), F.lit('", "x": null}]}'))
    return t.table(s, d, "events").select("event_id", canonical.canonical_sha256(text).alias("hash"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_pointer(s, d):
    return t.table(s, d, "events").select("event_id", scalars.json_pointer(F.col("props"), "/k").alias("k"))


@query("SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) >= 2 THEN sha256(string_split(text, chr(10))[1] || chr(10) || string_split(text, chr(10))[2]) END AS anchor FROM documents")
def line_anchor_hash(s, d):
    return t.table(s, d, "documents").select("doc_id", scalars.line_anchor(F.col("text"), 1, 2).alias("anchor"))


@query(r"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN v LIKE '%.%' THEN regexp_replace(regexp_replace(v, '0+$', ''), '\.$', '') ELSE v END AS plain, abs(l_tax - l_discount) <= 0.015 AS near FROM (SELECT *, CAST(CAST(l_discount AS DECIMAL(9, 4)) AS VARCHAR) AS v FROM lineitem)""")
def normal_numbers(s, d):
    c = F.col
    return t.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scalars.normal_decimal(c("l_discount").cast("decimal(9,4)").cast("string")).alias("plain"), scalars.approx(c("l_tax"), c("l_discount"), 0.015).alias("near"))


@query(r"SELECT page_id, url, NOT regexp_matches(url, '^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)|(^|/)\.(/|$)|//|/$') AND url <> '' AS portable FROM pages")
def portable_paths(s, d):
    return t.table(s, d, "pages").select("page_id", "url", scalars.portable_path(F.col("url")).alias("portable"))


@query("SELECT p_brand, count(*) AS n, round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 4) AS intercept, round(regr_r2(p_retailprice, p_size), 6) AS r2 FROM part GROUP BY p_brand")
def ols_by_group(s, d):
    y, x = F.col("p_retailprice"), F.col("p_size")
    return t.table(s, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


from strandline.plans import judgements as _judgements, runs as _runs  # noqa: E402,F401  add their queries
