"""Integrity checks: each returns findings ``severity, code, node_id, detail``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.vocab import ANNOTATION_RELATIONS, DEPENDENCY_RELATIONS, INPUT_TYPES, NODE_TYPES, RETIRED, SEVERITIES, STATUSES
from strandline.functions.scalars import portable_path
from strandline.operators import graph

FINDING = ("severity", "code", "node_id", "detail")


def finding(df: DataFrame, severity: str, code: str, node: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), node.alias("node_id"), detail.alias("detail"))


def duplicate_id(nodes: DataFrame) -> DataFrame:
    many = nodes.groupBy("id").count().where("count > 1")
    return finding(many, "error", "DUPLICATE_ID", F.col("id"), F.concat(F.col("count").cast("string"), F.lit(" declarations")))


def malformed_edge(edges: DataFrame) -> DataFrame:
    bad = edges.where(~F.coalesce((F.col("src") != "") & (F.col("dst") != "") & (F.col("rel") != ""), F.lit(False)))
    return finding(bad, "error", "MALFORMED_EDGE", F.coalesce("src", F.lit("")), F.concat_ws(" ", F.coalesce("src", F.lit("?")), F.coalesce("rel", F.lit("?")), F.coalesce("dst", F.lit("?"))))


def self_edge(edges: DataFrame) -> DataFrame:
    return finding(edges.where("src = dst"), "error", "SELF_EDGE", F.col("src"), F.col("rel"))


def dangling_edge(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each bad end."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("end"), F.col("dst").alias("other"), "rel"), F.struct(F.col("dst").alias("end"), F.col("src").alias("other"), "rel"))).alias("x")).select("x.*")
    bad = ends.join(nodes.select(F.col("id").alias("end")), "end", "left_anti")
    return finding(bad, "error", "DANGLING_EDGE", F.col("end"), F.concat_ws(" ", "rel", "other"))


def cycle(deps: DataFrame) -> DataFrame:
    return finding(graph.on_cycles(deps), "error", "CYCLE", F.col("id"), F.lit("on a dependency cycle"))


def _canonical(canonical: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in canonical.items() for x in pair))


def silent_drift(nodes: DataFrame, bindings: DataFrame, canonical: dict[str, str]) -> DataFrame:
    """Only status exactly ``current`` counts."""
    off = bindings.withColumn("want", _canonical(canonical)[F.col("concept")]).where("value <> want")
    return finding(off.join(nodes.where("status = 'current'"), "id", "left_semi"), "error", "SILENT_DRIFT", F.col("id"), F.concat_ws(" ", "concept", "value"))


def _linked(nodes: DataFrame, deps: DataFrame, down: tuple[str, ...], up: tuple[str, ...]) -> DataFrame:
    u, d = nodes.where(F.col("status").isin(*up)).select(F.col("id").alias("up"), F.col("status").alias("up_status")), nodes.where(F.col("status").isin(*down)).select(F.col("id").alias("down"))
    return deps.join(u, "up").join(d, "down", "left_semi")


def reads_retired(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    return finding(_linked(nodes, deps, ("current",), RETIRED), "error", "READS_RETIRED", F.col("down"), F.concat_ws(" ", "up", "up_status"))


def depends_on_planned(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    return finding(_linked(nodes, deps, ("current", "confirmed"), ("planned",)), "error", "DEPENDS_ON_PLANNED", F.col("down"), F.col("up"))


def off_backbone(nodes: DataFrame, deps: DataFrame, bindings: DataFrame) -> DataFrame:
    """Claims of any status against all their ancestors with another value of a shared concept."""
    claims = bindings.join(nodes.where("type = 'claim'"), "id", "left_semi")
    above = graph.closure(claims.select(F.col("id").alias("root"), "id").distinct(), graph.reverse(deps))
    own = claims.select(F.col("id").alias("root"), "concept", F.col("value").alias("own"))
    off = above.join(bindings, "id").join(own, ["root", "concept"]).where("value <> own").select("root", "id").distinct()
    return finding(off, "error", "CLAIM_CITES_OFFBACKBONE", F.col("root"), F.col("id"))


def upstream_stale(nodes: DataFrame, deps: DataFrame, dirty: DataFrame) -> DataFrame:
    """Every live descendant of a dirty node (``id``), once, with the first of these."""
    live = nodes.where(~F.col("status").isin(*RETIRED, "planned"))
    below = graph.first_root(dirty, deps).join(live, "id", "left_semi")
    return finding(below, "warning", "UPSTREAM_STALE", F.col("id"), F.col("root"))


def stale_render(renders: DataFrame, nodes: DataFrame, deps: DataFrame, files: DataFrame, tolerance_s: float = 2.0, inputs: tuple[str, ...] = INPUT_TYPES) -> DataFrame:
    """Renders (``id``) older than an ancestor by more than the tolerance, with the newest such ancestor.

    ``files`` has ``id, mtime`` (seconds).  Only live ancestors of an input type count.
    The newest one travels down the graph, so the cost does not grow with pairs.
    """
    live = nodes.where(F.col("type").isin(*inputs) & ~F.col("status").eqNullSafe(F.lit("deprecated")))
    newest = graph.carried(files.join(live, "id", "left_semi").select("id", F.struct("mtime", "id").alias("best")), deps, largest=True)
    late = renders.join(newest, "id").join(files, "id").where(F.col("best.mtime") > F.col("mtime") + tolerance_s)
    return finding(late, "error", "STALE_RENDER", F.col("id"), F.col("best.id"))


def lint_vocabulary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = finding(nodes.where((F.col("type") != "") & ~F.col("type").isin(*NODE_TYPES)), "warning", "UNKNOWN_TYPE", F.col("id"), F.col("type"))
    states = finding(nodes.where((F.col("status") != "") & ~F.col("status").isin(*STATUSES)), "warning", "UNKNOWN_STATUS", F.col("id"), F.col("status"))
    relations = finding(edges.where((F.col("rel") != "") & ~F.col("rel").isin(*DEPENDENCY_RELATIONS, *ANNOTATION_RELATIONS)), "warning", "UNKNOWN_REL", F.col("src"), F.col("rel"))
    return kinds.union(states).union(relations)


def status_relation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    bad = nodes.where(F.col("status").isin("null", "dead_end", "retracted")).select(F.col("id").alias("src"), "status")
    return finding(edges.where("rel = 'supports'").join(bad, "src"), "warning", "STATUS_RELATION_MISMATCH", F.col("src"), F.concat_ws(" ", "status", "dst"))


def no_backbone(nodes: DataFrame, bindings: DataFrame) -> DataFrame:
    """Claims and renders that are live: current, confirmed or without a status."""
    live = F.coalesce(F.col("status").isin("current", "confirmed"), F.lit(True))
    bare = nodes.where(F.col("type").isin("claim", "figure") & live).join(bindings, "id", "left_anti")
    return finding(bare, "warning", "NO_BACKBONE", F.col("id"), F.lit(""))


def invalid_node_path(nodes: DataFrame) -> DataFrame:
    """Nodes (``id, path``) whose path is not portable or leaves the root."""
    return finding(nodes.where(F.col("path").isNotNull() & (F.col("path") != "") & ~portable_path(F.col("path"))), "error", "INVALID_NODE_PATH", F.col("id"), F.col("path"))


def missing_file(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes whose sound path is not among the files (``path``)."""
    gone = nodes.where(portable_path(F.col("path"))).join(files.select("path"), "path", "left_anti")
    return finding(gone, "error", "MISSING_FILE", F.col("id"), F.col("path"))


def unknown_concept(bindings: DataFrame, concepts: DataFrame) -> DataFrame:
    """Bindings of concepts (``name``) that are not declared."""
    odd = bindings.join(concepts.select(F.col("name").alias("concept")), "concept", "left_anti")
    return finding(odd, "error", "UNKNOWN_BACKBONE_CONCEPT", F.col("id"), F.col("concept"))


def ambiguous_backbone(nodes: DataFrame, concepts: DataFrame) -> DataFrame:
    """Nodes with one value (``backbone``) for a graph of several concepts."""
    many = concepts.agg((F.count_distinct("name") > 1).alias("many"))
    odd = nodes.where("backbone IS NOT NULL").join(F.broadcast(many.where("many")), F.lit(True), "left_semi")  # one row at most
    return finding(odd, "error", "AMBIGUOUS_BACKBONE", F.col("id"), F.col("backbone"))


def pending(nodes: DataFrame, bindings: DataFrame, canonical: dict[str, str]) -> DataFrame:
    """Nodes marked stale, each with how its bindings are to move, in the order of concepts."""
    moves = bindings.withColumn("move", F.concat(F.col("concept"), F.lit(":"), F.col("value"), F.lit(" -> "), F.coalesce(_canonical(canonical)[F.col("concept")], F.lit("?"))))
    listed = moves.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("move")), ", ").alias("moves"))
    return finding(nodes.where("status = 'stale'").join(listed, "id", "left"), "pending", "PENDING", F.col("id"), F.coalesce("moves", F.lit("")))


def merged(findings: DataFrame) -> DataFrame:
    """One row for each code, node and detail: the gravest severity, how many checks say so, and whether it blocks."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    one = findings.select("code", F.coalesce("node_id", F.lit("")).alias("node_id"), F.coalesce("detail", F.lit("")).alias("detail"), rank.alias("rank"))
    least = one.groupBy("code", "node_id", "detail").agg(F.min("rank").alias("rank"), F.count("*").alias("sources"))
    return least.select(F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("rank").cast("int")).alias("severity"), "code", "node_id", "detail", "sources", (F.col("rank") == 1).alias("blocking"))


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "code").agg(F.count("*").alias("n"), F.countDistinct("node_id").alias("n_nodes"))
