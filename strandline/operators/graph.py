"""Traversal of typed dependency graphs.

Edges are ``src, dst, rel``.  Recursion is a frontier loop: each round joins only
the frontier with the edges and anti-joins what is known, and its result is
written to the shared folder, so plans stay short and survive lost executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.vocab import ANNOTATION_RELATIONS
from strandline.sources.scratch import settled

#: Nodes up to which a frontier is broadcast.
BROADCAST_NODES = 100_000


def dependencies(edges: DataFrame) -> DataFrame:
    """``up, down, rel`` of well-formed edges that propagate; ``reads`` is turned round."""
    whole = edges.where("src <> '' AND dst <> '' AND rel <> ''").where(~F.col("rel").isin(*ANNOTATION_RELATIONS))
    turned = F.col("rel") == "reads"
    return whole.select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("up"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("down"), "rel")


def reverse(deps: DataFrame) -> DataFrame:
    return deps.select(F.col("down").alias("up"), F.col("up").alias("down"), "rel")


def closure(seeds: DataFrame, deps: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``[root,] id, depth`` reachable from ``seeds`` (``id`` and optionally ``root``), by the least depth.

    A seed itself appears only where a cycle leads back to it.
    """
    by = [c for c in ("root", "id") if c in seeds.columns]
    step = settled(deps.select("up", "down"), "steps")
    frontier, known, depth = seeds.select(*by).distinct(), None, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = frontier.join(step, F.col("id") == F.col("up")).select(*by[:-1], F.col("down").alias("id")).distinct()
        if known is not None:
            reached = reached.join(known, by, "left_anti")
        frontier = settled(reached.withColumn("depth", F.lit(depth)), "frontier")
        if frontier.limit(1).count() == 0:
            break
        known = frontier if known is None else known.union(frontier)
        frontier = frontier.select(*by)
    return known if known is not None else seeds.select(*by).withColumn("depth", F.lit(0)).limit(0)


def carried(seeds: DataFrame, deps: DataFrame, largest: bool = False) -> DataFrame:
    """``id, best`` of what ``seeds`` (``id, best``) reach: the least (or largest) ``best`` of the seeds that reach it.

    One value travels for each node, not one for each pair.  A round appends what it
    improves and rewrites nothing; the deltas are reduced once, at the end.
    """
    least = F.max if largest else F.min
    step = settled(deps.select("up", "down"), "steps")
    frontier = seeds.groupBy("id").agg(least("best").alias("best"))
    known = None
    while True:
        reached = frontier.join(step, F.col("id") == F.col("up")).groupBy(F.col("down").alias("id")).agg(least("best").alias("best"))
        if known is not None:
            k, r = known.alias("k"), reached.alias("r")
            settles = F.col("k.best") >= F.col("r.best") if largest else F.col("k.best") <= F.col("r.best")
            reached = r.join(k, (F.col("k.id") == F.col("r.id")) & settles, "left_anti")
        frontier = settled(reached, "better")
        known = frontier if known is None else known.union(frontier)
        if frontier.limit(1).count() == 0:
            return known.groupBy("id").agg(least("best").alias("best"))


def first_root(seeds: DataFrame, deps: DataFrame) -> DataFrame:
    """``id, root``: what ``seeds`` (``id``) reach, each with the least seed that reaches it."""
    return carried(seeds.select("id", F.col("id").alias("best")), deps).withColumnRenamed("best", "root")


def impact(nodes: DataFrame, deps: DataFrame, bindings: DataFrame, concept: str, value: str) -> DataFrame:
    """``id, type, status, direct, root``: nodes bound to another value, and all that depends on them."""
    bound = bindings.where((F.col("concept") == concept) & (F.col("value") != value)).join(nodes.where(~F.col("status").eqNullSafe(F.lit("deprecated"))), "id").select("id").distinct()
    reached = first_root(bound, deps)
    both = bound.withColumn("direct", F.lit(True)).join(reached, "id", "full_outer")
    return both.select("id", F.coalesce("direct", F.lit(False)).alias("direct"), "root").join(nodes, "id").select("id", "type", "status", "direct", F.coalesce("root", "id").alias("root"))


def layers(nodes: DataFrame, deps: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``id, layer``: the longest path that ends in a node; a cycle raises.

    A node is in the next layer, or beyond, if some input is in the layer before; each
    round stores only these, and a node's last round is its layer.
    """
    step = settled(deps.join(nodes.select(F.col("id").alias("down")), "down", "left_semi").select("up", "down"), "steps")
    reached = [nodes.select("id", F.lit(0).alias("layer"))]
    frontier = nodes.select("id")
    for round_no in range(1, max_rounds):
        frontier = settled(frontier.join(step, F.col("id") == F.col("up")).select(F.col("down").alias("id")).distinct(), "raised")
        if frontier.limit(1).count() == 0:
            return reduce(DataFrame.union, reached).groupBy("id").agg(F.max("layer").alias("layer"))
        reached.append(frontier.withColumn("layer", F.lit(round_no)))
    raise ValueError("the graph has a cycle or is deeper than max_rounds")


def _core(pairs: DataFrame) -> DataFrame:
    current = settled(pairs, "core")
    size = current.count()
    while size:
        kept = current.join(current.select(F.col("down").alias("up")).distinct(), "up", "left_semi").join(current.select(F.col("up").alias("down")).distinct(), "down", "left_semi").select("up", "down")
        current = settled(kept, "core")
        if (left := current.count()) == size:
            break
        size = left
    return current


def cycle_core(deps: DataFrame) -> DataFrame:
    """``id`` of the nodes that stay when nodes without inputs or without dependents are trimmed again and again."""
    current = _core(deps.select("up", "down").distinct())
    return current.select(F.col("up").alias("id")).union(current.select("down")).distinct()


def on_cycles(deps: DataFrame) -> DataFrame:
    """``id`` of the nodes that reach themselves: self edges, and what each strongly connected part of the core holds.

    Each round gives the core's nodes the least node that reaches them and, within equal
    ones, the least that they reach; a node for which both are the same lies on a cycle
    with it.  The parts that are settled go, and the rest is trimmed again.
    """
    pairs = deps.select("up", "down").distinct()
    found = settled(pairs.where("up = down").select(F.col("up").alias("id")), "cycle-nodes")
    core = settled(_core(pairs.where("up <> down")), "core")
    while core.limit(1).count():
        below = _least_reaching(core)
        colour = below.select("id", "root")
        same = core.join(colour.toDF("up", "a"), "up").join(colour.toDF("down", "b"), "down").where("a = b")
        back = closure(colour.where("id = root").select("root", "id"), same.select(F.col("down").alias("up"), F.col("up").alias("down"), F.lit("").alias("rel")))
        part = settled(back.select("id").union(back.select(F.col("root").alias("id"))).distinct(), "cycle-part")
        found = settled(found.union(part), "cycle-nodes")
        roots = settled(part.union(colour.where("id = root").select("id")).distinct(), "cycle-done")
        rest = core.join(roots.toDF("up"), "up", "left_anti").join(roots.toDF("down"), "down", "left_anti").select("up", "down")
        core = settled(_core(rest), "core")
    return found.distinct()


def _least_reaching(pairs: DataFrame) -> DataFrame:
    """``id, root``: the least node that reaches each node, itself included."""
    known = settled(pairs.select(F.col("up").alias("id")).union(pairs.select("down")).distinct().withColumn("root", F.col("id")), "colours")
    frontier = known
    while True:
        reached = frontier.join(pairs, F.col("id") == F.col("up")).groupBy(F.col("down").alias("id")).agg(F.min("root").alias("new"))
        frontier = settled(reached.join(known, "id").where("new < root").select("id", F.col("new").alias("root")), "better")
        if frontier.limit(1).count() == 0:
            return known
        known = settled(known.join(frontier, "id", "left_anti").union(frontier), "colours")


def bounded_context(edges: DataFrame, seeds: DataFrame, max_hops: int, max_nodes: int) -> DataFrame:
    """``id, hop``: an undirected neighbourhood of ``seeds`` (``id``); in each hop the lexically least ids enter until ``max_nodes`` are in.

    ``max_nodes`` is the budget that defines the operator; seeds are never dropped.
    """
    both = edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("x")).select("x.*")
    known = settled(seeds.select("id", F.lit(0).alias("hop")).distinct(), "context")
    for hop in range(1, max_hops + 1):
        held = known.count()
        room = max_nodes - held
        if room <= 0:
            break
        near = known.where(F.col("hop") == hop - 1)
        near = F.broadcast(near) if held <= BROADCAST_NODES else near
        following = both.join(near, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(known, "id", "left_anti")
        known = settled(known.union(following.orderBy("id").limit(room).select("id", F.lit(hop).alias("hop"))), "context")
    return known


def fitted_context(context: DataFrame, edges: DataFrame, node_bytes: Column, edge_bytes: Column, budget: int) -> DataFrame:
    """``kind, id, other, rel`` of a bounded context that fits ``budget`` bytes: edges give way first, then the farthest nodes, seeds never.

    ``context`` is what ``bounded_context`` returns, so its rows and the edges among them are few.
    """
    nearest = Window.orderBy("hop", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = context.withColumn("used", F.sum(node_bytes).over(nearest)).where((F.col("hop") == 0) | (F.col("used") <= budget))
    at = kept.select(F.col("id").alias("src"), F.col("hop").alias("from_hop"))
    to = kept.select(F.col("id").alias("dst"), F.col("hop").alias("to_hop"))
    inside = edges.select("src", "dst", "rel").distinct().join(F.broadcast(at), "src").join(F.broadcast(to), "dst").withColumn("far", F.greatest("from_hop", "to_hop"))
    first = Window.orderBy("far", "src", "dst", "rel").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nodes = kept.agg(F.coalesce(F.max("used"), F.lit(0)).alias("n")).first()["n"]
    fits = inside.withColumn("used", F.sum(edge_bytes).over(first) + nodes).where(F.col("used") <= budget)
    return kept.select(F.lit("node").alias("kind"), "id", F.lit(None).cast("string").alias("other"), F.lit(None).cast("string").alias("rel")).union(fits.select(F.lit("edge"), "src", "dst", "rel"))
