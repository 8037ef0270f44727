"""The projection of a graph and its records for retrieval: nodes, edges and what does not resolve.

Nodes are ``id, kind``; edges ``src, dst, rel, kind`` and what else a record carries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import content_id
from strandline.operators.search import normal_key

#: Kinds in the order in which a projection lists them.
NODE_KINDS = ("semantic", "run", "assessment", "method_assessment", "derivation", "proof", "deliberation_candidate", "deliberation_proposal", "deliberation_set", "deliberation_ballot", "finding")
EDGE_KINDS = ("semantic", "run_binding", "semantic_assessment", "method_assessment", "derivation", "proof", "deliberation", "finding")


def rank(kind: Column, kinds: tuple[str, ...]) -> Column:
    """The place of a kind; unknown ones come last."""
    place = F.array_position(F.array(*map(F.lit, kinds)), kind)
    return F.when(F.coalesce(place, F.lit(0)) > 0, place.cast("int") - 1).otherwise(F.lit(99))


def with_edge_ids(edges: DataFrame) -> DataFrame:
    """Edges with a content id over all their columns, by name: equal edges get equal ids."""
    return edges.withColumn("edge_id", content_id("edge", F.to_json(F.struct(*sorted(edges.columns)), {"ignoreNullFields": "false"})))


def resolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are in the projection; repeated ones once."""
    ids = nodes.select("id").distinct()
    return edges.dropDuplicates().join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def unresolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``owner_id, missing_id, relation, edge_kind``: one row for each end that is not in the projection."""
    ends = edges.dropDuplicates().select(F.col("src").alias("owner_id"), F.explode(F.array("src", "dst")).alias("missing_id"), F.col("rel").alias("relation"), F.col("kind").alias("edge_kind"))
    return ends.join(nodes.select(F.col("id").alias("missing_id")), "missing_id", "left_anti").select("owner_id", "missing_id", "relation", "edge_kind")


def in_order(nodes: DataFrame) -> DataFrame:
    """Nodes as a projection lists them, sorted by range."""
    return nodes.orderBy(rank(F.col("kind"), NODE_KINDS), "id")


def edges_in_order(edges: DataFrame) -> DataFrame:
    return edges.orderBy(rank(F.col("kind"), EDGE_KINDS), "src", "dst", "rel", "edge_id")


def _speaks(language: Column, wanted: str | None) -> Column:
    first = F.lit(False) if wanted is None else F.coalesce(language == wanted, F.lit(False))
    return F.when(first, 0).when(language.isNull(), 1).otherwise(2)


def display_labels(labels: DataFrame, wanted: str | None = None) -> DataFrame:
    """``term, text, language``: the label to show of each term: in the wanted language, else in none, else in the first."""
    language = F.col("language")
    least = F.min(F.struct(_speaks(language, wanted).alias("r"), F.coalesce(language, F.lit("")).alias("l"), "text", "language")).alias("x")
    return labels.groupBy("term").agg(least).select("term", "x.text", "x.language")


def matches(queries: DataFrame, names: DataFrame, wanted: str | None = None) -> DataFrame:
    """``query, term, tier, matched_on, text, language``: how a query names each term, at best.

    ``names``: ``term, kind, text, language``, the kind being iri (compared as it is),
    preferred_label or synonym (compared in normal form).
    """
    tier = F.when(F.col("kind") == "iri", 0).when(F.col("kind") == "preferred_label", 1).otherwise(2)
    exact = F.col("kind") == "iri"
    keyed = names.withColumn("key", F.when(exact, F.concat(F.lit("="), F.col("text"))).otherwise(F.concat(F.lit("~"), normal_key(F.col("text")))))
    asked = queries.select("query").distinct().select("query", F.explode(F.array(F.concat(F.lit("="), F.col("query")), F.concat(F.lit("~"), normal_key(F.col("query"))))).alias("key"))
    best = F.min(F.struct(tier.alias("tier"), _speaks(F.col("language"), wanted).alias("r"), F.coalesce("language", F.lit("")).alias("l"), "text", "language", F.col("kind").alias("matched_on"))).alias("x")
    return keyed.join(asked, "key").groupBy("query", "term").agg(best).select("query", "term", "x.tier", "x.matched_on", "x.text", "x.language")
