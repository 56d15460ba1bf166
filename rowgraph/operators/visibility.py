"""What a caller may see: joins against the rows they can read, made at read time.

``pks`` is the one-column frame ``source_pk`` of the rows the caller's policy
lets through; nothing of it is stored, so a changed policy or share shows at
once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgraph.operators.graph import Graph


def visible_mentions(graph: Graph, pks: DataFrame) -> DataFrame:
    return graph.mentions_of(pks)


def visible_entities(graph: Graph, pks: DataFrame) -> DataFrame:
    """Entities with a mention in a readable row."""
    return graph.entity.join(visible_mentions(graph, pks), "entity_id", "left_semi")


def visible_support(graph: Graph, pks: DataFrame) -> DataFrame:
    return graph.edge_support.join(pks, "source_pk", "left_semi")


def visible_edges(graph: Graph, pks: DataFrame, mode: str | None = "union") -> DataFrame:
    """Union: any support readable.  Intersection: no support hidden, judged on all support."""
    return graph.edges_of(pks, mode or "union")


def named_edges(graph: Graph, edges: DataFrame) -> DataFrame:
    """Edges with the surfaces of their ends; any other columns stay."""
    src = graph.entity.select(F.col("entity_id").alias("src"), F.col("surface").alias("src_surface"))
    dst = graph.entity.select(F.col("entity_id").alias("dst"), F.col("surface").alias("dst_surface"))
    others = [c for c in edges.columns if c not in ("edge_id", "src", "dst", "predicate")]
    number = [c for c in edges.columns if c == "edge_id"]
    return edges.join(src, "src").join(dst, "dst").select(
        *number, F.col("src_surface").alias("src"), F.col("dst_surface").alias("dst"), "predicate", *others
    )


def visible_phonetic(graph: Graph, pks: DataFrame) -> DataFrame:
    return graph.entity_phonetic.join(visible_mentions(graph, pks), "entity_id", "left_semi")


def visible_overrides(overrides: DataFrame, pks: DataFrame) -> DataFrame:
    return overrides.join(pks, "source_pk", "left_semi")


def visible_decisions(decisions: DataFrame, graph: Graph, pks: DataFrame) -> DataFrame:
    """Decisions one of whose names belongs to a readable mention."""
    seen = visible_mentions(graph, pks)
    names = seen.select(F.col("mention_norm").alias("n")).unionAll(
        graph.entity.join(seen, "entity_id", "left_semi").select(F.col("norm").alias("n"))
    )
    return decisions.withColumn("n", F.explode(F.array("norm_a", "norm_b"))).join(names, "n", "left_semi").drop("n").distinct()


def visible_proposals(graph: Graph, pks: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """Pairs of readable entities that share a phonetic key and differ in name."""
    seen = visible_entities(graph, pks)
    keys = graph.entity_phonetic.join(seen.select("entity_id", "surface", "norm"), "entity_id")
    a, b = (keys.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("entity_id", "surface", "norm")]) for x in "ab")
    pairs = a.join(b, "key").filter("entity_id_a < entity_id_b and norm_a <> norm_b")
    if decided is not None:
        ordered = pairs.withColumn("lo", F.least("norm_a", "norm_b")).withColumn("hi", F.greatest("norm_a", "norm_b"))
        pairs = ordered.join(decided.select(F.col("norm_a").alias("lo"), F.col("norm_b").alias("hi")), ["lo", "hi"], "left_anti")
    return pairs.select(
        F.col("entity_id_a").alias("entity_a"), F.col("surface_a"), F.col("entity_id_b").alias("entity_b"), F.col("surface_b")
    ).distinct()


def most_connected(edges: DataFrame) -> DataFrame:
    """``(person, times_together)`` over both ends of named edges."""
    ends = edges.select(F.col("src").alias("person")).unionAll(edges.select(F.col("dst").alias("person")))
    return ends.groupBy("person").agg(F.count(F.lit(1)).alias("times_together"))
