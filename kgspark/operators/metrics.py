"""Graph measures, per document: degree, betweenness, clustering, components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators.components import connected_components

Store = Callable[[DataFrame], DataFrame]


def arcs(edges: DataFrame) -> DataFrame:
    """The simple digraph: parallel relations are one arc."""
    return edges.select("doc_id", F.col("source").alias("u"), F.col("target").alias("v")).distinct()


def degree_centrality(nodes: DataFrame, simple: DataFrame) -> DataFrame:
    """Arcs in and out over n - 1; 1 in a graph of one node."""
    ends = simple.select("doc_id", F.col("u").alias("id")).unionByName(simple.select("doc_id", F.col("v").alias("id"))).groupBy("doc_id", "id").agg(F.count("*").alias("d"))
    n = nodes.groupBy("doc_id").agg(F.count("*").alias("n"))
    joined = nodes.select("doc_id", "id").join(n, "doc_id").join(ends, ["doc_id", "id"], "left")
    return joined.select("doc_id", "id", F.when(F.col("n") <= 1, 1.0).otherwise(F.coalesce("d", F.lit(0)) / (F.col("n") - 1.0)).alias("degree_centrality"))


def betweenness(nodes: DataFrame, simple: DataFrame, store: Store, pivots: int | None = None) -> DataFrame:
    """Directed betweenness over (n - 1)(n - 2), ends left out.

    All sources at once: breadth-first levels count shortest paths per
    (source, node); then shares flow back from the last level.  A document has
    n rows per source; for large graphs ``pivots`` takes that many sources, those
    with the least digests, and scales up.
    """
    n = nodes.groupBy("doc_id").agg(F.count("*").alias("n"))
    sources = nodes.select("doc_id", F.col("id").alias("s"))
    if pivots is not None:
        from pyspark.sql import Window as W

        k = F.row_number().over(W.partitionBy("doc_id").orderBy(F.md5(F.col("s").cast("string"))))
        sources = sources.withColumn("k", k).where(F.col("k") <= pivots).drop("k")
    steps = store(simple.where("u <> v"))
    level = store(sources.select("doc_id", "s", F.col("s").alias("v"), F.lit(1.0).alias("sigma"), F.lit(0).alias("dist")))
    levels, seen = [level], level
    while True:
        ahead = level.withColumnRenamed("v", "u").join(steps, ["doc_id", "u"]).groupBy("doc_id", "s", "v").agg(F.sum("sigma").alias("sigma"))
        level = store(ahead.join(seen.select("doc_id", "s", "v"), ["doc_id", "s", "v"], "left_anti").withColumn("dist", F.lit(len(levels))).select("doc_id", "s", "v", "sigma", "dist"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level)
    # delta(u) = sum over arcs to the next level of sigma(u) / sigma(v) * (1 + delta(v))
    delta = levels[-1].withColumn("delta", F.lit(0.0))
    total = delta.where("s <> v").select("doc_id", "v", "delta")
    for level in reversed(levels[:-1]):
        after = delta.select("doc_id", "s", "v", F.col("sigma").alias("sv"), F.col("delta").alias("dv"))
        here = level.withColumnRenamed("v", "u")
        flow = here.join(steps, ["doc_id", "u"]).join(after, ["doc_id", "s", "v"]).groupBy("doc_id", "s", "u").agg(F.sum(F.col("sigma") / F.col("sv") * (1 + F.col("dv"))).alias("delta"))
        delta = store(here.join(flow, ["doc_id", "s", "u"], "left").na.fill(0.0, ["delta"]).withColumnRenamed("u", "v").select("doc_id", "s", "v", "sigma", "dist", "delta"))
        total = total.unionByName(delta.where("s <> v").select("doc_id", "v", "delta"))
    sums = total.groupBy("doc_id", F.col("v").alias("id")).agg(F.sum("delta").alias("b"))
    joined = nodes.select("doc_id", "id").join(n, "doc_id").join(sums, ["doc_id", "id"], "left")
    scale = F.lit(1.0) if pivots is None else F.greatest(F.lit(1.0), F.col("n") / F.lit(float(pivots)))
    value = F.when(F.col("n") > 2, scale * F.coalesce("b", F.lit(0.0)) / ((F.col("n") - 1.0) * (F.col("n") - 2.0))).otherwise(0.0)
    return joined.select("doc_id", "id", value.alias("betweenness_centrality"))


def clustering(nodes: DataFrame, simple: DataFrame) -> DataFrame:
    """Share of neighbour pairs that are linked, direction ignored; 0 below two neighbours.

    Each edge points to its end of higher degree, so that a hub opens few wedges.
    """
    pairs = simple.where("u <> v").select("doc_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    degree = pairs.select("doc_id", F.col("a").alias("id")).unionByName(pairs.select("doc_id", F.col("b").alias("id"))).groupBy("doc_id", "id").agg(F.count("*").alias("d"))
    by = lambda end: degree.select("doc_id", F.col("id").alias(end), F.col("d").alias(f"d{end}"))
    both = pairs.join(by("a"), ["doc_id", "a"]).join(by("b"), ["doc_id", "b"])
    up = F.struct("da", "a") < F.struct("db", "b")
    aimed = both.select("doc_id", F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y"))
    wedges = aimed.join(aimed.withColumnRenamed("y", "z"), ["doc_id", "x"]).where("y < z")
    triangles = wedges.join(pairs.withColumnsRenamed({"a": "y", "b": "z"}), ["doc_id", "y", "z"], "left_semi")
    corners = triangles.select("doc_id", F.explode(F.array("x", "y", "z")).alias("id")).groupBy("doc_id", "id").agg(F.count("*").alias("t"))
    joined = nodes.select("doc_id", "id").join(degree, ["doc_id", "id"], "left").join(corners, ["doc_id", "id"], "left")
    return joined.select("doc_id", "id", F.when(F.col("d") >= 2, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1.0))).otherwise(0.0).alias("clustering_coefficient"))


def node_metrics(nodes: DataFrame, edges: DataFrame, store: Store, pivots: int | None = None) -> DataFrame:
    simple = store(arcs(edges))
    by = ["doc_id", "id"]
    return degree_centrality(nodes, simple).join(betweenness(nodes, simple, store, pivots), by).join(clustering(nodes, simple), by)


def weak_components(nodes: DataFrame, edges: DataFrame, store: Store) -> DataFrame:
    """The component of each node: doc_id, id, component (its smallest id)."""
    node = lambda c: F.struct("doc_id", F.col(c).alias("id"))
    found = connected_components(edges.select(node("source").alias("a"), node("target").alias("b")), store, "a", "b").select("node.doc_id", "node.id", F.col("component.id").alias("component"))
    return nodes.select("doc_id", "id").join(found, ["doc_id", "id"], "left").withColumn("component", F.coalesce("component", "id"))


def graph_metrics(nodes: DataFrame, edges: DataFrame, store: Store) -> DataFrame:
    """Per document: nodes, arcs, density, average degree, weak components."""
    n = nodes.groupBy("doc_id").agg(F.count("*").alias("num_nodes"))
    m = arcs(edges).groupBy("doc_id").agg(F.count("*").alias("num_edges"))
    c = weak_components(nodes, edges, store).groupBy("doc_id").agg(F.count_distinct("component").alias("num_components"))
    joined = n.join(m, "doc_id", "left").join(c, "doc_id").na.fill(0)
    pairs = F.col("num_nodes") * (F.col("num_nodes") - 1)
    return joined.select("doc_id", "num_nodes", "num_edges", F.when(pairs > 0, F.col("num_edges") / F.when(pairs > 0, pairs)).otherwise(0.0).alias("density"), F.when(F.col("num_nodes") > 0, 2.0 * F.col("num_edges") / F.col("num_nodes")).otherwise(0.0).alias("average_degree"), "num_components")
