"""Graph refinement: nodes and edges validated, merged, filtered, scored, pruned.

Nodes are (doc_id, id, label, type, aliases, occurrence_count), edges
(doc_id, id, source, target, relation_type, confidence, evidence_blocks, ord).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions import json_text as J
from kgspark.functions import numbers as N
from kgspark.functions import text as T
from kgspark.functions import vocabulary as V
from kgspark.operators import metrics as M

MIN_CONFIDENCE = 0.55


def to_nodes(canonical: DataFrame, parity: bool = False) -> DataFrame:
    """Canonical concepts as nodes; with ``parity`` each occurs once."""
    n = F.lit(1) if parity else F.coalesce("occurrence_count", F.lit(1))
    return canonical.select("doc_id", F.col("canonical_id").alias("id"), F.col("canonical_name").alias("label"), "type", "aliases", n.cast("int").alias("occurrence_count"))


def to_edges(relations: DataFrame) -> DataFrame:
    """Relations as edges, with their evidence as a list."""
    evidence = F.filter(F.array("evidence_block_id"), lambda x: x.isNotNull())
    order = F.row_number().over(W.partitionBy("doc_id").orderBy("edge_id"))
    return relations.select("doc_id", F.col("edge_id").alias("id"), F.col("source_concept_id").alias("source"), F.col("target_concept_id").alias("target"), "relation_type", F.coalesce("confidence", F.lit(0.6)).alias("confidence"), evidence.alias("evidence_blocks"), order.alias("ord"))


def valid_nodes(nodes: DataFrame) -> DataFrame:
    """One node per id with an id and a label; the first by label."""
    named = nodes.where((F.coalesce(F.col("id").cast("string"), F.lit("")) != "") & (F.coalesce(T.strip(F.col("label")), F.lit("")) != ""))
    return named.withColumn("__k", F.row_number().over(W.partitionBy("doc_id", "id").orderBy("label"))).where("__k = 1").drop("__k")


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """No self-loops, both ends known, confidence held to 0..1."""
    kept = edges.where("source <> target")
    for end in ("source", "target"):
        kept = kept.join(nodes.select("doc_id", F.col("id").alias(end)), ["doc_id", end], "left_semi")
    return kept.withColumn("confidence", J.clamp(F.col("confidence")))


def validation_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per document: nodes and edges before and after validation."""
    kept = valid_nodes(nodes)
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    out = count(nodes, "nodes_before").join(count(kept, "nodes_after"), "doc_id", "left").join(count(edges, "edges_before"), "doc_id", "left").join(count(valid_edges(edges, kept), "edges_after"), "doc_id", "left")
    return out.na.fill(0)


def merge_duplicates(edges: DataFrame) -> DataFrame:
    """One edge per source, target and type: average confidence, all evidence."""
    merged = edges.groupBy("doc_id", "source", "target", "relation_type").agg(
        F.min_by("id", "ord").alias("id"), N.mean(F.col("confidence")).alias("confidence"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("evidence_blocks")))).alias("evidence_blocks"), F.min("ord").alias("ord")
    )
    return merged.select("doc_id", "id", "source", "target", "relation_type", "confidence", "evidence_blocks", "ord")


def quality(edges: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    return edges.where((F.col("confidence") >= min_confidence) & (F.size("evidence_blocks") > 0))


def priority(relation: Column) -> Column:
    out = F.lit(0)
    for name, p in V.RELATION_PRIORITY.items():
        out = F.when(relation == name, p).otherwise(out)
    return out


def resolve_conflicts(edges: DataFrame) -> DataFrame:
    """Where a pair both contrasts and causes, defines or is part, only its best edge stays."""
    pair = W.partitionBy("doc_id", "source", "target")
    contrast = F.max((F.col("relation_type") == "CONTRASTS_WITH").cast("int")).over(pair)
    strong = F.max(F.col("relation_type").isin(*V.STRONG_RELATIONS).cast("int")).over(pair)
    best = F.row_number().over(pair.orderBy(priority(F.col("relation_type")).desc(), F.desc("confidence"), "ord"))
    marked = edges.withColumns({"__clash": (contrast + strong) == 2, "__k": best})
    return marked.where(~F.col("__clash") | (F.col("__k") == 1)).drop("__clash", "__k")


def refine(edges: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    return resolve_conflicts(quality(merge_duplicates(edges), min_confidence))


def score(nodes: DataFrame, measured: DataFrame) -> DataFrame:
    """Adds the measures and importance: 0.4 occurrences (of the most), 0.3 degree, 0.3 betweenness."""
    most = F.max("occurrence_count").over(W.partitionBy("doc_id"))
    joined = nodes.join(measured, ["doc_id", "id"], "left").na.fill(0.0, ["degree_centrality", "betweenness_centrality", "clustering_coefficient"])
    share = F.when(most > 0, F.col("occurrence_count") / F.when(most > 0, most)).otherwise(0.0)
    return joined.withColumn("importance_score", 0.4 * share + 0.3 * F.col("degree_centrality") + 0.3 * F.col("betweenness_centrality"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges at each node, every relation counted: doc_id, id, degree."""
    ends = edges.select("doc_id", F.col("source").alias("id")).unionByName(edges.select("doc_id", F.col("target").alias("id")))
    return nodes.select("doc_id", "id").join(ends.groupBy("doc_id", "id").agg(F.count("*").alias("degree")), ["doc_id", "id"], "left").na.fill(0, ["degree"])


def prune(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without nodes that have no edge and occur once at most, and without their edges."""
    kept = nodes.join(degrees(nodes, edges), ["doc_id", "id"]).where("degree > 0 or occurrence_count > 1").drop("degree")
    left = edges
    for end in ("source", "target"):
        left = left.join(kept.select("doc_id", F.col("id").alias(end)), ["doc_id", end], "left_semi")
    return kept, left


def assemble(nodes: DataFrame, edges: DataFrame, prune_isolated: bool = True) -> tuple[DataFrame, DataFrame]:
    """Pruned, with ranks by importance (to nine places, then by id) and by confidence."""
    if prune_isolated:
        nodes, edges = prune(nodes, edges)
    n = nodes.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(N.rounded(F.col("importance_score"), 9).desc(), "id")))
    e = edges.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("confidence"), "source", "target", "relation_type")))
    return n, e


def final_graph(nodes: DataFrame, edges: DataFrame, store: M.Store, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and one row of metadata per document.

    Counts are those after pruning, measures those before it.
    """
    nodes = store(valid_nodes(nodes))
    refined = store(refine(valid_edges(edges, nodes), min_confidence))
    measured = M.node_metrics(nodes, refined, store)
    whole = M.graph_metrics(nodes, refined, store)
    n, e = assemble(score(nodes, measured), refined)
    counts = n.groupBy("doc_id").agg(F.count("*").alias("n_nodes")).join(e.groupBy("doc_id").agg(F.count("*").alias("n_edges")), "doc_id", "left")
    meta = whole.join(counts, "doc_id", "left").na.fill(0).withColumn("min_confidence", F.lit(min_confidence))
    return n, e, meta


def full_format(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON text per document with all parts of nodes and edges."""
    r = lambda c, d: N.rounded(F.col(c), d).alias(c)
    n = F.struct("id", "label", "type", "aliases", "occurrence_count", r("importance_score", 3), r("degree_centrality", 3), r("betweenness_centrality", 3), r("clustering_coefficient", 3))
    e = F.struct("id", "source", "target", "relation_type", r("confidence", 2), "evidence_blocks")
    return _as_json(nodes, n, edges, e)


def minimal_format(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a viewer needs: id, label, type, importance / source, target, relation, weight."""
    n = nodes.select("doc_id", "id", "label", "type", N.rounded(F.col("importance_score"), 2).alias("importance"))
    return n, edges.select("doc_id", "source", "target", F.col("relation_type").alias("relation"), N.rounded(F.col("confidence"), 2).alias("weight"))


def _as_json(nodes: DataFrame, node: Column, edges: DataFrame, edge: Column) -> DataFrame:
    gather = lambda df, rank, part, name: df.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(rank, part.alias("x")))), lambda s: s["x"]).alias(name))
    n = gather(nodes, F.col("rank"), F.to_json(node), "nodes")
    e = gather(edges, F.col("rank"), F.to_json(edge), "edges")
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.coalesce(c, F.array().cast("array<string>")), ","), F.lit("]"))
    return n.join(e, "doc_id", "left").select("doc_id", F.concat(F.lit('{"nodes":'), listed(F.col("nodes")), F.lit(',"edges":'), listed(F.col("edges")), F.lit("}")).alias("graph_json"))


def relation_summary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation_type").agg(F.count("*").alias("n"), N.rounded(N.mean(F.col("confidence")), 4).alias("avg_confidence"))


def top_nodes(nodes: DataFrame, n: int = 10) -> DataFrame:
    """The n most important nodes of each document."""
    return nodes.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("importance_score"), "id"))).where(F.col("rank") <= n)
