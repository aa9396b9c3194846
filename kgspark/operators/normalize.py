"""Clusters of like concepts, and one canonical concept for each.

Candidates are (doc_id, concept_id, ord, name, type, description, block_id,
heading_path, confidence), ``ord`` giving their order in a document.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as K

from kgspark.functions import numbers as N
from kgspark.functions import text as T
from kgspark.functions import vectors as V
from kgspark.operators.components import SLICE_EDGES, grouped_components
from kgspark.operators.pivots import pairs_in_groups, pairs_within
from kgspark.sources.tables import store

THRESHOLD = 0.80
#: Chance that a pair at the threshold is proposed, and most signs of a band.
RECALL, MOST_SIGNS = 0.995, 16
Store = Callable[[DataFrame], DataFrame]


def with_keys(rows: DataFrame) -> DataFrame:
    return rows.withColumn("name_key", T.name_key(F.col("name")))


def exact_dedup(rows: DataFrame) -> DataFrame:
    """One candidate per name key and document: the most confident, then the first."""
    first = F.row_number().over(W.partitionBy("doc_id", "name_key").orderBy(F.desc("confidence"), "ord"))
    return with_keys(rows).withColumn("__k", first).where("__k = 1").drop("__k")


def embedding_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("embedding_text", F.concat("name", F.lit(". "), "description"))


def attach_vectors(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Joins a stored (key, vec) table on the embedding text."""
    return embedding_text(rows).join(vectors.select(F.col("key").alias("embedding_text"), F.col("vec").alias("embedding")), "embedding_text", "left")


def similar_pairs(rows: DataFrame, threshold: float = THRESHOLD, scope: str = "doc", group: str = "doc_id", ident: str = "ord", vector: str = "embedding", store: Store = store) -> DataFrame:
    """Pairs a < b with cosine at least ``threshold``: group, a, b, similarity.

    Within a document all pairs are compared, by ``pivots.pairs_in_groups``;
    vectors with components that are null or not finite, or zero, have none.
    A threshold of 0 gives all pairs.  With scope "corpus"
    ``pivots.pairs_within`` finds all pairs, whatever their groups; vectors of
    another length than the longest, with nulls, or zero have none.  With scope
    "bands" ``candidate_pairs`` proposes pairs, of which a few are missed, and
    the exact cosine decides.
    """
    size = V.norm(F.col(vector))
    slim = rows.select(F.col(group).alias("g"), F.col(ident).alias("i"), F.col(vector).alias("v"), size.alias("n"))
    sim = V.cosine(F.col("a.v"), F.col("b.v"), F.col("a.n"), F.col("b.n"))
    if scope == "doc" and threshold > 0:
        whole = slim.where("n > 0 and g is not null and i is not null")
        whole = whole.select("g", "i", F.transform("v", lambda x: x.cast("double")).alias("v"))
        whole = whole.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        return pairs_in_groups(whole, threshold, store).withColumnRenamed("g", group)
    if scope == "doc":
        pairs = slim.alias("a").join(slim.alias("b"), "g").where("a.i < b.i").select("g", F.col("a.i").alias("a"), F.col("b.i").alias("b"), sim.alias("similarity"))
        return pairs.where(F.col("similarity") >= threshold).withColumnRenamed("g", group)
    if scope == "corpus":
        whole = slim.where("n > 0")
        dim = whole.agg(F.max(F.size("v"))).first()[0] or 0
        whole = whole.where((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))).select("i", F.transform("v", lambda x: x.cast("double")).alias("v"))
        return pairs_within(store(whole), threshold, store)
    near = candidate_pairs(slim.where("n > 0"), threshold)
    pairs = near.join(slim.select(F.col("i").alias("a"), F.col("v").alias("v_a"), F.col("n").alias("n_a")), "a").join(slim.select(F.col("i").alias("b"), F.col("v").alias("v_b"), F.col("n").alias("n_b")), "b")
    pairs = pairs.select("a", "b", V.cosine(F.col("v_a"), F.col("v_b"), F.col("n_a"), F.col("n_b")).alias("similarity"))
    return pairs.where(F.col("similarity") >= threshold)


def candidate_pairs(vectors: DataFrame, threshold: float, recall: float = RECALL, seed: int = 1) -> DataFrame:
    """Pairs a < b of (i, v) that share all signs of a band of random hyperplanes.

    Two vectors at the angle w agree in a sign with chance 1 - w / pi.  A band
    has about log2 of the vectors as signs, so that few others share it, and
    bands are as many as a pair at the threshold needs to meet with ``recall``.
    """
    n, dim = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    signs = min(max(round(math.log2(max(n, 2))) - 2, 4), MOST_SIGNS)
    meet = (1 - math.acos(min(1.0, threshold)) / math.pi) ** signs
    bands = 1 if meet >= recall else math.ceil(math.log(1 - recall) / math.log(1 - meet))
    dim = dim or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).normal(size=(dim, bands * signs))
        weight = 1 << np.arange(signs)
        for batch in batches:
            if batch.num_rows:
                v = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                keys = ((v @ planes > 0).reshape(len(v), bands, signs) * weight).sum(2)
                own, band = np.repeat(np.arange(len(v)), bands), np.tile(np.arange(bands), len(v))
                yield pa.RecordBatch.from_arrays([pa.array(band, pa.int64()), pa.array(keys.reshape(-1), pa.int64()), batch["i"].take(pa.array(own))], names=["band", "key", "i"])

    kind = vectors.schema["i"].dataType.simpleString()
    rows = vectors.where(F.size("v") == dim).select("i", F.transform("v", lambda x: x.cast("double")).alias("v")).mapInArrow(run, f"band long, key long, i {kind}")
    a, b = rows.withColumnRenamed("i", "a"), rows.withColumnRenamed("i", "b")
    return a.join(b, ["band", "key"]).where("a < b").select("a", "b").distinct()


def adjacency(pairs: DataFrame) -> DataFrame:
    """Both directions of each pair."""
    return pairs.unionByName(pairs.withColumnsRenamed({"a": "__a", "b": "a"}).withColumnsRenamed({"__a": "b"}))


def clusters(rows: DataFrame, pairs: DataFrame, store: Store, *keep: str, most: int = SLICE_EDGES) -> DataFrame:
    """Members with their cluster: doc_id, ord, cluster (its smallest ord), size, similarity, and the columns to ``keep`` of their rows.

    Similarity is the mean over all pairs of members, those below the threshold
    counting 0; single members have 1.  A document's rows and pairs meet in one
    task (``members_in_tasks``).  Of documents with over ``most`` of them pairs
    are spread over tasks by ``grouped_components``.
    """
    nodes, links = rows.select("doc_id", "ord", *keep), pairs.select("doc_id", "a", "b", "similarity")
    sizes = nodes.select("doc_id").unionByName(links.select("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    # At most a row for each ``most`` of all rows.
    large = store(sizes.where(F.col("n") > most).select(F.col("doc_id").alias("__doc")))
    if large.isEmpty():
        return members_in_tasks(nodes, links, keep)
    part = lambda df, how: df.join(F.broadcast(large), F.col("doc_id").eqNullSafe(F.col("__doc")), how)
    small = members_in_tasks(part(nodes, "left_anti"), part(links, "left_anti"), keep)
    nodes, links = part(nodes, "left_semi"), part(links, "left_semi")
    named = grouped_components(links, store, slice_edges=most).select("doc_id", F.col("node").alias("ord"), F.col("component").alias("cluster"))
    members = nodes.join(named, ["doc_id", "ord"], "left").withColumn("cluster", F.coalesce("cluster", "ord"))
    sums = links.select("doc_id", F.col("a").alias("ord"), "similarity").join(members.select("doc_id", "ord", "cluster"), ["doc_id", "ord"]).groupBy("doc_id", "cluster").agg(F.sum("similarity").alias("total_"))
    n = F.count("*").over(W.partitionBy("doc_id", "cluster"))
    mean = F.when(F.col("size") == 1, 1.0).otherwise(F.coalesce("total_", F.lit(0.0)) / (F.col("size") * (F.col("size") - 1) / 2.0))
    spread = members.withColumn("size", n).join(sums, ["doc_id", "cluster"], "left").select("doc_id", "ord", "cluster", "size", mean.alias("similarity"), *keep)
    return small.unionByName(spread)


def members_in_tasks(nodes: DataFrame, links: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``clusters`` of documents that each fit a task."""
    kind = nodes.schema["ord"].dataType
    plain = nodes.select("doc_id", "ord", F.lit(None).cast(kind).alias("b"), F.lit(None).cast("double").alias("similarity"), *keep)
    ends = links.where("doc_id is not null and a is not null and b is not null")
    both = plain.unionByName(ends.select("doc_id", F.col("a").cast(kind).alias("ord"), F.col("b").cast(kind).alias("b"), F.col("similarity").cast("double").alias("similarity")), allowMissingColumns=True)

    def joined(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        doc = pc.dictionary_encode(rows["doc_id"], null_encoding="encode").combine_chunks().indices.to_numpy().astype(np.int64)
        single = rows["b"].is_null().to_numpy()
        own, pair = np.flatnonzero(single), np.flatnonzero(~single)
        u, v = rows["ord"].to_numpy(), rows["b"].filter(pa.array(~single)).to_numpy()
        ords, rank = np.unique(np.concatenate([u[own], u[pair], v]), return_inverse=True)
        # Nodes in the order of documents and ords, so the least is the first.
        keys, at = np.unique(np.concatenate([doc[own], doc[pair], doc[pair]]) * len(ords) + rank, return_inverse=True)
        node, a, b = np.split(at, [len(own), len(own) + len(pair)])
        label = first_of(len(keys), a, b)
        size = np.bincount(label[node], minlength=len(keys))
        held = np.zeros(len(keys), bool)
        held[node] = True
        similarity = rows["similarity"].filter(pa.array(~single)).fill_null(0.0).to_numpy()
        total = np.bincount(label[a[held[a]]], weights=similarity[held[a]], minlength=len(keys))
        of = label[node]
        n = size[of]
        mean = np.where(n == 1, 1.0, total[of] / np.maximum(n * (n - 1) / 2.0, 1))
        rows = rows.filter(pa.array(single))
        out = [rows["doc_id"], rows["ord"], pa.array(ords[keys[of] % len(ords)], rows["ord"].type), pa.array(n.astype(np.int64)), pa.array(mean), *(rows[c] for c in keep)]
        yield from pa.table(out, names=["doc_id", "ord", "cluster", "size", "similarity", *keep]).to_batches(max_chunksize=50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < 200_000 or batch["doc_id"][0] == batch["doc_id"][-1]:
                continue
            # Documents up to the last one, which may go on in the next batch.
            doc = pc.dictionary_encode(batch["doc_id"], null_encoding="encode").indices.to_numpy()
            cut = int(np.flatnonzero(doc != doc[-1])[-1]) + 1
            held[-1] = batch.slice(0, cut)
            yield from joined(pa.Table.from_batches(held))
            held, n = [batch.slice(cut)], batch.num_rows - cut
        if n:
            yield from joined(pa.Table.from_batches(held))

    fields = [nodes.schema["doc_id"], nodes.schema["ord"], K.StructField("cluster", kind), K.StructField("size", K.LongType()), K.StructField("similarity", K.DoubleType()), *(nodes.schema[c] for c in keep)]
    return both.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, K.StructType(fields))


def first_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of ``n`` nodes reaches by the edges (a, b)."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (down := label[label])).any():
            label = down


def cluster_stats(members: DataFrame) -> DataFrame:
    """Per document: clusters, single and multiple ones, average and largest size."""
    each = members.where("ord = cluster").select("doc_id", F.col("size").alias("n"))  # the first member
    return each.groupBy("doc_id").agg(F.count("*").alias("n_clusters"), F.count_if(F.col("n") == 1).alias("n_single"), F.count_if(F.col("n") > 1).alias("n_multi"), F.round(F.avg("n"), 4).alias("avg_size"), F.max("n").alias("max_size"))


def verification_prompts(members: DataFrame, names: DataFrame) -> DataFrame:
    """A yes-or-no prompt per cluster of several members."""
    listed = _with_columns(members.where("size > 1"), names, "name").groupBy("doc_id", "cluster").agg(F.sort_array(F.collect_list(F.struct("ord", "name"))).alias("m"))
    return listed.select("doc_id", "cluster", F.concat(F.lit("Are these names of one concept? Answer yes or no.\n- "), F.array_join(F.transform("m", lambda x: x["name"]), "\n- ")).alias("prompt"))


def accepted(reply: Column) -> Column:
    """Whether a reply says yes within its first ten characters; none accepts."""
    plain = F.lower(T.strip(F.coalesce(reply, F.lit(""))))
    return (plain == "") | F.contains(F.left(plain, F.lit(10)), F.lit("yes"))


def apply_verdicts(members: DataFrame, replies: DataFrame) -> DataFrame:
    """Rejected clusters become single members; ``replies`` is (doc_id, cluster, reply)."""
    judged = members.join(replies, ["doc_id", "cluster"], "left")
    no = (F.col("size") > 1) & ~accepted(F.col("reply"))
    return judged.select("doc_id", "ord", F.when(no, F.col("ord")).otherwise(F.col("cluster")).alias("cluster"), F.when(no, 1).otherwise(F.col("size")).alias("size"), F.when(no, 1.0).otherwise(F.col("similarity")).alias("similarity"), (~no).alias("verified"))


def _with_columns(members: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """Members with columns of their rows, joined unless ``clusters`` kept them."""
    if set(columns) <= set(members.columns):
        return members.select("doc_id", "ord", "cluster", *columns)
    return members.select("doc_id", "ord", "cluster").join(rows.select("doc_id", "ord", *columns), ["doc_id", "ord"])


def canonical_names(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Per cluster the most frequent name, then the shortest, then the earliest."""
    named = _with_columns(members, rows, "name").repartition("doc_id", "cluster")
    counts = named.groupBy("doc_id", "cluster", "name").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return counts.groupBy("doc_id", "cluster").agg(F.min_by("name", F.struct(-F.col("n"), F.length("name"), F.col("first"))).alias("canonical_name"))


def canonical_concepts(rows: DataFrame, members: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """One concept per cluster: doc_id, canonical_id, canonical_name, aliases, type,
    descriptions, source_blocks, occurrence_count, importance_score.

    Importance is 0.4 of the share of candidates (times ten, at most 1), 0.3 of
    the number of heading paths (of five) and 0.3 of the average confidence;
    ``totals`` has the candidates of each document before any were merged.
    Without it each row has them as ``total``.
    """
    held = ["total"] if totals is None else []
    joined = _with_columns(members, rows, "name", "type", "description", "block_id", "heading_path", "confidence", *held).repartition("doc_id", "cluster")
    times = lambda c: F.count("*").over(W.partitionBy("doc_id", "cluster", c))
    set_of = lambda c: F.sort_array(F.collect_set(c))
    merged = joined.withColumn("n_name", times("name")).withColumn("n_type", times("type")).groupBy("doc_id", "cluster").agg(
        F.min_by("name", F.struct(-F.col("n_name"), F.length("name"), F.col("ord"))).alias("canonical_name"),
        F.min_by("type", F.struct(-F.col("n_type"), F.col("ord"))).alias("type"),
        set_of("name").alias("names"),
        set_of(F.when(T.strip(F.col("description")) != "", F.col("description"))).alias("descriptions"),
        set_of("block_id").alias("source_blocks"),
        F.count("*").cast("int").alias("occurrence_count"),
        F.size(F.collect_set(F.when(F.size("heading_path") > 0, F.col("heading_path")))).alias("paths"),
        N.mean(F.col("confidence")).alias("confidence"),
        *(F.max(c).alias(c) for c in held),
    )
    all_ = merged if totals is None else merged.join(totals, "doc_id")
    score = 0.4 * F.least(F.lit(1.0), 10.0 * F.col("occurrence_count") / F.col("total")) + 0.3 * F.least(F.lit(1.0), F.col("paths") / 5.0) + 0.3 * F.col("confidence")
    ident = T.short_hash(F.col("doc_id"), F.col("cluster"))
    return all_.select("doc_id", ident.alias("canonical_id"), "canonical_name", F.array_remove("names", F.col("canonical_name")).alias("aliases"), "type", "descriptions", "source_blocks", "occurrence_count", N.rounded(score, 3).alias("importance_score"))


def funnel(candidates: DataFrame, unique: DataFrame, canonical: DataFrame) -> DataFrame:
    """Per document: candidates, after exact dedup, canonical, reduction in percent."""
    counts = [df.groupBy("doc_id").agg(F.count("*").alias(name)) for df, name in ((candidates, "n_candidates"), (unique, "n_unique"), (canonical, "n_canonical"))]
    return with_reduction(counts[0].join(counts[1], "doc_id", "left").join(counts[2], "doc_id", "left"))


def with_reduction(counts: DataFrame) -> DataFrame:
    return counts.withColumn("reduction", F.round(100.0 * (1 - F.col("n_canonical") / F.col("n_candidates")), 1))


def canonical_summary(canonical: DataFrame) -> DataFrame:
    """Per type: concepts, with aliases, occurrences, share in percent."""
    out = canonical.groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.size("aliases") > 0).alias("n_with_aliases"), F.sum("occurrence_count").alias("occurrences"))
    return out.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 1))  # a row per type
