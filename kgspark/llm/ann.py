"""Approximate nearest neighbours: probed lists, scanned block by block of dimensions.

After a random rotation the part of a squared distance that falls on the first
``d`` of ``D`` dimensions is a Beta(d / 2, (D - d) / 2) share of the whole.  So
a partial distance tests the hypothesis that a candidate is near enough for a
query's k best, and most candidates are abandoned after a few blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.llm._common import materialize

#: The index is fitted to at most so many vectors, those with the smallest
#: digests of their ids; every vector is indexed.
MAX_SAMPLE = 20_000
#: Lists are as many as the square root of the vectors, but no more than this;
#: from there on (16 million) lists grow.
MAX_LISTS = 4_096
#: Vectors of a part, and queries that visit it together: longer lists are
#: split, and a list is copied for further queries that visit it.
PART, QUERIES = 20_000, 20_000
#: Pairs of queries and vectors looked at together in a task.
PAIRS = 100_000
#: Dimensions looked at together, with a test after each block.
BLOCK = 16
#: Chance that one test abandons a candidate that is near enough.
ERROR = 1e-3
#: Share of the pairs left beyond which a block is added to all of them by one
#: matrix product; below it, to those left.
DENSE = 0.05
#: Share of the true neighbours within the sample that the probed lists must hold.
WANTED = 0.97
SEED = 7


@dataclass
class Index:
    """A rotation, the lists' centres, and the number of lists to probe."""

    rotation: np.ndarray
    centres: np.ndarray
    probes: int

    @property
    def dim(self) -> int:
        return len(self.rotation)

    def lists(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.centres.T, axis=1)

    def nearest_lists(self, q: np.ndarray) -> np.ndarray:
        """All lists of each query, best first."""
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")


def clean(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Rows (id, v) that take part, as doubles.

    Null ids, null or zero vectors and such with null or non-finite components
    are left out, and those whose length is not the most common one.
    """
    v = F.col(column).cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    rows = rows.where(~odd & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0))


def _rows(cells: pa.Array, dim: int) -> np.ndarray:
    return cells.flatten().to_numpy().reshape(-1, dim)


def fit(rows: DataFrame, n: int, *, k: int = 20, seed: int = SEED) -> Index | None:
    """Fit the index to a bounded sample of ``clean`` rows; None without rows."""
    sample = rows.orderBy(F.md5(F.col("id").cast("string")), "id").limit(MAX_SAMPLE).collect()
    if not sample:
        return None
    x = np.array([r["v"] for r in sample])
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    lists = int(min(max(1, round(n**0.5)), MAX_LISTS, max(1, len(x) // 4)))
    # Spherical k-means: the nearest centre has the largest inner product.
    centres = unit[rng.choice(len(unit), lists, replace=False)]
    for _ in range(12):
        own = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    index = Index(rotation, centres, lists)
    # Lists to probe: how far down the queries' orders their true neighbours lie.
    asked = rng.choice(len(x), min(300, len(x)), replace=False)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, len(x) - 1)]
    if near.size:
        rank = np.empty((len(asked), lists), np.int64)
        order = index.nearest_lists(x[asked])
        np.put_along_axis(rank, order, np.arange(lists)[None, :].repeat(len(asked), 0), axis=1)
        at = np.take_along_axis(rank, index.lists(unit)[near], axis=1)
        held = np.array([(at <= p).mean() for p in range(lists)])
        index.probes = int(np.argmax(held >= WANTED)) + 1
    return index


def cuts_of(dim: int) -> list[int]:
    """Where the blocks of dimensions end."""
    return [*range(BLOCK, dim, BLOCK), dim]


def critical_shares(dim: int) -> list[float]:
    """Per block, the share of a squared distance that its first dimensions exceed with chance ERROR."""
    out = []
    x = (np.arange(20_000) + 0.5) / 20_000
    for d in cuts_of(dim)[:-1]:
        weight = (d / 2 - 1) * np.log(x) + ((dim - d) / 2 - 1) * np.log1p(-x)
        below = np.cumsum(np.exp(weight - weight.max()))
        out.append(float(x[np.searchsorted(below, (1 - ERROR) * below[-1])]))
    return [*out, 1.0]


def norms(rotated: np.ndarray) -> np.ndarray:
    """Squared norms of the first dimensions, a row per block."""
    return np.stack([(rotated[:, :c] ** 2).sum(1) for c in cuts_of(rotated.shape[1])])


def scan(q: np.ndarray, q_rows: np.ndarray, x: np.ndarray, x_rows: np.ndarray, x_ids: np.ndarray, qr: np.ndarray, xr: np.ndarray, k: int, shares: list[float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of ``x`` for each query: query number, row of ``x``, score.

    ``qr`` and ``xr`` are the rotated vectors.  The exact scores of the k
    candidates that look best after the first block give each query a
    threshold, and these stay in any case, so that a query gets ``k`` rows or
    all its candidates.  A score of at least the threshold t means a squared
    distance of at most |q|^2 + |x|^2 - 2 t; after each block, candidates whose
    partial distance is over the critical share of that are abandoned.  What is
    left is scored on the original vectors.
    """
    cuts, shares = cuts_of(qr.shape[1]), shares or critical_shares(qr.shape[1])
    q_norms, x_norms = norms(qr), norms(xr)
    whole_q, whole_x = q_norms[-1], x_norms[-1]
    # Rounding of the rotated sums.
    slack = 1e-9 * (whole_q + whole_x.max())
    part = qr[:, : cuts[0]] @ xr[:, : cuts[0]].T
    # Where a query meets itself.
    by_row = np.argsort(x_rows, kind="stable")
    begin, end = (np.searchsorted(x_rows, q_rows, side=s, sorter=by_row) for s in ("left", "right"))
    own_q = np.repeat(np.arange(len(q)), end - begin)
    own_x = by_row[np.arange(len(own_q)) + np.repeat(begin - np.cumsum(end - begin) + (end - begin), end - begin)]
    best, first = np.full(len(q), -np.inf), None
    if len(x) > k:
        nearness = part + (0.5 * cuts[0] / cuts[-1] * whole_x - 0.5 * x_norms[0])[None, :]
        nearness[own_q, own_x] = -np.inf
        first = np.argpartition(nearness, len(x) - k, axis=1)[:, len(x) - k :]
        taken = np.isfinite(np.take_along_axis(nearness, first, axis=1))
        exact = np.einsum("qkd,qd->qk", x[first], q)
        exact[~taken] = -np.inf
        best = exact.min(axis=1) - slack

    def least(n: int) -> tuple[np.ndarray, np.ndarray]:
        # A pair stays if its sum so far is at least that of these parts, of the query and of the vector.
        return 0.5 * (q_norms[n] - shares[n] * (whole_q - 2 * best) - slack), 0.5 * (x_norms[n] - shares[n] * whole_x)

    if first is None:
        on = np.ones((len(q), len(x)), bool)
        on[own_q, own_x] = False
        i, j = np.nonzero(on)
    else:
        of_q, of_x = least(0)
        alive, i, j, sums = part >= of_q[:, None] + of_x[None, :], None, None, None
        alive[own_q, own_x] = False
        for n, (begin, end) in enumerate(zip(cuts[:-1], cuts[1:], strict=True), 1):
            of_q, of_x = least(n)
            if i is None and np.count_nonzero(alive) > DENSE * alive.size:
                part += qr[:, begin:end] @ xr[:, begin:end].T
                alive &= part >= of_q[:, None] + of_x[None, :]
                continue
            if i is None:
                i, j = np.nonzero(alive)
                sums = part[i, j]
            sums = sums + np.einsum("nd,nd->n", qr[i, begin:end], xr[j, begin:end])
            left = sums >= of_q[i] + of_x[j]
            i, j, sums = i[left], j[left], sums[left]
        if i is None:
            # All have their whole sum: only the k best of a query, with the first ones, need an exact score.
            q_at, k_at = np.nonzero(taken)
            alive[q_at, first[q_at, k_at]] = True
            part[~alive] = -np.inf
            least_best = np.partition(part, len(x) - k, axis=1)[:, len(x) - k] - slack
            i, j = np.nonzero(alive & (part >= least_best[:, None]))
            first, taken = first[:, :0], taken[:, :0]
        # The first ones with those that were left, each pair once.
        at = np.unique(np.concatenate([i * len(x) + j, (np.arange(len(q))[:, None] * len(x) + first)[taken]]))
        i, j = at // len(x), at % len(x)
    score = (q[i] * x[j]).sum(axis=1)
    order = np.lexsort((x_ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    return i[nth < k], j[nth < k], score[nth < k]


def search(vectors: DataFrame, *, k: int = 20, query: str | None = None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows by inner product of each query: query_id, rank, vec_id, score.

    Queries are the rows for which the SQL condition ``query`` on ``id`` holds
    (default: all); candidates are all rows but the query's own, also others of
    its id.  Ids are whole numbers.  Rows that ``clean`` leaves out take no
    part.  Equal scores are ranked by id.  With fewer candidates than ``k`` all
    are returned.

    Each vector lies in the list of its nearest centre; a query probes the
    lists nearest to it, as many as the fit asks for and as hold ``k`` others.
    Lists are split into parts by a digest, so that a list of many like vectors
    is scanned by many tasks; per part only ``k`` rows a query go on.  A list is
    copied once for every QUERIES queries that visit it.
    """
    # Written once with their numbers, which tell rows of one id apart.
    rows = materialize(clean(vectors, key, column).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = rows.count()
    index = fit(rows, n, k=k)
    spark = vectors.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    made, dim = spark.sparkContext.broadcast(index), index.dim
    shares = critical_shares(dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = made.value.lists(_rows(batch["v"], dim))
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch["row"], batch["id"], batch["v"]], names=["list", "row", "id", "v"])

    form = "list int, row long, id long, v array<double>"
    listed = materialize(rows.select("row", "id", "v").mapInArrow(assign, form), "lists")
    held = np.zeros(len(index.centres), np.int64)
    for r in listed.groupBy("list").count().collect():  # a row per list
        held[r["list"]] = r["count"]
    sizes = spark.sparkContext.broadcast(held)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sizes.value
        for batch in batches:
            if not batch.num_rows:
                continue
            order = made.value.nearest_lists(_rows(batch["v"], dim))
            before = np.cumsum(counts[order], axis=1) - counts[order]
            probed = (np.arange(order.shape[1])[None, :] < made.value.probes) | (before <= 2 * k)
            row, at = np.nonzero(probed & (counts[order] > 0))
            to = order[row, at]
            for b in range(0, len(row), 5_000):
                some = pa.array(row[b : b + 5_000])
                yield pa.RecordBatch.from_arrays([pa.array(to[b : b + 5_000].astype(np.int32)), *(batch[c].take(some) for c in ("row", "id", "v"))], names=["list", "row", "id", "v"])

    asked = materialize(rows.where(query or "true").select("row", "id", "v").mapInArrow(ask, form), "visits")
    visits = asked.groupBy("list").agg(F.count("*").alias("visits"))
    # A row per list: in how many parts it is split, and how often it is copied.
    plan = listed.groupBy("list").agg(F.count("*").alias("size")).join(visits, "list")
    plan = materialize(plan.select("list", F.ceil(F.col("size") / PART).cast("int").alias("parts"), F.ceil(F.col("visits") / QUERIES).cast("int").alias("turns")), "list-sizes")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    asked = asked.join(F.broadcast(plan), "list").withColumn("turn", one("turns")).withColumn("part", every("parts"))  # MAX_LISTS rows
    asked = asked.select("list", "part", "turn", "row", "id", "v")
    again = F.broadcast(plan.toDF("list", "parts", "turns"))
    stored = listed.join(again, "list").withColumn("part", one("parts")).withColumn("turn", every("turns")).select("list", "part", "turn", "row", "id", "v")

    def visit(queries: pa.Table, held_: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and held_.num_rows:
            q, x = (_rows(t["v"].combine_chunks(), dim) for t in (queries, held_))
            (q_ids, q_rows), (x_ids, x_rows) = ((t["id"].to_numpy(), t["row"].to_numpy()) for t in (queries, held_))
            step = max(1, PAIRS // len(x))
            qr, xr = q @ made.value.rotation, x @ made.value.rotation
            for b in range(0, len(q), step):
                i, j, score = scan(q[b : b + step], q_rows[b : b + step], x, x_rows, x_ids, qr[b : b + step], xr, k, shares)
                out.append((q_rows[b : b + step][i], q_ids[b : b + step][i], x_ids[j], score))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0)]
        return pa.table(dict(zip(("query_row", "query_id", "vec_id", "score"), map(pa.array, cols), strict=True)))

    found = asked.groupBy("list", "part", "turn").cogroup(stored.groupBy("list", "part", "turn")).applyInArrow(visit, "query_row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
