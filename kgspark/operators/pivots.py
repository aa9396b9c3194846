"""All pairs of vectors within an angle, by a partition around pivots or within given groups."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Store = Callable[[DataFrame], DataFrame]

#: Vectors of a cell that one task compares; more are compared in slices.
CELL_ROWS = 16_384
#: Vectors of a given group that one task compares, and rows of a product that it holds at once.
SLICE_ROWS, BLOCK_ROWS = 8_192, 256
#: Pivots that the driver and each task hold, at most: with 1,000 dimensions 32 MB.
MOST_PIVOTS = 4_096
#: Rounds in which crowded cells get pivots of their own.
ROUNDS = 3
#: Angles are taken so much wider, for what floating point may lose.
SLACK = 1e-7


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _home(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Each vector with its nearest pivot and the angle to it: i, v, home, angle."""
    shared, dim = vectors.sparkSession.sparkContext.broadcast(pivots), pivots.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _unit(_matrix(batch["v"], dim)) @ shared.value.T
                home = near.argmax(1)
                angle = np.arccos(np.clip(near[np.arange(len(home)), home], -1, 1))
                yield pa.RecordBatch.from_arrays([batch["i"], batch["v"], pa.array(home, pa.int32()), pa.array(angle)], names=["i", "v", "home", "angle"])

    kind = vectors.schema["i"].dataType.simpleString()
    return vectors.select("i", "v").mapInArrow(assign, f"i {kind}, v array<double>, home int, angle double")


def _cells(vectors: DataFrame, n: int, store: Store, cell_rows: int, seed: int) -> tuple[np.ndarray, DataFrame, dict[int, tuple[int, float]]]:
    """Pivots, the assigned vectors, and rows and largest angle per cell.

    Crowded cells are split again around pivots drawn from their own vectors,
    unless all of these are one and the same.
    """

    def drawn(rows: DataFrame, k: int) -> np.ndarray:
        # By the least hashes, so that a rerun draws the same, and each of equal vectors once.
        named = rows.select("v", F.xxhash64("v", F.lit(seed)).alias("h"))
        least = [r["h"] for r in named.select("h").distinct().orderBy("h").limit(k).collect()]
        some = named.where(F.col("h").isin(least)).groupBy("h").agg(F.first("v").alias("v")).orderBy("h").collect()
        return _unit(np.array([r["v"] for r in some], np.float64))

    pivots = drawn(vectors, min(max(1, n // cell_rows), MOST_PIVOTS // 2))
    for turn in range(ROUNDS + 1):
        homed = store(_home(vectors, pivots))
        found = {r["home"]: (r["n"], r["angle"]) for r in homed.groupBy("home").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect()}
        crowded = [c for c, (rows, angle) in found.items() if rows > 2 * cell_rows and angle > 1e-6]
        room = MOST_PIVOTS - len(pivots)
        if turn == ROUNDS or not crowded or room <= 0:
            break
        more = [drawn(homed.where(F.col("home") == c), min(max(2, found[c][0] // cell_rows), max(1, room // len(crowded)))) for c in sorted(crowded)]
        grown = np.unique(np.concatenate([pivots, *more]), axis=0)
        if len(grown) == len(pivots):
            break
        pivots = grown[:MOST_PIVOTS]
    return pivots, homed, found


def _visits(homed: DataFrame, pivots: np.ndarray, cells: dict[int, tuple[int, float]], angle: float) -> DataFrame:
    """The other cells in which a vector may have a partner: i, v, cell; only cells below its own.

    Two bounds leave a cell out.  By the triangle inequality a partner's angle
    to the cell's pivot is at least the vector's less ``angle``, and the cell
    has none so far out; and the vector may be further than that from the plane
    on whose other side the cell lies.
    """
    radius = np.full(len(pivots), -np.inf)
    for c, (_, far) in cells.items():
        radius[c] = far
    shared, dim = homed.sparkSession.sparkContext.broadcast((pivots, radius)), pivots.shape[1]
    # The plane between two pivots passes through the centre of the sphere.
    reach = math.sin(min(angle, math.pi / 2))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radius = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                near = _unit(_matrix(part["v"], dim)) @ pivots.T
                home = part["home"].to_numpy()
                apart = np.sqrt(np.maximum(2 - 2 * pivots[home] @ pivots.T, 0))
                ok = np.arccos(np.clip(near, -1, 1)) - angle - SLACK <= radius
                ok &= near[np.arange(len(home)), home][:, None] - near <= reach * apart + 10 * SLACK
                ok &= np.arange(len(pivots))[None] < home[:, None]
                row, cell = np.nonzero(ok)
                own = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([part["i"].take(own), part["v"].take(own), pa.array(cell, pa.int32())], names=["i", "v", "cell"])

    kind = homed.schema["i"].dataType.simpleString()
    return homed.select("i", "v", "home").mapInArrow(visit, f"i {kind}, v array<double>, cell int")


def pairs_within(vectors: DataFrame, threshold: float, store: Store, cell_rows: int = CELL_ROWS, seed: int = 1) -> DataFrame:
    """All pairs a < b of (i, v) with a cosine of at least ``threshold``: a, b, similarity.

    No pair is lost, at any threshold.  Each vector belongs to the cell of its
    nearest pivot and visits those others that can hold a partner; a pair is
    compared in one cell only.  Cells of many rows or visitors are compared in
    slices of ``cell_rows``, each pair of slices by one task as a product of
    matrices.  How many cells a vector visits depends on the threshold against
    the spread of the vectors: a few where they lie in clusters, nearly all
    where nothing sets them apart, and then the work is that of all pairs.

    Vectors are arrays of doubles of one length, without nulls and not zero;
    pairs of one id are left out.  Cosines below 0 count as 0, so a threshold
    of 0 gives all pairs.
    """
    kind = vectors.schema["i"].dataType.simpleString()
    schema = f"a {kind}, b {kind}, similarity double"
    n = vectors.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    angle = math.acos(min(1.0, threshold)) + SLACK if threshold > 0 else math.pi
    pivots, homed, cells = _cells(vectors, n, store, cell_rows, seed)
    visits = _visits(homed, pivots, cells, angle)  # made again for the shuffle: cheaper than to write them
    coming = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}  # a row per pivot
    pieces = lambda rows: -(-rows // cell_rows)
    sizes = vectors.sparkSession.createDataFrame([(c, pieces(rows), pieces(coming.get(c, 0))) for c, (rows, _) in cells.items()], "cell int, n_own int, n_coming int")
    slice_of = lambda count: F.pmod(F.xxhash64("i", "v"), F.greatest(count, F.lit(1))).cast("int")
    upto = lambda count: F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    # A task is (cell, left slice of its own rows, right slice of its own or of visitors).
    own = homed.select("i", "v", F.col("home").alias("cell")).join(F.broadcast(sizes), "cell").withColumn("s", slice_of(F.col("n_own")))
    left = F.transform(F.sequence(F.col("s"), F.col("n_own") - 1), lambda r: F.struct(F.col("s").alias("l"), r.alias("r"), F.lit(False).alias("met"), F.lit(True).alias("is_left")))
    right = F.transform(F.filter(F.sequence(F.lit(0), F.col("s")), lambda x: x < F.col("s")), lambda x: F.struct(x.alias("l"), F.col("s").alias("r"), F.lit(False).alias("met"), F.lit(False).alias("is_left")))
    met = F.transform(upto(F.col("n_coming")), lambda r: F.struct(F.col("s").alias("l"), r.alias("r"), F.lit(True).alias("met"), F.lit(True).alias("is_left")))
    sent = own.select("cell", "i", "v", F.explode(F.concat(left, right, met)).alias("task"))
    guests = visits.join(F.broadcast(sizes), "cell").withColumn("s", slice_of(F.col("n_coming")))
    there = F.transform(F.sequence(F.lit(0), F.col("n_own") - 1), lambda x: F.struct(x.alias("l"), F.col("s").alias("r"), F.lit(True).alias("met"), F.lit(False).alias("is_left")))
    sent = sent.unionByName(guests.select("cell", "i", "v", F.explode(there).alias("task"))).select("cell", "task.*", "i", "v")
    dim = pivots.shape[1]

    def compare(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        on_left = table["is_left"].to_numpy()
        same = not first["met"] and first["l"] == first["r"]
        a = table.filter(pa.array(on_left))
        b = a if same else table.filter(pa.array(~on_left))
        out: list[tuple] = []
        if a.num_rows and b.num_rows:
            va, vb = (_matrix(x["v"].combine_chunks(), dim) for x in (a, b))
            na, nb = (np.linalg.norm(v, axis=1) for v in (va, vb))
            for start in range(0, len(va), 1_024):
                near = va[start : start + 1_024] @ vb.T / (na[start : start + 1_024, None] * nb[None])
                row, col = np.nonzero(near >= threshold - 1e-9)
                row += start
                if same:
                    row, col = row[row < col], col[row < col]
                # Once more one by one, so that a pair's value doesn't depend on the slices.
                value = np.clip(np.einsum("ij,ij->i", va[row], vb[col]) / (na[row] * nb[col]), 0, 1)
                out.append((row[value >= threshold], col[value >= threshold], value[value >= threshold]))
        if not out:
            return pa.table({"x": a["i"].slice(0, 0), "y": a["i"].slice(0, 0), "similarity": pa.array([], pa.float64())})
        row, col, value = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"x": a["i"].take(pa.array(row)), "y": b["i"].take(pa.array(col)), "similarity": pa.array(value)})

    found = sent.groupBy("cell", "l", "r", "met").applyInArrow(compare, f"x {kind}, y {kind}, similarity double")
    return found.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def pairs_in_groups(vectors: DataFrame, threshold: float, store: Store, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """All pairs a < b of (g, i, v) of one group with a cosine of at least ``threshold``: g, a, b, similarity.

    Groups of over ``slice_rows`` vectors are compared in slices, each two
    slices by one task as products of matrices, whose pairs leave it block by
    block; so a task holds two slices, however large the group.  The work is
    that of all pairs of a group.  ``threshold`` is above 0.  Vectors are arrays
    of doubles without nulls, finite and not zero; those of different lengths
    have no pairs.
    """
    g, kind = vectors.schema["g"].dataType, vectors.schema["i"].dataType
    sized = vectors.withColumn("dim", F.size("v"))
    # At most a row for each ``slice_rows`` of all vectors.
    large = store(sized.groupBy("g", "dim").agg(F.count("*").alias("n")).where(F.col("n") > slice_rows).select("g", "dim", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices")))
    dealt = sized.join(F.broadcast(large), ["g", "dim"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    dealt = dealt.withColumn("s", F.pmod(F.xxhash64("i", "v"), F.col("slices")).cast("int"))
    # A task is (group, length, left slice, right slice); a slice meets itself and each other one.
    left = F.transform(F.sequence(F.col("s"), F.col("slices") - 1), lambda r: F.struct(F.col("s").alias("l"), r.alias("r"), F.lit(True).alias("is_left")))
    right = F.transform(F.filter(F.sequence(F.lit(0), F.col("s")), lambda x: x < F.col("s")), lambda x: F.struct(x.alias("l"), F.col("s").alias("r"), F.lit(False).alias("is_left")))
    sent = dealt.select("g", "dim", F.explode(F.concat(left, right)).alias("task"), "i", "v").select("g", "dim", "task.*", "i", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        first = {c: table[c][0] for c in ("g", "dim", "l", "r")}
        on_left = table["is_left"].to_numpy()
        same = first["l"] == first["r"]
        ids = table["i"].combine_chunks()
        v = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, first["dim"].as_py())
        a, b = np.nonzero(on_left)[0], np.nonzero(on_left if same else ~on_left)[0]
        size = np.linalg.norm(v, axis=1)
        unit = v / size[:, None]
        right = unit[b].T
        for start in range(0, len(a), BLOCK_ROWS):
            row, col = np.nonzero(unit[a[start : start + BLOCK_ROWS]] @ right >= threshold - 1e-9)
            row += start
            if same:
                row, col = row[row < col], col[row < col]
            row, col = a[row], b[col]
            for k in range(0, len(row), 1 << 17):
                # Once more one by one, so that a pair's value doesn't depend on the slices.
                x, y = row[k : k + (1 << 17)], col[k : k + (1 << 17)]
                value = np.clip(np.einsum("ij,ij->i", v[x], v[y]) / (size[x] * size[y]), 0, 1)
                x, y, value = x[value >= threshold], y[value >= threshold], value[value >= threshold]
                yield pa.RecordBatch.from_arrays([pa.repeat(first["g"], len(x)), ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(value)], names=["g", "x", "y", "similarity"])

    schema = T.StructType([T.StructField("g", g), T.StructField("x", kind), T.StructField("y", kind), T.StructField("similarity", T.DoubleType())])
    found = sent.groupBy("g", "dim", "l", "r").applyInArrow(compare, schema)
    return found.where("x <> y").select("g", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
