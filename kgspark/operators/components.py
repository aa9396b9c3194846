"""Connected components of an undirected graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def connected_components(edges: DataFrame, store: Callable[[DataFrame], DataFrame], src: str = "src", dst: str = "dst") -> DataFrame:
    """Smallest node reachable from each node that has an edge: node, component.

    Alternates two star steps: every node links its larger neighbours to its
    smallest neighbour, then its smaller ones to the smallest.  The number of
    rounds grows with the logarithm of the size, and no step gathers a node's
    neighbours into one row.  ``store`` writes an intermediate table and reads
    it back.  Null ends and self-loops are ignored.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    pairs = store(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    before = None
    while True:
        # Large star: larger neighbours move to the smallest of node and neighbours.
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # Small star: a node and its smaller neighbours move to the smallest one.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("m").alias("a"), "v", "u")
        small = small.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("v").alias("v")), F.struct(F.col("a").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        pairs = store(small.where("u <> v").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(pairs.select(F.col("u").alias("node"), F.col("u").alias("component"))).distinct()


#: Edges of a group that are joined by one task; larger groups are sliced.
SLICE_EDGES = 1 << 20


def grouped_components(edges: DataFrame, store: Callable[[DataFrame], DataFrame], group: str = "doc_id", src: str = "a", dst: str = "b", slice_edges: int = SLICE_EDGES) -> DataFrame:
    """``connected_components`` of edges that stay within groups: group, node, component.

    A group's edges meet in one task, which joins them by pointers to the
    smallest node.  A group of more than ``slice_edges`` is spread over several
    tasks; what each leaves of its slice, an edge per node, goes on to
    ``connected_components``.
    """
    pairs = edges.select(F.col(group).alias("g"), F.col(src).alias("u"), F.col(dst).alias("v")).where("g is not null and u is not null and v is not null and u <> v")
    sizes = pairs.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > slice_edges)
    # At most a row for each ``slice_edges`` of all edges.
    large = store(sizes.select("g", F.ceil(F.col("n") / slice_edges).cast("int").alias("slices")))
    slices = F.coalesce("slices", F.lit(1))
    dealt = pairs.join(F.broadcast(large), "g", "left").select("g", F.pmod(F.xxhash64("u", "v"), slices).cast("int").alias("slice"), "u", "v")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parent = None, {}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def told():
            for x in parent:
                held.append((at[0], x, root(x)))

        def made():
            rows = [pa.array(c, k) for c, k in zip(zip(*held, strict=True) if held else ((), (), ()), kinds, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays(rows, names=["g", "node", "component"])

        held: list[tuple] = []
        for batch in batches:
            kinds = (batch["g"].type, batch["u"].type, batch["u"].type)
            for g, part, u, v in zip(*(batch[c].to_pylist() for c in ("g", "slice", "u", "v")), strict=True):
                if (g, part) != at:
                    told()
                    at, parent = (g, part), {}
                a, b = root(parent.setdefault(u, u)), root(parent.setdefault(v, v))
                if a != b:
                    parent[max(a, b)] = min(a, b)
            yield made()
        if parent:
            told()
            yield made()

    kind = pairs.schema["u"].dataType
    schema = T.StructType([T.StructField("g", pairs.schema["g"].dataType), T.StructField("node", kind), T.StructField("component", kind)])
    joined = store(dealt.repartition("g", "slice").sortWithinPartitions("g", "slice").mapInArrow(join, schema))
    if large.isEmpty():
        return joined.withColumnRenamed("g", group)
    in_slices = joined.join(F.broadcast(large), "g", "left_semi")
    node = lambda c: F.struct("g", F.col(c).alias("x"))
    whole = connected_components(in_slices.select(node("node").alias("src"), node("component").alias("dst")), store)
    rest = joined.join(F.broadcast(large), "g", "left_anti")
    return rest.unionByName(whole.select("node.g", F.col("node.x").alias("node"), F.col("component.x").alias("component"))).withColumnRenamed("g", group)


def grown_components(named: DataFrame, edges: DataFrame, store: Callable[[DataFrame], DataFrame], src: str = "src", dst: str = "dst") -> DataFrame:
    """What added edges change in (node, component): rows of new nodes, and of nodes whose component is another now.

    ``named`` is the result for the edges so far.  Components are joined by the
    graph of components that the new edges make, so of ``named`` only the
    components that they touch are read into the result; put in place of the
    old rows, it gives what all edges together would.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    old = lambda end: named.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    ends = store(ends.distinct().join(old("u"), "u", "left").join(old("v"), "v", "left"))
    linked = ends.select(F.coalesce("of_u", "u").alias("u"), F.coalesce("of_v", "v").alias("v"))
    joined = store(connected_components(linked, store, "u", "v"))
    moved = named.join(joined.select(F.col("node").alias("component"), F.col("component").alias("now")), "component").where("component <> now").select("node", F.col("now").alias("component"))
    # A new node in an old component is linked to it, so it has a row of its own name.
    fresh = ends.select(F.explode(F.filter(F.array(F.struct(F.col("u").alias("node"), F.col("of_u").alias("was")), F.struct(F.col("v").alias("node"), F.col("of_v").alias("was"))), lambda e: e["was"].isNull())).alias("e")).select("e.node").distinct()
    return moved.unionByName(fresh.join(joined, "node").select("node", "component"))


#: Steps along arcs that are planned as one job, before its result is written.
STEPS = 3


def _spread(start: DataFrame, arcs: DataFrame, store: Callable[[DataFrame], DataFrame], value: str, best: Callable, along: Callable) -> DataFrame:
    """Values of nodes (node, value) carried along arcs (u, v) until none gets a better one.

    A node keeps ``best`` of its own value and ``along`` of those of the nodes
    before it.  A node's values are combined before they are shuffled.
    """
    state = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node", value).cast("decimal(38,0)")).alias("sum")]
    table, before = stored_with(start, store, *state)
    while True:
        for _ in range(STEPS):
            moved = arcs.join(table.withColumnRenamed("node", "u"), "u").select(F.col("v").alias("node"), along(F.col(value)).alias(value))
            table = table.unionByName(moved).groupBy("node").agg(best(value).alias(value))
        table, now = stored_with(table, store, *state)
        if now == before:
            return table
        before = now


def stored_with(df: DataFrame, store: Callable[[DataFrame], DataFrame], *what: Column) -> tuple[DataFrame, dict]:
    """A stored table, and aggregates of it."""
    out = store(df)
    return out, out.agg(*what).first().asDict()


def strong_components(arcs: DataFrame, store: Callable[[DataFrame], DataFrame], src: str = "src", dst: str = "dst") -> DataFrame:
    """Nodes on cycles with the component they are strongly connected to: node, component.

    Components are named by a node of theirs; nodes on no cycle, or only on one
    of their own, have no row.  Arcs that can't be on a cycle are trimmed.  Then
    every node takes the least name that reaches it as its colour, and what
    reaches the node of that name against the arcs, within the colour, is its
    component.  These go, and the rest is coloured anew.  No pairs of reaching
    and reached nodes are made.  Null ends and self-loops are ignored.
    """
    size = F.count(F.lit(1)).alias("n")
    live, seen = stored_with(arcs.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v").distinct(), store, size)
    out = None
    while True:
        n = seen["n"]
        while n:  # arcs from a node that none goes to, or to one that none leaves
            slim = live
            for _ in range(STEPS):
                slim = slim.join(slim.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(slim.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
            live, seen = stored_with(slim.select("u", "v"), store, size)
            n, was = seen["n"], n
            if n == was:
                break
        if not n:
            break
        nodes = live.select(F.col("u").alias("node")).distinct()  # after trimming all nodes have an arc that leaves
        colours = _spread(nodes.withColumn("colour", F.col("node")), live, store, "colour", F.min, lambda c: c)
        end = lambda e: colours.select(F.col("node").alias(e), F.col("colour").alias(f"colour_{e}"))
        inner = store(live.join(end("u"), "u").join(end("v"), "v").where("colour_u = colour_v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        back = _spread(colours.where("node = colour"), inner, store, "colour", F.min, lambda c: c)
        # A root on no cycle is alone.
        several = back.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1").select("colour")
        found = back.join(several, "colour", "left_semi").select("node", F.col("colour").alias("component"))
        out = found if out is None else out.unionByName(found)
        gone = back.select("node")
        live, seen = stored_with(live.join(gone.withColumnRenamed("node", "u"), "u", "left_anti").join(gone.withColumnRenamed("node", "v"), "v", "left_anti"), store, size)
    if out is None:
        return live.select(F.col("u").alias("node"), F.col("v").alias("component"))  # no rows
    return store(out)


def topological_levels(arcs: DataFrame, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Arcs on the longest path to each node of an acyclic graph (u, v): node, level."""
    nodes = arcs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return _spread(nodes.withColumn("level", F.lit(0)), arcs, store, "level", F.max, lambda c: c + 1)
