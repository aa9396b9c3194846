"""Queries over a loaded concept graph.

``load_graph`` gives arcs (src, dst, relation, dep_kind, ord) and the known
concepts are (name, confidence, ord).
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions import vocabulary as V
from kgspark.operators.components import stored_with, strong_components, topological_levels

Store = Callable[[DataFrame], DataFrame]


def load_graph(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends known; dependencies and others told apart."""
    return arcs_of(edges.join(concepts.select(F.col("name").alias("src")), "src", "left_semi").join(concepts.select(F.col("name").alias("dst")), "dst", "left_semi"))


def arcs_of(edges: DataFrame) -> DataFrame:
    """``load_graph`` of edges whose ends are known to be concepts."""
    kind = F.when(F.col("relation").isin(*V.DEPENDENCY_RELATIONS), "dependency").otherwise("related")
    return edges.select("src", "dst", "relation", "ord", kind.alias("dep_kind"))


def relationships(graph: DataFrame) -> DataFrame:
    """Every relation recorded both ways: concept, other, relation."""
    return graph.select(F.col("src").alias("concept"), F.col("dst").alias("other"), "relation").unionAll(graph.select(F.col("dst").alias("concept"), F.col("src").alias("other"), "relation"))


def dependencies(graph: DataFrame, starts: DataFrame, store: Store, max_depth: int = 2) -> DataFrame:
    """What each start needs: start, concept, distance (at most max_depth + 1).

    Includes the start itself if it lies on a cycle.
    """
    steps = graph.where("dep_kind = 'dependency'").select("src", "dst").distinct()
    frontier = starts.select(F.col("name").alias("start"), F.col("name").alias("at"))
    found = None
    for hop in range(1, max_depth + 2):
        ahead = frontier.join(steps, F.col("at") == F.col("src")).select("start", F.col("dst").alias("concept")).distinct()
        if found is not None:
            ahead = ahead.join(found.select("start", "concept"), ["start", "concept"], "left_anti")
        ahead = store(ahead.withColumn("distance", F.lit(hop)))
        found = ahead if found is None else found.unionByName(ahead)
        if ahead.isEmpty():
            break
        frontier = ahead.select("start", F.col("concept").alias("at"))
    return found


def dependencies_within(graph: DataFrame, starts: DataFrame, graph_of: Callable[[str], Column], store: Store, max_depth: int = 2, without: DataFrame | None = None, walked_arcs: int | None = None) -> DataFrame:
    """``dependencies`` for many graphs that no arc joins: start, concept, distance.

    ``graph_of`` gives the graph of a named column; both ends of an arc are in one.
    Concepts of ``without`` are walked through and not listed.  A graph and its
    starts meet in one task, which walks from each; graphs of more than
    ``walked_arcs`` dependencies go hop by hop, spread over tasks.
    """
    arcs = graph.where("dep_kind = 'dependency' and src is not null and dst is not null").select(graph_of("src").alias("g"), "src", "dst")
    large = store(arcs.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > (walked_arcs or WALKED_ARCS)).select("g"))
    named = lambda df, role: df.where("name is not null").select(graph_of("name").alias("g"), F.col("name").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(role).alias("role"))
    rows = arcs.withColumn("role", F.lit("arc")).unionByName(named(starts, "start"))
    if without is not None:
        rows = rows.unionByName(named(without, "without"))
    most = max_depth + 1

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ahead, from_, hidden = None, {}, set(), set()

        def found() -> Iterator[tuple[str, str, int]]:
            for start in from_:
                seen, edge = set(), [start]
                for hop in range(1, most + 1):
                    edge = {to for name in edge for to in ahead.get(name, ())} - seen
                    if not edge:
                        break
                    seen |= edge
                    for concept in edge:
                        if concept not in hidden:
                            yield start, concept, hop

        def made() -> Iterator[pa.RecordBatch]:
            told = found()
            while held := list(itertools.islice(told, 50_000)):
                start, concept, hop = zip(*held, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(start, pa.string()), pa.array(concept, pa.string()), pa.array(hop, pa.int32())], names=["start", "concept", "distance"])

        for batch in batches:
            for g, src, dst, role in zip(*(batch[c].to_pylist() for c in ("g", "src", "dst", "role")), strict=True):
                if g != at:
                    yield from made()
                    at, ahead, from_, hidden = g, {}, set(), set()
                if role == "arc":
                    ahead.setdefault(src, set()).add(dst)
                else:
                    (from_ if role == "start" else hidden).add(src)
        yield from made()

    few = rows.join(F.broadcast(large), "g", "left_anti")  # at most a row for each ``walked_arcs`` arcs
    walked = few.repartition("g").sortWithinPartitions("g").mapInArrow(walk, "start string, concept string, distance int")
    if large.isEmpty():
        return walked
    own = lambda df, c: df.join(F.broadcast(large.select(F.col("g").alias("__g"))), graph_of(c) == F.col("__g"), "left_semi")
    rest = dependencies(own(graph.where("src is not null and dst is not null"), "src"), own(starts, "name"), store, max_depth)
    if without is not None:
        rest = rest.join(without.select(F.col("name").alias("concept")), "concept", "left_anti")
    return walked.unionByName(rest.select("start", "concept", "distance"))


def dependents(graph: DataFrame) -> DataFrame:
    """Direct dependents: concept, dependent."""
    return graph.where("dep_kind = 'dependency'").select(F.col("dst").alias("concept"), F.col("src").alias("dependent"))


def related_unexplored(graph: DataFrame, starts: DataFrame, explored: DataFrame) -> DataFrame:
    """Related concepts not explored yet, once per edge: start, concept, ord."""
    rows = graph.where("dep_kind = 'related'").join(starts.select(F.col("name").alias("src")), "src", "left_semi")
    return rows.join(explored.select(F.col("name").alias("dst")), "dst", "left_anti").select(F.col("src").alias("start"), F.col("dst").alias("concept"), "ord")


def prerequisite_chain(graph: DataFrame, starts: DataFrame, store: Store) -> DataFrame:
    """All prerequisites of each start, what they need before them: start, concept, place.

    The order is that of a walk over dependencies in their order (``ord``, then
    name): a concept is listed when the walk comes back from it, or at once
    where the walk has been at it before, as on cycles.  Cycles end, and no depth
    is cut.  What is reachable is found for all starts together; a start's walk
    is one task over the dependencies that it reaches.  ``prerequisite_order``
    has no such task; it is the one for large graphs.
    """
    needs = graph.where("dep_kind = 'dependency'")
    order = F.min("ord") if "ord" in graph.columns else F.lit(0)
    steps = store(needs.groupBy("src", "dst").agg(order.cast("long").alias("ord")))
    frontier = reached = store(starts.select(F.col("name").alias("start"), F.col("name").alias("at")).distinct())
    while True:
        ahead = frontier.join(steps, F.col("at") == F.col("src")).select("start", F.col("dst").alias("at")).distinct()
        frontier = store(ahead.join(reached, ["start", "at"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = store(reached.unionByName(frontier))
    arcs = reached.join(steps, F.col("at") == F.col("src")).select("start", "src", "dst", "ord")

    def walk(arcs: pd.DataFrame) -> pd.DataFrame:
        start = arcs["start"].iloc[0]
        ahead: dict = {}
        for src, dst in arcs.sort_values(["ord", "dst"])[["src", "dst"]].itertuples(index=False):
            ahead.setdefault(src, []).append(dst)
        chain, seen, way = {}, {start}, [(start, iter(ahead.get(start, ())))]
        while way:
            at, rest = way[-1]
            step = next(rest, None)
            if step is None:
                way.pop()
                if way:
                    chain.setdefault(at)
            elif step in seen:
                chain.setdefault(step)
            else:
                seen.add(step)
                way.append((step, iter(ahead.get(step, ()))))
        return pd.DataFrame({"start": start, "concept": list(chain), "place": range(1, len(chain) + 1)})

    kind = graph.schema["src"].dataType.simpleString()
    return arcs.groupBy("start").applyInPandas(walk, f"start {kind}, concept {kind}, place int")


def prerequisite_order(graph: DataFrame, starts: DataFrame, store: Store) -> DataFrame:
    """``prerequisite_chain`` without a walk, for graphs of any size: start, concept, place.

    Without cycles the order is the same: that of a walk in depth over
    dependencies in their order (``ord``, then name), which lists a concept when
    it comes back from it.  A cycle counts as one concept with the dependencies of its members; its members
    stand together, in order of their names.  A start is listed only if it lies
    on a cycle, and then as the last one.

    Cycles are contracted first.  In the acyclic rest the walk comes to a
    concept by the least way there, ways being compared step by step; so the
    ways of all starts are found level by level, each by the least of those to
    the level before it, and their order, longer ways before their beginnings,
    is that of the walk.  Only what the starts reach is held, and an arc is
    followed once for each of them.  A row is as wide as its way is long.
    """
    needs = graph.where("dep_kind = 'dependency'")
    order = F.min("ord") if "ord" in graph.columns else F.lit(0)
    steps = store(needs.groupBy("src", "dst").agg(order.cast("long").alias("ord")))
    cycles = strong_components(steps, store)
    unit = lambda name: cycles.select(F.col("node").alias(name), F.col("component").alias(f"{name}_unit"))
    in_units = lambda df, *names: functools.reduce(lambda d, n: d.join(unit(n), n, "left").withColumn(f"{n}_unit", F.coalesce(f"{n}_unit", n)), names, df)
    joined = in_units(steps, "src", "dst").where("src_unit <> dst_unit")
    arcs = store(joined.groupBy(F.col("src_unit").alias("u"), F.col("dst_unit").alias("v")).agg(F.min(F.struct("ord", F.col("dst").alias("name"))).alias("step")))
    levels = topological_levels(arcs, store)
    arcs = store(arcs.join(levels.select(F.col("node").alias("v"), "level"), "v"))

    begun = in_units(starts.select(F.col("name").alias("start")).distinct(), "start").withColumnRenamed("start_unit", "unit")
    step = arcs.schema["step"].dataType.simpleString()
    rows = begun.join(levels.select(F.col("node").alias("unit"), "level"), "unit", "left")
    next_level = F.min("level").alias("next")
    rows, seen = stored_with(rows.select("start", "unit", F.coalesce("level", F.lit(0)).alias("level"), F.array().cast(f"array<{step}>").alias("way")), store, next_level)
    reached = None
    while (level := seen["next"]) is not None:
        now = rows.where(F.col("level") == level)
        reached = now if reached is None else reached.unionByName(now)
        ahead = now.drop("level").join(arcs, F.col("unit") == F.col("u")).select("start", F.col("v").alias("unit"), "level", F.array_append("way", F.col("step")).alias("way"))
        open_ = rows.where(F.col("level") > level).unionByName(ahead).groupBy("start", "unit", "level").agg(F.min("way").alias("way"))
        rows, seen = stored_with(open_, store, next_level)
    if reached is None:
        reached = rows
    members = cycles.select("node", F.col("component").alias("unit"))
    own = steps.where("src = dst").select(F.col("src").alias("concept"), F.lit(True).alias("loop"))
    listed = reached.join(members, "unit", "left").withColumn("concept", F.coalesce("node", "unit")).join(own, "concept", "left")
    listed = listed.where("concept <> start or node is not null or loop")
    # What comes after a way ends sorts behind all that goes on from there.
    last = F.array(F.struct(F.lit(2**63 - 1).alias("ord"), F.lit(None).cast(graph.schema["dst"].dataType).alias("name")))
    place = F.row_number().over(W.partitionBy("start").orderBy(F.concat("way", last), F.col("concept") == F.col("start"), "concept"))
    return listed.select("start", "concept", place.alias("place"))


#: Arcs of a graph that one task walks over; larger graphs go level by level.
WALKED_ARCS = 1 << 20


def _walker() -> Callable[[dict[tuple[str, str], tuple], list[str]], Iterator[tuple[str, str, int]]]:
    """The walk over one graph, as a function that tasks get by value."""

    def components_of(arcs: dict[str, list[str]]) -> dict[str, str]:
        """The least member of each node's strong component, by Tarjan's walk without recursion."""
        number: dict[str, int] = {}
        low: dict[str, int] = {}
        unit: dict[str, str] = {}
        stack: list[str] = []
        for root in arcs:
            if root in number:
                continue
            path = [(root, iter(arcs[root]))]
            number[root] = low[root] = len(number)
            stack.append(root)
            while path:
                at, ahead = path[-1]
                for to in ahead:
                    if to not in number:
                        number[to] = low[to] = len(number)
                        stack.append(to)
                        path.append((to, iter(arcs.get(to, ()))))
                        break
                    if to not in unit:
                        low[at] = min(low[at], number[to])
                else:
                    path.pop()
                    if path:
                        low[path[-1][0]] = min(low[path[-1][0]], low[at])
                    if low[at] == number[at]:
                        members = [stack.pop()]
                        while members[-1] != at:
                            members.append(stack.pop())
                        unit.update(dict.fromkeys(members, min(members)))
        return unit

    def walk(steps: dict[tuple[str, str], tuple], starts: list[str]) -> Iterator[tuple[str, str, int]]:
        """Start, concept and place of one graph, as ``prerequisite_order`` has them."""
        arcs: dict[str, list[str]] = {}
        for u, v in steps:
            arcs.setdefault(u, []).append(v)
        unit = components_of(arcs)
        members: dict[str, list[str]] = {}
        for name, of in unit.items():
            members.setdefault(of, []).append(name)
        between: dict[str, dict[str, tuple]] = {}
        for (u, v), order in steps.items():
            a, b = unit[u], unit[v]
            if a != b:
                own, step = between.setdefault(a, {}), (order, v)
                own[b] = min(own.get(b, step), step)
        ahead_of = {a: sorted(own, key=own.__getitem__) for a, own in between.items()}
        for start in starts:
            if start not in unit:
                continue
            met, place = {unit[start]}, 0
            path = [(unit[start], iter(ahead_of.get(unit[start], ())))]
            while path:
                at, ahead = path[-1]
                to = next((b for b in ahead if b not in met), None)
                if to is not None:
                    met.add(to)
                    path.append((to, iter(ahead_of.get(to, ()))))
                    continue
                path.pop()
                for concept in sorted(members[at], key=lambda c: (c == start, c)):
                    if concept != start or len(members[at]) > 1 or (start, start) in steps:
                        place += 1
                        yield start, concept, place

    return walk


def prerequisite_order_within(graph: DataFrame, starts: DataFrame, graph_of: Callable[[str], Column], store: Store, walked_arcs: int = WALKED_ARCS) -> DataFrame:
    """``prerequisite_order`` for many graphs that no arc joins: start, concept, place.

    ``graph_of`` gives the graph of a named column; both ends of an arc are in one.
    A graph and its starts meet in one task, which walks over it; graphs of
    more than ``walked_arcs`` dependencies go level by level, spread over tasks.
    """
    needs = graph.where("dep_kind = 'dependency' and src is not null and dst is not null")
    order = F.col("ord").cast("long") if "ord" in graph.columns else F.lit(0).cast("long")
    arcs = needs.select(graph_of("src").alias("g"), "src", "dst", order.alias("ord"))
    begun = starts.where("name is not null").select(graph_of("name").alias("g"), F.col("name").alias("src")).distinct()
    walk_one = _walker()
    large = store(arcs.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > walked_arcs).select("g"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, steps, from_ = None, {}, []
        kind, held = pa.string(), []

        def made():
            columns = list(zip(*held, strict=True)) if held else [(), (), ()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], kind), pa.array(columns[2], pa.int32())], names=["start", "concept", "place"])

        for batch in batches:
            for g, src, dst, step in zip(*(batch[c].to_pylist() for c in ("g", "src", "dst", "ord")), strict=True):
                if g != at:
                    held.extend(walk_one(steps, from_))
                    at, steps, from_ = g, {}, []
                if dst is None:
                    from_.append(src)
                else:
                    key = (-1, 0) if step is None else (0, step)  # nulls come first
                    own = steps.get((src, dst))
                    # The least number counts, and null only if there is no other.
                    if own is None or own == (-1, 0) or (step is not None and key < own):
                        steps[src, dst] = key
            yield made()
        held.extend(walk_one(steps, from_))
        if held:
            yield made()

    few = lambda df: df.join(F.broadcast(large), "g", "left_anti")
    rows = few(arcs).unionByName(few(begun).withColumns({"dst": F.lit(None).cast("string"), "ord": F.lit(None).cast("long")}))
    walked = rows.repartition("g").sortWithinPartitions("g").mapInArrow(walk, "start string, concept string, place int")
    if large.isEmpty():
        return walked
    own = lambda df, c: df.join(F.broadcast(large.select(F.col("g").alias("__g"))), graph_of(c) == F.col("__g"), "left_semi")
    return walked.unionByName(prerequisite_order(own(graph, "src"), own(starts, "name"), store))


def knowledge_gaps(graph: DataFrame, starts: DataFrame, explored: DataFrame, store: Store, true_depth: bool = False, most: int = 5, graph_of: Callable[[str], Column] | None = None) -> DataFrame:
    """Unexplored dependencies by relevance: start, concept, relevance.

    1/2 for direct ones, 1/3 for those behind them; further ones count 1/2
    again, or one over their distance and one with ``true_depth``.  With
    ``graph_of`` the graph is many that no arc joins: ``dependencies_within``.
    """
    if graph_of is None:
        found = dependencies(graph, starts, store, 3).join(explored.select(F.col("name").alias("concept")), "concept", "left_anti")
    else:
        found = dependencies_within(graph, starts, graph_of, store, 3, explored)
    far = 1.0 / (F.col("distance") + 1) if true_depth else F.lit(0.5)
    rows = found.withColumn("relevance", F.when(F.col("distance") == 1, 0.5).when(F.col("distance") == 2, 1.0 / 3).otherwise(far))
    k = F.row_number().over(W.partitionBy("start").orderBy(F.desc("relevance"), "distance", "concept"))
    return rows.withColumn("k", k).where(F.col("k") <= most).select("start", "concept", "relevance")


def suggest_next(concepts: DataFrame, graph: DataFrame, starts: DataFrame, explored: DataFrame, most: int = 3) -> DataFrame:
    """Related unexplored concepts, gateways first: start, concept, is_gateway, score, needed_by, place.

    A gateway is what another concept of the same set depends on.
    """
    near = related_unexplored(graph, starts, explored).groupBy("start", "concept").agg(F.min("ord").alias("first"))
    needs = graph.where("dep_kind = 'dependency' and src <> dst").select(F.col("src").alias("other"), F.col("dst").alias("concept")).distinct()
    others = near.select("start", F.col("concept").alias("other"), F.col("first").alias("other_first"))
    open_ = near.join(needs, "concept").join(others, ["start", "other"]).groupBy("start", "concept").agg(F.sort_array(F.collect_list(F.struct("other_first", "other"))).alias("by"))
    rows = near.join(open_, ["start", "concept"], "left").join(concepts.select(F.col("name").alias("concept"), F.col("confidence").alias("score")), "concept")
    rows = rows.withColumn("is_gateway", F.col("by").isNotNull()).withColumn("needed_by", F.array_join(F.transform(F.slice(F.coalesce("by", F.array().cast("array<struct<other_first:int,other:string>>")), 1, 2), lambda x: x["other"]), ", "))
    place = F.row_number().over(W.partitionBy("start").orderBy(F.desc("is_gateway"), F.desc("score"), "first", "concept"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("start", "concept", "is_gateway", "score", "needed_by", "place")


def unexplored_ranking(concepts: DataFrame, graph: DataFrame, explored: DataFrame, store: Store, first: int = 10, shown: int = 4) -> DataFrame:
    """Of the first unexplored concepts, those that depend on something come first."""
    some = concepts.join(explored.select("name"), "name", "left_anti").orderBy("ord", "name").limit(first)
    some = store(some.select("name", "ord"))
    needs = dependencies(graph, some, store, 1).select(F.col("start").alias("name")).distinct().withColumn("has", F.lit(True))
    rows = some.join(needs, "name", "left").select(F.col("name").alias("concept"), "ord", F.coalesce("has", F.lit(False)).alias("has_dependencies"))
    rows = rows.withColumn("relevance", F.when(F.col("has_dependencies"), 1.0).otherwise(0.5))
    place = F.row_number().over(W.orderBy(F.desc("has_dependencies"), "ord", "concept"))  # at most ``first`` rows
    return rows.withColumn("place", place).where(F.col("place") <= shown).select("concept", "has_dependencies", "relevance", "place")


def question_suggestions(concepts: DataFrame, explored: DataFrame, first: int = 10, most: int = 2) -> DataFrame:
    """The first unexplored of the first concepts."""
    some = concepts.orderBy("ord", "name").limit(first)
    return some.join(explored.select("name"), "name", "left_anti").orderBy("ord", "name").limit(most).select(F.col("name").alias("concept"))


def valid_suggestions(suggestions: DataFrame, concepts: DataFrame, explored: DataFrame) -> DataFrame:
    """Suggestions of known, unexplored concepts with a positive relevance."""
    known = suggestions.join(concepts.select(F.col("name").alias("concept")), "concept", "left_semi")
    return known.join(explored.select(F.col("name").alias("concept")), "concept", "left_anti").where("relevance > 0")


def concept_info(concepts: DataFrame, names: DataFrame) -> DataFrame:
    return concepts.join(names, "name", "left_semi")


def export_graph(concepts: DataFrame, graph: DataFrame, dedupe: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and both-way edges of weight 0.5 for a viewer."""
    edges = relationships(graph).select(F.col("concept").alias("source"), F.col("other").alias("target"), "relation", F.lit(0.5).alias("weight"))
    nodes = concepts.select(F.col("name").alias("id"), F.col("name").alias("label"), F.lit("core_concept").alias("type"), F.col("confidence").alias("importance"))
    return nodes, edges.distinct() if dedupe else edges


def claim_verdicts(hits: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per claim: supported if any hit scores above the threshold; its first three sources.

    ``hits`` is (claim, rank, url, score).
    """
    good = F.max("score") > threshold
    listed = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("rank", "url"))), 1, 3), lambda x: x["url"])
    return hits.groupBy("claim").agg(F.when(good, "SUPPORTED").otherwise("UNVERIFIED").alias("verdict"), F.when(good, 0.7).otherwise(0.4).alias("confidence"), F.array_join(listed, ",").alias("sources"))


def search_projection(results: DataFrame) -> DataFrame:
    """Hits with the first 200 characters of their content."""
    return results.withColumn("content", F.left("content", F.lit(200)))


def neighbours(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """One-hop neighbours of the selected nodes, direction ignored: node, neighbour."""
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour")).unionAll(edges.select(F.col("target").alias("node"), F.col("source").alias("neighbour")))
    return both.join(selected.select("node"), "node", "left_semi").distinct()


def node_panel(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges at the selected nodes: node, direction, other, relation, weight."""
    side = lambda own, other, name: edges.join(selected.select(F.col("node").alias(own)), own, "left_semi").select(F.col(own).alias("node"), F.lit(name).alias("direction"), F.col(other).alias("other"), "relation", "weight")
    return side("source", "target", "outgoing").unionByName(side("target", "source", "incoming"))


def viewer_defaults(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with the viewer's defaults; 0 counts as missing."""
    given = lambda c, d: F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), F.lit(d)).alias(c)
    n = nodes.select("doc_id", "id", "label", F.coalesce("type", F.lit("unknown")).alias("type"), given("importance", 0.5))
    return n, edges.select("doc_id", "source", "target", F.coalesce("relation", F.lit("ASSOCIATED_WITH")).alias("relation"), given("weight", 0.5))
