"""Blocks, graphs and components against sequential restatements."""

import random
import re
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from kgspark.functions import text as T
from kgspark.functions import vocabulary as V
from kgspark.operators import blocks as B
from kgspark.operators import metrics as M
from kgspark.operators import normalize as N
from kgspark.operators import pages as P
from kgspark.operators import reason as H
from kgspark.operators import refine as G
from kgspark.operators import relations as R
from kgspark.operators.components import connected_components, grouped_components, grown_components, strong_components
from kgspark.operators.pivots import pairs_in_groups, pairs_within
from kgspark.plans import inputs as I
from kgspark.sources.tables import store


def test_heading_path(spark):
    given = [(1, 0, "heading", "h1", "Machine Learning"), (1, 1, "heading", "h2", "Regularization"), (1, 2, "heading", "h3", "L2"), (1, 3, "paragraph", "p", "text"), (2, 0, "paragraph", "p", "before"), (2, 1, "heading", "h2", "A")]
    rows = B.sections(spark.createDataFrame(given, "doc_id long, position int, type string, tag string, text string")).collect()
    paths = {(r.doc_id, r.order_index): r.heading_path for r in rows}
    assert paths == {(1, 1): ["Machine Learning"], (1, 2): ["Machine Learning", "Regularization"], (1, 3): ["Machine Learning", "Regularization", "L2"], (2, 1): ["Introduction"], (2, 2): ["Introduction", "A"]}


def test_sections_are_a_stack(spark):
    rng, given, want = random.Random(1), [], {}
    for doc in range(60):
        open_, n = [], 0
        for pos in range(rng.randint(1, 14)):
            if rng.random() < 0.6:
                level = rng.randint(1, 6)
                n += 1
                given.append((doc, pos, "heading", f"h{level}", f"t{pos}"))
                while open_ and open_[-1][0] >= level:
                    open_.pop()
                want[doc, n] = [*[t for _, t in open_], f"t{pos}"]
                open_.append((level, f"t{pos}"))
            else:
                given.append((doc, pos, "paragraph", "p", "x"))
                if not n:
                    n = 1
                    want[doc, 1] = ["Introduction"]
                    open_ = [(1, "Introduction")]
    rows = B.sections(spark.createDataFrame(given, "doc_id long, position int, type string, tag string, text string")).collect()
    assert {(r.doc_id, r.order_index): r.heading_path for r in rows} == want


def test_chunks_follow_the_sentences(spark):
    rng, given, want = random.Random(2), [], {}
    for pos in range(80):
        sentences = [("However this holds" if rng.random() < 0.25 else "A plain sentence of words") + f" {k}." for k in range(rng.randint(1, 17))]
        text = " ".join(sentences)
        given.append((1, pos, "paragraph", "p", text))
        chunks, now = [], []
        for s in sentences:
            now.append(s)
            if any(p in s.lower() for p in V.TRANSITIONS) or len(now) >= 5:
                chunks.append(" ".join(now))
                now = []
        want[pos] = [text] if len(text) < 100 or len(sentences) <= 2 else chunks + ([" ".join(now)] if now else [])
    got = defaultdict(list)
    for r in B.semantic_chunks(spark.createDataFrame(given, "doc_id long, position int, type string, tag string, text string")).orderBy("position", "chunk").collect():
        got[r.position].append(r.text)
    assert got == want


def test_page_blocks(spark):
    html = """<html><head><title>T &amp; t</title><script>var x="</p>";</script></head><body><nav><p>menu</p></nav><!-- <p>no</p> -->
    <div class="wide"><article><h1>Head</h1><p>One <b>two<p>Three<ul><li>a<ul><li>b</li></ul></li></ul><pre><code>c</code></pre><p class="shared">gone</p><p> </p><a href="../x?y#z">to  x</a></article></div><p>after</p></body></html>"""
    pages = spark.createDataFrame([(1, "http://h.org/a/b", html), (2, "http://h.org", "<p>bare</p>"), (3, "u", ""), (4, "u", None)], "page_id long, url string, html string")
    got = [tuple(r) for r in P.content_blocks(pages).orderBy("page_id", "position").collect()]
    assert got == [(1, 0, "heading", "h1", "Head"), (1, 1, "paragraph", "p", "One two"), (1, 2, "paragraph", "p", "Three"), (1, 3, "list", "ul", "a b"), (1, 4, "list", "ul", "b"), (1, 5, "code", "pre", "c"), (1, 6, "code", "code", "c"), (2, 0, "paragraph", "p", "bare")]
    assert [r.title for r in P.page_titles(pages).orderBy("page_id").collect()] == ["T & t", "Untitled", "Untitled", "Untitled"]
    assert [tuple(r)[2:] for r in P.links(pages).collect()] == [("http://h.org/x?y", "to x", True)]


def test_density(spark):
    html = f"<body><div><p>{'w ' * 400}</p><p>x</p></div><section>{'v ' * 300}<i>i</i></section></body>"
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    assert P.densest(P.elements(P.tokens(pages))).first().density == 600.0


def test_conflict(spark):
    kind = "doc_id int, id string, source int, target int, relation_type string, confidence double, ord int, evidence_blocks array<string>"
    rows = [(0, "a", 1, 2, "CAUSES", 0.6, 1, ["e"]), (0, "b", 1, 2, "CONTRASTS_WITH", 0.9, 2, ["e"]), (0, "c", 1, 2, "USES", 0.9, 3, ["e"]), (0, "d", 2, 1, "CONTRASTS_WITH", 0.9, 4, ["e"]), (0, "f", 2, 1, "USES", 0.9, 5, ["e"])]
    assert {r.id for r in G.resolve_conflicts(spark.createDataFrame(rows, kind)).collect()} == {"a", "d", "f"}


def brandes(n, arcs):
    out, value = defaultdict(set), dict.fromkeys(range(n), 0.0)
    for u, v in arcs:
        out[u].add(v)
    for s in range(n):
        sigma, dist, order, before = Counter({s: 1}), {s: 0}, [], defaultdict(list)
        todo = deque([s])
        while todo:
            u = todo.popleft()
            order.append(u)
            for v in out[u]:
                if v not in dist:
                    dist[v] = dist[u] + 1
                    todo.append(v)
                if dist[v] == dist[u] + 1:
                    sigma[v] += sigma[u]
                    before[v].append(u)
        delta = Counter()
        for v in reversed(order):
            for u in before[v]:
                delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
            if v != s:
                value[v] += delta[v]
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v, x in value.items()}


@pytest.mark.parametrize("arcs", [[(0, 1), (1, 2)], [(0, 1), (1, 2), (2, 0)], [(0, k) for k in range(1, 5)] + [(k, 0) for k in range(1, 5)], [(0, 1), (2, 3), (3, 2), (1, 3), (0, 2), (4, 4)]])
def test_betweenness(spark, arcs):
    n = 6
    nodes = spark.createDataFrame([(7, k) for k in range(n)], "doc_id int, id int")
    simple = spark.createDataFrame([(7, *a) for a in arcs], "doc_id int, u int, v int")
    got = {r.id: r.betweenness_centrality for r in M.betweenness(nodes, simple, store).collect()}
    assert got == pytest.approx(brandes(n, [a for a in arcs if a[0] != a[1]]))


def test_path_and_triangle(spark):
    nodes = spark.createDataFrame([(1, x) for x in "abc"], "doc_id int, id string")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c")], "doc_id int, source string, target string")
    degree = {r.id: r.degree_centrality for r in M.degree_centrality(nodes, M.arcs(edges)).collect()}
    assert degree == {"a": 0.5, "b": 1.0, "c": 0.5}
    whole = M.graph_metrics(nodes, edges, store).first()
    assert (whole.density, whole.num_components) == (pytest.approx(2 / 6), 1)
    closed = edges.unionByName(spark.createDataFrame([(1, "c", "a")], "doc_id int, source string, target string"))
    assert {r.clustering_coefficient for r in M.clustering(nodes, M.arcs(closed)).collect()} == {1.0}


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(30)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src int, dst int"), store).collect()}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "src int, dst int"), store).collect() == []


@pytest.mark.parametrize("seed", (1, 2))
def test_components_grow(spark, seed):
    """As if all edges had been there from the start; other components have no rows."""
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(30)] + [(100, 101), (None, 3), (4, 4)]
    more = [(rng.randrange(90), rng.randrange(90)) for _ in range((1, 8, 25)[seed])] + [(200, 201), (5, None), (6, 6)]
    frame = lambda e: spark.createDataFrame(e, "src int, dst int")
    before = store(connected_components(frame(edges), store))
    changed = grown_components(before, frame(more), store).collect()
    named = {r.node: r.component for r in before.collect()}
    assert len({r.node for r in changed}) == len(changed) and all(named.get(r.node) != r.component for r in changed)
    named |= {r.node: r.component for r in changed}
    assert named == {r.node: r.component for r in connected_components(frame(edges + more), store).collect()}


def test_pairs_of_a_block(spark):
    rows = spark.createDataFrame([(1, "b", c) for c in "ABC"], "doc_id int, block_id string, concept_id string")
    assert {tuple(r)[2:] for r in R.candidate_pairs(rows).collect()} == {("A", "B"), ("A", "C"), ("B", "C")}


def walked(arcs, start):
    """Dependencies of a concept as a recursive walk lists them."""
    ahead, chain, seen = defaultdict(list), [], set()
    for a, b in arcs:
        ahead[a].append(b)

    def go(at):
        if at in seen:
            return
        seen.add(at)
        for step in ahead[at]:
            go(step)
            if step not in chain:
                chain.append(step)

    go(start)
    return chain


@pytest.mark.parametrize("seed", range(4))
def test_chain_puts_dependencies_first(spark, seed):
    """Also over more than fifty steps, on cycles and for self-loops."""
    rng = random.Random(seed)
    arcs = [(f"n{k}", f"n{k + 1}") for k in range(60)] if not seed else [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(25)]
    arcs = list(dict.fromkeys(arcs))
    graph = spark.createDataFrame([(a, b, "dependency", k) for k, (a, b) in enumerate(arcs)] + [("n0", "other", "related", 99)], "src string, dst string, dep_kind string, ord int")
    starts = sorted({a for a, _ in arcs})[:6] + ["alone"]
    got = defaultdict(list)
    for r in H.prerequisite_chain(graph, spark.createDataFrame([(x,) for x in starts], "name string"), store).orderBy("start", "place").collect():
        got[r.start].append(r.concept)
    assert got == {x: walked(arcs, x) for x in starts if walked(arcs, x)}
    assert seed or len(got["n0"]) == 60


def test_merged_edges_do_not_depend_on_order(spark):
    rng = random.Random(9)
    rows = [(0, f"e{k}", 1, 2, "USES", rng.randrange(1, 10**6) / 10**6, k, [f"b{k % 7}"]) for k in range(500)]
    kind = "doc_id int, id string, source int, target int, relation_type string, confidence double, ord int, evidence_blocks array<string>"
    want = None
    for _ in range(3):
        rng.shuffle(rows)
        got = G.merge_duplicates(spark.createDataFrame(rows, kind).repartition(7)).collect()
        assert want is None or got == want
        want = got


@pytest.mark.parametrize("threshold", [0.8, 0.95])
def test_corpus_pairs_find_those_of_all_pairs(spark, threshold):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(900, 32))
    v[300:600] = v[:300] + rng.normal(size=(300, 32)) * rng.uniform(0.05, 0.7, (300, 1))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(int(a), int(b)) for a, b in np.argwhere(np.triu(unit @ unit.T, 1) >= threshold)}
    rows = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(v)], "doc_id int, ord int, embedding array<double>")
    got = {(r.a, r.b) for r in N.similar_pairs(rows, threshold, "corpus").collect()}
    assert got <= want and len(got) >= 0.98 * len(want) > 50
    # Far fewer pairs are looked at than there are.
    slim = rows.select(F.col("ord").alias("i"), F.col("embedding").alias("v"))
    assert N.candidate_pairs(slim, 0.95).count() < 0.5 * 900 * 899 / 2


@pytest.mark.parametrize("slice_rows", [8_192, 64])
def test_pairs_in_groups_are_those_of_all_pairs(spark, slice_rows):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 8))
    v[400:] = v[:200] + rng.normal(size=(200, 8)) * 0.3
    group = [("a", "b", "c")[min(i % 7, 2)] for i in range(600)]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(group[a], int(a), int(b)) for a, b in np.argwhere(np.triu(unit @ unit.T, 1) >= 0.6) if group[a] == group[b]}
    rows = spark.createDataFrame([(g, i, x.tolist()) for g, i, x in zip(group, range(600), v, strict=True)], "g string, i long, v array<double>")
    got = pairs_in_groups(rows, 0.6, store, slice_rows).collect()
    assert len(got) == len(want) > 500 and {(r.g, r.a, r.b) for r in got} == want
    assert all(abs(r.similarity - unit[r.a] @ unit[r.b]) < 1e-12 for r in got)


def test_pairs_of_a_group_are_not_joined_row_by_row(spark):
    near, inf = [3.0, 4.0], float("inf")
    given = [(1, 1, near), (1, 2, near), (1, 3, [0.0, 0.0]), (1, 4, [None, 1.0]), (1, 5, [1.0, inf]), (1, 6, [3.0, 4.0, 0.0]), (1, 7, None), (2, 8, near), (None, 9, near), (None, 10, near), (1, None, near)]
    found = N.similar_pairs(spark.createDataFrame(given, "doc_id int, ord int, embedding array<double>"), 0.5)
    assert [tuple(r) for r in found.collect()] == [(1, 1, 2, 1.0)]
    assert "Join" not in found._jdf.queryExecution().analyzed().toString().replace("Join LeftOuter", "")
    assert N.similar_pairs(spark.createDataFrame([], found.sparkSession.createDataFrame(given, "doc_id int, ord int, embedding array<double>").schema), 0.5).collect() == []


@pytest.mark.parametrize("walked_arcs", [None, 12])
def test_dependencies_within_graphs_are_those_found_hop_by_hop(spark, walked_arcs):
    rng = random.Random(11)
    arcs = [(f"{g}:{rng.randrange(9)}", f"{g}:{rng.randrange(9)}", "DEPENDS_ON", rng.choice(["dependency", "dependency", "related"])) for g in range(30) for _ in range(g)]
    graph = spark.createDataFrame(arcs, "src string, dst string, relation string, dep_kind string")
    starts = spark.createDataFrame([(f"{g}:{k}",) for g in range(31) for k in range(9)] * 2, "name string")
    hidden = spark.createDataFrame([(f"{g}:{g % 9}",) for g in range(31)], "name string")
    of = lambda name: F.substring_index(name, ":", 1)
    rows = lambda df: sorted(tuple(r) for r in df.select("start", "concept", "distance").collect())
    want = rows(H.dependencies(graph, starts, store, 2))
    assert rows(H.dependencies_within(graph, starts, of, store, 2, walked_arcs=walked_arcs)) == want
    shown = [r for r in want if int(r[1].split(":")[0]) % 9 != int(r[1].split(":")[1])]
    assert len(shown) < len(want)
    assert rows(H.dependencies_within(graph, starts, of, store, 2, hidden, walked_arcs)) == shown
    gaps = lambda **how: sorted(tuple(r) for r in H.knowledge_gaps(graph, starts.distinct(), hidden, store, **how).collect())
    assert gaps(graph_of=of) == gaps()


def test_ends_of_document_relations_are_document_concepts(spark):
    from kgspark.plans import inputs as I

    held = spark.createDataFrame([(d, p, f"word{(d * p + k) % 11:03d}") for d in range(9) for p in range(4) for k in range(5)], "doc_id long, position int, word string")
    rows = I.candidates(held)
    edges = I.document_relations(rows)
    got = sorted(map(str, H.arcs_of(edges).collect()))
    assert len(got) > 50 and got == sorted(map(str, H.load_graph(I.document_nodes(rows), edges).collect()))


@pytest.mark.parametrize("word_boundary", [False, True])
def test_mentions_are_those_of_all_names(spark, word_boundary):
    rng = random.Random(5)
    names = ["ab", "a", "graph", "graph theory", "theory", "é", "learning", "machine learning", "x-ray"]
    texts = [" ".join(rng.choice(["Graph", "theory", "theories", "MACHINE", "learning", "learn", "É", "cab", "x-ray", "q", "\n"]) for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["", "a"]
    blocks = spark.createDataFrame([(k % 2, f"b{k}", t) for k, t in enumerate(texts)], "doc_id int, block_id string, text string")
    lookup = spark.createDataFrame([(d, n, f"c{k}") for d in range(2) for k, n in enumerate(names) if d or k % 2], "doc_id int, name string, concept_id string")
    plain = lambda t: " " + re.sub(r"\W+", " ", t) + " "
    want = set()
    for k, t in enumerate(texts):
        hits = {f"c{j}" for j, n in enumerate(names) if (k % 2 or j % 2) and n in t.lower() and (not word_boundary or plain(n) in plain(t.lower()))}
        want |= {(k % 2, f"b{k}", c) for c in hits} if len(hits) > 1 else set()
    assert {tuple(r) for r in R.mentions(blocks, lookup, word_boundary).collect()} == want
    # The same where documents are spread over tasks, and with names and texts that find nothing.
    odd = lookup.unionByName(spark.createDataFrame([(0, "", "c90"), (0, None, "c91"), (7, "a", "c92")], lookup.schema))
    more = blocks.unionByName(spark.createDataFrame([(0, "b99", None), (8, "b98", "a graph")], blocks.schema))
    assert {tuple(r) for r in R.mentions(more, odd, word_boundary, slice_chars=50).collect()} == want
    assert R.mentions(blocks.limit(0), lookup).collect() == R.mentions(blocks, lookup.limit(0)).collect() == []


def test_crawl(spark):
    links = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (2, 3, 0), (1, 3, 0), (3, 0, 0)], "src int, dst int, ordinal int")
    roots = spark.createDataFrame([(0,)], "node int")
    got = {r.node: (r.depth, r.parent) for r in P.crawl(links, roots, 5, 10, store).collect()}
    assert got == {0: (0, None), 1: (1, 0), 2: (1, 0), 3: (2, 1)}
    assert {r.node for r in P.crawl(links, roots, 5, 2, store).collect()} == {0, 1}
    assert {r.node: r.depth for r in P.crawl(links, roots, 5, None, store).collect()} == {0: 0, 1: 1, 2: 1, 3: 2}


def test_crawl_by_cleaned_url(spark):
    pages = spark.createDataFrame([(1, "http://h.org/a?ref=x#top"), (2, "http://h.org/a"), (3, "http://h.org/b"), (4, "no url")], "page_id long, url string")
    links = spark.createDataFrame([(1, 0, "http://h.org/b?utm_source=q", True), (1, 1, "http://other.org/", False), (3, 0, "http://h.org/c#d", True), (3, 1, "http://h.org/a", True)], "page_id long, ordinal int, target_url string, is_internal boolean")
    nodes, arcs = P.crawl_graph(pages, links)
    assert {tuple(r) for r in nodes.collect()} == {("http://h.org/a", 1), ("http://h.org/b", 3)}
    met = P.crawl(arcs, nodes.where("page_id = 1"), 2, None, store)
    assert {tuple(r) for r in met.collect()} == {("http://h.org/a", 0, None), ("http://h.org/b", 1, "http://h.org/a"), ("http://h.org/c", 2, "http://h.org/b")}
    stored = spark.createDataFrame([("http://h.org/a", 2, 2, 1)], "node string, n_blocks long, n_links long, n_internal long")
    assert [tuple(r) for r in P.crawl_summary(met, stored).orderBy("depth").collect()] == [(0, 1, 2, 2, 1), (1, 1, 0, 0, 0), (2, 1, 0, 0, 0)]


def test_readings(spark):
    texts = spark.createDataFrame([(1, k, f"h{k}", 2, "x" * 3000) for k in range(12)] + [(2, 0, "h", 1, "Access denied here")], "doc_id long, order_index int, heading string, level int, content string")
    titles = spark.createDataFrame([(1, "t"), (2, "u")], "doc_id long, title string")
    links = spark.createDataFrame([(1, k, f"u{k}", "a" * 200) for k in range(30)], "doc_id long, ordinal int, target_url string, anchor_text string")
    short, full = ({r.doc_id: r for r in P.readings(texts, titles, links, x).collect()} for x in (True, False))
    assert (len(short[1].sections), len(short[1].links), len(short[1].links[0].text), len(short[1].content)) == (8, 20, 100, 8 * (700 + 6) + 7 * 2)
    assert (len(full[1].sections), len(full[1].sections[0].content), len(full[1].links), len(full[1].links[0].text)) == (12, 2000, 30, 200)
    assert short[2].is_error and not short[1].is_error and short[2].links == []
    assert {r.doc_id for r in P.readings(texts, titles, links, with_errors=False).collect()} == {1}


def test_blank_input(spark):
    none = spark.createDataFrame([], "doc_id long, position int, type string, tag string, text string")
    assert B.semantic_blocks(none).collect() == []
    assert B.block_stats(B.semantic_blocks(none)).where(F.lit(True)).collect() == []


# Cycles and long graphs --------------------------------------------------------


def components_of(arcs):
    """Nodes on cycles of several, with the set of those they reach and are reached by."""
    ahead = defaultdict(set)
    for a, b in arcs:
        ahead[a].add(b)

    def reach(at):
        seen, todo = set(), [at]
        while todo:
            for x in ahead[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        return seen

    far = {x: reach(x) for x in {x for e in arcs for x in e}}
    return {x: frozenset(y for y in far[x] if x in far[y]) | {x} for x in far if any(x in far[y] for y in far[x] - {x})}


@pytest.mark.parametrize("seed", (3, 4))
def test_strong_components(spark, seed):
    rng = random.Random(seed)
    n = 40
    arcs = [(rng.randrange(n), rng.randrange(n)) for _ in range((20, 40, 50, 60, 120)[seed])] + [(100, 101), (101, 102), (102, 100), (102, 110), (110, 111), (111, 110), (7, 7), (None, 3)]
    got = strong_components(spark.createDataFrame(arcs, "src int, dst int"), store).collect()
    want = components_of([e for e in arcs if None not in e])
    assert {r.node for r in got} == set(want) and len(got) == len(want)
    named = defaultdict(set)
    for r in got:
        named[r.component].add(r.node)
    assert all(c in members and members == want[c] for c, members in named.items())


def test_no_strong_components(spark):
    for arcs in ([], [(1, 2), (2, 3), (1, 3), (4, 4)]):
        assert strong_components(spark.createDataFrame(arcs, "src int, dst int"), store).collect() == []


def contracted(arcs, start):
    """The walk over units, cycles being units; members by name, the start last."""
    units = components_of(arcs)
    unit = lambda x: min(units[x]) if x in units else x
    firsts = {}
    for k, (a, b) in enumerate(arcs):
        if unit(a) != unit(b):
            firsts.setdefault((unit(a), unit(b)), k)
    chain = walked([e for e, _ in sorted(firsts.items(), key=lambda x: x[1])], unit(start)) + [unit(start)]
    out = [x for u in chain for x in sorted(units.get(u, {u}), key=lambda x: (x == start, x))]
    return out if start in units or (start, start) in arcs else out[:-1]


@pytest.mark.parametrize("seed", (1, 2))
def test_order_of_prerequisites(spark, seed):
    """The walk's order without cycles, and units in it with them."""
    rng = random.Random(seed)
    pairs = [(rng.randrange(16), rng.randrange(16)) for _ in range(34)]
    if seed % 2:
        pairs = [(min(p), max(p)) for p in pairs if p[0] != p[1]]
    arcs = list(dict.fromkeys((f"n{a:02}", f"n{b:02}") for a, b in pairs))
    graph = spark.createDataFrame([(a, b, "dependency", k) for k, (a, b) in enumerate(arcs)] + [("n00", "other", "related", 99)], "src string, dst string, dep_kind string, ord int")
    starts = sorted({a for a, _ in arcs})[:8] + ["alone"]
    got = defaultdict(list)
    for r in H.prerequisite_order(graph, spark.createDataFrame([(x,) for x in [*starts, starts[0]]], "name string"), store).orderBy("start", "place").collect():
        got[r.start].append(r.concept)
    want = walked if seed % 2 else contracted
    assert got == {x: want(arcs, x) for x in starts if want(arcs, x)}


def test_order_within_graphs(spark):
    """Graphs walked in tasks, and those too large for it, in the order that all have level by level."""
    rng = random.Random(7)
    rows = []
    for g in range(8):
        pairs = [(rng.randrange(12), rng.randrange(12)) for _ in range(10 + 4 * g)]
        rows += [(f"{g}:n{a:02}", f"{g}:n{b:02}", "dependency", rng.choice([None, 1, 2, 3])) for a, b in pairs]
    graph = spark.createDataFrame([*rows, ("0:n00", "0:other", "related", 9), (None, "1:n00", "dependency", 1)], "src string, dst string, dep_kind string, ord int")
    starts = spark.createDataFrame([(f"{g}:n{k:02}",) for g in range(9) for k in (0, 3, 5, 3)], "name string")
    seen = lambda df: sorted((r.start, r.concept, r.place) for r in df.collect())
    want = seen(H.prerequisite_order(graph, starts, store))
    written = []

    def counted(df):
        written.append(df)
        return store(df)

    got = seen(H.prerequisite_order_within(graph, starts, lambda c: F.substring_index(c, ":", 1), counted))
    assert got == want
    assert len(written) == 1
    assert seen(H.prerequisite_order_within(graph, starts, lambda c: F.substring_index(c, ":", 1), store, 25)) == want


def test_order_over_many_levels(spark):
    arcs = [(f"n{k:03}", f"n{k + 1:03}", "dependency", k) for k in range(16)] + [(f"n{k:03}", f"n{k + 2:03}", "dependency", 100 + k) for k in range(14)]
    graph = spark.createDataFrame(arcs, "src string, dst string, dep_kind string, ord int")
    rows = H.prerequisite_order(graph, spark.createDataFrame([("n000",)], "name string"), store).orderBy("place").collect()
    assert [r.concept for r in rows] == [f"n{k:03}" for k in range(16, 0, -1)]


def test_order_of_nothing(spark):
    graph = spark.createDataFrame([], "src string, dst string, dep_kind string, ord int")
    assert H.prerequisite_order(graph, spark.createDataFrame([("a",)], "name string"), store).collect() == []
    assert H.prerequisite_order(graph, spark.createDataFrame([], "name string"), store).collect() == []


# Pairs of vectors ----------------------------------------------------------------


def vectors_of(kind, rng):
    import numpy as np

    if kind == "clusters":
        centres = rng.normal(size=(30, 24))
        return centres[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 24)) * 0.25
    if kind == "crowd":  # a third of all vectors are one, others lie close by
        v = rng.normal(size=(900, 24))
        v[:300] = v[0]
        v[300:600] = v[0] + rng.normal(size=(300, 24)) * 0.2
        return v
    return rng.normal(size=(800, 24))


@pytest.mark.parametrize(("kind", "threshold"), [("clusters", 0.8), ("crowd", 0.95), ("plain", 0.5), ("plain", 0.0), ("plain", 1.0)])
def test_pivots_lose_no_pair(spark, kind, threshold):
    """Also with many cells, cells split again, and slices of cells."""
    import numpy as np

    rng = np.random.default_rng(len(kind))
    v = vectors_of(kind, rng)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = np.clip((unit @ unit.T), 0, 1)
    want = {(int(a), int(b)) for a, b in np.argwhere(np.triu(cos >= threshold + 1e-9, 1))}
    may = {(int(a), int(b)) for a, b in np.argwhere(np.triu(cos >= threshold - 1e-9, 1))}
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i int, v array<double>")
    got = pairs_within(rows, threshold, store, cell_rows=60).collect()
    pairs = {(r.a, r.b) for r in got}
    assert len(got) == len(pairs) and want <= pairs <= may
    assert all(abs(r.similarity - cos[r.a, r.b]) < 1e-9 for r in got[:2000])


def test_rows_sent_stay_linear_in_clusters(spark):
    """Four times the vectors of like clusters: about four times the visits."""
    import numpy as np

    from kgspark.operators import pivots

    visits = []
    for n in (1_000, 4_000):
        rng = np.random.default_rng(3)
        centres = rng.normal(size=(n // 50, 16))
        v = np.repeat(centres, 50, axis=0) + rng.normal(size=(n, 16)) * 0.05
        rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i int, v array<double>")
        made, homed, cells = pivots._cells(rows, n, store, 50, 1)
        visits.append(pivots._visits(homed, made, cells, 0.2).count() / n)
    assert visits[1] < 2 * max(visits[0], 0.5)


def test_odd_vectors_have_no_pairs(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, None]), (5, [3.0, 0.0]), (6, [float("nan"), 1.0])]
    df = spark.createDataFrame([(0, i, v) for i, v in rows], "doc_id int, ord int, embedding array<double>")
    assert {(r.a, r.b) for r in N.similar_pairs(df, 0.9, "corpus").collect()} == {(0, 1), (0, 5), (1, 5)}
    assert N.similar_pairs(df.limit(0), 0.9, "corpus").collect() == []


# Crawls of many roots ------------------------------------------------------------


def crawled(links, root, max_depth, max_pages):
    """Breadth first, links in their order, until there are enough pages."""
    out, queue = {root: (0, None, 1)}, deque([root])
    ahead = defaultdict(dict)
    for src, dst, k in links:
        ahead[src][dst] = min(k, ahead[src].get(dst, k))
    while queue:
        at = queue.popleft()
        for dst in sorted(ahead[at], key=lambda x: (ahead[at][x], x)):
            if dst not in out and out[at][0] < max_depth and (max_pages is None or len(out) < max_pages):
                out[dst] = (out[at][0] + 1, at, len(out) + 1)
                queue.append(dst)
    return {(root, node, *x) for node, x in out.items()}


@pytest.mark.parametrize(("max_depth", "max_pages"), [(1, 5), (3, 7), (10, None)])
def test_each_root_has_its_own_crawl(spark, max_depth, max_pages):
    rng = random.Random(max_depth)
    links = [(rng.randrange(30), rng.randrange(30), rng.randrange(6)) for _ in range(90)]
    links += [(0, k, k) for k in range(1, 25)] + [(5, 5, 0)]
    roots = [0, 5, 11, 11, 77]
    made = P.crawl_each(spark.createDataFrame(links, "src int, dst int, ordinal int"), spark.createDataFrame([(r,) for r in roots], "node int"), max_depth, max_pages, store)
    got = made.collect()
    want = set().union(*(crawled(links, r, max_depth, max_pages) for r in set(roots)))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_components_within_groups(spark):
    rng = random.Random(5)
    edges = [(g, rng.randrange(60), rng.randrange(60)) for g in range(4) for _ in range(15 * (g + 1))] + [(9, k, k + 1) for k in range(300)] + [(None, 1, 2), (5, None, 1), (5, 3, 3)]
    rows = spark.createDataFrame(edges, "doc_id int, a int, b int")
    node = lambda c: F.struct("doc_id", F.col(c).alias("x"))
    want = {(r.node.doc_id, r.node.x): r.component.x for r in connected_components(rows.where("doc_id is not null and a is not null").select(node("a").alias("src"), node("b").alias("dst")), store).collect()}
    for most in (1000, 20):  # with 20 edges a task, the larger groups are sliced
        assert {(r.doc_id, r.node): r.component for r in grouped_components(rows, store, slice_edges=most).collect()} == want


def test_clusters_of_a_chain_take_no_rounds(spark):
    written = []

    def counted(df):
        written.append(df)
        return store(df)

    rows = spark.range(500).select(F.lit(1).alias("doc_id"), F.col("id").alias("ord"))
    pairs = rows.where("ord > 0").select("doc_id", (F.col("ord") - 1).alias("a"), F.col("ord").alias("b"), F.lit(0.9).alias("similarity"))
    out = N.clusters(rows, pairs, counted).agg(F.count("*"), F.max("cluster"), F.min("size")).first()
    assert tuple(out) == (500, 0, 500)
    assert len(written) <= 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_clusters_meet_their_rows_in_one_task(spark):
    """Components, sizes and sums as by hand, also where documents are spread; columns are kept without a join."""
    rng = random.Random(8)
    members = [(g, k, f"name {k}") for g in (1, 2, 3, None) for k in rng.sample(range(80), 40)]
    links = [(g, rng.randrange(80), rng.randrange(80), rng.choice([0.8, 0.9, None])) for g in (1, 2, 3, None) for _ in range(12 * (g or 1))]
    links += [(1, None, 3, 0.9), (2, 4, None, 0.9), (2, 4, 4, 0.8)]
    rows, pairs = spark.createDataFrame(members, "doc_id int, ord int, name string"), spark.createDataFrame(links, "doc_id int, a int, b int, similarity double")
    want = set()
    for g in (1, 2, 3, None):
        own = {k for d, k, _ in members if d == g}
        near = [(a, b, s) for d, a, b, s in links if d == g and None not in (d, a, b)]
        least = {k: k for k in own | {x for a, b, _ in near for x in (a, b)}}
        for _ in least:
            for a, b, _s in near:
                least[a] = least[b] = min(least[a], least[b])
        for k in own:
            size = sum(least[x] == least[k] for x in own)
            total = sum(s or 0.0 for a, _, s in near if a in own and least[a] == least[k])
            want.add((g, k, least[k], size, round(1.0 if size == 1 else total / (size * (size - 1) / 2), 9), f"name {k}"))
    for most in (1000, 30):
        got = N.clusters(rows, pairs, store, "name", most=most).collect()
        assert len(got) == len(want) and {(*r[:4], round(r[4], 9), r[5]) for r in got} == want
    kept = N.clusters(rows, pairs, store, "name")
    assert "Join" not in plan_of(N.canonical_names(rows, kept)) and "Join" in plan_of(N.canonical_names(rows, kept.drop("name")))
    names = lambda m: {tuple(r) for r in N.canonical_names(rows, m).collect()}
    assert names(kept.where("doc_id is not null")) == names(kept.drop("name"))


def test_large_batches_of_documents_are_cut_between_them(spark):
    """Documents of 7 concepts in a row, over several batches of a task."""
    rows = spark.range(210_000 * 2).repartition(1).select((F.col("id") / 7).cast("int").alias("doc_id"), (F.col("id") % 7).cast("int").alias("ord"))
    pairs = rows.where("ord < 6").select("doc_id", F.col("ord").alias("a"), (F.col("ord") + 1).alias("b"), F.lit(0.7).alias("similarity"))
    out = N.clusters(rows, pairs, store).agg(F.count("*"), F.max("cluster"), F.min("size"), F.max("size"), F.round(F.min("similarity"), 6)).first()
    assert tuple(out) == (420_000, 0, 7, 7, 0.2)


def test_texts_under_one_key_give_each_word_once(spark):
    held = spark.createDataFrame([(d, p, w) for d in (1, 1, 2, 3) for p, w in ((0, "several"), (1, "several"), (1, "another"))], "doc_id long, position int, word string")
    got = sorted(tuple(r) for r in I.candidates(held).where("doc_id = 1").select("position", "word", "ord").collect())
    assert got == [(0, "several", 1), (1, "another", 2), (1, "several", 3)]
    words = ["a", "Straße", "classes", "naïves", "İtems", "x-rays", " s ", "", "foo_s", "bus", "yes", "ЯБЛОКИs", "ﬁles"]
    whole = lambda n: F.array_join(F.transform(T.words(F.replace(F.regexp_replace(F.lower(n), r"(?U)[^\w\s-]", ""), F.lit("-"), F.lit(" "))), lambda w: F.when(F.endswith(w, F.lit("es")) & (F.length(w) > 4), F.substring(w, F.lit(1), F.length(w) - 2)).when(F.endswith(w, F.lit("s")) & (F.length(w) > 3), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)), " ")
    assert not spark.createDataFrame([(w,) for w in words], "n string").where(T.name_key(F.col("n")) != whole(F.col("n"))).collect()
