"""Digest index, source divergence and ranked search against plain restatements."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kgspark.llm import divergence, exact_dedup, lexical

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string"
#: Clashing names that the operators use themselves.
EXTRA = ("digest", "row", "key", "batch", "gid", "src", "n", "value", "rank", "part", "__same", "__digest", "doc")


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"alpha Beta {'gamma' if i % 2 else 'delta'} w{i % 7} ÄÖ straße-Álpha", "ab"[i % 2], f"s{i % 5}") for i in range(120)]
    out += [(200 + i, "the same text in many copies", "a", "hot") for i in range(60)]
    out += [(300, None, "a", "s1"), (301, "", None, None), (302, " \n\t.,;", "c", "only"), (303, "\x00Z\x7fy", "c", "other"), (304, "rare " * 30_000, "b", "s1")]
    out += [(None, "the same text in many copies", "a", "hot"), (None, None, None, None), (5, "twice the same row", "b", "s9"), (5, "twice the same row", "b", "s9"), (6, "twice the same row", "b", "s9")]
    return [*out, (6, "twice the same row", "b", "s9")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in EXTRA}).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Digest index ---------------------------------------------------------------


def verdicts(df):
    return Counter(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))


def expected(rows, before=()):
    old, groups, out = dict(before), defaultdict(list), Counter()
    for doc, text, *_ in rows:
        groups[text or ""].append(doc)
    for text, ids in groups.items():
        ids.sort(key=lambda d: -1 if d is None else d)
        keep, stays = (old[text], False) if text in old else (ids[-1], True)
        for k, d in enumerate(ids):
            out[d, keep, len(ids), stays and k == len(ids) - 1, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def test_one_of_equal_texts_stays(spark, docs, rows, tmp_path):
    with exact_dedup.DigestIndex(spark, str(tmp_path / "index")) as index:
        assert verdicts(index.judge(docs, "1")) == expected(rows)
        assert index.rows().count() == len({r[1] or "" for r in rows})


def test_later_batches_meet_the_index(spark, rows, tmp_path):
    path = str(tmp_path / "it's an index")
    first, second = rows[:100], rows[100:]
    made = lambda part: spark.createDataFrame(part, SCHEMA)
    with exact_dedup.DigestIndex(spark, path.replace("'", ""), buckets=4) as index:
        one = index.judge(made(first), "b'1")
        kept = {r[1] or "": r[0] for r in first}
        for doc, text, *_ in first:
            kept[text or ""] = max(kept[text or ""], doc)
        assert verdicts(index.judge(made(second), "2")) == expected(second, kept)
        assert verdicts(one) == expected(first)  # as it was before the second batch
        n = index.rows().count()
    with exact_dedup.DigestIndex(spark, path.replace("'", ""), buckets=9) as again:
        assert again.buckets == 4
        # Batches that are added again are stored once and judged as before.
        assert verdicts(again.judge(made(second), "2")) == expected(second, kept)
        assert verdicts(again.judge(made(first[:0]), "3")) == Counter()
        assert again.rows().count() == n
        plan = again.rows().select("digest").join(again.rows().hint("merge").select("digest"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_kept_rows_come_with_their_columns(spark, docs, rows, tmp_path):
    with exact_dedup.DigestIndex(spark, str(tmp_path / "index")) as index:
        kept = index.keep_new(docs, "1")
        assert kept.columns == docs.columns
        got = Counter((r[0], r[1]) for r in kept.collect())
    want = Counter({(d, t) for (d, keep, _, stays, sha) in expected(rows) if stays for t in {r[1] for r in rows if r[0] == d and hashlib.sha256((r[1] or "").encode()).hexdigest() == sha}})
    # Null and empty text are equal: one of them stays.
    assert {(d, t or "") for d, t in got} == {(d, t or "") for d, t in want} and sum(got.values()) == len({r[1] or "" for r in rows})


def test_texts_are_compared_as_normalised(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    with exact_dedup.DigestIndex(spark, str(tmp_path / "index"), normalise=lambda c: F.lower(F.regexp_replace(c, " +", " "))) as index:
        got = {r.doc_id: (r.keep_id, r.kept, r.text_sha256) for r in index.judge(rows, "1").collect()}
    sha = hashlib.sha256(b"a b").hexdigest()
    assert got[1] == (2, False, sha) and got[2] == (2, True, sha) and got[3][:2] == (3, True)


# Source divergence ----------------------------------------------------------


def divergences(rows, min_docs=10, top=10):
    terms = [(lang or "", source or "", Counter(LETTERS.findall((text or "").translate(LOWER)))) for _, text, lang, source in rows]
    out = []
    for lang in {t[0] for t in terms}:
        own = [t for t in terms if t[0] == lang]
        df, all_, by = Counter(), Counter(), defaultdict(Counter)
        for _, source, c in own:
            df.update(c.keys())
            all_.update(c)
            by[source].update(c)
        kept = [t for t in df if df[t] >= min_docs]
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        ps, q = {s: p(c) for s, c in by.items()}, p(all_)
        for s in ps:
            pairs = [(-sum(f(ps[s][t], ps[o][t]) for t in kept), o.encode(), o) for o in ps if o != s]
            best = [(-f(ps[s][t], q[t]), t.encode(), t) for t in kept if by[s][t] and ps[s][t] > q[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(best)[:top])):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(ranked, 1)]
    return Counter(out)


@pytest.mark.parametrize(("bits", "block", "least"), [(64, 256, 10), (3, 2, 10), (5, 1, 2)])
def test_divergence(docs, rows, bits, block, least):
    """Also with digests that collide, and with sources in several blocks."""
    got = divergence.audit(docs, bits=bits, block=block, min_docs=least)
    assert Counter(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == divergences(rows, least)


def test_divergence_of_nothing(spark, empty):
    assert divergence.audit(empty).count() == 0
    none = spark.createDataFrame([(1, None, "x", "a"), (2, ".", "x", "b")], SCHEMA)
    assert {tuple(r) for r in divergence.audit(none).collect()} == {("x", "a", "pair", "b", 0, 1), ("x", "b", "pair", "a", 0, 1)}


# Ranked search --------------------------------------------------------------


def ranking(rows, items, top=10):
    own = [(d, Counter(TERMS.findall((t or "").translate(LOWER)))) for d, t, *_ in rows]
    own = [(d, c, sum(c.values())) for d, c in own if c]
    n, total = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = Counter()
    for item, text in set(items):
        want = Counter(TERMS.findall((text or "").translate(LOWER)))
        scored = []
        for d, c, size in own:
            m = 25 + 75 * size * n // total
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in want.items() if c[t])
            if score > 0:
                scored.append((-score, math.inf if d is None else d))
        out.update((item, k, None if d == math.inf else d, -s) for k, (s, d) in enumerate(sorted(scored)[:top], 1))
    return out


ITEMS = [(1, "Alpha gamma w3 w3 nowhere"), (1, "Alpha gamma w3 w3 nowhere"), (2, "the same text"), (2, "rare straße"), (3, None), (4, "?!"), (5, " ".join(f"w{i}" for i in range(90)) + " ÄÖ twice"), (None, "many copies"), (6, "nowhere")]


@pytest.mark.parametrize(("block_docs", "top", "pass_chars"), [(16_384, 10, 1 << 22), (7, 3, 1 << 22), (1, 10, 60), (64, 200, 100)])
def test_search(spark, docs, rows, block_docs, top, pass_chars):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({c: F.lit(1) for c in EXTRA})
    got = lexical.search(docs, items, top=top, block_docs=block_docs, pass_chars=pass_chars)
    assert Counter(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == ranking(rows, ITEMS, top)


def test_search_of_nothing(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(empty, items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


def test_few_masks_are_evaluated():
    """The documents with the best mask end the search."""
    import numpy as np

    n = 4000
    at = np.concatenate([np.arange(n), np.arange(0, n, 100)]).astype(np.int32)
    row = {"docs": np.arange(n), "sizes": np.full(n, 10, np.int32), "terms": np.array([3, 8], np.int32), "ends": np.array([n, n + 40], np.int32), "at": at, "tf": np.ones(n + 40, np.int32)}
    block = lexical._Block(row, n, 10 * n)
    looked = []
    best, lexical._best = lexical._best, lambda s, d, top: looked.append(len(s)) or best(s, d, top)
    try:
        scores, ids = block.search([(3, 5), (8, 900)], 10, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    finally:
        lexical._best = best
    assert ids.tolist() == [100 * k for k in range(10)] and max(looked) < 100
