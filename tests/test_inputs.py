"""Words, candidates and replies made from documents, against plain Python."""

import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from kgspark.operators import concepts as C
from kgspark.plans import inputs as I
from kgspark.plans import registry

WORDS = "several another neighbour Graphs' theories, learning; machine's wählbar naïvely x short 1234567 ΛΟΓΙΚΗ".split()


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def texts(n):
    """Lines of words by rule; word ``rare<k>`` is in one or two documents."""
    line = lambda d, p: " ".join([WORDS[(d * 7 + p * 3 + k * k) % len(WORDS)] for k in range((d + p) % 5)] + [f"rarewords{'abcdefghijklmnop'[d % 16]}{'xyz'[d // 16 % 3]}"] * (p % 2))
    return [(d, "\n".join(line(d, p) for p in range(d % 6))) for d in range(n)]


def brute(rows):
    """(doc_id, position, ord, word) of each candidate."""
    held = defaultdict(set)
    for d, text in rows:
        for p, line in enumerate((text or "").split("\n")):
            held[d, p] |= {w for w in "".join(c for c in line if c.isalpha() or c == " ").lower().split(" ") if len(w) >= 7}
    df = defaultdict(set)
    for (d, _), words in held.items():
        for w in words:
            if d is not None:
                df[w].add(d)
    out, n = [], defaultdict(int)
    for (d, p), words in sorted(held.items(), key=lambda x: (str(x[0][0]), x[0][1])):
        for w in sorted(words, key=lambda w: w.encode()):
            if len(df[w]) >= 3:
                n[d] += 1
                out.append((d, p, n[d], w))
    return out


def same(spark, path, rows):
    sf = documents(spark, path, [(d, t, "en", "s", 0) for d, t in rows])
    held = I.words(spark, sf)
    want = sorted(brute(rows), key=str)
    assert len(want) > 30
    got = lambda held: sorted((tuple(r) for r in I.candidates(held).select("doc_id", "position", "ord", "word").collect()), key=str)
    assert got(held) == want
    one_by_one = held.select("doc_id", F.explode("lines").alias("x")).select("doc_id", "x.position", F.explode("x.words").alias("word"))
    assert got(one_by_one) == want
    totals = defaultdict(int)
    for d, *_ in want:
        totals[d] += 1
    assert {r[0]: r[1] for r in I.candidates(held, "total").select("doc_id", "total").distinct().collect()} == totals


def test_candidates_are_those_of_each_document(spark, tmp_path):
    same(spark, tmp_path, [*texts(40), (100, ""), (101, None)])


def test_texts_under_one_key_or_none_are_one_document(spark, tmp_path):
    rows = texts(40)
    same(spark, tmp_path, [(None if d % 11 == 5 else d % 17, t) for d, t in rows])


def test_no_row_of_a_word_is_sent_by_its_word(spark):
    """Frequent words would all go to one task; orders need no window."""
    held = spark.createDataFrame([(d, [(0, ["several", "another"])]) for d in range(4)], "doc_id long, lines array<struct<position int, words array<string>>>")
    plan = I.candidates(held)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Window|LeftSemi", plan)
    by_word = [x for x in re.findall(r"hashpartitioning\((\w+)#", plan) if x == "word"]
    assert len(by_word) == 1 and "partial_count" in plan  # counts only


def test_a_reply_is_parsed_once(spark):
    replies = spark.createDataFrame([(1, "1_0", 0, '{"concepts":[{"name":"graph","confidence":0.7},{"name":3}]}')], "doc_id long, block_id string, ord int, raw_output string")
    kept = C.dedup_documents(C.filter_candidates(C.parse(replies)))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    filters = " ".join(x for x in plan.split("\n") if "Filter" in x)
    assert "variant" not in filters.lower() and "raw_output" not in filters
    assert [tuple(r) for r in kept.select("name", "confidence").collect()] == [("graph", 0.7)]


@pytest.mark.parametrize("name", ["concept_dedup_doc", "normalization_funnel"])
def test_odd_keys_give_what_the_sql_gives(spark, tmp_path, name):
    rows = [(None if d % 11 == 5 else d % 17, t) for d, t in texts(40)]
    sf = documents(spark, tmp_path, [(d, t, "en", "s", 0) for d, t in rows])
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet/*.parquet')")
    got = registry.QUERIES[name](spark, sf)
    want = con.sql(registry.ORACLES[name]).project(", ".join(got.columns)).fetchall()
    have = {tuple(r) for r in got.collect()}
    assert len(want) > 10 and have ^ set(want) == set()


def test_counts_of_clusters_write_no_texts(spark, monkeypatch):
    written = []
    monkeypatch.setattr(registry, "store", lambda df: written.append(df.columns) or df)
    registry._clustered(spark, "/root/testdata/sf0.001", "total")
    assert ["doc_id", "ord", "next_ord", "total"] in written
