"""Repeated strings against counting every string of 200 bytes."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import suffix_dedup
from tests.llm.test_corpus import EDGES, SF, bag


def brute(rows):
    seen = Counter()
    for _, text in rows:
        raw = (text or "").encode()
        seen.update(raw[i : i + 200] for i in range(len(raw) - 199))
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - 199):
            if seen[raw[i : i + 200]] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])[: len(gone)]).sum()), hashlib.sha256(kept).hexdigest()))
    return bag(out)


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"block": F.lit(1), "data": F.lit("x"), "spans": F.lit(2)}).repartition(3)
    return bag(suffix_dedup.digest(suffix_dedup.remove_repeats(docs)).collect())


def test_real_documents_and_edges(spark):
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    odd = [(k, t and t[:2000]) for k, t, _ in EDGES]
    odd += [(2000, "\x00" * 450), (2001, "\x00" * 199), (2002, "ab" * 150), (2003, "ab" * 99 + "c\x00\x00"), (None, None)]
    assert run(spark, real + odd) == brute(real + odd)


@pytest.mark.parametrize("seed", range(4))
def test_passages_of_all_lengths(spark, monkeypatch, seed):
    """Also in many ranges, and with prefixes that count as hot."""
    if seed:
        monkeypatch.setattr(suffix_dedup, "PART", 20)
        monkeypatch.setattr(suffix_dedup, "HOT", [0, 30, 5, 0][seed])
    rng = np.random.default_rng(seed)
    word = lambda n: "".join(chr(c) for c in rng.choice([97, 98, 99, 233, 0], n, p=[0.4, 0.3, 0.2, 0.09, 0.01]))
    passages = [word(int(rng.integers(150, 700))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(int(rng.integers(0, 5))):
            p = passages[int(rng.integers(len(passages)))]
            a, b = sorted(rng.integers(0, len(p) + 1, 2).tolist())
            q = p[a:b] if rng.random() < 0.6 else p
            if rng.random() < 0.5 and q:
                k = int(rng.integers(len(q)))
                q = q[:k] + word(1) + q[k + 1 :]
            parts += [q, word(int(rng.integers(0, 60)))]
        rows.append((i, "".join(parts)))
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == Counter()


def test_loser_tree():
    rng = np.random.default_rng(5)
    for k in (1, 2, 3, 5, 8):
        runs, everything = [], []
        for _ in range(k):
            own = sorted({bytes(rng.integers(0, 3, int(rng.integers(0, 12))).astype(np.uint8)) for _ in range(int(rng.integers(0, 30)))})
            common, before = [], b""
            for s in own:
                n = next((i for i, (x, y) in enumerate(zip(before, s)) if x != y), min(len(before), len(s)))
                common.append(n if before or not common else 0)
                before = s
            runs.append((common, [s[n:] for s, n in zip(own, common)]))
            everything.append(own)
        order, common = suffix_dedup.merge(runs)
        heads = [iter(own) for own in everything]
        merged = [next(heads[i]) for i in order]
        assert merged == sorted(s for own in everything for s in own)
        for n, a, b in zip(common[1:], merged, merged[1:]):
            assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])
