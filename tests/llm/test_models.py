"""License scan, toxicity, nearest neighbours and the pipeline on small tables."""

import re
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kgspark.llm import ann, licenses, toxicity
from kgspark.llm.queries import held_out, tokenizer_path
from tests.llm.test_corpus import EDGES, SF, base, lines_brute, one_each, targets_brute


def pairs_of(text):
    words = re.sub(r"[^\w]|_", " ", text.lower()).split()
    return set(zip(words, words[1:]))


def test_licenses(spark):
    texts = ["Released under the MIT License.", "a\nreleased under THE mit license\nb", "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.", "license", "", None, "The MIT License was released under protest by many people today.", *(w for ws in licenses.TEMPLATES.values() for w in ws)]
    rows = list(enumerate(texts)) + [(None, texts[0]), (1, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "license": F.lit("x"), "pairs": F.lit(2)})
    want = {}
    for doc, text in rows:
        for passage in {*(text or "").split("\n"), text or ""}:
            a = pairs_of(passage)
            for name, wordings in licenses.TEMPLATES.items():
                for w in wordings:
                    b = pairs_of(w)
                    dice = 2 * len(a & b) / max(1, len(a) + len(b))
                    if dice >= licenses.THRESHOLD:
                        want[doc, name] = max(dice, want.get((doc, name), 0))
    got = {(r.doc_id, r.license): r.score for r in licenses.scan_licenses(docs).collect()}
    assert got == pytest.approx(want)
    assert licenses.scan_licenses(docs.limit(0)).collect() == []


def test_licenses_in_windows(spark):
    """Wrapped, embedded and whole licences, against all windows."""
    mit, apache = licenses.TEXTS["MIT"][1], licenses.TEXTS["Apache-2.0"][0]
    wrapped = lambda t: "Some words before it.\n# " + "\n# ".join(textwrap.wrap(t, 70)) + "\nAnd more after it."
    short = licenses.TEMPLATES["Apache-2.0"][0]
    texts = [wrapped(mit), wrapped(apache), "Our long tale of a library ends here; it was " + licenses.TEMPLATES["MIT"][0] + " Nobody knew what that meant, least of all the author of it.", "x y " * 50 + short + " a b" * 50 + " " + short + " c d e f g h", wrapped(licenses.TEXTS["BSD-3-Clause"][0]), wrapped(licenses.TEMPLATES["ISC"][0]), wrapped(licenses.TEMPLATES["GPL-3.0"][1]), "The license of the software under which it was released is not known to the author of this text."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.license): r for r in licenses.scan_licenses(docs).collect()}
    for at, name in enumerate(["MIT", "Apache-2.0", "MIT", "Apache-2.0", "BSD-3-Clause", "ISC", "GPL-3.0"]):
        assert got[at, name].score >= licenses.THRESHOLD
    assert got[3, "Apache-2.0"].n_passages == 1 and not any(d == 7 for d, _ in got)
    given = {"a": ("one two three four five six",), "b": ("two three two three two three nine",)}
    rng = np.random.default_rng(1)
    rows = [(i, "\n".join(" ".join(rng.choice(["one", "two", "three", "four", "five", "six", "nine"], 5, p=[0.1, 0.25, 0.25, 0.1, 0.1, 0.1, 0.1])) for _ in range(4))) for i in range(60)]
    want = {}
    for i, text in rows:
        words = text.split()
        for name, (wording,) in given.items():
            form, longest = pairs_of(wording), int((len(wording.split()) - 1) / 0.5 * 1.5)
            score = lambda p: 2 * len(pairs_of(p) & form) / max(1, len(pairs_of(p)) + len(form))
            by_line = max(map(score, [*text.split("\n"), text]))
            best = max(score(" ".join(words[b:e])) for b in range(len(words)) for e in range(b + 2, min(len(words), b + longest + 1) + 1) if e <= len(words)) if by_line < 2 / 3 else by_line
            if best >= 2 / 3:
                want[i, name] = best
    got = {(r.doc_id, r.license): r.score for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), given, threshold=2 / 3).collect()}
    assert got == pytest.approx(want) and len(want) > 20


def test_fold():
    assert toxicity.fold("You M0RON, іdіоt! c1own 12 ｉdiot").split() == ["you", "moron", "idiot", "ciown", "12", "idiot"]
    assert toxicity.fold(None) == "  "


def test_scores_of_the_default_model():
    model = toxicity.default_model()
    assert model.score("what an 1d1ot and m0r0n you are") > 0.5 > model.score("the class clown ate clown fish and put it into the trash can")
    assert model.score("") == model.score(None) < 0.5
    assert toxicity.Model({}).score("idiot") < 0.5


def test_exceptions_cancel_only_their_words():
    model = toxicity.Model({toxicity.fold("clown"): 6.0})
    assert model.features("clown fish")[1] == 0 and model.features("clown fish, you clown")[1] > 0


def features_brute(model, text):
    """Every term and every harmless phrase looked for at every place."""
    folded = toxicity.fold(text)
    harmless = [(b, b + len(p) - 1) for e in model.exceptions for p in [toxicity.fold(e)] for b in range(len(folded)) if folded.startswith(p, b)]
    best = {}
    for b in range(len(folded)):
        hits = [w for t, w in model.weights.items() if folded.startswith(t, b)]
        if hits and not any(x <= b < y for x, y in harmless):
            best[b] = max(hits)
    return float(np.log1p(100 * sum(best.values()) / (len(folded.split()) + toxicity.SMOOTH))), float(np.log1p(len(best)))


def test_features_against_plain_scans(spark):
    rng = np.random.default_rng(4)
    words = ["clown", "cl0wn", "c1own", "fish", "trash", "can", "tr4sh", "сlown", "clowns", "trashy", "bin", "x", "класс", "class", "5", "idiot", "1d1ot!", "a-b"]
    weights = {toxicity.fold("clown"): 3.0, " trash": 2.0, toxicity.fold("trash"): 2.5, toxicity.fold("idiot"): 5.0, " c": 0.5}
    given = toxicity.Model(weights, ("clown fish", "trash can", "class clown", "a b"))
    for _ in range(400):
        text = "".join(w + str(rng.choice([" ", "\n", ", ", "."])) for w in rng.choice(words, int(rng.integers(0, 25))))
        assert given.features(text) == pytest.approx(features_brute(given, text))
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    learned = toxicity.fit(toxicity.labelled_sample(docs, labels.where(~held_out())))
    rows = docs.limit(150).collect()
    got = {r.doc_id: r.score for r in toxicity.score(docs, learned).collect()}
    for r in rows:
        x, y = features_brute(learned, r.text)
        a, b, c = learned.calibration
        assert learned.features(r.text) == pytest.approx((x, y))
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-(a + b * x + c * y))))


def test_learned_exceptions(spark):
    bad = [(f"you are such a vermin number {i} go away", 1) for i in range(20)]
    good = [(f"the vermin control service {i} came on time", 0) for i in range(6)] + [(f"plain words {i} of no note", 0) for i in range(400)]
    model = toxicity.fit(spark.createDataFrame(bad + good, "text string, toxic int"))
    assert "vermin controi" in model.exceptions and not any("number" in e for e in model.exceptions)
    assert model.score("call vermin control service") < 0.5 < model.score("you vermin go away")


def test_toxicity_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "idiot"), (None, None)], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("score", "predicted", "held_out", "toxic")})
    assert toxicity.score(docs, toxicity.default_model()).columns == ["doc_id", "score", "predicted"]
    assert toxicity.labelled_sample(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).collect() == [("idiot", 1)]


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(toxicity.labelled_sample(docs, labels.where(~held_out())))
    scored = toxicity.score(docs, model).join(labels.where(held_out()), "doc_id").collect()
    found = toxicity.accuracy([(r.score, r.toxic) for r in scored])
    print("held out", found, len(model.weights), len(model.exceptions))
    assert found["accuracy"] > 0.96 and found["auc"] > 0.9


def test_toxicity_edges(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string, source string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(1003, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled_sample(docs, labels))
    assert model == toxicity.default_model()
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.score(docs.limit(0), model).collect() == []


def vectors_of(rows, dim):
    return [(i, np.array(x, float)) for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(np.array(x, float)).all() and np.any(np.array(x, float)) and len(x) == dim]


def ranked_brute(rows, k, asked, dim):
    """Scores of the k nearest of each query row, by id."""
    v = vectors_of(rows, dim)
    out = defaultdict(list)
    for n, (q, a) in enumerate(v):
        if asked(q):
            ranked = sorted((-float((a * b).sum()), i) for m, (i, b) in enumerate(v) if m != n)[:k]
            out[q].append([(i, -s) for s, i in ranked])
    return out


def found_by(result):
    """Ranked ids per query; the same rank again is another row of that id."""
    rows = defaultdict(list)
    for r in result.collect():
        rows[r.query_id, r.rank].append((r.vec_id, r.score))
    return rows


def test_neighbours_with_edges(spark, monkeypatch):
    monkeypatch.setattr(ann, "MAX_LISTS", 1)  # all pairs, so that the rows are those of all pairs
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(60)]
    # Ids that occur twice: each row asks, and the other is its candidate.
    rows += [(40, rng.normal(size=8).tolist()), (60, rows[60][1])]
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] * 8), (904, [1.0]), (None, rows[0][1]), (905, [float("inf")] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"list": F.lit(1), "id": F.lit(2), "row": F.lit(4), "score": F.lit(3)})
    found = found_by(ann.search(table, k=20, query="id % 20 = 0"))
    for q, lists in ranked_brute(rows, 20, lambda q: q % 20 == 0, 8).items():
        for rank in range(1, 21):
            want, got = sorted(x[rank - 1] for x in lists), sorted(found[q, rank])
            assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want])
    few = table.where("vec_id < 4")
    assert Counter(r.query_id for r in ann.search(few, k=20).collect()) == {i: 3 for i in range(4)}
    assert ann.search(table.limit(0)).collect() == []


@pytest.mark.parametrize("dim", [64, 128])
def test_neighbours_among_near_copies(spark, dim):
    """Each query gets its k rows, and hardly any of the true ones is missed."""
    rng = np.random.default_rng(dim)
    centres = np.repeat(rng.normal(size=(20, dim)), 50, axis=0)
    v = centres + rng.normal(size=centres.shape) * rng.choice([0.05, 0.3, 0.8], (len(centres), 1))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in ann.search(table, k=20, query="id % 5 = 0").orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    scores = v @ v.T
    np.fill_diagonal(scores, -np.inf)
    assert all(len(found[q]) == 20 for q in range(0, len(v), 5))
    assert np.mean([len(set(found[q]) & set(np.argsort(-scores[q])[:20].tolist())) / 20 for q in range(0, len(v), 5)]) > 0.97


def test_hypothesis_test_keeps_its_error():
    """Of pairs just near enough about ERROR are abandoned per block; far ones nearly all."""
    rng = np.random.default_rng(0)
    dim, cuts = 64, ann.cuts_of(64)
    assert cuts == [16, 32, 48, 64]
    rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    apart = (rng.normal(size=(200_000, dim))) @ rotation
    share = np.stack([(apart[:, :c] ** 2).sum(1) for c in cuts]) / (apart**2).sum(1)
    lost = (share > np.array(ann.critical_shares(dim))[:, None] + 1e-12).mean(1)
    assert (lost[:3] < 1.5 * ann.ERROR).all() and (lost[:3] > 0.6 * ann.ERROR).all() and lost[3] == 0
    q, x = rng.normal(size=(10, dim)), rng.normal(size=(3000, dim))
    x[:40] = q[0] + 0.1 * rng.normal(size=(40, dim))
    number = np.arange(len(x))
    i, j, score = ann.scan(q, -1 - np.arange(10), x, number, number, q @ rotation, x @ rotation, 20)
    assert Counter(i.tolist()) == {n: 20 for n in range(10)}
    want = [set(np.argsort(-(x @ v))[:20].tolist()) for v in q]
    assert np.mean([len(set(j[i == n].tolist()) & want[n]) / 20 for n in range(10)]) > 0.97
    assert score == pytest.approx([float(q[a] @ x[b]) for a, b in zip(i, j)])


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_neighbours_recall(spark, sf):
    """Recall of the registered parameters against all pairs, with several lists."""
    rows = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    x = rows.collect()
    ids, v = np.array([r.vec_id for r in x]), np.array([r.embedding for r in x], float)
    found = defaultdict(set)
    for r in ann.search(rows, query="id % 20 = 0").collect():
        found[r.query_id].add(r.vec_id)
    held = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        s[i] = -np.inf
        held.append(len(found[ids[i]] & set(ids[np.argsort(-s)[:20]].tolist())) / 20)
    print("recall", sf, np.mean(held))
    assert np.mean(held) >= 0.93


def test_neighbours_in_parts_and_turns(spark, monkeypatch):
    """Split lists and copied ones give the same rows."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(400, 16)) + 2
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "MAX_LISTS", 2)
    monkeypatch.setattr(ann, "PART", 60)
    monkeypatch.setattr(ann, "QUERIES", 30)
    found = found_by(ann.search(table, k=10, query="id % 2 = 0"))
    scores = v @ v.T
    np.fill_diagonal(scores, -np.inf)
    hits = [found[q, rank + 1][0][0] in set(np.argsort(-scores[q])[:10].tolist()) for q in range(0, 400, 2) for rank in range(10)]
    assert len(hits) == 2000 and np.mean(hits) > 0.95


def test_pipeline_stages(spark, tmp_path):
    """Each stage against its restatement on the rows of the one before."""
    real = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(k, t and t[:3000], "en", s, 0) for k, t, s in EDGES if k is not None], real.schema).dropDuplicates(["doc_id"])
    docs = real.unionByName(odd)
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        now = after.collect()
        if name != "packing":
            assert after.columns == real.columns
            now_rows = [(r.doc_id, r.text, r.source) for r in now]
        if name == "quality rules":
            assert Counter(now_rows) == Counter(r for r in before if not base(r[1])[-1])
        elif name == "line dedup":
            gone = {k[0]: k[2] for k in lines_brute(before)}
            assert len(now_rows) == len(before) and all(len((t or "").split("\n")) >= 1 for _, t, _ in now_rows)
            lost = {d: len((t or "").split("\n")) for d, t, _ in before}
            for d, t, _ in now_rows:
                assert (t or "").count("\n") + 1 == max(1, lost[d] - gone[d])
        elif name == "n-gram Jaccard join":
            assert Counter(r[0] for r in now_rows) == Counter(r[0] for r in one_each(before, 5, 80)) and set(now_rows) <= set(before)
        elif name == "mixing":
            sizes = defaultdict(int)
            for _, t, s in before:
                sizes[s] += len((t or "").split())
            taken = defaultdict(int)
            for _, t, s in now_rows:
                taken[s] += len((t or "").split())
            largest = max(len((t or "").split()) for _, t, _ in before)
            assert all(abs(taken[s] - x) <= 3 * largest + 1 for s, x in targets_brute(sizes).items())
            assert set(now_rows) <= set(before) and max(Counter(now_rows).values()) <= 3
        else:
            assert Counter(r.doc_id for r in now if r.piece == 0) == Counter(d for d, _, _ in before)
            filled = defaultdict(int)
            for r in now:
                filled[r.sequence_id] += r.length
            assert max(filled.values()) <= 4096
        kept.append(len(now))
        docs = after
    assert kept[0] >= kept[2] > 0 and tokenizer_path()


def test_scan_scores_only_the_best_exactly(monkeypatch):
    """Against all pairs where nothing is abandoned by chance; about ``k`` pairs of a query get an exact score."""
    rng, k = np.random.default_rng(4), 5
    x = np.repeat(rng.normal(size=(400, 64)), 2, axis=0)  # each twice
    rotation = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    ids, asked = rng.permutation(800), np.arange(0, 800, 20)
    scored = []
    monkeypatch.setattr(ann.np, "lexsort", lambda keys, sort=np.lexsort: scored.append(len(keys[0])) or sort(keys))
    i, j, score = ann.scan(x[asked], asked, x, np.arange(800), ids, x[asked] @ rotation, x @ rotation, k, [1.0] * 4)
    want = []
    for n, q in enumerate(asked):
        exact = (x[q] * x).sum(axis=1)
        exact[q] = -np.inf
        want += [(n, int(r)) for r in sorted(range(800), key=lambda r: (-exact[r], ids[r]))[:k]]
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == want
    assert np.array_equal(score, (x[asked][i] * x[j]).sum(axis=1)) and scored[0] <= (k + 1) * len(asked)
