"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm._common import materialize

#: The lexicon and calibration are learned from at most so many labelled rows,
#: those whose ids have the smallest digests.
MAX_LABELLED = 20_000
#: A term is kept for the lexicon if at least this share of the toxic texts
#: (and MIN_SUPPORT of them) hold it, and its log odds are at least MIN_WEIGHT.
MIN_SHARE, MIN_SUPPORT, MIN_WEIGHT = 0.004, 5, 2.5
#: Lengths of word beginnings that may be terms.
BEGINNINGS = (4, 5, 6)
#: A phrase of two words, one of them of the lexicon, is harmless if it is in at
#: least so many clean labelled texts and relatively no more often in toxic ones.
MIN_HARMLESS = 3
#: Words added to each text's length, so that very short ones are not all or nothing.
SMOOTH = 20

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһԛԝвкмнтгӏαεικνορτυχβηγ", "aeopcyxijsdhqwbkmhtriaeiknoptuxbny", strict=True))
#: Digits and signs written for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
#: Harmless phrases around words that are else counted.
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "trash bag", "class clown", "pond scum", "soap scum")
#: Terms used where no labels are given.
DEFAULT_TERMS = ("disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "worthless")

# i and l are one letter, as 1 stands for either.
_FOLD = str.maketrans(HOMOGLYPHS | {"l": "i"})
_SIGNS = str.maketrans(DIGITS)
_INSIDE = re.compile(r"(?<=[^\W\d_])[0-9@$!|]+(?=[^\W\d_])|(?<![^\W_])[0-9@$|]+(?=[^\W\d_])|(?<=[^\W\d_]{2})[013457]+(?![^\W_])")
_BREAKS = re.compile(r"[\W_]+")
_HAS_SIGN = re.compile(r"[0-9@$!|]")


def fold(text: str | None) -> str:
    """Words of a text in one spelling, with a blank before and after each.

    Compatibility forms and case are folded, then look-alike letters, then
    digits and signs that stand within or beside letters.
    """
    t = text or ""
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
    t = t.casefold()
    if _HAS_SIGN.search(t):
        t = _INSIDE.sub(lambda m: m[0].translate(_SIGNS), t)
    return f" {_BREAKS.sub(' ', t.translate(_FOLD)).strip()} "


def terms_of(folded: str) -> set[str]:
    """Possible terms: " word " for a word, " begi" for a beginning."""
    words = {w for w in folded.split() if 3 <= len(w) <= 40}
    out = {f" {w} " for w in words}
    for n in BEGINNINGS:
        out.update(f" {w[:n]}" for w in words if len(w) > n)
    return out


@dataclass
class Model:
    """Terms with weights, harmless phrases, and a logistic calibration."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    calibration: tuple[float, float, float] = (-4.0, 2.0, 0.5)
    _matcher: object = field(default=None, repr=False, compare=False)

    def matcher(self):
        if self._matcher is None:
            tree = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                tree.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                tree.add_word(fold(phrase), (len(fold(phrase)), None))
            tree.make_automaton()
            self._matcher = tree
        return self._matcher

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "calibration": self.calibration, "_matcher": None}

    def features(self, text: str | None) -> tuple[float, float]:
        """Weight of the matches by length, and their number, both as logs.

        Each word counts once, by its heaviest term; matches inside a harmless
        phrase don't count.
        """
        folded = fold(text)
        tree = self.matcher()
        if not len(tree):
            return 0.0, 0.0
        best: dict[int, float] = {}
        harmless: list[tuple[int, int]] = []
        for end, (n, weight) in tree.iter(folded):
            start = end - n + 1
            if weight is None:
                harmless.append((start, end))
            else:
                best[start] = max(best.get(start, 0.0), weight)
        for b, e in harmless:
            for start in [s for s in best if b <= s < e]:
                del best[start]
        words = max(0, folded.count(" ") - 1)
        return float(np.log1p(100 * sum(best.values()) / (words + SMOOTH))), float(np.log1p(len(best)))

    def score(self, text: str | None) -> float:
        a, b, c = self.calibration
        x, y = self.features(text)
        return float(1 / (1 + np.exp(-np.clip(a + b * x + c * y, -40, 40))))


def default_model() -> Model:
    return Model({fold(t): 6.0 for t in DEFAULT_TERMS})


def labelled_sample(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = MAX_LABELLED) -> DataFrame:
    """Texts of at most ``limit`` labelled rows: text, toxic.

    The labelled ids are so few that they are broadcast.  Null ids and labels
    are left out; an id labelled twice counts as toxic if one label says so.
    """
    ids = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("toxic"))
    ids = ids.orderBy(F.md5(F.col(key).cast("string")), key).limit(limit)
    return docs.select(key, F.col(text).alias("text")).join(F.broadcast(ids), key).select("text", "toxic")


def _count(rows: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """In how many of the texts each term (if wanted) is: term, n."""
    sent = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        only = sent.value
        for batch in batches:
            for t in batch[0].to_pylist():
                found = terms_of(fold(t))
                held.update(found if only is None else found & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])

    return rows.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def fit(sample: DataFrame) -> Model:
    """Lexicon and calibration from ``labelled_sample``; the default without both labels.

    Terms come from the toxic texts, each in a share of them, so their number is
    bounded as the sample is; of terms that begin alike the shortest stays
    unless a longer one weighs clearly more.
    """
    sample = materialize(sample, "labelled")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return default_model()
    support = max(MIN_SUPPORT, MIN_SHARE * n_toxic) if n_toxic >= MIN_SUPPORT else 1
    often = _count(sample.where("toxic = 1"), None).where(F.col("n") >= support)
    # Bounded: terms that a share of the texts hold.
    toxic = {r["term"]: r["n"] for r in often.collect()}
    clean = {r["term"]: r["n"] for r in _count(sample.where("toxic = 0"), frozenset(toxic)).collect()}
    weigh = lambda t: float(np.log((toxic[t] + 0.5) / (n_toxic + 1)) - np.log((clean.get(t, 0) + 0.5) / (n_clean + 1)))
    weights = {t: w for t in toxic if (w := weigh(t)) >= MIN_WEIGHT}
    kept: dict[str, float] = {}
    for t in sorted(weights, key=lambda t: (len(t), t)):
        shorter = max((kept[t[:n]] for n in range(1, len(t)) if t[:n] in kept), default=None)
        if shorter is None or weights[t] > shorter + 1.5:
            kept[t] = weights[t]
    model = Model(kept, (*EXCEPTIONS, *harmless_phrases(sample, kept, n_toxic, n_clean)))
    model.calibration = calibrate(*_features(sample, model))
    return model


def phrases_of(folded: str, weights: dict[str, float]) -> set[str]:
    """Phrases of a lexicon's word with the word before or after it."""
    words = folded.split()
    known = [f" {w} " in weights or any(f" {w[:n]}" in weights for n in range(1, len(w) + 1)) for w in words]
    return {f"{a} {b}" for a, b, x, y in zip(words, words[1:], known, known[1:]) if x or y}


def harmless_phrases(sample: DataFrame, weights: dict[str, float], n_toxic: int, n_clean: int) -> list[str]:
    """Learned exceptions: phrases around words of the lexicon that clean texts hold."""
    sent = sample.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for t, toxic in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                held.update((p, toxic) for p in phrases_of(fold(t), sent.value))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.string()), pa.array([x for _, x in held], pa.int32()), pa.array(list(held.values()), pa.int64())], names=["phrase", "toxic", "n"])

    counted = sample.select("text", F.col("toxic").cast("int")).mapInArrow(run, "phrase string, toxic int, n long")
    n = lambda label: F.sum(F.when(F.col("toxic") == label, F.col("n")).otherwise(0))
    sums = counted.groupBy("phrase").agg(n(1).alias("bad"), n(0).alias("good")).where(F.col("good") >= MIN_HARMLESS)
    # Bounded: phrases that several texts of the sample hold.
    return sorted(r["phrase"] for r in sums.where(F.col("bad") * n_clean <= F.col("good") * n_toxic).collect())


def _features(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the bounded sample."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            found = [own.features(t) for t in batch[0].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.float64()), pa.array([y for _, y in found], pa.float64()), batch[1].cast(pa.int32())], names=["x", "y", "toxic"])

    got = sample.select("text", F.col("toxic").cast("int")).mapInArrow(run, "x double, y double, toxic int").collect()
    # The sample is bounded; in one order, sums come out alike on each run.
    got = np.array(sorted((r["x"], r["y"], r["toxic"]) for r in got), float).reshape(-1, 3)
    return got[:, :2], got[:, 2]


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Logistic regression by Newton steps; the classes weigh the same."""
    a = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max(len(y) - y.sum(), 1)) * len(y)
    beta, penalty = np.zeros(3), np.diag([1e-3, ridge, ridge])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -40, 40)))
        grad = a.T @ (weight * (y - p)) - penalty @ beta
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + penalty, grad)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, beta))


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, score (0 to 1), predicted (1 from 0.5 on).

    Null and empty texts have no matches and get the score of that.  Rows with
    equal or null keys are scored each; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            scores = np.array([own.score(t) for t in batch[1].to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[key, "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double, predicted int")


def accuracy(scored: Iterable[tuple[float, int]]) -> dict[str, float]:
    """Accuracy at 0.5 and area under the ROC curve of (score, label) pairs."""
    s, y = (np.array(c, float) for c in zip(*scored, strict=True))
    _, inverse, count = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inverse]
    n = y.sum()
    return {"accuracy": float(((s >= 0.5) == (y > 0)).mean()), "auc": float((rank[y > 0].sum() - n * (n + 1) / 2) / max(n * (len(y) - n), 1))}
