"""Ranked lexical search: documents grouped by the query terms they hold."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.llm._common import materialize, split_terms

#: Ranks of an item.
TOP = 10
#: Characters of items that are searched for in one pass; more items take several.
PASS_CHARS = 4 << 20
#: Documents and postings of a block of the index, at most.
BLOCK_DOCS, BLOCK_POSTINGS = 16_384, 1 << 20
#: What is no term: ASCII but letters and digits; letters are lower-cased on the way.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_INDEX = "docs array<long>, sizes array<int>, terms array<int>, ends array<int>, at array<int>, tf array<int>"
_NO_KEY = 2**63 - 1


def terms_of(text: str | bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, ASCII letters lower-cased; null has none."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return [t for part in split_terms(raw, _TERMS) for t in part]


def index_blocks(docs: DataFrame, vocabulary: list[bytes], *, key: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Postings of the vocabulary's terms, a row per block of documents.

    docs and sizes are the keys and term counts of the block's documents that
    have terms; terms are the numbers of those held, in order, and ``at`` and
    ``tf`` up to ``ends`` their postings: document within the block and
    occurrences.
    """
    known = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        ids: list[int] = []
        sizes: list[int] = []
        term: list[int] = []
        at: list[int] = []
        tf: list[int] = []

        def emit() -> pa.RecordBatch:
            t, a, f = (np.array(x, np.int32) for x in (term, at, tf))
            order = np.lexsort((a, t))
            held, counts = np.unique(t, return_counts=True)
            columns = [np.array(ids, np.int64), np.array(sizes, np.int32), held, np.cumsum(counts), a[order], f[order]]
            kinds = [pa.int64(), *[pa.int32()] * 5]
            for x in (ids, sizes, term, at, tf):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([c], pa.list_(k)) for c, k in zip(columns, kinds, strict=True)], names=["docs", "sizes", "terms", "ends", "at", "tf"])

        for batch in batches:
            texts = batch[1].cast(pa.binary())
            for i, doc in enumerate(batch[0].to_pylist()):
                own: Counter = Counter()
                for part in split_terms(texts[i].as_py() or b"", _TERMS):
                    own.update(part)
                if not own:
                    continue
                hits = [(number[w], c) for w, c in own.items() if w in number]
                term.extend(h[0] for h in hits)
                tf.extend(h[1] for h in hits)
                at.extend([len(ids)] * len(hits))
                ids.append(_NO_KEY if doc is None else doc)
                sizes.append(own.total())
                if len(ids) >= block_docs or len(term) >= BLOCK_POSTINGS:
                    yield emit()
        if ids:
            yield emit()

    return docs.select(F.col(key).cast("long"), text).mapInArrow(build, _INDEX)


def weight(n: int, df: int) -> int:
    """Of a term that ``df`` of ``n`` documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class _Block:
    """A block of the index with what each posting adds per unit of weight."""

    def __init__(self, row: dict[str, np.ndarray], n: int, total: int) -> None:
        self.docs, self.terms = row["docs"], {int(t): k for k, t in enumerate(row["terms"])}
        self.ends = np.concatenate([[0], row["ends"]])
        self.at, tf = row["at"], row["tf"].astype(np.int64)
        m = 25 + 75 * row["sizes"].astype(np.int64) * n // total
        self.adds = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.at])
        self.most = np.maximum.reduceat(self.adds, self.ends[:-1]) if len(self.terms) else self.adds
        self.bits: dict[int, np.ndarray] = {}

    def bitmap(self, k: int) -> np.ndarray:
        """One bit per document of the block: whether it holds the k-th held term."""
        if k not in self.bits:
            held = np.zeros(len(self.docs), np.uint8)
            held[self.at[self.ends[k] : self.ends[k + 1]]] = 1
            self.bits[k] = np.packbits(held, bitorder="little")
        return self.bits[k]

    def search(self, item: list[tuple[int, int]], top: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The best (scores, keys), these documents included; ``item`` is (term, weight).

        Documents are grouped by the mask of terms they hold.  Masks are taken
        by the most that any document of the block could score with them, and
        none is looked at once ``top`` documents score more than that.
        """
        own = [(self.terms[t], w) for t, w in item if t in self.terms and w > 0]
        if not own:
            return best
        ks, ws = np.array([k for k, _ in own]), np.array([w for _, w in own], np.int64)
        rows = np.stack([self.bitmap(k) for k in ks])
        some = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(rows, axis=0), bitorder="little", count=len(self.docs)))
        held = np.unpackbits(rows, axis=1, bitorder="little", count=len(self.docs))[:, some]
        names = np.packbits(held, axis=0, bitorder="little").T  # a mask per document
        width = -(-names.shape[1] // 8) * 8
        words = np.zeros((len(some), width), np.uint8)
        words[:, : names.shape[1]] = names
        words = words.view(np.uint64)
        order = np.lexsort(words.T)
        change = np.any(words[order[1:]] != words[order[:-1]], axis=1)
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        ends = np.concatenate([starts[1:], [len(order)]])
        bound = (ws * self.most[ks]) @ held[:, order[starts]].astype(np.int64)
        by_bound = np.argsort(-bound, kind="stable")
        done, step = 0, 4 * top
        while done < len(by_bound):
            least = best[0][top - 1] if len(best[0]) >= top else 0
            part = by_bound[done:]
            # A mask that can just reach the last score may still win by its key.
            part = part[: np.searchsorted(-bound[part], -least, side="right")] if least else part
            if not len(part):
                break
            sizes = np.cumsum(ends[part] - starts[part])
            part = part[: max(1, int(np.searchsorted(sizes, step)))]
            docs = np.sort(some[np.concatenate([order[starts[g] : ends[g]] for g in part])])
            scores = np.zeros(len(docs), np.int64)
            for k, w in zip(ks, ws, strict=True):
                at = self.at[self.ends[k] : self.ends[k + 1]]
                place = np.minimum(np.searchsorted(at, docs), len(at) - 1)
                scores += np.where(at[place] == docs, w * self.adds[self.ends[k] + place], 0)
            best = _best(np.concatenate([best[0], scores]), np.concatenate([best[1], self.docs[docs]]), top)
            done += len(part)
            step *= 4
        return best


def _best(scores: np.ndarray, docs: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((docs, -scores))[:top]
    order = order[scores[order] > 0]
    return scores[order], docs[order]


def _passes(items: DataFrame, limit: int) -> list[DataFrame]:
    """The items in parts of about ``limit`` characters, by hash."""
    chars = items.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-chars // limit))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def search(docs: DataFrame, items: DataFrame, *, top: int = TOP, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", pass_chars: int = PASS_CHARS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The documents that score highest for each item: item_id, rank, doc_id, score.

    Every row of ``docs`` is a document; equal scores go by ascending key, null
    keys last.  Rows of ``items`` with equal key and text are one item; items
    with one key and different texts are ranked each by itself, under the key
    they share.  Null texts have no terms.  Documents that score 0 are left out,
    so items without a known term, or empty tables, give no rows.  Keys are
    whole numbers.

    Documents are read once for each pass of items (one, below ``pass_chars``
    characters of items): postings of the items' terms are written in blocks,
    then counted, then each task searches its blocks and sends at most ``top``
    rows per item.
    """
    asked = items.select(F.col(item_key).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).distinct()
    out = None
    for k, part in enumerate(_passes(materialize(asked, "items"), pass_chars)):
        own = [(r["item_id"], Counter(terms_of(r["text"]))) for r in part.collect()]  # ``pass_chars``, about
        found = _search(docs, own, top, key, text, block_docs).withColumn("pass", F.lit(k))
        out = found if out is None else out.unionByName(found)
    by = W.partitionBy("item_id", "pass", "item").orderBy(F.desc("score"), F.asc("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", F.nullif("doc_id", F.lit(_NO_KEY)).alias("doc_id"), "score")


def _search(docs: DataFrame, items: list[tuple[int | None, Counter]], top: int, key: str, text: str, block_docs: int) -> DataFrame:
    vocabulary = sorted({t for _, own in items for t in own})
    blocks = materialize(index_blocks(docs, vocabulary, key=key, text=text, block_docs=block_docs), "postings")
    sizes = blocks.select(F.size("docs").alias("n"), F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x).alias("l")).agg(F.sum("n"), F.sum("l")).first()
    n, total = sizes[0] or 0, sizes[1] or 0
    held = blocks.select(F.posexplode("terms").alias("k", "term"), "ends").select("term", (F.get("ends", F.col("k")) - F.coalesce(F.get("ends", F.col("k") - 1), F.lit(0))).alias("df"))
    df = {r["term"]: r["df"] for r in held.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # a row per term of the items
    number = {t: i for i, t in enumerate(vocabulary)}
    asked = [[(number[t], c * weight(n, df[number[t]])) for t, c in own.items() if df.get(number[t])] for _, own in items]
    shared = docs.sparkSession.sparkContext.broadcast((asked, [i for i, _ in items]))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, ids = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked)
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block({c: batch[c][i].values.to_numpy() for c in batch.schema.names}, n, total)
                best = [block.search(item, top, b) for item, b in zip(asked, best, strict=True)]
        rows = [(ids[k], k, d, s) for k, b in enumerate(best) for s, d in zip(*(x.tolist() for x in b), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["item_id", "item", "doc_id", "score"])

    return blocks.mapInArrow(rank, "item_id long, item long, doc_id long, score long")
