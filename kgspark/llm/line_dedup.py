"""Line dedup: documents probe minimal perfect hashes over frequent lines."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm._common import BROADCAST_LIMIT, SPACES, materialize

#: A line is dropped when its key has at least so many code
#: points and is found in at least so many documents.
MIN_CHARS = 40
MIN_DOCS = 5
#: Keys per shard of the hash, about.
SHARD_KEYS = 500_000
#: Bytes of a key in a shard: fingerprint, count, keeper, and bits of the hash.
KEY_BYTES = 21


def line_key(line: str) -> str:
    """The line without white space at its ends, ASCII letters lower-cased."""
    key = line.strip(SPACES)
    return key.lower() if key.isascii() else key.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def _hashes(text: str | None, min_chars: int) -> tuple[list[str], list[int], list[tuple[int, int]]]:
    """The lines, the numbers of those that count, and their keys' hashes."""
    lines = (text or "").split("\n")
    at, keys = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
            digest = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"))
            at.append(i)
            keys.append((digest >> 64, digest & _MASK))
    return lines, at, keys


_MASK = (1 << 64) - 1


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A new 64-bit hash of each key for a level."""
    with np.errstate(over="ignore"):
        x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & _MASK)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys, by levels of bit arrays.

    At each level a key that alone falls on its bit is placed; the others go to
    the next one.  A key's number is the rank of its bit over all levels.
    """

    def __init__(self, keys: np.ndarray, load: float = 2.0) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        rest, start = keys, 0
        while len(rest):
            size = max(64, int(len(rest) * load) // 64 * 64 + 64)
            at = (_mix(rest, len(self.levels)) % np.uint64(size)).astype(np.int64)
            seen = np.bincount(at, minlength=size)
            bits = seen == 1
            ranks = start + np.concatenate([[0], np.cumsum(bits.reshape(-1, 64).sum(1))[:-1]])
            self.levels.append((size, np.packbits(bits, bitorder="little"), ranks.astype(np.int64)))
            start += int(bits.sum())
            rest = rest[seen[at] > 1]
        self.size = start

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Numbers from 0; -1 for some keys, and any number for other strange ones."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, bits, ranks) in enumerate(self.levels):
            if not len(left):
                break
            at = (_mix(keys[left], level) % np.uint64(size)).astype(np.int64)
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            own, word = left[hit], at[hit] >> 6
            if len(own):
                blocks = bits.reshape(-1, 8)[word]
                full = np.unpackbits(blocks, axis=1, bitorder="little")
                below = np.arange(64)[None, :] < (at[hit] & 63)[:, None]
                out[own] = ranks[word] + (full * below).sum(1)
            left = left[~hit]
        return out


class Shard:
    """Arrays of the frequent lines of one shard, addressed by a perfect hash."""

    def __init__(self, key: np.ndarray, print_: np.ndarray, count: np.ndarray, keeper: np.ndarray) -> None:
        self.hash = PerfectHash(key)
        at = self.hash.index(key)
        self.prints, self.counts, self.keepers = np.empty_like(print_), np.empty(len(key), np.uint32), np.empty_like(keeper)
        self.prints[at], self.counts[at], self.keepers[at] = print_, np.minimum(count, 2**32 - 1), keeper

    def drops(self, key: np.ndarray, print_: np.ndarray, doc: np.ndarray, min_docs: int) -> np.ndarray:
        """Which of these lines go: frequent ones outside the keeping document."""
        if not self.hash.size:
            return np.zeros(len(key), bool)
        at = self.hash.index(key)
        known = (at >= 0) & (self.prints[at] == print_) & (self.counts[at] >= min_docs)
        return known & (self.keepers[at] != doc)


def frequent_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Hashes of the lines that ``min_docs`` documents hold: k1, k2, n_docs, keeper.

    Each row of ``docs`` is a document and counts a line once; very common
    lines are combined before the shuffle.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, ids = [], []
            for doc, value in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                own = set(_hashes(value, min_chars)[2])
                k.extend(own)
                ids.extend([doc] * len(own))
            flat = np.array(k, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1]), pa.array(ids, pa.int64())], names=["k1", "k2", "doc"])

    lines = docs.select(F.col(key).cast("long"), text).mapInArrow(hashes, "k1 long, k2 long, doc long")
    counted = lines.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper"))
    return counted.where(F.col("n_docs") >= min_docs)


def build_shards(lines: DataFrame, shards: int) -> DataFrame:
    """One row per shard: shard, arrays (pickled ``Shard``)."""

    def build(table: pa.Table) -> pa.Table:
        columns = [table[c].to_numpy() for c in ("k1", "k2", "n_docs", "keeper")]
        made = Shard(columns[0].view(np.uint64), columns[1].view(np.uint64), columns[2], columns[3])
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "arrays": pa.array([pickle.dumps(made)], pa.binary())})

    # A keeper is null only if all documents of the line have a null id.
    rows = lines.select(F.pmod("k1", F.lit(shards)).cast("int").alias("shard"), "k1", "k2", "n_docs", F.coalesce("keeper", F.lit(-(2**63))).alias("keeper"))
    return rows.groupBy("shard").applyInArrow(build, "shard int, arrays binary")


def _kept(lines: list[str], gone: set[int]) -> str:
    return "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else "\n".join(lines)


def drop_frequent_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, key: str = "doc_id", text: str = "text", broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``docs`` without frequent lines, and ``__n_lines`` and ``__n_dropped``.

    Lines end at \\n; a null or empty text is one empty line and comes back as
    it was.  A line that goes does so at every place in its document; the
    document with the largest key keeps all of its own.  Null keys count as the
    least one.  Rows with equal keys are documents of their own that keep or
    lose a line together.  Other columns are passed on.

    The frequent lines' hashes are split into shards, each a minimal perfect
    hash with a 64-bit fingerprint, count and keeper per key.  While all shards
    together are below ``broadcast_limit`` the tasks probe a broadcast copy;
    beyond it the lines' hashes go to the shards and only the numbers of lost
    lines come back to the documents.
    Keys are whole numbers, as the largest key keeps a line.
    """
    lines = materialize(frequent_lines(docs, min_chars=min_chars, min_docs=min_docs, key=key, text=text), "lines")
    n = lines.count()
    shards = max(1, -(-n // SHARD_KEYS))
    arrays = materialize(build_shards(lines, shards), "line-shards")
    names = docs.columns
    at = names.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("__n_lines", T.LongType()), T.StructField("__n_dropped", T.LongType())])

    if n * KEY_BYTES <= broadcast_limit:
        made = docs.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["arrays"]) for r in arrays.collect()})

        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = {s: pickle.loads(b) for s, b in made.value.items()}
            for batch in batches:
                values = batch[at].to_pylist()
                split = [_hashes(v, min_chars) for v in values]
                flat = np.array([k for _, _, keys in split for k in keys], np.uint64).reshape(-1, 2)
                ids = np.array([-(2**63) if x is None else x for x in batch[names.index(key)].to_pylist()], np.int64)
                doc = np.repeat(ids, [len(keys) for _, _, keys in split])
                gone = np.zeros(len(flat), bool)
                shard = np.mod(flat[:, 0].view(np.int64), shards)
                for s, table in tables.items():
                    own = np.flatnonzero(shard == s)
                    gone[own] = table.drops(flat[own, 0], flat[own, 1], doc[own], min_docs)
                out, k = [], 0
                for value, (all_lines, places, keys) in zip(values, split, strict=True):
                    lost = {p for p, g in zip(places, gone[k : k + len(keys)], strict=True) if g}
                    k += len(keys)
                    out.append((_kept(all_lines, lost) if lost else value, len(all_lines), len(lost)))
                columns = [batch[i] for i in range(len(names))]
                columns[at] = pa.array([x[0] for x in out], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], names=[*names, "__n_lines", "__n_dropped"])

        return docs.mapInArrow(rewrite, schema)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, nums, k = [], [], [], []
            for doc, value, same in zip(*(batch[i].to_pylist() for i in range(3)), strict=True):
                _, places, keys = _hashes(value, min_chars)
                ids.extend([doc] * len(keys))
                texts.extend([same] * len(keys))
                nums.extend(places)
                k.extend(keys)
            flat = np.array(k, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), pa.array(nums, pa.int32()), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["doc", "same", "line", "k1", "k2"])

    def probe(keys: pa.Table, held: pa.Table) -> pa.Table:
        lost = np.zeros(keys.num_rows, bool)
        ids = keys["doc"].fill_null(-(2**63)).to_numpy()
        if held.num_rows and keys.num_rows:
            table = pickle.loads(held["arrays"][0].as_py())
            lost = table.drops(keys["k1"].to_numpy().view(np.uint64), keys["k2"].to_numpy().view(np.uint64), ids, min_docs)
        return pa.table({"doc": pa.array(ids[lost]), "same": keys["same"].filter(pa.array(lost)), "line": keys["line"].filter(pa.array(lost))})

    # A shard is copied to as many parts as keep each group of probes small.
    sent = docs.select(F.col(key).cast("long").alias("doc"), text, F.xxhash64(text)).mapInArrow(probes, "doc long, same long, line int, k1 long, k2 long")
    sent = materialize(sent, "line-probes")
    salts = max(1, -(-sent.count() // (shards * 2_000_000)))
    sent = sent.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc", "line"), F.lit(salts)).cast("int"))
    held = arrays.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    lost = sent.groupBy("shard", "salt").cogroup(held.groupBy("shard", "salt")).applyInArrow(probe, "doc long, same long, line int")
    lost = lost.groupBy("doc", "same").agg(F.collect_set("line").alias("__lost"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, gone in zip(batch[at].to_pylist(), batch[len(names)].to_pylist(), strict=True):
                all_lines = (value or "").split("\n")
                out.append((_kept(all_lines, set(gone)) if gone else value, len(all_lines), len(gone or ())))
            columns = [batch[i] for i in range(len(names))]
            columns[at] = pa.array([x[0] for x in out], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], names=[*names, "__n_lines", "__n_dropped"])

    joined = docs.join(lost, (F.coalesce(docs[key].cast("long"), F.lit(-(2**63))) == lost["doc"]) & (F.xxhash64(docs[text]) == lost["same"]), "left").select(*[docs[c] for c in names], "__lost")
    return joined.mapInArrow(cut, schema)


def digest(deduped: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_lines, n_dropped, kept_sha256."""
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    return deduped.select(F.col(key), F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), sha.alias("kept_sha256"))
