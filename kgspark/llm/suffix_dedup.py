"""Repeated byte strings, found by a distributed merge sort of suffixes.

A string of LENGTH bytes that starts at two places holds, near its start, the
same sampled position in both: the least hash among the first SPAN 16-byte
windows.  So only the suffixes at such positions are sorted, and each carries
the bytes before it.  Documents are gathered in blocks.  A suffix whose first
LENGTH - SPAN + 1 bytes occur once is told by its hash and goes no further
(the exchange of distinguishing prefixes in string sorting).  The others make
one sorted, front-coded run per block, without equal entries; runs are
exchanged by ranges of that hash and merged by loser trees that compare
lengths of common prefixes first and never look at a known prefix again.  The
merged order and its common prefixes, with the same for the bytes before, say
for each suffix which strings around it are repeated.

The number of ranges grows with the suffixes that are exchanged.  A prefix that
more than HOT suffixes begin with, which no split by ranges makes smaller, is
not merged: the strings around its suffixes are counted by their hashes instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm._common import join_sized, materialize, work_dir
from kgspark.llm.jaccard_join import _mix, shared_signatures

#: Fixed value: length of the strings, in bytes.
LENGTH = 200
#: A sampled position starts less than so many bytes after the string.
SPAN = 128
#: Bytes of text in a block, and of those looked at together, about; a longer
#: document is not cut.
BLOCK_BYTES = 2 << 20
CHUNK_BYTES = 1 << 19
#: Suffixes of a range that is merged, about, and most suffixes of one prefix there.
PART, HOT = 50_000, 100_000

_GRAM = 16
_BASE = 0x9E3779B97F4A7C15
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


class Blocks:
    """A written table of blocks, bucketed so that joins on ``block`` move none of it."""

    def __init__(self, docs: DataFrame, key: str, text: str) -> None:
        spark = docs.sparkSession
        self.key, self.kind = key, docs.schema[key].dataType
        self.partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"blocks_{uuid.uuid4().hex}"

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base, made = TaskContext.get().partitionId() << 32, 0
            ids: list = []
            raw: list[bytes] = []
            held, kept_as = 0, None

            def block() -> pa.RecordBatch:
                lengths = np.array([len(r) for r in raw], np.int64)
                return pa.RecordBatch.from_arrays([pa.array([base + made]), pa.array([ids], pa.list_(kept_as)), pa.array([lengths.tobytes()]), pa.array([b"".join(raw)], pa.binary())], names=["block", "ids", "lengths", "data"])

            for batch in batches:
                kept_as = batch[0].type
                for k, t in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                    ids.append(k)
                    raw.append((t or "").encode("utf-8", "surrogatepass"))
                    held += len(raw[-1]) + 16
                    if held >= BLOCK_BYTES:
                        yield block()
                        made, held = made + 1, 0
                        ids.clear()
                        raw.clear()
            if ids:
                yield block()

        kind = self.kind.simpleString()
        blocks = docs.select(key, text).mapInArrow(gather, f"block long, ids array<{kind}>, lengths binary, data binary")
        blocks.write.bucketBy(self.partitions, "block").option("path", f"{work_dir(spark)}/{name}").saveAsTable(name)
        self.table = spark.table(name)

    def joined(self, small: DataFrame, how: str) -> DataFrame:
        return self.table.join(small.hint("shuffle_hash"), "block", how)


def _window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row; width is a power of two."""
    step = 1
    while step < width:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    return keys


def anchors(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions of a block, the document each is in, and the prefix hashes."""
    ends = np.cumsum(lengths)
    parts, first, start = [], 0, 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(ends, start + CHUNK_BYTES, side="right")))
        picked, doc, hashed = _anchors(data[start : ends[last - 1]], lengths[first:last])
        parts.append((picked + start, doc + first, hashed))
        first, start = last, int(ends[last - 1])
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum(lengths)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) < LENGTH or not (lengths >= LENGTH).any():
        return none
    with np.errstate(over="ignore"):
        gram, power, step = _BYTES[data], np.uint64(_BASE), 1
        while step < _GRAM:
            gram = gram[:-step] * power + gram[step:]
            power, step = power * power, 2 * step
        mixed = _mix(gram)
        # Of equal hashes the last counts, alike in all copies of a string.
        keys = (mixed & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(mixed), dtype=np.uint64))
        least = _window_min(keys, SPAN)
        first = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)
        # Only strings that lie within one document.
        inside = np.zeros(len(first) + 1, np.int64)
        some = lengths >= LENGTH
        np.add.at(inside, (ends - lengths)[some], 1)
        np.add.at(inside, np.minimum(ends[some] - LENGTH + 1, len(first)), -1)
        picked = np.unique(first[np.cumsum(inside[:-1]) > 0])
        doc = np.searchsorted(ends, picked, side="right")
        ok = picked + LENGTH - SPAN + 1 <= ends[doc]
        picked, doc = picked[ok], doc[ok]
        prefix = LENGTH - SPAN + 1
        hashed = np.full(len(picked), _BASE, np.uint64)
        for at in [*range(0, prefix - _GRAM, _GRAM), prefix - _GRAM]:
            hashed = _mix(hashed * np.uint64(_BASE) + gram[picked + at])
    return picked, doc, hashed


def _block(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(batch["data"][row].as_buffer(), np.uint8), np.frombuffer(batch["lengths"][row].as_buffer(), np.int64)


def prefix_rows(blocks: DataFrame) -> DataFrame:
    """The distinct prefix hashes of each block: sig, block, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield _counted(anchors(*_block(batch, row))[2], batch["block"][row].as_py())

    return blocks.select("block", "lengths", "data").mapInArrow(run, _COUNTED)


_COUNTED = "sig long, block long, n long"


def _counted(hashed: np.ndarray, block: int) -> pa.RecordBatch:
    hashed, count = np.unique(hashed, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64)), pa.array(np.full(len(hashed), block, np.int64)), pa.array(count.astype(np.int64))], names=["sig", "block", "n"])


def _among(hashed: np.ndarray, cell: pa.Scalar) -> np.ndarray:
    """Where the hashes are in the list of a cell."""
    wanted = np.sort(np.asarray(cell.values.to_numpy(), np.int64).view(np.uint64))
    return wanted[np.minimum(np.searchsorted(wanted, hashed), len(wanted) - 1)] == hashed


def _windows(data: np.ndarray, lengths: np.ndarray, hot: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings around a block's suffixes of hot prefixes: hash, document, start in it."""
    picked, doc, hashed = anchors(data, lengths)
    some = _among(hashed, hot)
    picked, doc = picked[some], doc[some]
    begin = (np.cumsum(lengths) - lengths)[doc]
    start = picked[:, None] - np.arange(SPAN)[None, :]
    inside = (start >= begin[:, None]) & (start + LENGTH <= (begin + lengths[doc])[:, None])
    start, doc = start[inside], np.repeat(doc, inside.sum(1))
    start, once = np.unique(start, return_index=True)
    doc = doc[once]
    acc = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        values = _BYTES[data]
        for k in range(LENGTH):
            acc = acc * np.uint64(_BASE) + values[start + k]
        return _mix(acc), doc, start - (np.cumsum(lengths) - lengths)[doc]


def window_rows(blocks: DataFrame) -> DataFrame:
    """The strings around suffixes of the blocks' hot prefixes, by hash: sig, block, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield _counted(_windows(*_block(batch, row), batch["hot"][row])[0], batch["block"][row].as_py())

    return blocks.select("block", "lengths", "data", "hot").mapInArrow(run, _COUNTED)


def window_spans(blocks: DataFrame) -> DataFrame:
    """Where those strings are whose hashes are in ``hashes``: block, doc, start, end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                hashed, doc, start = _windows(*_block(batch, row), batch["hot"][row])
                some = _among(hashed, batch["hashes"][row])
                own = pa.array(np.full(int(some.sum()), batch["block"][row].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([own, pa.array(doc[some].astype(np.int32)), pa.array(start[some]), pa.array(start[some] + LENGTH)], names=["block", "doc", "start", "end"])

    return blocks.select("block", "lengths", "data", "hot", "hashes").mapInArrow(run, "block long, doc int, start long, end long")


def _common(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one before."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        lcp = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        out[1:] = np.minimum(lcp, np.minimum(lengths[1:], lengths[:-1]))
    return out


def _tails(rows: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    columns = np.arange(rows.shape[1])[None, :]
    return rows[(columns >= begin[:, None]) & (columns < end[:, None])].tobytes()


def _order(rows: np.ndarray) -> np.ndarray:
    flat = np.ascontiguousarray(rows)
    return np.argsort(flat.view(f"V{rows.shape[1]}").reshape(-1), kind="stable") if len(rows) else np.zeros(0, np.int64)


_RUN = "part int, block long, lcp binary, right_length binary, right binary, left_lcp binary, left_length binary, left binary, n binary, doc binary, pos binary"


def sorted_runs(blocks: DataFrame, parts: int) -> DataFrame:
    """Front-coded sorted runs of the suffixes whose prefixes repeat, per part and block."""
    behind = SPAN - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data, lengths = _block(batch, row)
                picked, doc, hashed = anchors(data, lengths)
                some = np.flatnonzero(_among(hashed, batch["hashes"][row]))
                part = (hashed[some] >> np.uint64(33)).astype(np.int64) % parts
                for p in np.unique(part):
                    own = some[part == p]
                    yield front_coded(data, lengths, picked[own], doc[own], int(p), batch["block"][row].as_py())

    def front_coded(data: np.ndarray, lengths: np.ndarray, pos: np.ndarray, doc: np.ndarray, part: int, block: int) -> pa.RecordBatch:
        ends = np.cumsum(lengths)
        start = ends[doc] - lengths[doc]
        right_n, left_n = np.minimum(LENGTH, ends[doc] - pos), np.minimum(behind, pos - start)
        at = np.arange(LENGTH)[None, :]
        right = np.where(at < right_n[:, None], data[np.minimum(pos[:, None] + at, len(data) - 1)], 0).astype(np.uint8)
        at = np.arange(1, behind + 1)[None, :]
        left = np.where(at <= left_n[:, None], data[np.maximum(pos[:, None] - at, 0)], 0).astype(np.uint8)
        sizes = np.stack([right_n, left_n], 1).astype(np.uint8)
        order = _order(np.concatenate([right, sizes[:, :1], left, sizes[:, 1:]], 1))
        pos, doc, right, left, right_n, left_n = (x[order] for x in (pos - start, doc, right, left, right_n, left_n))
        lcp, left_lcp = _common(right, right_n), _common(left, left_n)
        equal = (lcp == right_n) & (left_lcp == left_n)
        equal[1:] &= (right_n[1:] == right_n[:-1]) & (left_n[1:] == left_n[:-1])
        equal[:1] = False
        new = np.flatnonzero(~equal)
        n = np.diff(np.append(new, len(pos)))
        lcp, left_lcp, right, left, right_n, left_n = (x[new] for x in (lcp, left_lcp, right, left, right_n, left_n))
        if len(new):
            lcp[0] = left_lcp[0] = 0
        small = lambda x: x.astype(np.uint8).tobytes()
        cells = [small(lcp), small(right_n), _tails(right, lcp, right_n), small(left_lcp), small(left_n), _tails(left, left_lcp, left_n), n.astype(np.uint32).tobytes(), doc.astype(np.uint32).tobytes(), pos.astype(np.int64).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], names=[f.split()[0] for f in _RUN.split(", ")])

    return blocks.mapInArrow(run, _RUN)


def merge(runs: list[tuple[list[int], list[bytes]]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs by a loser tree on strings and common prefixes.

    Each run is its strings' lengths of common prefix with the one before, and
    the rest of each string.  Returns the run of each string in merged order,
    and its common prefix with the one before.  Every player keeps its common
    prefix with the last winner: the longer one is the smaller string, and only
    with equal ones are bytes compared, from there on.
    """
    k = max(1, len(runs))
    text: list[bytes | None] = [None] * k
    lcp, at = [0] * k, [0] * k

    def step(i: int) -> None:
        """The run's next string; its common prefix is with the one just taken."""
        n = at[i]
        common, tails = runs[i]
        if n == len(tails):
            text[i] = None
            return
        lcp[i] = common[n]
        text[i] = tails[n] if not n else text[i][: common[n]] + tails[n]
        at[i] = n + 1

    def beats(a: int, b: int) -> bool:
        """Whether a's string comes first; the loser learns its common prefix with it."""
        x, y = text[a], text[b]
        if x is None or y is None:
            return x is not None
        if lcp[a] != lcp[b]:
            return lcp[a] > lcp[b]
        h = lcp[a]
        n = min(len(x), len(y))
        size = 8
        while h < n:
            if x[h : h + size] == y[h : h + size]:
                h, size = h + size, 2 * size
                continue
            while size > 1:
                size //= 2
                if x[h : h + size] == y[h : h + size]:
                    h += size
            break
        h = min(h, n)
        first = len(x) <= len(y) if h == n else x[h] < y[h]
        lcp[b if first else a] = h
        return first

    for i in range(len(runs)):
        step(i)
    loser = [0] * k
    # Build: winners of the lower matches meet higher up.
    winner = [0] * (2 * k)
    for i in range(k):
        winner[k + i] = i
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        won = beats(a, b)
        winner[node], loser[node] = (a, b) if won else (b, a)
    top = winner[1] if k > 1 else 0
    order, common = [], []
    while text[top] is not None:
        order.append(top)
        common.append(lcp[top])
        step(top)
        node = (k + top) // 2
        while node:
            rival = loser[node]
            if text[rival] is not None and not beats(top, rival):
                loser[node], top = top, rival
            node //= 2
    return order, common


def _split(data: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes)
    return [data[b:e] for b, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def _reach(common: np.ndarray, right_n: np.ndarray, left: np.ndarray, left_n: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance r at which the string from r before a suffix
    to LENGTH - r after it is repeated; -1 where none is.

    Entries are in merged order; two share the string if their common prefix
    is at least LENGTH - r, and the bytes before agree for r.
    """
    m = len(common)
    low, high = np.full(m, -1, np.int64), np.full(m, -1, np.int64)
    own_low, own_high = np.maximum(0, LENGTH - right_n), np.minimum(SPAN - 1, left_n)
    twice = (copies > 1) & (own_low <= own_high)
    low[twice], high[twice] = own_low[twice], own_high[twice]
    group = np.cumsum(common < LENGTH - SPAN + 1)
    size = np.bincount(group)[group] if m else group
    # Groups of which each entry is its own proof need no more.
    open_ = np.bincount(group, weights=~twice)[group] > 0 if m else group.astype(bool)
    some = np.flatnonzero((size > 1) & open_)
    if not len(some):
        return low, high
    # Entries that lie between two of one group are of it too, so the prefixes stay those of neighbours.
    order = _order(np.concatenate([left[some], left_n[some, None].astype(np.uint8)], 1))
    left_common = _common(left[some][order], left_n[some][order])
    rank = np.empty(len(some), np.int64)
    right_common, rn, ln = common[some], right_n[some], left_n[some]
    starts = np.concatenate([[True], some[1:] != some[:-1] + 1])
    right_common = np.where(starts, 0, right_common)
    for r in range(SPAN):
        valid = np.flatnonzero((ln >= r) & (rn >= LENGTH - r))
        if len(valid) < 2:
            continue
        right_class = np.cumsum(right_common < LENGTH - r)
        rank[order] = np.cumsum(left_common < r)
        key = (right_class * (len(some) + 1) + rank)[valid]
        by = np.argsort(key, kind="stable")
        key = key[by]
        same = key[1:] == key[:-1]
        again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        hit = some[valid[by[again]]]
        low[hit] = np.where((low[hit] < 0) | (low[hit] > r), r, low[hit])
        high[hit] = np.maximum(high[hit], r)
    return low, high


def merge_part(table: pa.Table) -> pa.Table:
    """Repeated stretches around the suffixes of a part: block, doc, start, end."""
    rows = table.to_pylist()
    bytes_of = lambda r, c: np.frombuffer(r[c], np.uint8).astype(np.int64)
    runs, rights, lefts, left_ns, counts, docs, poss = [], [], [], [], [], [], []
    for r in rows:
        lcp, right_n, left_lcp, left_n = (bytes_of(r, c) for c in ("lcp", "right_length", "left_lcp", "left_length"))
        runs.append((lcp.tolist(), _split(r["right"], right_n - lcp)))
        rights.append(right_n)
        left = np.zeros((len(left_n), SPAN - 1), np.uint8)
        before = b""
        for i, (n, tail) in enumerate(zip(left_lcp.tolist(), _split(r["left"], left_n - left_lcp), strict=True)):
            before = before[:n] + tail
            left[i, : len(before)] = np.frombuffer(before, np.uint8)
        lefts.append(left)
        left_ns.append(left_n)
        counts.append(np.frombuffer(r["n"], np.uint32).astype(np.int64))
        docs.append(np.frombuffer(r["doc"], np.uint32).astype(np.int64))
        poss.append(np.frombuffer(r["pos"], np.int64))
    order, common = merge(runs)
    # The n-th string of a run in merged order is the n-th of its entries.
    order = np.array(order, np.int64)
    sizes = np.array([len(x) for x in rights], np.int64)
    entry = np.empty(len(order), np.int64)
    entry[np.argsort(order, kind="stable")] = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat = (np.cumsum(sizes) - sizes)[order] + entry
    right_n, left, left_n, count = (np.concatenate(x)[flat] for x in (rights, lefts, left_ns, counts))
    low, high = _reach(np.array(common, np.int64), right_n, left, left_n, count)
    back = np.empty(len(flat), np.int64)
    back[flat] = np.arange(len(flat))
    held = np.concatenate(counts)
    low, high = np.repeat(low[back], held), np.repeat(high[back], held)
    block = np.repeat([r["block"] for r in rows], [len(d) for d in docs])
    doc, pos = np.concatenate(docs), np.concatenate(poss)
    some = np.flatnonzero(low >= 0)
    some = some[np.lexsort((pos[some], doc[some], block[some]))]
    block, doc, start, end = block[some], doc[some], (pos - high)[some], (pos - low + LENGTH)[some]
    # A constant per document keeps apart what lies in different ones.
    own = np.cumsum(np.concatenate([[0], (np.diff(block) != 0) | (np.diff(doc) != 0)]).astype(np.int64))[: len(some)]
    if len(some):
        first = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
        start, end = union_spans(start + (own << 40), end + (own << 40))
        own = start >> 40
        block, doc, start, end = block[first][own], doc[first][own], start & _LOW40, end & _LOW40
    return pa.table({"block": pa.array(block, pa.int64()), "doc": pa.array(doc, pa.int32()), "start": pa.array(start, pa.int64()), "end": pa.array(end, pa.int64())})


_LOW40 = (1 << 40) - 1


def union_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the stretches; touching ones are one run."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts without the bytes of repeated strings: key, n_bytes, spans, kept.

    A byte goes if a string of LENGTH bytes over it also starts elsewhere, in
    the same document or another; ``spans`` are the maximal runs that go, as
    (start, end), and ``kept`` is what is left, as bytes.  Matches do not cross
    documents.  Null and empty texts have no bytes.  Every row is a document of
    its own: keys may be null or repeat.  An empty table gives none.  Only
    strings around prefixes of more than HOT suffixes are told by 64-bit hashes.
    """
    blocks = Blocks(docs, key, text)
    shared = materialize(shared_signatures(prefix_rows(blocks.table)), "prefixes")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = materialize(shared.groupBy("sig").agg(F.sum("n").alias("n")).where(F.col("n") > HOT).select("sig"), "hot-prefixes")
    of_block = lambda rows, name: rows.groupBy("block").agg(F.collect_list("sig").alias(name))
    cold = of_block(join_sized(shared, hot, "sig", "left_anti", row_bytes=16), "hashes")
    runs = sorted_runs(blocks.joined(cold, "inner").select("block", "lengths", "data", "hashes"), max(1, -(-total // PART)))
    found = materialize(runs.groupBy("part").applyInArrow(merge_part, "block long, doc int, start long, end long"), "repeats")
    if not hot.isEmpty():
        warm = materialize(of_block(join_sized(shared, hot, "sig", "left_semi", row_bytes=16), "hot"), "hot-blocks")
        again = of_block(shared_signatures(window_rows(blocks.joined(warm, "inner"))), "hashes")
        found = found.unionByName(materialize(window_spans(blocks.joined(warm.join(again, "block"), "inner")), "hot-repeats"))
    found = found.groupBy("block").agg(F.collect_list(F.struct("doc", "start", "end")).alias("found"))
    kind = blocks.kind.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data, lengths = _block(batch, row)
                whole = data.tobytes()
                cell = batch["found"][row]
                if cell.is_valid:
                    doc, start, end = (cell.values.field(i).to_numpy() for i in range(3))
                else:
                    doc = start = end = np.zeros(0, np.int64)
                order = np.argsort(doc, kind="stable")
                doc, start, end = doc[order], start[order], end[order]
                first = np.searchsorted(doc, np.arange(len(lengths) + 1))
                spans, kept, at = [], [], 0
                for i, n in enumerate(lengths.tolist()):
                    own = whole[at : at + n]
                    at += n
                    b, e = first[i], first[i + 1]
                    if b == e:
                        spans.append([])
                        kept.append(own)
                        continue
                    s, t = (x.tolist() for x in union_spans(start[b:e], end[b:e]))
                    spans.append([{"start": x, "end": y} for x, y in zip(s, t, strict=True)])
                    kept.append(b"".join(own[x:y] for x, y in zip([0, *t], [*s, n], strict=True)))
                yield pa.RecordBatch.from_arrays([batch["ids"][row].values, pa.array(lengths), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=[key, "n_bytes", "spans", "kept"])

    out = blocks.joined(found, "left").select("ids", "lengths", "data", "found")
    return out.mapInArrow(cut, f"`{key}` {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def digest(removed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: key, n_bytes, n_removed, n_spans, kept_sha256."""
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return removed.select(key, "n_bytes", length.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
