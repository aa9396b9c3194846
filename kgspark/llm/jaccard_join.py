"""Exact n-gram Jaccard self-join by partitioned token universes.

The tokens of a document are its distinct word n-grams.  For a band of set
sizes, two sets that link differ in at most ``H`` tokens, and the hashed
universe is split into segments that are allocated 1 (the segment's tokens
must be equal to match) or 2 (they may differ by one token, found through
one-deletion neighbourhoods).  As the allocations add up to more than ``H``,
two linked sets match in some segment.  How many segments get 1 or 2, and how
many are kept in reserve for empty ones, is chosen per band by cost; each set
takes the subset of the first segments that suffices for its own size.
Candidates whose parity bitmaps differ in more bits than linked sets of their
sizes can differ in tokens are left out; the others are verified on the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.llm._common import join_sized, materialize, slices
from kgspark.operators.components import connected_components

#: Unless a contract says otherwise: five words, similarity 0.8.
WORDS = 5
PERCENT = 80
#: A band spans sizes up to where the smallest set has so many tokens a segment.
LEAST_LOAD = 2.6
#: Classes of each signature that its others are tried with first.
FRONT = 3
#: Pairs that a signature may have left before its sets are split by their rare tokens:
#: by estimate, not measured, what it costs to read the 2,000 texts that have so many.
SPLIT_PAIRS = 4_000_000
#: Buckets that tokens are counted in to tell which are rare.
TOKEN_BUCKETS = 1 << 18
#: 64-bit words of a set's parity bitmap; sets of more tokens than bits have a
#: second one, of as many bits as tokens, up to the next power of two.
BITMAP = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P1
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    step, done = np.uint64(base), 1
    while done < n:
        out[done : 2 * done] = out[: min(done, n - done)] * step
        step, done = step * step, 2 * done
    return out


_TABLE = _mix(np.arange(1, 257, dtype=np.uint64) * _P1)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the number of words of each text.

    A word's hash is that of its bytes, A-Z lower-cased, as a polynomial over
    random byte values, mixed with its length.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    with np.errstate(over="ignore"):
        space = _SPACE[data]
        start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
        if not len(start):
            return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
        values = _TABLE[_LOWER[data]]
        length = end - start
        hashes = np.zeros(len(start), np.uint64)
        # Words by length: the k-th byte of all that are longer than k.
        order = np.argsort(-length, kind="stable")
        falling = -length[order]
        at = start[order]
        acc = np.zeros(len(start), np.uint64)
        for k in range(int(length.max())):
            n = int(np.searchsorted(falling, -k, side="left"))
            if n < 64 and k > 256:
                break
            acc[:n] = acc[:n] * _P1 + values[at[:n] + k]
        else:
            n = 0
        for i in range(n):  # very long words, one by one
            word = values[at[i] + k : at[i] - falling[i]]
            powers = _powers(int(_P1), len(word))[::-1]
            acc[i] = acc[i] * (powers[0] * _P1) + (word * powers).sum()
        hashes[order] = _mix(acc + length[order].astype(np.uint64) * _P2)
    bounds = np.cumsum([len(r) + 1 for r in raw])
    return hashes, np.diff(np.searchsorted(start, bounds), prepend=0)


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and each set's size.

    A text with fewer than ``words`` words has its whole sequence as its one
    shingle; one without words has none.
    """
    hashes, n_words = word_hashes(texts)
    counts = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(n_words) - n_words
    at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(total)
    with np.errstate(over="ignore"):
        acc = np.zeros(total, np.uint64)
        last = np.repeat(first + n_words, counts)
        for k in range(words):
            inside = at + k < last
            value = hashes[np.minimum(at + k, len(hashes) - 1)]
            acc = np.where(inside, _mix(acc * _P1 + value + np.uint64(k + 1)), acc)
    sizes = np.zeros(len(texts), np.int64)
    out = []
    ends = np.cumsum(counts)
    for i, (b, e) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
        if e > b:
            own = np.unique(acc[b:e]) if e - b > 1 else acc[b:e]
            sizes[i] = len(own)
            out.append(own)
    return np.concatenate(out), sizes


def _poisson_above(k: int, mean: float) -> float:
    """Probability that a Poisson number is over k; by the normal one for large means."""
    if mean > 100:
        return 0.5 * math.erfc((k + 0.5 - mean) / math.sqrt(2 * mean))
    term, above = math.exp(-mean), 1.0
    for n in range(min(k, 400) + 1):
        above -= term
        term *= mean / (n + 1)
    return max(0.0, above)


class Band:
    """Sizes from ``lo`` to ``hi`` of the larger set, and their segments."""

    def __init__(self, number: int, lo: int, hi: int, percent: int) -> None:
        self.number, self.lo, self.hi = number, lo, hi
        #: Least size of a smaller set that may link into this band.
        self.least = -(-lo * percent // 100)
        #: Most tokens by which two linked sets up to ``hi`` differ.
        self.differ = (100 - percent) * 2 * hi // (100 + percent)
        self.ones = self.twos = 0

    def needed(self, sizes: np.ndarray, percent: int) -> np.ndarray:
        """Allocation that sets of these sizes need: one more than they can differ by
        from any set, not smaller than ``lo`` or larger than ``hi``, that they link with."""
        partner = np.maximum(np.minimum(sizes * 100 // percent, self.hi), self.lo)
        return (100 - percent) * (sizes + partner) // (100 + percent) + 1

    def allocate(self, docs: int) -> None:
        """Choose the numbers of segments by the rows they make and the matches expected.

        Rows: one per segment and, with 2, one more per token in it.  Chance
        matches come from sets with so many empty segments that they must match
        on those too; more segments than needed are a reserve against that.
        """
        need = self.differ + 1
        size = self.least  # the smallest sets have the emptiest segments
        best = math.inf
        reserves = range(12 + need // 4) if need <= 400 else [0, *(int(need * f) for f in (0.01, 0.02, 0.04, 0.06, 0.08, 0.12, 0.18, 0.25))]
        for twos in sorted({0, 1, 2, 3, need // 8, need // 4, need // 2, (need + 1) // 2}):
            for reserve in reserves:
                ones = max(0, need + reserve - 2 * twos)
                m, spare = ones + twos, ones + 2 * twos - need
                load = size / m
                lost = math.exp(-load) * (ones + twos * (2 + load))
                short = _poisson_above(spare, lost)
                cost = m + twos * load + docs * short**2 * m
                if cost < best:
                    best, self.ones, self.twos = cost, ones, twos

    @property
    def segments(self) -> int:
        return self.ones + self.twos


def bands_of(largest: int, percent: int) -> list[Band]:
    """Bands of sizes; a set falls into its own and at most the next one."""
    ratio = percent * (100 + percent) / (200 * (100 - percent) * LEAST_LOAD) if percent < 100 else 2.0
    out, lo = [], 1
    while lo <= largest:
        hi = max(lo, math.floor(lo * ratio))
        hi = max(hi, -(-lo * 100 // percent))  # at most two bands per set
        out.append(Band(len(out), lo, hi, percent))
        lo = hi + 1
    return out


def signatures(tokens: np.ndarray, sizes: np.ndarray, bands: list[Band], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets, and the set that each belongs to."""
    ends = np.cumsum(sizes)
    sigs, owners = [], []
    with np.errstate(over="ignore"):
        mixed = _mix(tokens ^ _P2)
        for band in bands:
            if not band.differ:
                continue  # only equal sets link, which are one class
            own = np.flatnonzero((sizes >= max(1, band.least)) & (sizes <= band.hi))
            if not len(own):
                continue
            m = band.segments
            count = sizes[own]
            row = np.repeat(np.arange(len(own)), count)
            at = np.repeat(ends[own] - count - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            segment = ((tokens[at] >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
            slot = row * m + segment
            held = np.bincount(slot, minlength=len(own) * m)
            acc = np.zeros(len(own) * m, np.uint64)
            np.add.at(acc, slot, mixed[at])
            salt = _mix(np.arange(1, m + 1, dtype=np.uint64) * _P1 + np.uint64(band.number + 1) * _P2)
            # Allocation 2 goes to the first segments, 1 to the others.  A set can
            # count on a segment only as far as it has tokens there, and takes
            # the first segments until they add up to what it needs; if all are
            # too little, it also takes its empty segments.
            worth = np.where(np.arange(m) < band.twos, 2, 1)
            grid = held.reshape(-1, m)
            need = band.needed(count, percent)[:, None]
            sums = np.cumsum(np.minimum(grid, worth), axis=1)
            short = sums[:, -1] < need[:, 0]
            taken = (sums - np.minimum(grid, worth) < need) & (grid > 0) | short[:, None]
            r, s = np.nonzero(taken)
            sigs.append(_mix(acc.reshape(-1, m)[r, s] + salt[s]))
            owners.append(own[r])
            near = (segment < band.twos) & ((held[slot] > 1) | short[row]) & taken.reshape(-1)[slot]
            sigs.append(_mix(acc[slot[near]] - mixed[at[near]] + salt[segment[near]]))
            owners.append(own[row[near]])
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(owners)


def set_ids(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set, 0 for empty ones."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        with np.errstate(over="ignore"):
            ends = np.cumsum(sizes[some])
            out[some] = _mix(np.add.reduceat(_mix(tokens + _P1), ends - sizes[some]) + sizes[some].astype(np.uint64))
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def bitmaps(tokens: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> pa.Array:
    """Parity bitmaps of all sets, of so many 64-bit words each: a token flips one bit.

    Two sets differ in at least as many tokens as their bitmaps in bits.  Lengths
    are powers of two, or 0 for no bitmap (null); a longer bitmap folds to a
    shorter one by exclusive or.
    """
    ends = np.cumsum(words)
    own = np.repeat(words > 0, sizes)
    bit = (tokens >> np.uint64(7)) & np.repeat(words * 64 - 1, sizes).astype(np.uint64)
    at = (np.repeat((ends - words) * 64, sizes) + bit.astype(np.int64))[own]
    odd = (np.bincount(at, minlength=int(words.sum()) * 64) & 1).astype(bool)
    cells = np.packbits(odd, bitorder="little").view("<i8")
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(cells), mask=pa.array(words == 0))


def fingerprints(docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """Per row: doc, text_hash, n_shingles, set_id (null without shingles), bits, wide, stray.

    ``wide`` is the larger bitmap of a large set, else null; ``stray`` the text
    of a row without a key, by which it could be found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 2):
                tokens, sizes = shingle_sets(texts, words)
                ids = pa.array(set_ids(tokens, sizes).view(np.int64), mask=sizes == 0)
                large = np.where(sizes > 64 * BITMAP, 1 << np.ceil(np.log2(np.maximum(sizes, 64) / 64)).astype(np.int64), 0)
                bits, wide = bitmaps(tokens, sizes, np.full(len(sizes), BITMAP)), bitmaps(tokens, sizes, large)
                stray = pa.array([t if lost else None for t, lost in zip(texts, part[0].is_null().to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part[0], part[1], pa.array(sizes), ids, bits, wide, stray], names=["doc", "text_hash", "n_shingles", "set_id", "bits", "wide", "stray"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.xxhash64(F.col(text)), F.col(text))
    return rows.mapInArrow(run, f"doc {kind}, text_hash long, n_shingles long, set_id long, bits array<long>, wide array<long>, stray string")


def bits_apart(x: Column, y: Column) -> Column:
    """In how many bits two wide bitmaps differ, the longer one folded to the shorter."""
    least = F.least(F.size(x), F.size(y))
    word = lambda bits, k: F.aggregate(F.sequence(k, F.size(bits) - 1, least), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseXOR(bits[i]))
    folded = F.aggregate(F.sequence(F.lit(0), least - 1), F.lit(0), lambda acc, k: acc + F.bit_count(word(x, k).bitwiseXOR(word(y, k))))
    equal = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda acc, n: acc + n)
    return F.when(F.size(x) == F.size(y), equal).otherwise(folded)


def signature_rows(docs: DataFrame, bands: list[Band], words: int, percent: int, text: str) -> DataFrame:
    """Rows (sig, set_id); a set met again in a task is left out there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, texts in slices(batch, 0):
                tokens, sizes = shingle_sets(texts, words)
                ids = set_ids(tokens, sizes)
                new = np.zeros(len(ids), bool)
                for k, x in enumerate(ids.tolist()):
                    if x not in seen:
                        seen.add(x)
                        new[k] = True
                tokens, sizes, ids = tokens[np.repeat(new, sizes)], sizes[new], ids[new]
                sigs, owner = signatures(tokens, sizes, bands, percent)
                for k in range(0, len(sigs), 500_000):
                    yield pa.RecordBatch.from_arrays([_signed(sigs[k : k + 500_000]), _signed(ids[owner[k : k + 500_000]])], names=["sig", "set_id"])

    return docs.select(text).mapInArrow(run, "sig long, set_id long")


def shared_signatures(rows: DataFrame) -> DataFrame:
    """The rows whose ``sig`` another row has too, from rows sorted by it.

    With a column ``n``, a row counts that often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before_held = None, False  # the last row, and whether its signature came before
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            sig = batch["sig"].to_numpy()
            same = sig[1:] == sig[:-1]
            before = np.concatenate([[before_held], same])
            keep = before | np.concatenate([same, [False]])
            if "n" in batch.schema.names:
                keep |= batch["n"].to_numpy() > 1
            held, before_held = batch.slice(batch.num_rows - 1), bool(before[-1])
            keep[-1] = False
            yield batch.filter(pa.array(keep))
        if held is not None and (before_held or "n" in held.schema.names and held["n"][0].as_py() > 1):
            yield held

    return rows.repartition("sig").sortWithinPartitions("sig").mapInArrow(run, rows.schema)


def _own_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each set's id and tokens, from rows (set_id, text)."""
    for batch in batches:
        for part, texts in slices(batch, 1):
            tokens, sizes = shingle_sets(texts, words)
            ends = np.cumsum(sizes)
            for want, have, n, end in zip(part[0].to_pylist(), set_ids(tokens, sizes).view(np.int64).tolist(), sizes.tolist(), ends.tolist(), strict=True):
                if want == have:  # not so for another row of a key that is used twice
                    yield want, tokens[end - n : end]


def token_counts(texts: DataFrame, words: int) -> np.ndarray:
    """How many tokens the sets of (set_id, text) have, by TOKEN_BUCKETS hash buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(TOKEN_BUCKETS, np.int64)
        for _, tokens in _own_sets(batches, words):
            np.add.at(counts, tokens % np.uint64(TOKEN_BUCKETS), 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])

    table = texts.select("set_id", "text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(TOKEN_BUCKETS, np.int64)
    counts[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return counts


def size_steps(largest: int) -> np.ndarray:
    """Least sizes of steps of about a twentieth."""
    steps = [1]
    while steps[-1] <= largest:
        steps.append(max(steps[-1] + 1, steps[-1] * 21 // 20))
    return np.array(steps)


def rare_signatures(tokens: np.ndarray, counts: np.ndarray, steps: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a set, of which any two linked sets share one.

    Of two linked sets of n and m tokens, which share at least
    s = percent * (n + m) / (100 + percent), the first n - s + 1 tokens of the one and
    m - s + 1 of the other, in one order of all tokens, have one in common.  The
    order is by bucket counts, so that tokens of few sets come first.  A signature
    is a token with the size steps of both sets.
    """
    tokens = tokens[np.lexsort((tokens, counts[(tokens % np.uint64(TOKEN_BUCKETS)).astype(np.int64)]))]
    n = len(tokens)
    low, high = -(-n * percent // 100), n * 100 // percent
    own, first, last = (int(x) for x in np.searchsorted(steps, [n, low, high], side="right") - 1)
    out = []
    with np.errstate(over="ignore"):
        mixed = _mix(tokens + _P2)
        for other in range(first, last + 1):
            shared = -(-percent * (n + max(low, int(steps[other]))) // (100 + percent))
            both = np.uint64(min(own, other) << 20 | max(own, other)) * _P1
            out.append(_mix(mixed[: max(1, n - shared + 1)] ^ both))
    return np.concatenate(out)


def rare_signature_rows(texts: DataFrame, largest: int, words: int, percent: int) -> DataFrame:
    """Rows (sig, set_id) of the sets of (set_id, text), by their rarest tokens."""
    counts, steps = token_counts(texts, words), size_steps(largest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs: list[np.ndarray] = []
        owners: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([_signed(np.concatenate(sigs)), pa.array(np.concatenate(owners))], names=["sig", "set_id"])

        held = 0
        for set_id, tokens in _own_sets(batches, words):
            sigs.append(rare_signatures(tokens, counts, steps, percent))
            owners.append(np.full(len(sigs[-1]), set_id, np.int64))
            held += len(sigs[-1])
            if held >= 500_000:
                yield rows()
                sigs, owners, held = [], [], 0
        if sigs:
            yield rows()

    return texts.select("set_id", "text").mapInArrow(run, "sig long, set_id long")


def verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids whose sets link, from their texts; both are written tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ta, tb = (batch[c].to_pylist() for c in ("a", "b", "text_a", "text_b"))
            keep = []
            for begin in range(0, len(a), 200):
                part = slice(begin, begin + 200)
                different = dict.fromkeys([*ta[part], *tb[part]])
                tokens, sizes = shingle_sets(list(different), words)
                ids = set_ids(tokens, sizes).view(np.int64).tolist()
                ends = np.cumsum(sizes)
                sets = {t: (i, tokens[e - n : e]) for t, i, n, e in zip(different, ids, sizes.tolist(), ends.tolist(), strict=True)}
                for x, y, p, q in zip(a[part], b[part], ta[part], tb[part], strict=True):
                    (i, s), (j, t) = sets[p], sets[q]
                    ok = i == x and j == y  # not so for another text of the same key and hash
                    if ok and 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
                        both = np.concatenate([s, t])
                        both.sort()
                        common = int((both[1:] == both[:-1]).sum())
                        ok = 100 * common >= percent * (len(s) + len(t) - common)
                    else:
                        ok = False
                    keep.append(ok)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], names=["a", "b"])

    # Pairs are two numbers each and sent to the texts while they are few.
    foremost = pairs.select("a").distinct()
    left = join_sized(texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a")), materialize(foremost, "foremost"), "a", "left_semi", row_bytes=40)
    right = join_sized(texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b")), pairs, "b", "inner", row_bytes=40)
    return right.join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _components(docs: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    """Per row: doc, text_hash, n_shingles, set_id and component, the id of one of its sets."""
    prints = materialize(fingerprints(docs, words, key, text), "shingles")
    some = prints.where("n_shingles > 0")
    largest = some.agg(F.max("n_shingles")).first()[0] or 1
    bands = bands_of(largest, percent)
    sizes = some.select("set_id", "n_shingles").distinct().groupBy("n_shingles").count()
    level = sum((F.when(F.col("n_shingles") >= b.lo, 1).otherwise(0) for b in bands), F.lit(-1))
    counts = {r[0]: r[1] for r in sizes.groupBy(level.alias("band")).agg(F.sum("count")).collect()}  # one row per band
    for band in bands:
        band.allocate(counts.get(band.number, 0) + counts.get(band.number - 1, 0))

    # Sets of one signature; hashes may repeat a set that several tasks met.
    members = shared_signatures(signature_rows(docs, bands, words, percent, text)).distinct()
    many = members.groupBy("sig").agg(F.count("*").alias("n_sets")).where("n_sets > 1")
    members = materialize(members.join(many, "sig"), "signatures")
    shares = members.groupBy("set_id").agg(F.sum("n_sets").alias("shares"))
    # A class is found again by the key and the text of its first row with a key.
    row = F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "text_hash")))
    classes = some.groupBy("set_id").agg(row.alias("row"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"), F.first("wide").alias("wide"))
    classes = materialize(classes.join(shares, "set_id").select("*", "row.doc", "row.text_hash").drop("row"), "classes")
    about = classes.select("set_id", "n", "bits", "wide")
    lookup = docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    strays = some.where("doc is null").select("set_id", F.col("stray").alias("text"))

    def stored(df: DataFrame) -> DataFrame:
        return materialize(df, "links")

    tried: list[DataFrame] = []

    def linked(pairs: DataFrame) -> DataFrame:
        """Verified pairs among (a, b), of those not looked at before, with their texts fetched."""
        for past in tried:
            pairs = pairs.join(past, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        tried.append(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        ends = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
        return verify(pairs, texts_of(ends), words, percent)

    def texts_of(ends: DataFrame) -> DataFrame:
        """A row (set_id, text) for each of the sets."""
        reps = materialize(classes.select("set_id", "doc", "text_hash").join(ends, "set_id", "left_semi"), "representatives")
        keyed = join_sized(lookup, reps.where("doc is not null"), ["doc", "text_hash"], "inner", row_bytes=48).select("set_id", "text")
        # Sets that only rows without a key have: one of their texts.
        unkeyed = strays.join(reps.where("doc is null"), "set_id", "left_semi").groupBy("set_id").agg(F.min("text").alias("text"))
        found = materialize(keyed.unionByName(unkeyed), "candidate-texts")
        if found.count() > reps.count():
            # Rows repeated with key and text brought a text more than once.
            found = materialize(found.groupBy("set_id").agg(F.min("text").alias("text")), "candidate-texts")
        return found

    def split(sets: DataFrame) -> DataFrame:
        """Rows (sig, set_id) by rare tokens of the sets, in place of a signature of very many sets."""
        return shared_signatures(rare_signature_rows(texts_of(sets), largest, words, percent)).distinct()

    def parted(rows: DataFrame) -> DataFrame:
        """Signatures with sets in several components: the largest of these, and the pairs to try."""
        held = rows.groupBy("sig", "component").agg(F.count("*").alias("k"))
        held = held.groupBy("sig").agg(F.max(F.struct("k", "component")).alias("top"), F.count("*").alias("parts"), F.sum("k").alias("sets"))
        return held.where("parts > 1").select("sig", F.col("top.component").alias("top"), (F.col("sets") * (F.col("sets") - F.col("top.k"))).alias("pairs"))

    def like(a: str, b: str) -> Column:
        """Whether sizes and bitmaps allow a link."""
        n_a, bits_a, wide_a = (F.col(f"{a}.{c}") for c in ("n", "bits", "wide"))
        n_b, bits_b, wide_b = (F.col(f"{b}.{c}") for c in ("n", "bits", "wide"))
        few = lambda apart: apart * (100 + percent) <= (100 - percent) * (n_a + n_b)
        apart = sum((F.bit_count(bits_a[k].bitwiseXOR(bits_b[k])) for k in range(BITMAP)), F.lit(0))
        sizes = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
        return sizes & few(apart) & F.when(wide_a.isNull() | wide_b.isNull(), True).otherwise(few(bits_apart(wide_a, wide_b)))

    def named(links: DataFrame) -> DataFrame:
        return connected_components(links, stored, "a", "b").withColumnRenamed("node", "set_id")

    def placed(rows: DataFrame, names: DataFrame | None) -> DataFrame:
        if names is None:
            return rows.withColumn("component", F.col("set_id"))
        return rows.join(names, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))

    links = None
    for _ in range(2):
        spread = placed(members.select("sig", "set_id").join(classes.select("set_id", "shares"), "set_id"), None if links is None else named(links))
        # Of the components in a signature, the foremost sets of the first few.
        front = spread.groupBy("sig", "component").agg(F.max(F.struct("shares", "set_id")).alias("f"))
        front = front.withColumn("k", F.row_number().over(W.partitionBy("sig").orderBy(F.desc("f")))).where(F.col("k") <= FRONT)
        front = front.select("sig", F.col("component").alias("other"), F.col("f.set_id").alias("a"))
        pairs = spread.join(front, "sig").where("component <> other").select("a", F.col("set_id").alias("b")).distinct()
        pairs = pairs.join(about.alias("p"), F.col("a") == F.col("p.set_id")).join(about.alias("q"), F.col("b") == F.col("q.set_id")).where(like("p", "q"))
        if links is None:
            # One link is enough for a class to join the others of its group.
            pairs = pairs.join(classes.select(F.col("set_id").alias("a"), "shares"), "a").groupBy("b").agg(F.max_by("a", F.struct("shares", "a")).alias("a"))
        new = linked(pairs.select("a", "b"))
        links = stored(new if links is None else links.unionByName(new))

    names = named(links)
    spread = placed(members.select("sig", "set_id"), names)
    mixed = materialize(parted(spread), "open-signatures")
    crowded = mixed.where(F.col("pairs") > SPLIT_PAIRS)
    mixed = mixed.where(F.col("pairs") <= SPLIT_PAIRS).drop("pairs")
    open_ = spread.join(mixed, "sig")
    if not crowded.isEmpty():
        finer = placed(split(spread.join(crowded, "sig", "left_semi").select("set_id").distinct()), names)
        finer = materialize(finer, "split-signatures")
        open_ = open_.unionByName(finer.join(parted(finer).drop("pairs"), "sig").select(open_.columns))
    open_ = materialize(open_.join(about, "set_id"), "open")
    probes = open_.where("component <> top")
    apart = (F.col("p.component") != F.col("q.component")) & ((F.col("q.component") == F.col("q.top")) | (F.col("p.set_id") < F.col("q.set_id")))
    pairs = probes.alias("p").join(open_.alias("q"), (F.col("p.sig") == F.col("q.sig")) & apart & like("p", "q")).select(F.col("p.set_id").alias("a"), F.col("q.set_id").alias("b")).distinct()
    links = stored(links.unionByName(linked(pairs)))
    return materialize(placed(prints.drop("bits", "wide", "stray"), named(links)), "placed")


def similar_documents(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of linked documents: key, n_shingles, component_id.

    Two documents link when 100 * |common n-grams| >= percent * |all of both|;
    a component holds all that are reachable by links, and is named by its
    smallest key.  Words are runs of bytes other than white space, A-Z
    lower-cased.  Texts without words (null too) link with nothing; a text
    of fewer than ``words`` words has one n-gram.  Keys are of any type with an
    order.  Null keys stay in the result with the component of their text and
    name none; a component of null keys alone has a null name.  Rows with equal
    keys are told apart by their texts.  Sets are told apart by 64-bit hashes.

    Documents of equal sets are one class; only classes make signatures.  To
    find components, not all pairs of a signature need be verified: in two
    rounds classes are tried with the FRONT first ones in other components of
    their signatures that sizes and bitmaps allow, first being those that share
    most signatures with others; in the first round each with one.  Then all
    pairs of a signature that are still in different components are tried,
    which takes only classes outside its largest component against the rest.
    Where these pairs would be over SPLIT_PAIRS, as in a signature of a passage
    that very many texts share, its classes meet by their rarest tokens instead,
    as many as any link needs.  No pair is verified twice.
    """
    placed = _components(docs, words, percent, key, text)
    # A table of its own, so that a component of very many rows can be split when joined.
    least = materialize(placed.where("component is not null").groupBy("component").agg(F.min("doc").alias("component_id")), "names")
    out = join_sized(placed, least, "component", "left", row_bytes=24)
    return out.select(F.col("doc").alias(key), "n_shingles", F.coalesce("component_id", "doc").alias("component_id"))


def keep_one(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` of each component, with all columns, and all rows without words.

    The row with the smallest key stays, null keys last; of rows with that key,
    the one whose text has the smallest hash; of equal rows, any one.
    """
    placed = _components(docs, words, percent, key, text).where("component is not null")
    rank = F.struct(F.col("doc").isNull(), F.col("doc"), F.col("text_hash"))
    first = materialize(placed.groupBy("component").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1"), "groups")
    rows = join_sized(placed, first, "component", "inner", row_bytes=60)
    rows = materialize(rows.select(F.col("doc").alias("__doc"), F.col("text_hash").alias("__hash"), (rank == F.col("first")).alias("__first")), "grouped-rows")
    same = (F.col(key).eqNullSafe(F.col("__doc"))) & (F.xxhash64(F.col(text)) == F.col("__hash"))
    gone = materialize(rows.where("not __first").select("__doc", "__hash").distinct(), "copies")
    kept = join_sized(docs, gone, same, "left_anti", row_bytes=40)
    # The first row itself may be there several times.
    twice = materialize(rows.where("__first").groupBy("__doc", "__hash").count().where("count > 1").drop("count"), "repeats")
    if twice.isEmpty():
        return kept
    again = join_sized(kept, twice, same, "left_semi", row_bytes=40)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    again = again.groupBy(F.col(key).alias("__doc"), F.xxhash64(F.col(text)).alias("__hash")).agg(F.first(row).alias("row")).select("row.*")
    return join_sized(kept, twice, same, "left_anti", row_bytes=40).unionByName(again)
