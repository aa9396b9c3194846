"""Best-fit packing of token pieces by patterns of lengths."""

from __future__ import annotations

import bisect
import itertools
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.llm._common import materialize, slices

#: Tokens of a sequence, and the id that ends each document.
CAPACITY = 4096
END_ID = 1
#: Grid of the patterns: lengths are rounded up to multiples of CAPACITY / GRID.
GRID = 64
#: Most pieces of a pattern.
MOST = 4
#: Words kept per Python worker between documents; only speed depends on it.
CACHE_WORDS = 1_600_000
#: Pieces of one length are numbered in parts of about so many.
PART_ROWS = 500_000


class WordTokens:
    """Ids of whole texts, each distinct word encoded by the tokenizer once.

    Words are told apart by Arrow, and ids of its dictionary put in their order,
    so that Python sees each word once a batch.

    The tokenizer's pattern never crosses white space and its normaliser works
    on single characters, so ids of a text are those of its words in order;
    the exceptions (special tokens, separators that only Python calls white
    space) go through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        # Folded words of letters only need no normaliser.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = self.tokenizer.pre_tokenizer
        self.cache: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _folded(self, text: str) -> str | None:
        """The text as the tokenizer's normaliser leaves its words; None if it is an exception."""
        if any(x in text for x in self.special) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return None
        if not text.isascii():
            # str.lower() alone would write a final sigma at word ends.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def _learn(self, words: list[str]) -> None:
        """Take distinct words into the cache."""
        if len(self.cache) + len(words) > CACHE_WORDS:
            self.cache.clear()
        known = self.cache
        letters, odd, marked = set(), set(), []
        for w in words:
            if w in known:
                continue
            if w.isalpha():
                letters.add(w)
            elif (core := w.rstrip(punctuation))[-1:].isalpha():
                # Marks after a last letter are a piece of their own.
                marked.append((w, core, tail := w[len(core) :]))
                (letters if core.isalpha() else odd).add(core)
                odd.add(tail)
            else:
                odd.add(w)
        self._learn_letters([w for w in letters if w not in known])
        self._learn_singly([w for w in odd if w not in known])
        for w, core, tail in marked:
            known[w] = known[core] + known[tail]

    def _learn_letters(self, words: list[str]) -> None:
        """Words of letters only are one piece each, which ends in an id with ``</w>``."""
        for i in range(0, len(words), 500):
            some = words[i : i + 500]
            ids = np.array(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):
                self._learn_singly(some)
                continue
            flat, begin = ids.tobytes(), 0
            for w, cut in zip(some, (4 * cuts).tolist(), strict=True):
                self.cache[w] = flat[begin:cut]
                begin = cut

    def _learn_singly(self, words: list[str]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.cache[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes | memoryview]:
        """Little-endian 32-bit ids of each text."""
        folded = [self._folded(t) for t in texts]
        split = pc.utf8_split_whitespace(pa.array([t or "" for t in folded], pa.string()))
        words = split.flatten().dictionary_encode()
        different = words.dictionary.to_pylist()
        self._learn(different)
        ids = pa.array(map(self.cache.__getitem__, different), pa.large_binary(), size=len(different)).take(words.indices)
        _, ends, data = ids.buffers()
        at = np.frombuffer(ends, np.int64)[split.offsets.to_numpy()].tolist()
        flat = memoryview(data or b"")
        return [self._plain(t) if f is None else flat[b:e] for t, f, b, e in zip(texts, folded, at[:-1], at[1:], strict=True)]


_loaded: dict[str, WordTokens] = {}


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of the documents' ids: key, piece, start, length, ids_crc32.

    Ids of a text, null counting as empty, then END_ID; only what is longer
    than ``capacity`` is cut.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _loaded:
            _loaded[tokenizer] = WordTokens(tokenizer)
        tokens = _loaded[tokenizer]
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for part, texts in slices(batch, 1):
                rows = []
                for k, ids in enumerate(tokens.encode([t or "" for t in texts])):
                    whole = b"".join((ids, end))
                    for n, begin in enumerate(range(0, len(whole), 4 * capacity)):
                        piece = whole[begin : begin + 4 * capacity]
                        rows.append((k, n, begin // 4, len(piece) // 4, zlib.crc32(piece)))
                cols = np.array(rows, np.int64).T
                yield pa.RecordBatch.from_arrays([part[0].take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), *map(pa.array, cols[2:])], names=[key, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(cut, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def patterns(grid: int = GRID, most: int = MOST) -> list[tuple[int, ...]]:
    """Falling tuples of at most ``most`` sizes that fill the grid exactly."""
    found: list[tuple[int, ...]] = []

    def extend(done: tuple[int, ...], left: int, top: int) -> None:
        if not left:
            found.append(done)
        elif len(done) < most:
            for size in range(min(left, top), 0, -1):
                extend((*done, size), left - size, size)

    extend((), grid, grid)
    return found


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares, by accelerated projected gradient."""
    gram, target = a.T @ a, a.T @ b
    step = 1 / np.linalg.eigvalsh(gram)[-1]
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (gram @ y - target))
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / u * (new - x)
        x, t = new, u
    return x


class Plan:
    """Where the n-th piece of a length goes, as runs over whole counts.

    A run is ``count`` sequences alike; ``take`` gives the lengths in it, and
    the numbers of the pieces start at a running count per length.
    """

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, grid: int = GRID, most: int = MOST) -> None:
        self.capacity = capacity
        self.left = dict(histogram)
        self.used: dict[int, int] = defaultdict(int)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.sequences = 0
        self._patterns(grid, most)
        self._residuals()

    def _place(self, length: int, first: int, count: int, offset: int) -> None:
        """The next ``count`` pieces of a length go to sequences from ``first`` on."""
        self.rows.append((length, self.used[length], count, first, offset))
        self.used[length] += count
        self.left[length] -= count

    def _patterns(self, grid: int, most: int) -> None:
        width = -(-self.capacity // grid)
        bins: dict[int, list[int]] = defaultdict(list)
        for length in sorted(self.left, reverse=True):
            bins[-(-length // width)].append(length)
        have = np.zeros(grid + 1)
        for b, lengths in bins.items():
            have[b] = sum(self.left[x] for x in lengths)
        forms = [p for p in patterns(grid, most) if all(have[b] for b in p)]
        if not forms:
            return
        a = np.zeros((grid + 1, len(forms)))
        for k, form in enumerate(forms):
            for b in form:
                a[b, k] += 1
        # Long pieces have the fewest places to go, so their errors weigh more.
        weight = np.sqrt(np.arange(grid + 1) + 1.0)
        repeats = np.rint(nnls(a * weight[:, None], have * weight)).astype(int)
        there = sorted(x for x, n in self.left.items() if n)
        for k in np.argsort(-np.array([max(f) for f in forms]), kind="stable"):
            form, n = forms[k], int(repeats[k])
            while n > 0:
                # A pattern's last place is filled with what fits best.
                picks: list[int] = []
                taken: dict[int, int] = defaultdict(int)
                for b in form[:-1]:
                    x = next((x for x in bins[b] if self.left[x] > taken.get(x, 0)), None)
                    if x is None:
                        break
                    picks.append(x)
                    taken[x] += 1
                if len(picks) < len(form) - 1:
                    break
                room = self.capacity - sum(picks)
                at = bisect.bisect_right(there, room) - 1
                while at >= 0 and self.left[there[at]] <= taken.get(there[at], 0):
                    if not self.left[there[at]]:
                        there.pop(at)
                    at -= 1
                if at < 0 or there[at] <= room - 2 * width:
                    break
                picks.append(there[at])
                taken[there[at]] += 1
                # As long a run as one length of each place allows.
                run = min([n, *(self.left[x] // m for x, m in taken.items())])
                offset, first = 0, self.sequences
                for x in picks:
                    self._place(x, first, run, offset)
                    offset += x
                self.sequences += run
                self.open[self.capacity - offset].append((first, run))
                n -= run

    def _residuals(self) -> None:
        """Best fit of what is left, longest first, into the tightest open room."""
        rooms = sorted(r for r, runs in self.open.items() if r and runs)
        for length in sorted((x for x, n in self.left.items() if n), reverse=True):
            while self.left[length]:
                at = bisect.bisect_left(rooms, length)
                if at == len(rooms):
                    fit = self.capacity // length
                    count = max(1, self.left[length] // fit)
                    self.open[self.capacity].append((self.sequences, count))
                    self.sequences += count
                    rooms.append(self.capacity)
                    continue
                room = rooms[at]
                first, run = self.open[room].pop()
                if not self.open[room]:
                    rooms.pop(at)
                count = min(run, self.left[length])
                if count < run:
                    if not self.open[room]:
                        rooms.insert(at, room)
                    self.open[room].append((first + count, run - count))
                self._place(length, first, count, self.capacity - room)
                if room > length:
                    if not self.open[room - length]:
                        bisect.insort(rooms, room - length)
                    self.open[room - length].append((first, count))


def pack(cut: DataFrame, *, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to ``pieces``.

    Only the histogram of lengths, ``capacity`` counts at most, comes to the
    driver.  There patterns of up to MOST lengths on a grid are fitted to it by
    non-negative least squares and rounded; pieces they leave over are packed
    best fit.  The plan says for the n-th piece of each length where it goes,
    and pieces are numbered within their length in parts, so that a length
    that a third of all pieces share is not numbered by one task.

    Equal pieces, null keys and repeated rows are packed each.  An empty text
    is one piece of one id; an empty table gives none.
    """
    # As many parts as the pieces of the commonest length need.
    most = cut.groupBy("length").count().agg(F.max("count")).first()[0] or 1
    part = F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(-(-most // PART_ROWS))).cast("int")
    cut = cut.withColumn("__part", part)
    counts = cut.groupBy("length", "__part").agg(F.count("*").alias("n"))
    # A count for each length and part: at most 4096 by one for every PART_ROWS pieces of one length.
    got = counts.collect()
    histogram: dict[int, int] = defaultdict(int)
    starts = []
    for r in sorted(got, key=lambda r: (r["length"], r["__part"])):
        starts.append((r["length"], r["__part"], histogram[r["length"]]))
        histogram[r["length"]] += r["n"]
    plan = Plan(histogram, capacity)
    spark = cut.sparkSession
    columns = [np.array(c, np.int64) for c in zip(*starts, strict=True)] if starts else [np.zeros(0, np.int64)] * 3
    begin = spark.createDataFrame(pa.table(dict(zip(("length", "__part", "__before"), columns, strict=True)))).withColumn("__part", F.col("__part").cast("int"))
    numbered = cut.withColumn("__k", F.row_number().over(W.partitionBy("length", "__part").orderBy(key, "piece", "start", "ids_crc32")))
    numbered = numbered.join(F.broadcast(begin), ["length", "__part"]).withColumn("__n", F.col("__k") - 1 + F.col("__before"))

    # The runs of each length, in order: a piece finds its own by bisection.
    runs = {length: tuple(np.array(c) for c in zip(*[r[1:] for r in rows], strict=True)) for length, rows in itertools.groupby(sorted(plan.rows), key=lambda r: r[0])}
    sent = spark.sparkContext.broadcast(runs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            length, n = batch["length"].to_numpy(), batch["__n"].to_numpy()
            sequence, offset = np.empty_like(n), np.empty_like(n)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                first, _, begins, places = table[int(x)]
                run = np.searchsorted(first, n[own], side="right") - 1
                sequence[own] = begins[run] + n[own] - first[run]
                offset[own] = places[run]
            names = [key, "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kind = cut.schema[key].dataType.simpleString()
    out = numbered.select(key, "piece", "start", "length", "ids_crc32", "__n")
    return out.mapInArrow(place, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize, cut and pack: one row per piece with its place."""
    return pack(materialize(pieces(docs, tokenizer, capacity=capacity, key=key, text=text), "pieces"), capacity=capacity, key=key)
