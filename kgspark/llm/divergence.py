"""Source divergence audit: terms counted by digest, their texts joined back late."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.llm._common import fits_broadcast, join_sized, materialize, split_terms

#: Letters, lower-cased if ASCII, and bytes of other characters; the rest of ASCII ends a term.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: A kept term is in so many documents of its language at least; scale of p; ranks of terms.
MIN_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: Sources of a language that are compared as one block.
BLOCK = 256
#: Counts that a task holds before it sends them on, and elements of a step over matrices.
HELD, STEP = 400_000, 1 << 21


def _digest(term: Column, bits: int) -> Column:
    """Of 64 bits, or of fewer in tests."""
    full = F.xxhash64(term)
    return full if bits == 64 else F.pmod(full, F.lit(1 << bits))


def _p(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (N + 2 V)) without overflow, for V > 0."""
    wide = lambda c: c.cast("decimal(20,0)")
    top, bottom = wide(n + 2) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + 2 * kept)
    return (F.lit(1) + F.call_function("div", top, F.when(bottom != 0, bottom)).cast("long")).cast("long")


def _f(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most SCALE + 1, so squares fit 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _group(seed: int) -> Column:
    return F.xxhash64("lang", "source", F.lit(seed)).alias("gid")


def count_terms(docs: DataFrame, key: str) -> DataFrame:
    """Counts of the terms of (key, text), added up by each task as far as it can: key, term, n, df.

    What follows hashes the terms before any shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[object, Counter] = defaultdict(Counter)
        df: dict[object, Counter] = defaultdict(Counter)
        held = 0

        def emit(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            for k, counts in n.items():
                terms, documents = list(counts), df[k]
                for begin in range(0, len(terms), 100_000):
                    part = terms[begin : begin + 100_000]
                    columns = [pa.array([k] * len(part), kind), pa.array(part, pa.binary()).cast(pa.string()), pa.array([counts[t] for t in part], pa.int64()), pa.array([documents[t] for t in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "term", "n", "df"])
            n.clear()
            df.clear()

        for batch in batches:
            kind, texts = batch[0].type, batch[1].cast(pa.binary())
            for i, k in enumerate(batch[0].to_pylist()):
                own, before, seen = n[k], len(n[k]), set()
                for terms in split_terms(texts[i].as_py() or b"", _TERMS):
                    own.update(terms)
                    seen.update(terms)
                df[k].update(seen)
                held += len(own) - before
                if held > HELD:
                    yield from emit(kind)
                    held = 0
        if n:
            yield from emit(kind)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(count, f"{key} {kind}, term string, n long, df long")


def dictionary(docs: DataFrame, wanted: DataFrame, bits: int = 64) -> DataFrame:
    """Each text of the wanted digests, once per language: lang, digest, term.

    ``docs`` is (lang, text), ``wanted`` a written table of (lang, digest).
    Only wanted terms, and each once per task, are shuffled.
    """
    rows = count_terms(docs, "lang").select("lang", _digest(F.col("term"), bits).alias("digest"), "term")
    if fits_broadcast(wanted, 40):
        return rows.join(F.broadcast(wanted), ["lang", "digest"], "left_semi").distinct()
    return rows.distinct().join(wanted, ["lang", "digest"], "left_semi")


def _split(docs: DataFrame, counts: DataFrame, words: DataFrame, langs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Counts and dictionary with a part number per text of each digest that several share.

    ``docs`` is (gid, text), ``langs`` (gid, lang); a digest has a collision
    where the smallest and the largest of its texts differ.
    """
    ends = words.groupBy("lang", "digest").agg(F.min("term").alias("least"), F.max("term").alias("most"))
    mixed = materialize(ends.where("least <> most").select("lang", "digest"), "collisions")
    if mixed.isEmpty():
        return counts, words.withColumn("part", F.lit(0))
    numbered = words.withColumn("part", F.row_number().over(W.partitionBy("lang", "digest").orderBy("term")) - 1)
    of_mixed = materialize(numbered.join(mixed, ["lang", "digest"], "left_semi"), "split-terms")
    rows = join_sized(count_terms(docs, "gid"), langs, "gid", "inner", 64)
    again = join_sized(rows, of_mixed, ["lang", "term"], "inner", 64).groupBy("gid", "digest", "part").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    kept = counts.join(langs, "gid").join(mixed, ["lang", "digest"], "left_anti").select(counts.columns)
    return kept.unionByName(again), numbered


def audit(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP, bits: int = 64, block: int = BLOCK, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """How far the sources of a language are from each other: lang, source, part, item, value, rank.

    Part "pair" has each other source of the language, part "term" the terms
    that a source has more of than its language; the module's constants and
    ``_p`` and ``_f`` give the arithmetic, all in whole numbers.  Nulls count
    as '', every row is a document, and columns beside the three named play no
    part.  A group without terms, or a language without kept terms, still has
    its pairs; an empty table gives no rows.

    Terms are counted by task and shuffled as 64-bit digests.  Digests that may be kept get their texts
    from a second reading; where the smallest and largest text of one differ,
    it is counted again by text.  Texts join just the terms that can be ranked.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    groups = plain.groupBy("lang", "source").agg(F.count("*").alias("n_docs"))
    # A row per source: within a language as many as the result has per source.
    groups = groups.withColumn("src", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
    groups = materialize(groups, "groups")
    # Groups are named by hash, so texts need no join; a seed under which two share a name is passed over.
    seed = next(k for k in range(64) if groups.select(_group(k)).distinct().count() == groups.count())
    groups = groups.withColumn("gid", _group(seed))
    named = plain.select(_group(seed), "text")

    # Longs only from here on: terms don't leave the task.
    hashed = count_terms(named, "gid").groupBy("gid", _digest(F.col("term"), bits).alias("digest")).agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    counts = materialize(hashed.withColumn("part", F.lit(0)), "term-counts")
    by_lang = join_sized(counts, groups.select("gid", "lang"), "gid", "inner", 64)
    likely = materialize(by_lang.groupBy("lang", "digest").agg(F.sum("df").alias("df")).where(F.col("df") >= min_docs).select("lang", "digest"), "likely-terms")
    words = materialize(dictionary(plain, likely, bits), "term-texts")
    counts, words = _split(named, counts, words, groups.select("gid", "lang"), bits)

    term = ["lang", "digest", "part"]
    by_lang = join_sized(counts, groups.select("gid", "lang", "src"), "gid", "inner", 64)
    totals = by_lang.groupBy(*term).agg(F.sum("df").alias("df"), F.sum("n").alias("lang_n")).where(F.col("df") >= min_docs).drop("df")
    kept = materialize(by_lang.join(totals, term).select(*term, "gid", "src", "n", "lang_n"), "kept-counts")

    sums = kept.groupBy("lang", "gid").agg(F.sum("n").alias("total"))
    vocabulary = kept.select(*term, "lang_n").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    sized = groups.join(sums.drop("lang"), "gid", "left").join(vocabulary, "lang", "left")
    sized = materialize(sized.select("lang", "source", "src", "gid", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "v", "lang_total")]), "sized-groups")
    return _pairs(kept, sized, block).unionByName(_terms(kept, sized, words, top))


def _terms(kept: DataFrame, sized: DataFrame, words: DataFrame, top: int) -> DataFrame:
    rows = join_sized(kept.drop("lang", "src"), sized.select("gid", "lang", "source", "total", "v", "lang_total"), "gid", "inner", 128)
    p, q = _p(F.col("n"), F.col("total"), F.col("v")), _p(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    rows = rows.select("lang", "source", "digest", "part", p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "digest", "part", _f(F.col("p"), F.col("q")).alias("value"))
    # All that tie with the last rank get their texts, which then decide.
    by = W.partitionBy("lang", "source")
    best = rows.withColumn("__r", F.rank().over(by.orderBy(F.desc("value")))).where(F.col("__r") <= top).drop("__r")
    texts = best.join(words, ["lang", "digest", "part"])
    rank = F.row_number().over(by.orderBy(F.desc("value"), "term"))
    return texts.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pairs(kept: DataFrame, sized: DataFrame, block: int) -> DataFrame:
    """Sums of f over all kept terms, for each two sources of a language.

    A term is a row per block of sources, with p of each of them; two blocks of
    a term meet, and a task adds up their matrix, so it sends one sum per two
    sources.  No two sources are paired as rows.
    """
    own = sized.withColumn("block", F.floor(F.col("src") / block).cast("int"))
    zero = _p(F.lit(0).cast("long"), F.col("total"), F.col("v"))
    # A row per block: what a source has of a term it doesn't hold, in order of the sources.
    of_block = F.sort_array(F.collect_list(F.struct("src", F.struct(zero.alias("zero"), F.col("total").alias("total")).alias("x"))))
    bases = own.where("v > 0").groupBy("lang", "block").agg(of_block.alias("s"), F.first("v").alias("v"))
    bases = bases.select("lang", "block", "v", F.transform("s", lambda s: s["x"]["zero"]).alias("zeros"), F.transform("s", lambda s: s["x"]["total"]).alias("sums"))
    bases = materialize(bases, "blocks")
    held = kept.select("lang", "digest", "part", F.floor(F.col("src") / block).cast("int").alias("block"), "src", "n")
    # Every term meets every block of its language, also those that don't hold it.
    each = join_sized(kept.select("lang", "digest", "part").distinct(), bases.select("lang", "block"), "lang", "inner", 64)
    wide = held.groupBy("lang", "digest", "part", "block").agg(F.collect_list(F.struct(F.pmod("src", F.lit(block)).cast("int").alias("at"), "n")).alias("held"))
    wide = each.join(wide, ["lang", "digest", "part", "block"], "left")
    wide = join_sized(wide, bases, ["lang", "block"], "inner", 64 + 16 * block)
    got = lambda s: _p(s["n"], F.get("sums", s["at"]), F.col("v"))
    # Sources are the collected places and their p; the rest stay at the base.
    wide = wide.select("lang", "digest", "part", "block", F.transform("held", lambda s: s["at"]).alias("at"), F.transform("held", got).alias("p"), "zeros")
    other = wide.select("lang", "digest", "part", F.col("block").alias("block_b"), F.col("at").alias("at_b"), F.col("p").alias("p_b"), F.col("zeros").alias("zeros_b"))
    many = sized.where(F.col("src") >= block).limit(1).count()
    two = wide.join(other, ["lang", "digest", "part"]).where("block <= block_b") if many else wide.select("*", F.col("block").alias("block_b"), F.col("at").alias("at_b"), F.col("p").alias("p_b"), F.col("zeros").alias("zeros_b"))
    two = two.sortWithinPartitions("lang", "block", "block_b").select("lang", "block", "block_b", "at", "p", "zeros", "at_b", "p_b", "zeros_b")

    def dense(batch: pa.RecordBatch, end: str) -> np.ndarray:
        """p of every source of a block, a row per term."""
        base, at, p = (batch[c + end] for c in ("zeros", "at", "p"))
        out = base.flatten().to_numpy().reshape(batch.num_rows, -1).copy()
        sizes = at.value_lengths().fill_null(0).to_numpy()
        out[np.repeat(np.arange(batch.num_rows), sizes), at.flatten().to_numpy()] = p.flatten().to_numpy()
        return out

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def emit() -> pa.RecordBatch:
            name, a, b = now
            i, j = np.indices(total.shape).reshape(2, -1)
            return pa.RecordBatch.from_arrays([pa.array([name] * i.size, pa.string()), pa.array(i + a * block, pa.int32()), pa.array(j + b * block, pa.int32()), pa.array(total.reshape(-1))], names=["lang", "a", "b", "value"])

        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in ("lang", "block", "block_b")), strict=True))
            starts = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
            for begin, end in zip(starts, [*starts[1:], len(keys)], strict=True):
                run = batch.slice(begin, end - begin)
                p, q = dense(run, ""), dense(run, "_b")
                if keys[begin] != now:
                    if now:
                        yield emit()
                    now, total = keys[begin], np.zeros((p.shape[1], q.shape[1]), np.int64)
                step = max(1, STEP // total.size)
                for k in range(0, len(p), step):
                    a, b = p[k : k + step, :, None], q[k : k + step, None, :]
                    total += ((a - b) ** 2 // (a + b)).sum(0)
        if now:
            yield emit()

    sums = two.mapInArrow(add, "lang string, a int, b int, value long").where("a < b").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    end = lambda c, name: sized.select("lang", F.col("src").alias(c), F.col("source").alias(name))
    # Languages without kept terms have their pairs too; the result is a row per two sources.
    all_ = end("a", "source").join(end("b", "item"), "lang").where("a <> b").join(both, ["lang", "a", "b"], "left")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    rows = all_.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    return rows.withColumn("rank", rank)
