"""Mixing sources to target weights by systematic sampling, natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.llm._common import join_sized, materialize, words_of

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: A source is taken at most so many times.
MAX_EPOCHS = 3
#: Documents of one size in one source are numbered in 16 parts, by a digit of
#: their digest, and in 16 times as many for every 16-fold of so many rows.
PART_ROWS = 1_000_000
SEED = "mix-1"


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: source, source_size, weight, target.

    Targets share the total by weight, held to ``max_epochs`` times the source;
    what is over goes to the rest by weight until none is above.  That fixed
    point is the level ``x`` at which the sum of min(cap, x * weight) is the
    total: sources are capped in the order of cap / weight, and the first
    prefix after which no further one exceeds its cap gives the level.  Both
    windows run over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = left.cast("double") / share
    # The level if this source and all later ones are not capped; the first that fits holds.
    fits = F.when(level * F.col("weight") <= F.col("cap"), level)
    level = F.min(F.struct(F.when(fits.isNull(), 1).otherwise(0).alias("no"), F.col("rank").alias("rank"), F.col("level").alias("level"))).over(everything)
    per = per.withColumn("level", fits).withColumn("rank", F.row_number().over(order)).withColumn("level", level["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return per.select("source", "source_size", "weight", target.alias("target"))


def _digest(key: Column) -> Column:
    return F.md5(F.coalesce(key.cast("string"), F.lit("null")))


def _digits(rows: int) -> int:
    """Digits of the digest that make a part, so that parts of a hot size don't grow."""
    n = 1
    while PART_ROWS * 16**n < 16 * rows:
        n += 1
    return n


def _copies(docs: DataFrame, weights: tuple[int, ...], max_epochs: int, seed: str, key: str, source: str, text: str) -> DataFrame:
    """As ``copies``, with the text's hash."""
    size = F.size(words_of(F.col(text))).cast("long")
    slim = docs.select(F.col(key).alias(key), F.col(source).alias("source"), size.alias("size"), F.xxhash64(F.col(text)).alias("text_hash"))
    sized = materialize(slim, "mix-sizes")
    targets = source_targets(sized, weights, max_epochs)
    marked = sized.withColumn("digest", _digest(F.col(key))).withColumn("part", F.substring("digest", 1, _digits(sized.count())))
    parts = marked.groupBy("source", "size", "part").agg(F.count("*").alias("n"))
    in_size = W.partitionBy("source", "size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("before_part", F.coalesce(F.sum("n").over(in_size), F.lit(0)))
    sizes = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    in_source = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("before_size", F.coalesce(F.sum("n").over(in_source), F.lit(0))).drop("n")
    same = lambda a, b, *cols: [a[c].eqNullSafe(b[c]) for c in cols]
    starts = parts.join(sizes, same(parts, sizes, "source", "size")).select(parts["source"], parts["size"], "part", (F.col("before_part") + F.col("before_size")).alias("start"))
    starts = starts.join(targets, same(starts, targets, "source")).select(starts["source"], "size", "part", "start", "source_size", "target")
    placed = marked.withColumn("k", F.row_number().over(W.partitionBy("source", "size", "part").orderBy("digest", "text_hash")))
    placed = placed.join(starts, same(placed, starts, "source", "size", "part")).select(placed[key], placed["source"], placed["size"], "text_hash", "k", "start", "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce("source", F.lit("null")))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    upto = lambda n: F.floor(rate * n + offset)
    nth = F.col("start") + F.col("k")
    placed = placed.withColumn("copies", F.least(upto(nth) - upto(nth - 1), F.lit(max_epochs)).cast("long"))
    return placed.select(key, "source", "size", "text_hash", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def copies(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """How often the mix takes each document: key, source, size, source_size, target, copies, taken.

    Within its source every document is expected target / source_size times.
    The prefix sum of these runs over the documents by size, then by a digest
    of the key; with one random offset per source, a document is emitted once
    for each whole number that its stretch crosses.  As neighbours are of like
    size, the words taken come within about one document of the target.  The
    running number is put together from counts of (source, size), then of
    (source, size, part of the digest), so no source is walked by one task.

    Null texts and texts without words have size 0.  Null sources are one
    source, weighed last.  Repeated rows are mixed each; which of equal rows is
    taken more often makes no difference.  Reruns agree.
    """
    return _copies(docs, weights, max_epochs, seed, key, source, text).drop("text_hash")


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as ``copies`` says, with all columns.

    Rows find their number by key.  Those with a key that is null or there
    several times find it by source and hash of the text too; of rows equal in
    all these one stands for all, as often as they are taken together.
    """
    key_, source_, hash_ = F.col(key), F.col(source), F.xxhash64(F.col(text))
    taken = _copies(docs, weights, max_epochs, seed, key, source, text).select(key_.alias("__key"), F.col("source").alias("__source"), F.col("text_hash").alias("__hash"), F.col("copies").alias("__copies"))
    taken = materialize(taken, "mix-copies")
    often = materialize(taken.groupBy("__key").agg(F.count("*").alias("__n")).where("__n > 1 or __key is null").drop("__n"), "mix-keys")
    same = key_.eqNullSafe(F.col("__key"))
    times = lambda df: df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(docs.columns)
    if often.isEmpty():
        return times(join_sized(docs, taken.where("__copies > 0"), key_ == F.col("__key"), "inner", row_bytes=60))
    one = materialize(join_sized(taken, often.select(F.col("__key").alias("__often")), F.col("__key").eqNullSafe(F.col("__often")), "left_anti", row_bytes=40).where("__copies > 0"), "mix-single")
    single = times(join_sized(docs, one, key_ == F.col("__key"), "inner", row_bytes=60))
    several = join_sized(taken, often.select(F.col("__key").alias("__often")), F.col("__key").eqNullSafe(F.col("__often")), "left_semi", row_bytes=40)
    several = materialize(several.groupBy("__key", "__source", "__hash").agg(F.sum("__copies").alias("__copies")).where("__copies > 0"), "mix-several")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = join_sized(docs, often, same, "left_semi", row_bytes=40).groupBy(key_.alias("k"), source_.alias("s"), hash_.alias("h")).agg(F.first(row).alias("row"))
    on = F.col("k").eqNullSafe(F.col("__key")) & F.col("s").eqNullSafe(F.col("__source")) & (F.col("h") == F.col("__hash"))
    rows = join_sized(rows, several, on, "inner", row_bytes=80)
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select("row.*")
    return single.unionByName(rows)
