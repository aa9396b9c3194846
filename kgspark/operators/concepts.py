"""Concept candidates from model replies.

A reply row is (doc_id, block_id, ord, raw_output); candidates carry their
place, so that "the first" is always the least (block order, place in reply).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions import json_text as J
from kgspark.functions import numbers as N
from kgspark.functions import text as T

MIN_TEXT = 20
MIN_CONFIDENCE = 0.5
DEFAULT_CONFIDENCE = 0.6
MOST_WORDS = 25
#: The parts of items that are read.
_ITEMS = "array<struct<name variant, type variant, description variant, confidence variant>>"


def eligible(blocks: DataFrame) -> DataFrame:
    """Blocks with at least MIN_TEXT characters."""
    return blocks.where(F.length(T.strip(F.col("text"))) >= MIN_TEXT)


def prompts(blocks: DataFrame, short: bool = False) -> DataFrame:
    """Adds the prompt for a model: context, text and the form of the answer."""
    path = F.when(F.size("heading_path") > 0, F.array_join("heading_path", " > ")).otherwise("No heading context")
    ask = "List the concepts of the text as JSON." if short else 'Name the concepts that the text explains. Answer with JSON only: {"concepts": [{"name", "type", "description", "confidence"}]}.'
    return blocks.withColumn("prompt", F.concat(F.lit(ask), *([] if short else [F.lit("\nContext: "), path]), F.lit("\nText: "), "text"))


def parse(replies: DataFrame, parity: bool = False) -> DataFrame:
    """Candidates: doc_id, block_id, ord, place, name, type, description, confidence.

    Items that aren't objects, or have no name, or a name or description that
    isn't text, are dropped one by one.  Defaults: type core_concept, the name
    as description, confidence 0.6; confidence is held to 0..1, and long
    descriptions end after 25 words.  A top-level array is read too unless
    ``parity``.
    """
    # A reply is parsed once, and an item read once, before there is a row for it.
    whole = F.try_parse_json(J.json_of(F.col("raw_output"), arrays=not parity))
    read = replies.select("doc_id", "block_id", "ord", whole.alias("v"))
    items = F.try_variant_get("v", "$.concepts", _ITEMS)
    items = items if parity else F.coalesce(items, F.try_variant_get("v", "$", _ITEMS))
    text = lambda v: F.try_variant_get(v, "$", "string")
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    number = lambda v: J.clamp(F.coalesce(J.as_number(text(v)), F.lit(DEFAULT_CONFIDENCE)))
    one = lambda x: F.struct(
        F.when(is_text(x["name"]) & F.coalesce(is_text(x["description"]), F.lit(True)), text(x["name"])).alias("name"),
        F.when(is_text(x["type"]), text(x["type"])).otherwise("core_concept").alias("type"),
        text(x["description"]).alias("description"),
        number(x["confidence"]).alias("confidence"),
    )
    rows = read.select("doc_id", "block_id", "ord", F.posexplode(F.transform(items, one)).alias("place", "item")).where("item.name is not null")
    name = F.col("item.name")
    description = F.coalesce("item.description", name)
    many = T.words(description)
    cut = F.when(F.size(many) > MOST_WORDS, F.concat(F.array_join(F.slice(many, 1, MOST_WORDS), " "), F.lit("..."))).otherwise(description)
    return rows.select("doc_id", "block_id", "ord", "place", name.alias("name"), F.col("item.type").alias("type"), cut.alias("description"), F.col("item.confidence").alias("confidence"))


def is_valid(name: Column, type_: Column, description: Column, confidence: Column) -> Column:
    """Whether a candidate has all parts."""
    return (T.strip(name) != "") & type_.isNotNull() & description.isNotNull() & confidence.between(0, 1)


def _best(rows: DataFrame, *by: Column) -> DataFrame:
    best = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("confidence"), "ord", "place"))
    return rows.withColumn("__k", best).where("__k = 1").drop("__k")


def filter_candidates(rows: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Named, not generic, confident enough; one per lower-cased name and block."""
    kept = rows.where((T.strip(F.col("name")) != "") & ~T.is_generic(F.col("name")) & (F.col("confidence") >= min_confidence))
    return _best(kept, F.col("doc_id"), F.col("block_id"), F.lower(T.strip(F.col("name"))))


def dedup_documents(rows: DataFrame) -> DataFrame:
    """One per exact name and document, the most confident, then the first."""
    return _best(rows, F.col("doc_id"), T.strip(F.col("name")))


def with_provenance(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds concept_id and the block's heading path."""
    ident = T.short_hash(F.col("block_id"), F.lower(F.col("name")))
    return rows.join(blocks.select("block_id", "heading_path"), "block_id").withColumn("concept_id", ident).withColumnRenamed("block_id", "source_block_id")


def failures(replies: DataFrame, parity: bool = False) -> DataFrame:
    """Blocks whose reply gives no candidates: doc_id, block_id, reason.

    One document's bad replies are rows here and don't stop the others.
    """
    raw = F.coalesce("raw_output", F.lit(""))
    read = parse(replies, parity).select("doc_id", "block_id").distinct()
    reason = F.when(T.strip(raw) == "", "no reply").when(F.try_parse_json(J.json_of(raw, arrays=not parity)).isNull(), "no JSON").otherwise("no concepts")
    return replies.join(read, ["doc_id", "block_id"], "left_anti").select("doc_id", "block_id", reason.alias("reason"))


def run_counters(replies: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Per document: blocks, failed (no reply), raw and kept candidates."""
    blocks = replies.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.count_if(T.strip(F.coalesce("raw_output", F.lit(""))) == "").alias("n_failed"))
    raw = parse(replies)
    kept = filter_candidates(raw, min_confidence).groupBy("doc_id").agg(F.count("*").alias("n_kept"))
    raw = raw.groupBy("doc_id").agg(F.count("*").alias("n_raw"))
    joined = blocks.join(raw, "doc_id", "left").join(kept, "doc_id", "left")
    return joined.select("doc_id", "n_blocks", "n_failed", F.coalesce("n_raw", F.lit(0)).alias("n_raw"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


def summary(rows: DataFrame) -> DataFrame:
    """Per type: candidates, share in percent, average confidence."""
    counts = rows.groupBy("type").agg(F.count("*").alias("n"), N.rounded(N.mean(F.col("confidence")), 4).alias("avg_confidence"))
    return counts.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 1))  # a row per type


def top(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.desc("confidence"), "name", "doc_id", "ord", "place").limit(n)
