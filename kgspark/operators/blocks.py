"""Sections, heading paths and semantic blocks, keyed by document.

``content_blocks`` rows are (doc_id, position, type, tag, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.functions import text as T

SHORT, FEW, LONGEST = 100, 2, 5
WARN_TOKENS = 350


def _order() -> W:
    return W.partitionBy("doc_id").orderBy("position")


def with_sections(blocks: DataFrame) -> DataFrame:
    """Adds section (its number in the document, from 1), is_heading and level.

    A heading opens a section; content before any heading is in a section of
    its own, "Introduction" of level 1.
    """
    heading = F.col("type") == "heading"
    first = F.first(heading).over(_order().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    opened = F.sum(heading.cast("int")).over(_order().rowsBetween(W.unboundedPreceding, 0))
    level = F.when(heading, F.coalesce(F.regexp_extract("tag", r"^h([1-6])$", 1).try_cast("int"), F.lit(1)))
    return blocks.withColumns({"is_heading": heading, "section": (opened + F.when(first, 0).otherwise(1)).cast("int"), "level": level})


def with_paths(blocks: DataFrame) -> DataFrame:
    """``with_sections``, with the section's own_level and the headings open above it.

    ``open`` has (order_index, heading) of the section and those it lies in, the
    outermost first: the last heading of each level is carried along, and one
    is still open if no heading of a lower level came after it.
    """
    upto = _order().rowsBetween(W.unboundedPreceding, 0)
    marked = with_sections(blocks)
    head = F.struct(F.col("section").alias("order_index"), F.col("text").alias("heading"))
    last = {f"__l{k}": F.last(F.when(F.col("level") == k, head), ignorenulls=True).over(upto) for k in range(1, 7)}
    untitled = ~F.first("is_heading").over(_order().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    own = F.coalesce(F.last("level", ignorenulls=True).over(upto), F.lit(1))
    marked = marked.withColumns(last | {"__untitled": untitled, "own_level": own})
    intro = F.struct(F.lit(1).alias("order_index"), F.lit("Introduction").alias("heading"))
    marked = marked.withColumn("__l1", F.coalesce("__l1", F.when(F.col("__untitled"), intro)))

    def is_open(k: int) -> Column:
        at = F.col(f"__l{k}.order_index")
        return at.isNotNull() & (F.col("own_level") >= k) & (F.greatest(F.lit(0), F.lit(0), *[F.coalesce(F.col(f"__l{j}.order_index"), F.lit(0)) for j in range(1, k)]) < at)

    open_ = F.filter(F.array(*[F.when(is_open(k), F.col(f"__l{k}")) for k in range(1, 7)]), lambda x: x.isNotNull())
    return marked.withColumn("open", open_).drop("__untitled", *last)


def sections(blocks: DataFrame) -> DataFrame:
    """One row per section: doc_id, section_id, heading, level, order_index, parent_section_id, heading_path.

    A section's parent is the nearest earlier one of a lower level.
    """
    rows = with_paths(blocks).withColumn("__first", F.row_number().over(_order()) == 1).where("is_heading or __first")
    section_id = lambda c: F.concat(F.lit("sec_"), c.cast("string"))
    parent = F.get("open", F.size("open") - 2)["order_index"]
    return rows.select("doc_id", section_id(F.col("section")).alias("section_id"), F.element_at("open", -1)["heading"].alias("heading"), F.col("own_level").alias("level"), F.col("section").alias("order_index"), section_id(parent).alias("parent_section_id"), F.transform("open", lambda x: x["heading"]).alias("heading_path"))


def semantic_chunks(blocks: DataFrame) -> DataFrame:
    """Splits content blocks into chunks: adds chunk (from 0) and its text.

    Code, texts of under 100 characters and of at most two sentences stay
    whole.  Else a chunk ends after a sentence with a transition phrase or
    after five sentences: within a run of sentences up to a transition, chunks
    count five each.  Blank texts make no chunk.
    """
    plain = T.collapse(F.col("text"))
    cut = T.sentences(F.col("text"))
    whole = (F.col("type") == "code") | (F.length(plain) < SHORT) | (F.size(cut) <= FEW)
    kept = F.when(F.col("type") == "code", T.strip(F.col("text"))).otherwise(plain)
    rows = blocks.withColumn("__sentences", F.when(whole, F.array(kept)).otherwise(cut)).withColumn("__whole", whole)
    rows = rows.select(*blocks.columns, "__whole", F.posexplode("__sentences").alias("__n", "__sentence")).where("__sentence <> ''")
    by = W.partitionBy("doc_id", "position").orderBy("__n")
    run = F.coalesce(F.sum(T.is_transition(F.col("__sentence")).cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__run", run)
    within = F.row_number().over(W.partitionBy("doc_id", "position", "__run").orderBy("__n")) - 1
    rows = rows.withColumn("__part", F.floor(within / LONGEST))
    others = [c for c in blocks.columns if c not in ("doc_id", "position", "text")]
    parts = rows.groupBy("doc_id", "position", "__run", "__part").agg(*[F.first(c).alias(c) for c in others], F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__n", "__sentence"))), lambda x: x["__sentence"]), " ").alias("text"))
    number = F.row_number().over(W.partitionBy("doc_id", "position").orderBy("__run", "__part")) - 1
    return parts.withColumn("chunk", number).drop("__run", "__part")


def semantic_blocks(blocks: DataFrame, roots_only: bool = False) -> DataFrame:
    """Semantic blocks: block_id, doc_id, section_id, text, block_type, heading_path, order_index, token_estimate.

    With ``roots_only`` only content of sections without a parent counts.  All
    windows and groups are by document first, so blocks are shuffled once.
    """
    marked = with_paths(blocks).where("not is_heading")
    if roots_only:
        marked = marked.where(F.size("open") == 1)
    path = F.transform("open", lambda x: x["heading"]).alias("heading_path")
    placed = semantic_chunks(marked.select("doc_id", "position", "type", "text", "section", path)).withColumn("section_id", F.concat(F.lit("sec_"), F.col("section").cast("string")))
    order = F.row_number().over(W.partitionBy("doc_id").orderBy("section", "position", "chunk"))
    out = placed.withColumn("order_index", order)
    return out.select(T.short_hash(F.col("doc_id"), F.col("order_index")).alias("block_id"), "doc_id", "section_id", "text", T.block_type(F.col("text"), F.col("type")).alias("block_type"), "heading_path", "order_index", T.token_estimate(F.col("text")).alias("token_estimate"))


def violations(semantic: DataFrame) -> DataFrame:
    """Broken rules: doc_id, block_id, rule, severity."""
    rules = F.array(
        F.when(T.strip(F.col("text")) == "", F.struct(F.lit("blank text").alias("rule"), F.lit("error").alias("severity"))),
        F.when(F.size("heading_path") < 1, F.struct(F.lit("empty path").alias("rule"), F.lit("error").alias("severity"))),
        F.when(F.col("order_index") < 0, F.struct(F.lit("negative order").alias("rule"), F.lit("error").alias("severity"))),
        F.when(F.col("token_estimate") >= WARN_TOKENS, F.struct(F.lit("many tokens").alias("rule"), F.lit("warning").alias("severity"))),
    )
    found = semantic.select("doc_id", "block_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("v"))
    return found.select("doc_id", "block_id", "v.rule", "v.severity")


def block_stats(semantic: DataFrame, *by: str) -> DataFrame:
    """Per block type (and ``by``): blocks, share in percent, average and most tokens."""
    counts = semantic.groupBy(*by, "block_type").agg(F.count("*").alias("n_blocks"), F.round(F.avg("token_estimate"), 1).alias("avg_tokens"), F.max("token_estimate").alias("max_tokens"))
    share = F.round(100.0 * F.col("n_blocks") / F.sum("n_blocks").over(W.partitionBy(*by)), 1)
    return counts.withColumn("share", share)


def first_blocks(semantic: DataFrame, n: int) -> DataFrame:
    """The first n blocks of each document."""
    return semantic.withColumn("__k", F.row_number().over(W.partitionBy("doc_id").orderBy("order_index"))).where(F.col("__k") <= n).drop("__k")
