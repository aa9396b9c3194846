"""The operators' inputs, derived by Spark from the given tables.

The documents have no headings, phrases or replies of a model, so these are
put in by rule; every row of a table takes part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgspark.sources.tables import load, store

#: Concept types, picked by the length of a word.
TYPES = ("core_concept", "method", "tool", "metric", "theory")
#: A word of the dictionary is in so many documents at least.
MIN_DOCUMENTS = 3


def content_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block per line: short lines are headings, others get phrases put in."""
    docs = load(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "line")).where("trim(line) <> ''")
    n, at = F.length("line"), F.col("doc_id") + F.col("position")
    heading = n <= 60
    said = F.when(at % 2 == 0, F.replace("line", F.lit(", "), F.lit(" therefore "))).otherwise(F.col("line"))
    turn = (F.col("doc_id") * 31 + F.col("position")) % 9
    phrase = F.when(turn == 0, "It is defined as ").when(turn == 1, "For example, ").when(turn == 2, "It refers to ").when(turn == 3, "Consider ").otherwise("")
    kind = F.when(heading, "heading").when(at % 23 == 0, "code").when(at % 17 == 0, "list").otherwise("paragraph")
    tag = F.when(heading, F.concat(F.lit("h"), (1 + n % 4).cast("string"))).when(kind == "code", "pre").when(kind == "list", "ul").otherwise("p")
    return lines.select("doc_id", "position", kind.alias("type"), tag.alias("tag"), F.when(heading, F.col("line")).otherwise(F.concat(phrase, said)).alias("text"))


def site_links(pages: DataFrame) -> DataFrame:
    """Links between stored pages: src, dst (page_id), ordinal.

    The links of the given pages stand in their menus and lead to none that is
    stored; each is taken as one to a page of its own host, by the digest of
    its target.
    """
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    hosted = pages.select("page_id", host.alias("host"))
    found = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    links = pages.select("page_id", F.posexplode(found).alias("ordinal", "target_url"))
    numbered = hosted.withColumn("k", F.row_number().over(W.partitionBy("host").orderBy("page_id")) - 1)
    n = hosted.groupBy("host").agg(F.count("*").alias("n"))
    digest = F.conv(F.left(F.md5("target_url"), F.lit(7)), 16, 10).cast("long")
    out = links.join(hosted, "page_id").join(n, "host").select("host", F.col("page_id").alias("src"), (digest % F.col("n")).alias("k"), "ordinal")
    return out.join(numbered, ["host", "k"]).select("src", F.col("page_id").alias("dst"), "ordinal")


def _lines(texts: DataFrame, key: str) -> DataFrame:
    # Long words are taken from a whole text at once, before there is a row for each.
    plain = F.lower(F.regexp_replace("text", r"[^\p{L} \n]+", ""))
    held = lambda line: F.sort_array(F.array_distinct(F.regexp_extract_all(line, F.lit("[^ ]{7,}+"), F.lit(0))))
    each = F.transform(F.split(plain, "\n"), lambda line, k: F.struct(k.alias("position"), held(line).alias("words")))
    return texts.where("text is not null").select(key, F.filter(each, lambda x: F.size(x["words"]) > 0).alias("lines"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at least seven letters of the lines of each document, written once: doc_id, lines (position, words).

    Texts under one ``doc_id`` are one row, with each word of a line once.
    """
    docs = load(spark, sf_dir, "documents")
    lines = _lines(docs, "doc_id")
    several = store(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__doc")))
    if not several.isEmpty():
        part = lambda how: lines.join(several, F.col("doc_id").eqNullSafe(F.col("__doc")), how)
        lines = part("left_anti").unionByName(_by_document(_by_word(part("left_semi"))))
    return store(lines)


def _by_word(held: DataFrame) -> DataFrame:
    """A row per word of a line: doc_id, position, word."""
    lines = held.select("doc_id", F.explode("lines").alias("x"))
    return lines.select("doc_id", F.col("x.position").alias("position"), F.explode("x.words").alias("word"))


def _by_document(held: DataFrame) -> DataFrame:
    """``words`` from a row for each of them, or as they are."""
    if "lines" in held.columns:
        return held
    lines = held.groupBy("doc_id", "position").agg(F.sort_array(F.collect_set("word")).alias("words"))
    return lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("position", "words"))).alias("lines"))


def _distinct_words(held: DataFrame) -> DataFrame:
    """The words of each document: doc_id, word."""
    return _by_document(held).select("doc_id", F.explode(F.array_distinct(F.flatten("lines.words"))).alias("word"))


def word_counts(held: DataFrame) -> DataFrame:
    """In how many documents each word is: word, df, n (with none as a document), and the least and greatest of them, lo and hi."""
    return _distinct_words(held).groupBy("word").agg(F.count("doc_id").alias("df"), F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))


def dictionary(held: DataFrame) -> DataFrame:
    """The words of several documents: word, df."""
    return word_counts(held).where(F.col("df") >= MIN_DOCUMENTS).select("word", "df")


def _rare(counts: DataFrame) -> DataFrame:
    """The words of each document that the dictionary doesn't hold: doc_id, rare."""
    # Words of one or two documents are in the least and the greatest of them.
    nowhere = F.array().cast(counts.select(F.array("lo").alias("x")).schema["x"].dataType)
    of = F.array_distinct(F.concat(F.when(F.col("df") > 0, F.array("lo", "hi")).otherwise(nowhere), F.when(F.col("n") > F.col("df"), F.array(F.lit(None))).otherwise(nowhere)))
    each = counts.where(F.col("df") < MIN_DOCUMENTS).select(F.explode(of).alias("doc_id"), "word")
    return each.groupBy("doc_id").agg(F.collect_list("word").alias("rare"))


def candidate_lines(held: DataFrame) -> DataFrame:
    """Lines with words of the dictionary: doc_id, position, start, words, total.

    ``start`` counts the words of the document's lines before, ``total`` all of
    them.  ``held`` is ``words``.
    """
    return candidate_documents(held).select("doc_id", F.inline("lines"), "total")


def candidate_documents(held: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``candidate_lines`` in a row per document: doc_id, lines (position, start, words), total.

    Rare words are taken out by document, so no row of a frequent word is
    shuffled by it.  ``counts`` is ``word_counts``, where that is written.
    """
    held = _by_document(held)
    rare = _rare(word_counts(held) if counts is None else counts).withColumnRenamed("doc_id", "__doc").hint("shuffle_hash")
    both = held.join(rare, F.col("doc_id").eqNullSafe(F.col("__doc")), "left").select("doc_id", "lines", "rare")
    kind = both.schema["lines"].dataType.elementType["position"].dataType.simpleString()

    def without_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = lambda c: pc.fill_null(pc.list_value_length(c), 0).to_numpy()
            lines, rare = batch["lines"], batch["rare"]
            doc = np.repeat(np.arange(batch.num_rows), size(lines))
            at, held = (pc.struct_field(lines.flatten(), c) for c in ("position", "words"))
            line = np.repeat(np.arange(len(held)), size(held))
            text, gone = held.flatten(), rare.flatten()
            # A word of a document is a number.
            code = pa.concat_arrays([text, gone]).dictionary_encode()
            key = np.concatenate([doc[line], np.repeat(np.arange(batch.num_rows), size(rare))]) * len(code.dictionary) + code.indices.to_numpy()
            stays = ~np.isin(key[: len(text)], key[len(text) :])
            n = np.bincount(line[stays], minlength=len(held))
            ends = np.concatenate([[0], np.cumsum(n)])
            first = np.searchsorted(doc, doc, "left")
            some = np.flatnonzero(n)
            offsets = np.concatenate([ends[some], ends[-1:]]).astype(np.int32)
            own = [at.take(pa.array(some)), pa.array((ends[:-1] - ends[first])[some].astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), text.filter(pa.array(stays)))]
            lines = pa.StructArray.from_arrays(own, names=["position", "start", "words"])
            upto = np.searchsorted(doc[some], np.arange(batch.num_rows + 1)).astype(np.int32)
            total = np.bincount(doc, weights=n, minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(pa.array(upto), lines), pa.array(total)], names=["doc_id", "lines", "total"])

    return both.mapInArrow(without_rare, f"doc_id {both.schema['doc_id'].dataType.simpleString()}, lines array<struct<position: {kind}, start: int, words: array<string>>>, total long")


def _type_of(n: Column) -> Column:
    out = F.lit(TYPES[0])
    for k, name in enumerate(TYPES[1:], 1):
        out = F.when(n % len(TYPES) == k, name).otherwise(out)
    return out


def _capital(word: Column) -> Column:
    """With a capital, where the first letter is one of a to z."""
    first = F.left(word, F.lit(1))
    return F.concat(F.when(first.between("a", "z"), F.upper(first)).otherwise(first), F.substring(word, F.lit(2), F.length(word)))


def _name(word: Column, ord_: Column) -> Column:
    return F.when(ord_ % 3 == 1, F.concat(word, F.lit("s"))).when(ord_ % 3 == 2, _capital(word)).otherwise(word)


def _tenths(word: Column) -> Column:
    return 4 + F.length(word) % 7


def candidates(held: DataFrame, *keep: str) -> DataFrame:
    """A candidate per block and word of the dictionary: doc_id, position, ord, word, name, type, tenths, and columns to ``keep`` of ``candidate_lines``.

    ``held`` is ``words``.
    """
    lines = candidate_lines(held).repartition("doc_id")
    rows = lines.select("doc_id", "position", "start", *keep, F.posexplode("words").alias("k", "word")).withColumn("ord", F.col("start") + F.col("k") + 1)
    word = F.col("word")
    return rows.select("doc_id", "position", "ord", "word", _name(word, F.col("ord")).alias("name"), _type_of(F.length(word)).alias("type"), _tenths(word).alias("tenths"), *keep)


def _decimal(tenths: Column) -> Column:
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def _in_form(doc: Column, body: Column, listed: Column) -> Column:
    """The same content as models give it, by document."""
    return F.when(doc % 6 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(doc % 6 == 2, F.concat(F.lit("Here is the answer: "), body, F.lit(" Hope it helps."))).when(doc % 6 == 3, F.left(body, F.length(body) - 2)).when(doc % 6 == 4, listed).otherwise(body)


def concept_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with the candidates of each block: doc_id, block_id, ord, raw_output."""
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    full = lambda name, word: F.concat(F.lit('{"name":'), q(name), F.lit(',"type":'), q(_type_of(F.length(word))), F.lit(',"description":'), q(name), F.lit(',"confidence":'), _decimal(_tenths(word)), F.lit("}"))
    odd = lambda name, _: F.concat(F.lit('{"name":'), q(name), F.lit(',"description":'), q(F.concat(F.repeat(F.concat(name, F.lit(" ")), F.lit(39)), name)), F.lit(',"confidence":"high"},{"type":"x"}'))
    lines = candidate_lines(words(spark, sf_dir)).repartition("doc_id")
    items = lambda form: F.array_join(F.transform("words", lambda w, k: form(_name(w, F.col("start") + k + 1), w)), ",")
    rows = lines.select("doc_id", "position", F.when(F.col("doc_id") % 6 == 5, items(odd)).otherwise(items(full)).alias("items"))
    listed = F.concat(F.lit("["), "items", F.lit("]"))
    body = F.concat(F.lit('{"concepts":'), listed, F.lit("}"))
    return rows.select("doc_id", F.concat_ws("_", "doc_id", "position").alias("block_id"), F.col("position").alias("ord"), _in_form(F.col("doc_id"), body, listed).alias("raw_output"))


def concept_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates as clustering takes them: doc_id, ord, name, type, description, block_id, heading_path, confidence."""
    return as_concepts(candidates(words(spark, sf_dir)))


def as_concepts(rows: DataFrame, *keep: str) -> DataFrame:
    """``concept_rows`` of ``candidates``, and further columns."""
    path = F.when(F.col("position") > 0, F.array(F.concat(F.lit("part "), F.floor(F.col("position") / 3).cast("string")))).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", "ord", "name", "type", F.col("name").alias("description"), F.concat_ws("_", "doc_id", "position").alias("block_id"), path.alias("heading_path"), (F.col("tenths") / 10.0).alias("confidence"), *keep)


def with_next(rows: DataFrame) -> DataFrame:
    """Adds next_ord, that of the next concept of a document whose key has the same first four letters; ``rows`` has name_key."""
    return rows.withColumn("next_ord", F.lead("ord").over(W.partitionBy("doc_id", F.left("name_key", F.lit(4))).orderBy("ord")))


def name_pairs(rows: DataFrame) -> DataFrame:
    """Like concepts of a document, each with the next of its beginning: doc_id, a, b, similarity.

    ``rows`` has name_key, or next_ord from ``with_next``.
    """
    both = rows if "next_ord" in rows.columns else with_next(rows)
    return both.where("next_ord is not null").select("doc_id", F.col("ord").alias("a"), F.col("next_ord").alias("b"), F.lit(0.9).alias("similarity"))


def document_concepts(held: DataFrame) -> DataFrame:
    """The dictionary words that each document holds, as its concepts, frequent ones first.

    ``held`` is ``words``.
    """
    own = _distinct_words(held).join(dictionary(held), "word")
    order = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("df"), "word"))
    return own.select("doc_id", _ident(F.col("word")).alias("canonical_id"), order.alias("ord"), F.col("word").alias("canonical_name"), F.array(F.concat("word", F.lit("s"))).alias("aliases"))


def _ident(word: Column) -> Column:
    return F.concat(F.lit("c"), F.substring(F.md5(word), 1, 10))


def related_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What the queries on relations read, each written once: ``candidate_documents``, and ``doubtful_names``."""
    held = words(spark, sf_dir)
    counts = store(word_counts(held))
    return store(candidate_documents(held, counts).select("doc_id", "lines")), store(doubtful_names(counts))


def doubtful_names(counts: DataFrame) -> DataFrame:
    """The words of the dictionary that are another one's plural, and those others: word, df."""
    known = counts.where(F.col("df") >= MIN_DOCUMENTS).select("word", "df")
    plural = known.select(F.concat("word", F.lit("s")).alias("word"), F.col("word").alias("of"), F.col("df").alias("of_df"))
    both = known.join(plural, "word")
    return both.select("word", "df").union(both.select("of", "of_df")).distinct()


def named_concepts(documents: DataFrame, doubtful: DataFrame) -> DataFrame:
    """``document_concepts`` with an order of those only that share a name, as in ``document_concepts``."""
    own = documents.select("doc_id", F.explode(F.array_distinct(F.flatten("lines.words"))).alias("word")).join(doubtful, "word", "left")
    order = F.struct(F.coalesce(-F.col("df"), F.lit(0)).alias("rank"), "word")
    return own.select("doc_id", _ident(F.col("word")).alias("canonical_id"), order.alias("ord"), F.col("word").alias("canonical_name"), F.array(F.concat("word", F.lit("s"))).alias("aliases"))


def corpus_concepts(held: DataFrame) -> DataFrame:
    """The dictionary as known concepts of the whole corpus: name, ord."""
    return dictionary(held).select(F.col("word").alias("name"), (-F.col("df")).alias("ord"))


def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark's texts count as explored: name."""
    return _lines(load(spark, sf_dir, "benchmark"), "item_id").select(F.explode(F.flatten("lines.words")).alias("name")).distinct()


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks: doc_id, block_id, position, text."""
    docs = load(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "text")).select("doc_id", F.concat_ws("_", "doc_id", "position").alias("block_id"), "position", "text")


def relation_replies(documents: DataFrame) -> DataFrame:
    """From ``candidate_documents``, replies that relate neighbouring candidates of a block: doc_id, block_id, ord, raw_output.

    By place also lower-case types, unknown types, self-loops, an unknown
    concept, and confidences out of range.
    """
    lines = documents.select("doc_id", F.inline("lines")).where("size(words) > 1")

    def item(word: Column, at: Column) -> Column:
        ord_, after = F.col("start") + at + 1, F.get("words", at + 1)
        k = ord_ % 8
        kind = F.when(k == 0, "uses").when(k == 1, "LIKES").when(k == 2, "CAUSES").when(k == 3, "PART_OF").otherwise("DEPENDS_ON")
        target = F.when(k == 4, _capital(word)).when(k == 5, "zzzzzzz").otherwise(after)
        confidence = F.when(k == 6, "1.7").when(k == 7, "-0.2").otherwise(_decimal(_tenths(word)))
        return F.concat(F.lit('{"source":"'), word, F.lit('","target":" '), target, F.lit('","relation_type":"'), kind, F.lit('","confidence":'), confidence, F.lit("}"))

    items = F.array_join(F.transform(F.slice("words", 1, F.size("words") - 1), item), ",")
    body = F.concat(F.lit('{"relationships":['), "items", F.lit("]}"))
    rows = lines.select("doc_id", "position", items.alias("items"))
    return rows.select("doc_id", F.concat_ws("_", "doc_id", "position").alias("block_id"), F.col("position").alias("ord"), _in_form(F.col("doc_id"), body, body).alias("raw_output"))


RELATIONS = {"AF": "CAUSES", "AO": "CONTRASTS_WITH", "NF": "USES", "NO": "PART_OF", "RF": "DEPENDS_ON", "RO": "DEFINES"}


def _trade(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """Line items by nation of supplier and customer, and flag: source, target, rf, n, cents, evidence.

    ``by`` may be "doc_id": the customers are documents by hundreds.
    """
    t = lambda name: load(spark, sf_dir, name)
    line = t("lineitem").select("l_orderkey", "l_suppkey", "l_discount", F.concat("l_returnflag", "l_linestatus").alias("rf"))
    joined = line.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("target")), "o_custkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("source")), "l_suppkey")
    joined = joined.withColumn("doc_id", F.expr("o_custkey div 100"))
    return joined.groupBy(*by, "source", "target", "rf").agg(F.count("*").alias("n"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("cents"), F.min("l_orderkey").alias("evidence"))


def _relation(flag: Column) -> Column:
    relation = F.lit(None).cast("string")
    for value, name in RELATIONS.items():
        relation = F.when(flag == value, name).otherwise(relation)
    return relation


def _confidence() -> Column:
    """From the average discount, to four places."""
    return F.least(F.lit(10_000), F.expr("3000 + 500 * cents div n")) / F.lit(10_000.0)


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade between nations as relations, a graph per hundred customers: doc_id, id, source, target, relation_type, confidence, evidence_blocks, ord."""
    order = F.row_number().over(W.partitionBy("doc_id").orderBy("source", "target", "rf"))
    return _trade(spark, sf_dir, "doc_id").select("doc_id", F.concat_ws("_", "source", "target", "rf").alias("id"), "source", "target", _relation(F.col("rf")).alias("relation_type"), _confidence().alias("confidence"), F.array(F.col("evidence").cast("string")).alias("evidence_blocks"), order.alias("ord"))


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of each graph as nodes: doc_id, id, label, type, aliases, occurrence_count."""
    edges = _trade(spark, sf_dir, "doc_id")
    ends = edges.select("doc_id", F.col("source").alias("id")).unionByName(edges.select("doc_id", F.col("target").alias("id"))).distinct()
    n = load(spark, sf_dir, "customer").groupBy(F.expr("c_custkey div 100").alias("doc_id"), F.col("c_nationkey").alias("id")).agg(F.count("*").cast("int").alias("occurrence_count"))
    named = ends.join(load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label")), "id").join(n, ["doc_id", "id"], "left")
    return named.select("doc_id", "id", "label", F.lit("core_concept").alias("type"), F.array().cast("array<string>").alias("aliases"), F.coalesce("occurrence_count", F.lit(0)).alias("occurrence_count"))


def net_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who sells more to the other, of each two nations and flag: source, target, relation_type, confidence, ord."""
    sold = store(_trade(spark, sf_dir))
    bought = sold.select(F.col("source").alias("target"), F.col("target").alias("source"), "rf", F.col("n").alias("back"))
    net = sold.join(bought, ["source", "target", "rf"], "left").where("source <> target and n > coalesce(back, 0)")
    order = F.row_number().over(W.orderBy("source", "target", "rf"))  # a row per two nations and flag
    return net.select("source", "target", _relation(F.col("rf")).alias("relation_type"), _confidence().alias("confidence"), order.alias("ord"))


def trade_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as known concepts: name, confidence, ord."""
    nation = load(spark, sf_dir, "nation")
    return nation.select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 10 / 10.0).alias("confidence"), F.col("n_nationkey").alias("ord"))


def trade_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net trade between nations by name: src, dst, relation, ord."""
    edges, nation = net_edges(spark, sf_dir), load(spark, sf_dir, "nation")
    named = lambda end, name: nation.select(F.col("n_nationkey").alias(end), F.col("n_name").alias(name))
    return edges.join(named("source", "src"), "source").join(named("target", "dst"), "target").select("src", "dst", F.col("relation_type").alias("relation"), "ord")


def explored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of one region count as explored."""
    return load(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("name"))


def document_nodes(rows: DataFrame) -> DataFrame:
    """Concepts of each document's graph, the first place giving their order: name ("7:word"), doc_id, confidence, ord.

    ``rows`` is ``candidates``.
    """
    per = rows.groupBy("doc_id", "word").agg(F.min("ord").alias("ord"), F.first("tenths").alias("tenths"))
    return per.select(F.concat_ws(":", "doc_id", "word").alias("name"), "doc_id", (F.col("tenths") / 10.0).alias("confidence"), "ord")


def document_relations(rows: DataFrame) -> DataFrame:
    """Relations of neighbouring concepts of a line, every seventh turned round: src, dst, relation, ord.

    ``rows`` is ``candidates``; names are those of ``document_nodes``.
    """
    after = F.lead("word").over(W.partitionBy("doc_id", "position").orderBy("ord"))
    both = rows.select("doc_id", "ord", F.col("word").alias("a"), after.alias("b")).where("b is not null")
    k, turned = F.col("ord") % 5, F.col("ord") % 7 == 6
    kind = F.when(k == 0, "ASSOCIATED_WITH").when(k == 1, "CAUSES").when(k == 4, "PART_OF").otherwise("DEPENDS_ON")
    end = lambda x, y: F.concat_ws(":", "doc_id", F.when(turned, F.col(y)).otherwise(F.col(x)))
    return both.select(end("a", "b").alias("src"), end("b", "a").alias("dst"), kind.alias("relation"), "ord")


def document_starts(graph: DataFrame) -> DataFrame:
    """The concept of each document's graph that depends on most, by name if several do: name."""
    needs = graph.where("dep_kind = 'dependency'").groupBy("src").agg(F.count_distinct("dst").alias("n"))
    return needs.groupBy(F.substring_index("src", ":", 1)).agg(F.min_by("src", F.struct(-F.col("n"), "src")).alias("name")).select("name")


def long_words(nodes: DataFrame) -> DataFrame:
    """Concepts of ``document_nodes`` whose length is a multiple of four count as explored: name."""
    return nodes.where(F.length(F.substring_index("name", ":", -1)) % 4 == 0).select("name")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of changes to concept states."""
    e = load(spark, sf_dir, "events")
    confidence = F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.least(F.lit(1.0), F.col("value") / 500))
    return e.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("concept_name"), (F.col("event_id") % 2 == 0).alias("explored"), confidence.alias("confidence"), "ts", F.struct("ts", "event_id").alias("seq"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages; a turn's number is its time."""
    c = load(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), F.col("turn").alias("ts"), "role", F.col("text").alias("content"))
