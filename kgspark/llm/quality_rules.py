"""Quality rules with verdicts on whole hosts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm._common import SPACES, let, materialize, words_of

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.8
#: Bounds of the prior's weight, in documents.
MIN_PRIOR, MAX_PRIOR = 1.0, 1e6


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words covered by a window of ``width`` words that occurs twice or more.

    Windows are compared by 64-bit hashes.  Where all are distinct, as in most
    texts, nothing is sorted.
    """
    zero = F.lit(0).cast("long")

    def covered(windows: Column) -> Column:
        def among(pairs: Column) -> Column:
            twin = lambda x, k: F.coalesce(F.get(pairs, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False))
            starts = F.array_sort(F.transform(F.filter(pairs, twin), lambda x: x["i"]))
            begin = F.struct(zero.alias("n"), F.lit(-width).alias("last"))
            step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"), p.alias("last"))
            return F.aggregate(starts, begin, step, lambda acc: acc["n"])

        return let(F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), among)

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))
    distinct = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), zero).otherwise(covered(w))
    return F.when(F.size(words) <= width, zero).otherwise(let(hashes, distinct))


def _base(text: Column) -> Column:
    """Struct of the counts that the base verdict takes."""
    return let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))


def _base_failed(counts: Column) -> Column:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])


def measure(docs: DataFrame, *, host: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts and base verdict per document: key, host, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Null texts count as empty.  Rows with equal or null keys are measured each.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    rows = docs.select(
        F.col(key).alias(key),
        F.col(host).alias("host"),
        _base(F.col(text)).alias("counts"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return rows.select(key, "host", "counts.n_words", "word_chars", "n_symbols", "n_dup_lines", "counts.n_repeat_words", _base_failed(F.col("counts")).alias("base_failed"))


def host_counts(measured: DataFrame) -> DataFrame:
    """Documents and failures per host; a hot host is combined before the shuffle."""
    named = measured.where(F.col("host").isNotNull())
    return named.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))


def host_verdicts(hosts: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``host_counts`` with the shrunk failure ``rate`` and ``rejected``.

    The beta prior has the mean and variance of the hosts' raw failure rates
    (method of moments, its weight held between MIN_PRIOR and MAX_PRIOR);
    ``rate`` is the posterior mean.
    """
    raw = F.col("n_failed") / F.col("n_docs")
    m, m2 = hosts.agg(F.avg(raw), F.avg(raw * raw)).first()  # two numbers
    m = m or 0.0
    var = (m2 or 0.0) - m * m
    weight = min(max(m * (1 - m) / var - 1, MIN_PRIOR), MAX_PRIOR) if var > 1e-12 else MAX_PRIOR
    rate = (F.col("n_failed") + m * weight) / (F.col("n_docs") + weight)
    return hosts.select("host", "n_docs", "n_failed", rate.alias("rate"), (rate > max_rate).alias("rejected"))


def judge(docs: DataFrame, *, max_rate: float = MAX_HOST_RATE, host: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``measure`` with the final verdict ``kept``.

    A document is kept unless it failed itself or its host is rejected.  One
    without a host is judged by itself.  The measured rows, without texts, are
    written once; host verdicts are joined back to them.
    """
    rows = materialize(measure(docs, host=host, text=text, key=key), "quality")
    bad = host_verdicts(materialize(host_counts(rows), "quality-hosts"), max_rate).where("rejected").select("host", F.lit(True).alias("rejected"))
    return rows.join(bad, "host", "left").withColumn("kept", ~F.col("base_failed") & F.col("rejected").isNull()).drop("rejected")


def keep_good(docs: DataFrame, *, max_rate: float = MAX_HOST_RATE, host: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    The base verdict is computed again on the way out, which moves no texts.
    """
    failed = _base_failed(_base(F.col(text)))
    slim = docs.select(F.col(host).alias("host"), failed.alias("base_failed"))
    hosts = materialize(host_counts(slim), "quality-hosts")
    bad = host_verdicts(hosts, max_rate).where("rejected").select(F.col("host").alias("__bad_host"))
    return docs.where(~failed).join(bad, F.col(host) == F.col("__bad_host"), "left_anti").select(docs.columns)
