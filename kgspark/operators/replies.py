"""Typed reads of model replies, and the prompts that ask for them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions import json_text as J
from kgspark.functions import text as T
from kgspark.functions import vocabulary as V


def complete(prompts: DataFrame, completions: DataFrame, key: str = "key") -> DataFrame:
    """Joins a stored table of completions (key, raw_output)."""
    return prompts.join(completions, key, "left")


def complete_with(prompts: DataFrame, client: Callable[[], Callable[[str], str]], key: str = "key") -> DataFrame:
    """Asks a model: ``client`` makes one caller per partition; failures are null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()

        def one(prompt: str) -> str | None:
            try:
                return call(prompt)
            except Exception:  # a model's failure is that of one row
                return None

        for frame in frames:
            yield pd.DataFrame({key: frame[key], "raw_output": [one(p) for p in frame["prompt"]]})

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, "prompt").mapInPandas(run, f"`{key}` {kind}, raw_output string")


def intents(replies: DataFrame) -> DataFrame:
    """key, intent (unknown if not one of the ten), entities, confidence, reasoning.

    A reply without an object is unknown with confidence 0.
    """
    found = J.reply_json_of(F.col("raw_output"))
    m = F.from_json(found, "map<string,string>")
    rows = replies.select("key", m.alias("m"))
    name = F.lower(T.strip(F.col("m")["intent"]))
    known = F.when(name.isin(*V.INTENTS), name).otherwise("unknown")
    missing = F.col("m").isNull()
    return rows.select(
        "key",
        F.when(missing, "unknown").otherwise(F.coalesce(known, F.lit("unknown"))).alias("intent"),
        F.when(missing, F.lit(None)).otherwise(F.from_json(F.col("m")["entities"], "map<string,string>")).alias("entities"),
        F.when(missing, 0.0).otherwise(F.coalesce(J.as_number(F.col("m")["confidence"]), F.lit(0.5))).alias("confidence"),
        F.coalesce(F.col("m")["reasoning"], F.lit("")).alias("reasoning"),
    )


def quality_reports(replies: DataFrame) -> DataFrame:
    """key, credibility, bias, bias_type, readability, strengths, weaknesses, bar.

    Missing scores are 0.5, missing names unknown; at most three points each.
    """
    m = F.from_json(J.reply_json_of(F.col("raw_output")), "map<string,string>")
    rows = replies.select("key", F.coalesce(m, F.create_map().cast("map<string,string>")).alias("m"))
    number = lambda n: F.coalesce(J.as_number(F.col("m")[n]), F.lit(0.5))
    named = lambda n: F.coalesce(F.col("m")[n], F.lit("unknown"))
    points = lambda n: F.slice(F.coalesce(F.from_json(F.col("m")[n], "array<string>"), F.array().cast("array<string>")), 1, 3)
    credibility = number("credibility_score")
    tenth = J.clamp(credibility)
    bar = F.concat(F.repeat(F.lit("█"), F.floor(tenth * 10).cast("int")), F.repeat(F.lit("░"), (10 - F.floor(tenth * 10)).cast("int")))
    return rows.select("key", credibility.alias("credibility"), number("bias_score").alias("bias"), named("bias_type").alias("bias_type"), named("readability").alias("readability"), points("strengths").alias("strengths"), points("weaknesses").alias("weaknesses"), bar.alias("bar"))


def prerequisites(replies: DataFrame, most: int = 6) -> DataFrame:
    """key, place, concept, marker, reason: an array, or the one under "prerequisites"."""
    text = F.col("raw_output")
    array = F.from_json(F.when(F.try_parse_json(text).isNotNull() & F.startswith(T.strip(text), F.lit("[")), text), "array<map<string,string>>")
    inner = F.from_json(F.from_json(J.reply_json_of(text), "map<string,string>")["prerequisites"], "array<map<string,string>>")
    rows = replies.select("key", F.posexplode(F.slice(F.coalesce(array, inner), 1, most)).alias("place", "m"))
    marker = F.when(F.col("m")["level"] == "advanced", "●●●").when(F.col("m")["level"] == "intermediate", "●●○").otherwise("●○○")
    return rows.select("key", "place", F.col("m")["concept"].alias("concept"), marker.alias("marker"), F.coalesce(F.col("m")["reason"], F.lit("")).alias("reason"))


def article_graphs(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graphs in replies; nothing where a reply has none."""
    found = J.reply_json_of(F.col("raw_output"))
    parsed = replies.select("key", F.from_json(found, "nodes array<map<string,string>>, edges array<map<string,string>>").alias("g"))
    nodes = parsed.select("key", F.explode("g.nodes").alias("m")).select("key", F.col("m")["id"].alias("id"), F.coalesce(F.col("m")["label"], F.col("m")["id"]).alias("label"), F.coalesce(J.as_number(F.col("m")["importance"]), F.lit(0.5)).alias("importance"))
    edges = parsed.select("key", F.explode("g.edges").alias("m")).select("key", F.col("m")["source"].alias("source"), F.col("m")["target"].alias("target"), F.coalesce(F.col("m")["relation"], F.lit("ASSOCIATED_WITH")).alias("relation"))
    return nodes, edges


def prompts(articles: DataFrame) -> DataFrame:
    """Prompts of summary, explanation, suggestion, answer and quality, with their cuts.

    ``articles`` is (key, content, concepts array, question).
    """
    # How many concepts and characters each prompt holds.
    listed = lambda n: F.array_join(F.slice("concepts", 1, n), ", ")
    cut = lambda n: F.left("content", F.lit(n))
    form = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("prompt"))
    forms = F.array(
        form("summary", F.concat(F.lit("Summarize in a few sentences. Concepts: "), listed(10), F.lit("\n"), cut(3000))),
        form("explanation", F.concat(F.lit("Explain from the text: "), F.coalesce("question", F.lit("")), F.lit("\n"), cut(2000))),
        form("suggestion", F.concat(F.lit("Suggest what to read next among: "), listed(3))),
        form("answer", F.concat(F.lit("Answer from the text: "), F.coalesce("question", F.lit("")), F.lit("\n"), cut(2500))),
        form("quality", F.concat(F.lit("Rate credibility and bias as JSON.\n"), cut(2500))),
    )
    return articles.select("key", F.inline(forms))


def answers(prompted: DataFrame, completions: DataFrame) -> DataFrame:
    """Completions by (key, kind), with a plain sentence where a model gave none."""
    fallback = F.when(F.col("kind") == "summary", "No summary is available.").when(F.col("kind") == "suggestion", "Try one of the related concepts.").otherwise("No answer is available.")
    joined = prompted.join(completions, ["key", "kind"], "left")
    return joined.select("key", "kind", F.coalesce(F.nullif(T.strip(F.col("raw_output")), F.lit("")), fallback).alias("text"))
