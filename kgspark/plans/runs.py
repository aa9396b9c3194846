"""Runs of phases over many documents: each is done once, and fails alone."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.sources.keyed import KeyedTable
from kgspark.sources.tables import store

#: A phase: input rows of some documents to results and failures, (doc_id, error).
Step = Callable[[DataFrame], tuple[DataFrame, DataFrame]]

#: Parts into which documents are split where a job breaks, twice at most.
SPLIT = 8


def _in_text(field: T.StructField) -> Column:
    nested = isinstance(field.dataType, T.MapType | T.StructType | T.ArrayType | T.VariantType)
    return F.to_json(F.struct(field.name)) if nested else F.col(field.name)


def input_digests(inputs: DataFrame) -> DataFrame:
    """What each document's input rows come to, whatever their order: doc_id, digest."""
    rows = [_in_text(f) for f in sorted(inputs.schema.fields, key=lambda f: f.name)]
    total = F.sum(F.xxhash64(*rows).cast("decimal(38,0)"))
    return inputs.groupBy("doc_id").agg(F.concat_ws(":", F.count("*").cast("string"), total.cast("string")).alias("digest"))


def isolated(f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Step:
    """A step from a function of one document's rows; what it raises is that document's failure.

    ``schema`` has doc_id first.  All rows of a document are held by one task.
    """
    fields = T.StructType.fromDDL(schema)
    out = T.StructType([*fields.fields, T.StructField("_error", T.StringType())])

    def guarded(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            got = f(rows)[fields.names]
        except Exception as e:  # whatever the function raises is the document's
            row = dict.fromkeys(fields.names) | {"doc_id": rows["doc_id"].iloc[0], "_error": f"{type(e).__name__}: {e}"}
            return pd.DataFrame({k: pd.Series([v], dtype=object) for k, v in row.items()})
        return got.assign(_error=None)

    def step(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        done = store(rows.groupBy("doc_id").applyInPandas(guarded, out), "isolated")
        return done.where("_error is null").drop("_error"), done.where("_error is not null").select("doc_id", F.col("_error").alias("error"))

    return step


class PhaseRuns:
    """A table of runs, and the phases that write to it.

    A run takes the documents asked for, or all, that are not yet done with the
    input they have now: new ones, changed ones, and those that failed or were
    missing.  A document that fails keeps the results it had before; the others
    go on.  A run is done in ``parts``, and each is logged when its results are
    stored, so a run that is cut off is taken up at the part where it stopped.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "bigint", buckets: int = 8) -> None:
        self.runs = KeyedTable(spark, f"{path}/runs", f"doc_id {kind}, phase string, turn int, digest string, status string, error string, n_rows bigint", buckets=buckets)

    def history(self, phase: str) -> DataFrame:
        return self.runs.read().where(F.col("phase") == phase)

    def latest(self, phase: str) -> DataFrame:
        """The last state of each document: doc_id, turn, digest, status, error, n_rows."""
        last = F.max_by(F.struct("turn", "digest", "status", "error", "n_rows"), "turn").alias("last")
        return self.history(phase).groupBy("doc_id").agg(last).select("doc_id", "last.*")

    def unfinished(self, phase: str, inputs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
        """Documents that a run would do: doc_id, digest (null without input)."""
        digests = input_digests(inputs)
        asked = digests if wanted is None else wanted.select("doc_id").distinct().join(digests, "doc_id", "left")
        last = self.latest(phase).select("doc_id", F.col("digest").alias("last_digest"), "status")
        todo = asked.join(last, "doc_id", "left").where("status is null or status = 'failed' or not (digest <=> last_digest)")
        return todo.select("doc_id", "digest")

    def run(self, phase: str, inputs: DataFrame, step: Step, results: KeyedTable, wanted: DataFrame | None = None, parts: int = 1) -> int:
        """Do what is unfinished; how many documents that were."""
        todo = store(self.unfinished(phase, inputs, wanted), "todo")
        turn = (self.history(phase).agg(F.max("turn")).first()[0] or 0) + 1
        missing = todo.where("digest is null").select("doc_id", F.lit(phase).alias("phase"), F.lit(turn).alias("turn"), "digest", F.lit("missing").alias("status"), F.lit("no input").alias("error"), F.lit(0).cast("long").alias("n_rows"))
        n = todo.count()
        if not n:
            return 0
        self.runs.append(missing, f"{phase}-{turn}-{uuid.uuid4().hex}")
        there = todo.where("digest is not null")
        for part in range(parts):
            own = there.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == part)
            self._part(phase, turn, inputs, step, results, own, 0)
        return n

    def _part(self, phase: str, turn: int, inputs: DataFrame, step: Step, results: KeyedTable, own: DataFrame, depth: int) -> None:
        if own.isEmpty():
            return
        try:
            got, failed = step(inputs.join(own.select("doc_id"), "doc_id", "left_semi"))
            failed = store(failed.groupBy("doc_id").agg(F.min("error").alias("error")), "failed")
            got = store(got.join(failed, "doc_id", "left_anti"), "results")
        except PySparkException as e:  # the job broke: find the documents that break it
            if depth == 2:
                self._log(phase, turn, own.withColumn("error", F.lit(f"the job broke: {str(e)[:300]}")), None)
                return
            for k in range(SPLIT):
                self._part(phase, turn, inputs, step, results, own.where(F.pmod(F.xxhash64("doc_id", F.lit(depth + 1)), F.lit(SPLIT)) == k), depth + 1)
            return
        done = own.join(failed, "doc_id", "left")
        # A part that was stored but not logged is stored again: a put changes nothing then.
        results.put(got, f"{phase}-{turn}-{uuid.uuid4().hex}", keys=done.where("error is null"))
        self._log(phase, turn, done, got)

    def _log(self, phase: str, turn: int, done: DataFrame, got: DataFrame | None) -> None:
        n = done.select("doc_id").limit(0).withColumn("n_rows", F.lit(0).cast("long")) if got is None else got.groupBy("doc_id").agg(F.count("*").alias("n_rows"))
        status = F.when(F.col("error").isNull(), "done").otherwise("failed")
        rows = done.join(n, "doc_id", "left").select("doc_id", F.lit(phase).alias("phase"), F.lit(turn).alias("turn"), "digest", status.alias("status"), "error", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
        self.runs.append(rows, f"{phase}-{turn}-{uuid.uuid4().hex}")
