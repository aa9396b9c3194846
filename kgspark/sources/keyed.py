"""Tables by key that are replaced and appended to without rewriting the rest."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rows that a bucket is planned for.
BUCKET_BYTES = 256 << 20

_LOG = "batch string, attempt string, seq long, kind string, bucket int"


def buckets_for(df: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for a table that grows from these rows, by their counted bytes."""
    texts = [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, T.StringType | T.BinaryType)]
    nested = [F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
    row = sum([*texts, *nested], F.lit(8 * (len(df.columns) - len(texts) - len(nested))))
    return max(1, -(-(df.agg(F.sum(row.cast("long"))).first()[0] or 0) // bucket_bytes))


class KeyedTable:
    """Rows by key, in a shared folder, changed by batches.

    ``append`` adds rows; ``put`` takes the place of all rows of its keys.  Both
    write their own rows only, into the buckets of their keys, and then one line
    to the log, which makes them seen.  A batch that is already in the log is
    not stored again; what an attempt wrote that ended before its line is never
    seen.  ``compact`` writes a bucket's rows anew once more than so many
    batches are in it.  One writer at a time; readers see whole batches.

    Columns, key and number of buckets are those of the first call, and are read
    from the folder later.  Rows with a null key are stored like others; a put
    replaces them together.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: str = "doc_id", buckets: int = 8) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        try:
            self.buckets = spark.read.parquet(f"{self.path}/made").first()["buckets"]
        except AnalysisException:  # nothing is there yet
            self.buckets = buckets
            self._one([(buckets,)], "buckets int", "made")

    def _one(self, rows: list[tuple], schema: str, name: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, schema: T.StructType | str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def log(self) -> DataFrame:
        """Batches in the order in which they came: batch, attempt, seq, kind, bucket (of a compaction)."""
        return self._read("log", _LOG)

    def _lines(self) -> list[tuple[str, str, int, str, int]]:
        """The log on the driver: a line of some hundred bytes per batch."""
        return [tuple(r) for r in self.log().collect()]

    def has(self, batch: str) -> bool:
        return any(line[0] == batch for line in self._lines())

    def _done(self, batch: str, attempt: str, kind: str, buckets: Iterable[int] = (-1,)) -> None:
        """The line that makes an attempt seen; of a compaction, one for each bucket."""
        seq = 1 + max((line[2] for line in self._lines()), default=0)
        self._one([(batch, attempt, seq, kind, b) for b in buckets], _LOG, "log")

    def _write(self, rows: DataFrame, name: str, attempt: str) -> None:
        # A hot key may be in all files of its bucket: rows stay in their tasks.
        rows.withColumns({"_attempt": F.lit(attempt), "_bucket": self._bucket(F.col(self.key))}).write.mode("append").partitionBy("_bucket").parquet(f"{self.path}/{name}")

    def append(self, rows: DataFrame, batch: str) -> bool:
        """Add rows, once per batch; whether they were not there yet."""
        if self.has(batch):
            return False
        attempt = uuid.uuid4().hex
        self._write(rows.select(*self.schema.names), "rows", attempt)
        self._done(batch, attempt, "append")
        return True

    def put(self, rows: DataFrame, batch: str, keys: DataFrame | None = None) -> bool:
        """Replace the rows of ``keys`` (those of the rows if not given), once per batch.

        Keys without rows lose theirs.
        """
        if self.has(batch):
            return False
        attempt = uuid.uuid4().hex
        self._write((rows if keys is None else keys).select(self.key).distinct(), "keys", attempt)
        self._write(rows.select(*self.schema.names), "rows", attempt)
        self._done(batch, attempt, "put")
        return True

    def read(self, value: object = None) -> DataFrame:
        """The rows as they are now, of one key's bucket only if it is given."""
        return self._seen(value).select(*self.schema.names)

    def _seen(self, value: object = None, buckets: list[int] | None = None) -> DataFrame:
        log, base = self._sides()
        side = T.StructType([T.StructField("_attempt", T.StringType()), T.StructField("_bucket", T.IntegerType())])
        rows = self._read("rows", T.StructType([*self.schema.fields, *side.fields]))
        keys = self._read("keys", T.StructType([self.schema[self.key], *side.fields]))
        if buckets is not None:
            rows, keys = (df.where(F.col("_bucket").isin(buckets)) for df in (rows, keys))
        if value is not None:
            of = F.col(self.key) == F.lit(value).cast(self.schema[self.key].dataType)
            rows, keys = (df.where((F.col("_bucket") == self._bucket(F.lit(value).cast(self.schema[self.key].dataType))) & of) for df in (rows, keys))
        fresh = lambda df: df.join(log, "_attempt").join(base, "_bucket", "left").where("_base is null or _seq >= _base")
        put = fresh(keys).groupBy(F.col(self.key).alias("_key")).agg(F.max("_seq").alias("_put"))
        return fresh(rows).join(put, F.col(self.key).eqNullSafe(F.col("_key")), "left").where("_put is null or _seq >= _put")

    def _sides(self) -> tuple[DataFrame, DataFrame]:
        """The order of the attempts, and from which on a compacted bucket counts."""
        lines = self._lines()
        bases: dict[int, int] = {}
        for _, _, seq, kind, bucket in lines:
            if kind == "base":
                bases[bucket] = max(seq, bases.get(bucket, 0))
        log = self.spark.createDataFrame(list({(line[1], line[2]) for line in lines}), "_attempt string, _seq long")
        return F.broadcast(log), F.broadcast(self.spark.createDataFrame(list(bases.items()), "_bucket int, _base long"))

    def batches(self) -> DataFrame:
        """Batches that a reader of each bucket goes through: bucket, n."""
        side = T.StructType([T.StructField("_attempt", T.StringType()), T.StructField("_bucket", T.IntegerType())])
        log, base = self._sides()
        rows = self._read("rows", side).distinct().join(log, "_attempt")
        return rows.join(base, "_bucket", "left").where("_base is null or _seq >= _base").groupBy(F.col("_bucket").alias("bucket")).agg(F.count("*").alias("n"))

    def compact(self, most: int = 8) -> list[int]:
        """Write the buckets of more than ``most`` batches as one batch each; which they were.

        The old files stay until ``path`` is cleared or copied, and are not read
        for values any more.
        """
        full = sorted(r["bucket"] for r in self.batches().where(F.col("n") > most).collect())  # a row per bucket
        if full:
            attempt = uuid.uuid4().hex
            self._write(self._seen(buckets=full).select(*self.schema.names), "rows", attempt)
            self._done(f"base-{attempt}", attempt, "base", full)
        return full
