"""Exact dedup: a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm._common import join_sized, materialize

#: Rows of the index that a bucket is planned for, about 60 MB.
BUCKET_ROWS = 1_000_000
LEAST_BUCKETS = 8
_ROWS = "digest BINARY, keep_id BIGINT, keep_row BIGINT, batch STRING"


def buckets_for(rows: int) -> int:
    """Buckets of an index that is to hold so many rows."""
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


def _same(text: Column) -> Column:
    return text


class DigestIndex:
    """Digests of all texts that were ever kept, stored in a shared folder.

    The table is partitioned by batch, and within it bucketed and sorted by the
    SHA-256 digest of the normalised text, so new data meets it by a sort-merge
    anti-join to which the index comes without a shuffle.  What is new is
    appended as a batch of its own.  A batch that is added again (after a
    failure, say) is judged against the others only and replaces its own rows:
    it is stored once and gets the verdicts it got before.

    The number of buckets is fixed when the index is made and read from it
    later.  ``normalise`` maps a text to what is compared; nothing is changed
    by default.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = LEAST_BUCKETS, normalise: Callable[[Column], Column] = _same) -> None:
        self.spark, self.path, self.normalise = spark, path, normalise
        try:
            self.buckets = spark.read.parquet(f"{path}/made").first()["buckets"]
        except AnalysisException:  # nothing is there yet
            self.buckets = buckets
            spark.createDataFrame([], _ROWS).write.mode("append").partitionBy("batch").parquet(f"{path}/digests")
            spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}/made")
        self.name = f"digests_{hashlib.md5(path.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({_ROWS}) USING parquet PARTITIONED BY (batch)"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}/digests'"
        )
        spark.catalog.recoverPartitions(self.name)  # those that other sessions have stored

    def close(self) -> None:
        """Take the table out of the session's catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def rows(self) -> DataFrame:
        """digest, keep_id, keep_row, batch."""
        return self.spark.table(self.name)

    def digest(self, text: Column) -> Column:
        """SHA-256 of the normalised text; null counts as empty."""
        return F.unhex(F.sha2(self.normalise(F.coalesce(text, F.lit(""))), 256))

    def judge(self, docs: DataFrame, batch: str, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Index a batch and return a verdict per row: key, keep_id, group_size, kept, text_sha256.

        Of equal texts of the batch the row with the largest key stays, unless
        an earlier batch had the text: then none does, and keep_id is the row
        kept there.  group_size counts the batch's rows with the text.  Null
        keys count as the least; of rows that share key and text one stays.
        Keys are whole numbers.  An empty batch is stored as an empty one.
        """
        # A hot text is one row per task after the partial aggregate; only digests are shuffled.
        prints = materialize(docs.select(F.col(key).cast("long").alias("key"), self.digest(F.col(text)).alias("digest")).withColumn("row", F.monotonically_increasing_id()), "digests")
        best = F.max(F.struct("key", "row"))
        own = materialize(prints.groupBy("digest").agg(best.alias("best"), F.count("*").alias("n")), "digest-groups")
        in_buckets = own.repartition(self.buckets, "digest")
        others = self.rows().where(F.col("batch") != batch)
        fresh = in_buckets.join(others.select("digest").hint("merge"), "digest", "left_anti")
        rows = fresh.select("digest", F.col("best.key").alias("keep_id"), F.col("best.row").alias("keep_row"), F.lit(batch).alias("batch"))
        self._put(rows, batch)
        # Written, as the verdicts must not change when later batches come.
        keepers = in_buckets.join(self.rows().hint("merge"), "digest")
        keepers = materialize(keepers.select("digest", "n", "keep_id", F.when(F.col("batch") == batch, F.col("keep_row")).alias("keep_row")), "keepers")
        judged = prints.join(keepers, "digest")  # a hot digest is split by the skew join
        return judged.select(F.col("key").alias(key), "keep_id", F.col("n").alias("group_size"), F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

    def _put(self, rows: DataFrame, batch: str) -> None:
        """Append a batch, or replace what an earlier run of it has stored."""
        if self.rows().where(F.col("batch") == batch).isEmpty():
            rows.write.mode("append").insertInto(self.name)
            return
        materialize(rows.drop("batch"), "digests-again").createOrReplaceTempView(f"{self.name}_again")
        value = batch.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"INSERT OVERWRITE {self.name} PARTITION (batch = '{value}') SELECT * FROM {self.name}_again")
        self.spark.catalog.dropTempView(f"{self.name}_again")

    def keep_new(self, docs: DataFrame, batch: str, key: str = "doc_id", text: str = "text") -> DataFrame:
        """The rows of a batch that ``judge`` keeps, with all their columns."""
        judged = self.judge(docs, batch, key, text)
        own = judged.where(F.col(key).eqNullSafe(F.col("keep_id"))).groupBy(F.unhex("text_sha256").alias("__digest"), F.col(key).alias("__key")).agg(F.count("*").alias("__same"), F.max("kept").alias("__kept"))
        stay = materialize(own.where("__kept").drop("__kept"), "stay")
        # All columns as one, whatever their names.
        named = docs.select(F.struct("*").alias("doc"), self.digest(F.col(text)).alias("digest"), F.col(key).cast("long").alias("key"))
        rows = join_sized(named, stay, (named["digest"] == stay["__digest"]) & named["key"].eqNullSafe(stay["__key"]), "inner", 64)
        once = rows.where("__same = 1")
        if not stay.where("__same > 1").isEmpty():
            once = once.unionByName(rows.where("__same > 1").dropDuplicates(["digest"]))
        return once.select("doc.*")
