"""Sources and sinks of the pipeline's tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "documents": "id string, url string, title string, domain string, timestamp timestamp, depth int, parent_url string, links array<struct<source_doc_id:string,target_url:string,anchor_text:string,is_internal:boolean>>",
    "content_blocks": "doc_id string, position int, type string, tag string, text string",
    "semantic_blocks": "block_id string, doc_id string, section_id string, text string, block_type string, heading_path array<string>, order_index int, token_estimate int",
    "concept_candidates": "concept_id string, doc_id string, name string, type string, description string, source_block_id string, heading_path array<string>, confidence double",
    "canonical_concepts": "canonical_id string, doc_id string, canonical_name string, aliases array<string>, type string, descriptions array<string>, source_blocks array<string>, occurrence_count int, importance_score double",
    "concept_edges": "edge_id string, doc_id string, source_concept_id string, target_concept_id string, relation_type string, evidence_block_id string, confidence double",
    "graph_nodes": "id string, doc_id string, label string, type string, aliases array<string>, occurrence_count int, importance_score double, degree_centrality double, betweenness_centrality double, clustering_coefficient double",
    "graph_edges": "id string, doc_id string, source string, target string, relation_type string, confidence double, evidence_blocks array<string>",
}

#: Partitions of a table that is stored by key.
PARTS = 64


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _part(key: Column) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(PARTS)).cast("int")


def save(df: DataFrame, path: str, fmt: str = "parquet", key: str | None = None) -> None:
    """Write a table; with ``key`` only the rows of the keys present are replaced.

    Such a table is partitioned by a hash of the key, so that keys, however
    many, make no folders; rows of other keys in the same partitions stay.
    """
    if not key:
        df.write.mode("overwrite").format(fmt).save(path)
        return
    spark = df.sparkSession
    new = df.withColumn("_part", _part(F.col(key)))
    try:
        old = spark.read.format(fmt).load(path)
    except AnalysisException:  # nothing is there yet
        old = None
    if old is not None:
        touched = new.select("_part").distinct()
        stay = old.join(F.broadcast(touched), "_part", "left_semi").join(df.select(key).distinct(), key, "left_anti")  # PARTS rows
        new = store(new.unionByName(stay, allowMissingColumns=True), "replaced")
    new.write.mode("overwrite").format(fmt).partitionBy("_part").option("partitionOverwriteMode", "dynamic").save(path)


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Add rows to a stored table: sessions, messages, tool runs, articles, graphs."""
    df.write.mode("append").format(fmt).save(path)


def read(spark: SparkSession, path: str, table: str, fmt: str = "parquet") -> DataFrame:
    """Read a table of ``SCHEMAS``; malformed JSON gives nulls and ``_corrupt_record``."""
    reader = spark.read.format(fmt)
    if fmt == "json":
        return reader.schema(f"{SCHEMAS[table]}, _corrupt_record string").option("mode", "PERMISSIVE").load(path)
    return reader.schema(SCHEMAS[table]).load(path)


def with_id(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def ids(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.select(key).distinct()


def existing(df: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """The wanted ids that the table has."""
    return wanted.join(df.select(key), key, "left_semi")


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Where that is unset it is set: to a temporary folder in local mode, as in
    tests, else to one beside the warehouse's tables, which executors share.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        local = re.match(r"local(\[|$)", spark.sparkContext.master)
        shared = tempfile.mkdtemp(prefix="spark-work-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def store(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    This cuts the lineage at a table that outlives any executor.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges of all graphs; graphs stored before under the same ids are replaced."""
    save(nodes, f"{path}/nodes", key="doc_id")
    save(edges, f"{path}/edges", key="doc_id")


def load_graph(spark: SparkSession, path: str, doc_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, of one document from its partition if given."""
    out = []
    for name, table in (("nodes", "graph_nodes"), ("edges", "graph_edges")):
        df = spark.read.schema(f"{SCHEMAS[table]}, _part int").parquet(f"{path}/{name}")
        if doc_id is not None:
            df = df.where((F.col("_part") == _part(F.lit(doc_id))) & (F.col("doc_id") == doc_id))
        out.append(df.drop("_part"))
    return out[0], out[1]


def catalog(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Graphs with their counts and a name to show: doc_id, n_nodes, n_edges, name."""
    n = nodes.groupBy("doc_id").agg(F.count("*").alias("n_nodes"))
    e = edges.groupBy("doc_id").agg(F.count("*").alias("n_edges"))
    name = F.initcap(F.replace(F.col("doc_id").cast("string"), F.lit("_"), F.lit(" ")))
    return n.join(e, "doc_id", "full_outer").select("doc_id", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"), name.alias("name"))
