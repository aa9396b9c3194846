"""Whole phases, sources and sinks, and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from kgspark.operators import concepts as C
from kgspark.operators import replies as L
from kgspark.operators import sessions as S
from kgspark.plans import inputs as I
from kgspark.plans import pipeline
from kgspark.sources import tables
from kgspark.streaming.concept_state import follow

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("parity", [False, True])
def test_parse_replies(spark, parity):
    concept = {"name": "A", "type": "t", "description": "d", "confidence": 2}
    texts = [
        json.dumps({"concepts": [concept, {"type": "x"}, 3, {"name": 5}, {"name": "B", "description": 7}, {"name": "C", "confidence": "high"}]}),
        json.dumps([concept]),
        "```json\n" + json.dumps({"concepts": [{"name": "D", "description": "w " * 30}]}) + "\n```",
        '{"concepts": [{"name": "E"}',
        "",
        None,
    ]
    rows = spark.createDataFrame([(1, f"b{i}", i, t) for i, t in enumerate(texts)], "doc_id int, block_id string, ord int, raw_output string")
    got = [(r.block_id, r.name, r.type, r.confidence) for r in C.parse(rows, parity).orderBy("ord", "place").collect()]
    want = [("b0", "A", "t", 1.0), ("b0", "C", "core_concept", 0.6)] + ([] if parity else [("b1", "A", "t", 1.0)]) + [("b2", "D", "core_concept", 0.6)]
    assert got == want
    long = C.parse(rows).where("name = 'D'").first().description
    assert long == " ".join(["w"] * 25) + "..."


def test_failures_are_rows(spark):
    texts = ['{"concepts": [{"name": "A"}]}', "", None, "no json", '{"concepts": []}', '{"concepts": [{"x": 1}]}']
    rows = spark.createDataFrame([(i % 2, f"b{i}", i, t) for i, t in enumerate(texts)], "doc_id int, block_id string, ord int, raw_output string")
    assert {r.block_id: r.reason for r in C.failures(rows).collect()} == {"b1": "no reply", "b2": "no reply", "b3": "no JSON", "b4": "no concepts", "b5": "no concepts"}


def test_all_phases(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(5)
    from kgspark.operators import blocks as B

    semantic = tables.store(B.semantic_blocks(pipeline.ingest(pages)))
    words = semantic.select("block_id", F.slice(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 5)), 1, 4).alias("w"))
    listed = F.to_json(F.struct(F.transform("w", lambda w: F.struct(w.alias("name"))).alias("concepts")))
    candidates = tables.store(pipeline.extract(semantic, words.select("block_id", listed.alias("raw_output"))))
    assert candidates.count() > 10
    vectors = candidates.select(F.concat("name", F.lit(". "), "description").alias("key"), F.array(F.length("name").cast("double"), F.ascii("name").cast("double")).alias("vec")).distinct()
    canonical, counts = pipeline.normalize(candidates, vectors, tables.store, threshold=0.9999)
    assert all(r.n_canonical <= r.n_unique <= r.n_candidates for r in counts.collect())
    pair = F.when(F.size("w") > 1, F.to_json(F.struct(F.array(F.struct(F.get("w", 0).alias("source"), F.get("w", 1).alias("target"), F.lit("uses").alias("relation_type"), F.lit(0.9).alias("confidence"))).alias("relationships"))))
    edges = tables.store(pipeline.relate(semantic, canonical, words.select("block_id", pair.alias("raw_output"))))
    n, e, meta = pipeline.build_graph(canonical, edges, tables.store)
    assert n.count() > 0 and e.count() <= edges.count()
    assert {r.doc_id for r in meta.collect()} == {r.doc_id for r in canonical.select("doc_id").distinct().collect()}


def test_round_trips(spark, tmp_path):
    nodes = spark.createDataFrame([("d1", "n1", "A"), ("d2", "n2", "B")], "doc_id string, id string, label string")
    edges = spark.createDataFrame([("d1", "e1", "n1", "n1")], "doc_id string, id string, source string, target string")
    tables.save_graph(nodes, edges, str(tmp_path / "g"))
    n, e = tables.load_graph(spark, str(tmp_path / "g"), "d1")
    assert [r.id for r in n.collect()] == ["n1"] and [r.id for r in e.collect()] == ["e1"]
    tables.save(nodes.where("doc_id = 'd2'").withColumn("label", F.lit("C")), str(tmp_path / "g/nodes"), key="doc_id")
    assert {r.label for r in tables.load_graph(spark, str(tmp_path / "g"))[0].collect()} == {"A", "C"}
    assert [r.n_edges for r in tables.catalog(nodes, edges).orderBy("doc_id").collect()] == [1, 0]
    tables.append(nodes.where("doc_id = 'd1'"), str(tmp_path / "log"))
    tables.append(nodes, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('{"doc_id": "d", "position": 1, "text": "x"}\n{broken\n')
    rows = tables.read(spark, str(tmp_path / "j"), "content_blocks", "json").collect()
    assert sorted((r.doc_id or "", r._corrupt_record or "") for r in rows) == [("", "{broken"), ("d", "")]


def test_stream_agrees_with_batch(spark, tmp_path):
    changes = I.changes(spark, SF)
    changes.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    held = {}

    def sink(batch, _):
        held.update({(r.session_id, r.concept_name): tuple(r) for r in batch.collect()})

    running = follow(stream, sink, str(tmp_path / "state"))
    running.processAllAvailable()
    running.stop()
    assert held == {(r.session_id, r.concept_name): tuple(r) for r in S.concept_states(changes).collect()}


def test_model_calls(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "fail")], "key long, prompt string")

    def client():
        def call(prompt):
            if prompt == "fail":
                raise RuntimeError
            return prompt.upper()

        return call

    assert {r.key: r.raw_output for r in L.complete_with(prompts, client).collect()} == {1: "A", 2: None}


def test_intents(spark):
    rows = spark.createDataFrame([(1, '{"intent": "Suggest"}'), (2, "so {\"intent\": \"x\"}"), (3, "nothing"), (4, None)], "key long, raw_output string")
    assert [(r.intent, r.confidence) for r in L.intents(rows).orderBy("key").collect()] == [("suggest", 0.5), ("unknown", 0.5), ("unknown", 0.0), ("unknown", 0.0)]


def test_an_item_quoted_as_text_is_none(spark):
    from kgspark.operators import concepts, relations

    quoted = '"{\\"name\\":\\"b\\",\\"source\\":\\"a\\",\\"target\\":\\"b\\",\\"relation_type\\":\\"USES\\"}"'
    item = '{"name":"a","source":"p","target":"q","relation_type":"USES","confidence":"0.7"}'
    rows = spark.createDataFrame([(1, "1_0", 0, f'{{"concepts":[{quoted},{item}]}}'), (1, "1_1", 1, f"[{item},{quoted}]")], "doc_id int, block_id string, ord int, raw_output string")
    assert [(r.block_id, r.place, r.name, r.confidence) for r in concepts.parse(rows).orderBy("block_id").collect()] == [("1_0", 1, "a", 0.7), ("1_1", 0, "a", 0.7)]
    told = spark.createDataFrame([(1, "1_0", 0, f'{{"relationships":[{quoted}]}}')], "doc_id int, block_id string, ord int, raw_output string")
    assert relations.parse(told).collect() == []
