"""Readers, writers and incremental work."""

import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corvane.schemas import CANDIDATES
from corvane.sources import readers, writers
from corvane.streaming.incremental import collect_shards, label_rates


def test_jsonl_skips_blank_lines_and_fails_on_bad_rows(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "k int").count() == 2
    (tmp_path / "b.jsonl").write_text('{"k": 1}\nnonsense\n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        readers.read_jsonl(spark, str(tmp_path / "b.jsonl"), "k int").collect()


@pytest.mark.parametrize("shape", ["list", "candidate_rows", "rows", "jsonl", "parquet"])
def test_candidates_by_suffix(spark, tmp_path, shape):
    rows = [{"candidate_id": "p:gold", "candidate_text": "x"}, {"candidate_id": "q:gold", "candidate_text": "y"}]
    if shape == "parquet":
        path = tmp_path / "c.parquet"
        pq.write_table(pa.Table.from_pylist(rows), path)
    elif shape == "jsonl":
        path = tmp_path / "c.jsonl"
        path.write_text("\n".join(map(json.dumps, rows)))
    else:
        path = tmp_path / "c.json"
        path.write_text(json.dumps(rows if shape == "list" else {shape: rows}))
    got = readers.read_candidates(spark, str(path), CANDIDATES)
    assert {(r.candidate_id, r.candidate_text) for r in got.collect()} == {("p:gold", "x"), ("q:gold", "y")}


def test_artifact_header_is_checked(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"artifact_type": "other", "schema_version": "v", "sample_count_per_prompt": 10, "prompt_group_count": 0, "samples": []}))
    with pytest.raises(Exception, match="free-sample"):
        readers.read_free_samples(spark, str(tmp_path / "s.json")).collect()


def test_optional_and_shards(spark, tmp_path):
    assert readers.read_optional(spark, str(tmp_path / "none.parquet")) is None
    for i, content in enumerate(['{"k": 1}', '{"k": 2}', '{"k": ']):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "shard.json").write_text(content)
    good, bad = readers.read_shards(spark, str(tmp_path), "k int")
    assert sorted(r.k for r in good.collect()) == [1, 2] and bad.count() == 1


def test_half_floats(spark, tmp_path):
    values = pa.array([[np.float16(1.5), np.float16(-2)], [np.float16(0.25)]], pa.list_(pa.float16()))
    pq.write_table(pa.table({"prompt_id": ["a", "b"], "full_logits": values}), tmp_path / "h.parquet")
    got = readers.read_half_floats(spark, str(tmp_path), {"prompt_id": "string", "full_logits": "array<float>"})
    assert {r.prompt_id: r.full_logits for r in got.collect()} == {"a": [1.5, -2.0], "b": [0.25]}


def test_ragged_logits_fail(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "id string, full_logits array<float>")
    with pytest.raises(Exception, match="ragged"):
        writers.write_full_logits(df, str(tmp_path / "bad"), 2)
    writers.write_full_logits(df.where("id = 'a'"), str(tmp_path / "good"), 2)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1


def test_mappers(spark):
    rows = spark.createDataFrame([("1", "q ", ["b", " a", "", "b"]), ("2", "q", [])], "row_id string, question string, answer array<string>")
    assert [tuple(r) for r in readers.map_open(rows, bad="drop").collect()] == [("1", "q", "b", ["a", "b"], 2)]
    with pytest.raises(Exception, match="no question or no answer"):
        readers.map_open(rows).collect()
    rows = spark.createDataFrame([("Body.", "How many?", 3, "7", "sum")], "Body string, Question string, Answer int, ID string, Type string")
    assert [r.asDict() for r in readers.map_arithmetic(rows).collect()] == [{"ID": "7", "Type": "sum", "question": "Body. How many?", "primary_answer": "3", "aliases": ["3"], "alias_count": 1}]
    rows = spark.createDataFrame([("q", "<answer> yes\n <context> more"), ("q", "no tags")], "question string, text string")
    assert [(r.primary_answer, r.parsed_with_tag) for r in readers.map_tagged(rows).collect()] == [("yes", "true"), ("no tags", "false")]


def test_provenance_and_macros(spark):
    df = spark.createDataFrame([(1, 2.0, [1])], "k int, x double, heavy array<int>")
    lean, side = writers.split_provenance(df, "k", ["heavy"])
    assert lean.columns == ["k", "x"] and side.columns == ["k", "heavy"]
    assert {(r.name, r.text) for r in writers.macro_lines(df.select("x"), 1).collect()} == {("x", "2.0")}


def test_stream_collects_shards_once(spark, tmp_path):
    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    (source / "a.json").write_text('{"id": 1, "v": "x"}\n{"id": 1, "v": "x"}\n')
    for extra in ('{"id": 2, "v": "y"}', '{"id": 1, "v": "again"}'):
        collect_shards(spark, str(source), "id int, v string", target, state, ["id"]).awaitTermination()
        (source / f"{len(extra)}.json").write_text(extra)
    collect_shards(spark, str(source), "id int, v string", target, state, ["id"]).awaitTermination()
    assert sorted((r.id, r.v) for r in spark.read.parquet(target).collect()) == [(1, "x"), (2, "y")]


def test_rates_stream_like_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = label_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = label_rates(spark.read.parquet(f"{sf_dir}/events.parquet"))
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, batch.collect()))


def test_documents_are_parts_that_tasks_share(spark, tmp_path, monkeypatch):
    """Each part has its header and a bounded number of rows; all rows come back, and an empty list keeps its header."""
    from corvane.sources import readers, writers

    monkeypatch.setattr(writers, "DOCUMENT_ROWS", 10)
    rows = spark.range(0, 45, 1, 2).selectExpr("cast(id as string) candidate_id", "'q' question", "'a' candidate_text")
    path = f"{tmp_path}/c.json"
    writers.write_document(writers.listed(rows, "candidate_rows"), path)
    files = spark.read.text(path).selectExpr("value", "input_file_name() f")
    assert files.groupBy("f").count().where("count > 1").count() == 0 and files.count() == 6
    assert {r.candidate_id for r in readers.read_candidates(spark, path, "candidate_id string, question string, candidate_text string").collect()} == {str(i) for i in range(45)}
    assert writers.listed(rows.where("candidate_id < ''"), "candidate_rows").collect()[0].candidate_rows == []
