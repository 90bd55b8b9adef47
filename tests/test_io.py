"""Readers, writers and streams."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrata.sinks import writers
from lodestrata.sources import documents
from lodestrata.streaming import ledger


def page(cells, raw=None):
    table = lambda rows: {"status": "OK", "rows": [{"row": i, "cells": [{"text": t, "confidence": 0.98, "status": s} for t, s in r]} for i, r in enumerate(rows)]}
    return {"page": 1, "reconstructed_tables": [table(cells)] if cells else [], "tables": [table(raw)] if raw else []}


def write(folder, name, value):
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value))


def test_stage_documents(spark, tmp_path):
    head = [("Sample", "OK"), ("Value", "OK")]
    write(tmp_path, "a.json", {"document": "a", "pages": [page([head, [("S1", "OK"), ("5.00", "FALLBACK_OCR")]])]})
    write(tmp_path, "b.json", {"document": "b", "documents": [{"document": "b", "pages": [page([], [head, [("S1", "OK"), ("5.10", "OK")]])]}]})
    write(tmp_path, "skip.txt", "no")
    docs = documents.read_documents(spark, str(tmp_path))
    cells = {(r["document"], r["header"]): (r["value"], r["verification_status"], r["source_ocr_confidence"]) for r in documents.adapt_tables(docs).collect()}
    assert cells["a", "Value"] == ("5.00", "UNVERIFIED", 0.98) and cells["b", "Value"] == ("5.10", "OK", 0.98) and len(cells) == 4
    write(tmp_path, "bad.json", "{")
    assert len(documents.read_documents(spark, str(tmp_path), strict=False).collect()) == 2
    with pytest.raises(Exception, match="(?i)malformed|failfast|parse"):
        documents.read_documents(spark, str(tmp_path)).collect()


def test_document_without_pages_is_an_error(spark, tmp_path):
    write(tmp_path, "a.json", {"document": "empty", "pages": []})
    with pytest.raises(Exception, match="no pages in document empty"):
        documents.require_pages(documents.read_documents(spark, str(tmp_path))).collect()


def test_files(spark, tmp_path):
    for name in ("x.json", "review_x.json"):
        write(tmp_path, name, "{}")
    files = documents.list_files(spark, str(tmp_path), "*.json", "review_")
    assert [r["name"] for r in files.collect()] == ["x.json"]
    assert documents.newest(documents.list_files(spark, str(tmp_path)), F.lit("all")).count() == 1
    layouts = spark.createDataFrame([("p", 2, "late"), ("p", 1, "first")], "page STRING, priority INT, path STRING")
    assert documents.first_layout(layouts, ["page"], "priority").head()["path"] == "first"


def test_engine_boundary(spark):
    images = spark.createDataFrame([("p1", bytearray(b"ok")), ("p2", bytearray(b"bad"))], "path STRING, content BINARY")

    def engine(content):
        if content == b"bad":
            raise ValueError
        return [(" a  b ", 0.98765, [[1.0, 2.0], [5.0, 1.0]])]

    found = documents.with_engine(images, engine).select("path", "block_index", "text", "confidence", "bbox", "error").collect()
    assert [tuple(r) for r in found] == [("p1", 0, "a b", 0.9877, [1.0, 1.0, 5.0, 2.0], None), ("p2", None, None, None, None, "ValueError: ")]


def test_replace_and_report(spark, tmp_path):
    at = str(tmp_path / "t")
    df = lambda *rows: spark.createDataFrame(rows, "doc STRING, n INT")
    writers.replace_table(df(("a", 1), ("b", 1)), at)
    writers.merge_report(df(("a", 2)), at, "doc")
    assert sorted(map(tuple, spark.read.parquet(at).collect())) == [("a", 2), ("b", 1)]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    writers.publish(df(("a", 1), ("b", 2)), "doc", F.col("n") > 1, str(tmp_path / "p"))
    assert [r["doc"] for r in spark.read.parquet(str(tmp_path / "p")).collect()] == ["a"]


def test_snapshots(spark, tmp_path):
    folder, store = tmp_path / "out", str(tmp_path / "store")
    folder.mkdir()
    for name, value in (("a", "1"), ("b", "1"), ("c", "2")):
        write(folder, name, value)
    state = writers.snapshot(spark, str(folder), store)
    assert state.count() == 3 and spark.read.parquet(store).count() == 2
    writers.snapshot(spark, str(folder), store)
    assert spark.read.parquet(store).count() == 2
    assert writers.read_verified(spark, state, store).count() == 3
    wrong = spark.createDataFrame([("0" * 64, bytearray(b"x"))], "sha256 STRING, content BINARY")
    wrong.write.parquet(str(tmp_path / "wrong"))
    with pytest.raises(Exception, match="changed content"):
        writers.read_verified(spark, spark.createDataFrame([("p", "0" * 64)], "path STRING, sha256 STRING"), str(tmp_path / "wrong")).collect()


def test_report_escapes(spark):
    page_ = writers.html_report(spark.createDataFrame([("<b>",), (None,)], "t STRING"), ["t"], "T & U")
    assert "&lt;b&gt;" in page_ and "T &amp; U" in page_
    assert writers.summary_line(spark.createDataFrame([("x",), ("x",), ("y",)], "s STRING"), "s") == "x: 2, y: 1"


def test_upsert_stream_is_idempotent(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    df = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("m", 1, "x")], "key STRING, at INT, v STRING")
    df.write.parquet(source)
    for run in ("1", "2"):  # the second run gets everything again
        stream = spark.readStream.schema(df.schema).parquet(source)
        ledger.upsert_stream(stream, table, ["key"], ["at"], str(tmp_path / f"cp{run}")).awaitTermination()
        assert sorted(map(tuple, spark.read.parquet(table).collect())) == [("k", 2, "new"), ("m", 1, "x")]


def damage(folder):
    for file in folder.glob("*.parquet"):
        file.write_bytes(b"damaged")


def test_a_damaged_table_is_an_error_and_stays(spark, tmp_path):
    schema = "key STRING, at INT, v STRING"
    spark.createDataFrame([("n", 1, "late")], schema).write.parquet(str(tmp_path / "in"))
    for name, run in (
        ("upsert", lambda at: ledger.upsert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), at, ["key"], ["at"], at + "-cp").awaitTermination()),
        ("report", lambda at: writers.merge_report(spark.createDataFrame([("n", 1, "late")], schema), at, "key")),
        ("update", lambda at: writers.update_table(spark, at, lambda held: held.where("at > 0"))),
    ):
        at = tmp_path / name
        spark.range(1000).selectExpr("string(id) AS key", "1 AS at", "'x' AS v").coalesce(1).write.parquet(str(at))
        damage(at)
        before = {p.name: p.read_bytes() for p in at.iterdir()}
        with pytest.raises(Exception, match="(?i)parquet|damaged|footer"):
            run(str(at))
        assert {p.name: p.read_bytes() for p in at.iterdir()} == before


def test_upsert_by_bucket_leaves_other_buckets_alone(spark, tmp_path):
    schema, table = "key STRING, at INT, v STRING", tmp_path / "table"
    spark.createDataFrame([(f"k{i}", 1, "old") for i in range(40)], schema).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    ledger.upsert_stream(stream(), str(table), ["key"], ["at"], str(tmp_path / "cp"), buckets=8).awaitTermination()
    before = {p: p.stat().st_mtime_ns for p in table.rglob("*.parquet")}
    spark.createDataFrame([("k7", 2, "new"), ("k7", 0, "older")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    ledger.upsert_stream(stream(), str(table), ["key"], ["at"], str(tmp_path / "cp"), buckets=8).awaitTermination()
    after = {p: p.stat().st_mtime_ns for p in table.rglob("*.parquet")}
    assert len({p.parent for p in before}) > 4 and len({p.parent for p in before.keys() ^ after.keys()}) == 1
    assert {(r["key"], r["v"]) for r in spark.read.parquet(str(table)).collect()} == {(f"k{i}", "new" if i == 7 else "old") for i in range(40)}


def test_interrupted_replacement_is_recovered(spark, tmp_path):
    at = tmp_path / "t"
    writers.replace_table(spark.range(3), str(at))
    at.rename(tmp_path / "t.old-1")
    writers.merge_report(spark.createDataFrame([(9,)], "id BIGINT"), str(at), "id")
    assert sorted(r[0] for r in spark.read.parquet(str(at)).collect()) == [0, 1, 2, 9]


def test_update_under_a_lock(spark, tmp_path):
    at = str(tmp_path / "t")
    writers.update_table(spark, at, lambda held: spark.range(2) if held is None else held)
    with pytest.raises(ValueError, match="simulated"):
        writers.update_table(spark, at, lambda held: (_ for _ in ()).throw(ValueError("simulated")))
    assert spark.read.parquet(at).count() == 2
    with writers.locked(spark, at), pytest.raises(TimeoutError), writers.locked(spark, at, timeout=0.15, poll=0.02):
        pass
    writers.update_table(spark, at, lambda held: held.unionByName(spark.range(2, 5)))
    assert spark.read.parquet(at).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_versions_and_paths(spark, tmp_path):
    at = str(tmp_path / "t")
    for n in (2, 3):
        writers.publish_version(spark.range(n), at)
        assert writers.read_version(spark, at).count() == n
    state = spark.createDataFrame([("a/../../b", "0")], "path STRING, sha256 STRING")
    spark.createDataFrame([("0", bytearray(b"x"))], "sha256 STRING, content BINARY").write.parquet(str(tmp_path / "store"))
    with pytest.raises(Exception, match="invalid path"):
        writers.read_verified(spark, state, str(tmp_path / "store")).collect()


def test_scratch_folder(spark):
    from types import SimpleNamespace

    from lodestrata import session

    held = session.materialize(spark.range(4))
    assert held.count() == 4 and session.exists(spark, held._lodestrata_path)
    session.discard(held)
    assert not session.exists(spark, held._lodestrata_path)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getConf=dict, getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        session.scratch_root(cluster)
