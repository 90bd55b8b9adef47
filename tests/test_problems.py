"""Orphan references and nested records on small fixtures with every dirty case."""

import datetime as dt
import json

from pyspark.sql import functions as F

from lodestrata.operators import dewey, orphans
from lodestrata.operators import skew
from lodestrata.operators.skew import skew_lookup

T = lambda month, day=1: dt.datetime(2024, month, day)


def graph(spark, links, targets):
    rows = spark.createDataFrame(links, "id STRING, target STRING, at TIMESTAMP_NTZ, extra STRING")
    parents = spark.createDataFrame(targets, "key STRING, made TIMESTAMP_NTZ, gone TIMESTAMP_NTZ, id STRING")
    refs = [orphans.Reference("links", "target", rows, F.col("id"), F.col("target"), F.col("at"), "parents")]
    return refs, [orphans.Target("parents", parents, "key", "made", "gone")]


def test_direct_orphans(spark):
    links = [("1", "a", T(3), "x"), ("1", "a", T(3), "y"), ("2", "b", T(3), None), ("3", "c", T(3), None), ("4", None, T(3), None), ("5", "d", T(3), None), ("6", "zz", None, None), ("7", "d", None, None), ("8", "e", T(3), None)]
    targets = [("a", T(1), T(2), None), ("a", T(2), None, None), ("b", T(1), None, None), ("b", T(2), T(2), None), ("d", T(5), None, None), ("e", T(1), None, None), ("e", T(4), None, None), (None, T(1), None, None)]
    refs, parents = graph(spark, links, targets)
    got = {(r["ref_key"], r["reason"], r["ref_month"]) for r in orphans.direct_orphans(refs, parents).collect()}
    assert got == {("2", "deleted", "2024-03"), ("3", "missing", "2024-03"), ("5", "late", "2024-03"), ("6", "missing", None)}


def test_equal_times_count_the_withdrawn_state(spark):
    refs, parents = graph(spark, [("1", "a", T(3), None)], [("a", T(1), None, None), ("a", T(1), T(2), None)])
    assert [r["reason"] for r in orphans.direct_orphans(refs, parents).collect()] == ["deleted"]


def test_cascade_reaches_a_fixpoint_through_cycles(spark):
    refs, parents = graph(spark, [("1", "gone", T(3), None), ("9", "a", T(3), None)], [("a", T(1), None, None)])
    tree = spark.createDataFrame([("n1", "1"), ("n2", "n1"), ("n3", "n2"), ("n1", "n3"), ("n9", "9"), ("n0", None)], "id STRING, up STRING").withColumn("at", F.lit(T(4)).cast("timestamp_ntz"))
    edges = [
        orphans.Edge("nodes", "up", tree, F.col("id"), F.col("up"), F.col("at"), "links"),
        orphans.Edge("nodes", "up", tree, F.col("id"), F.col("up"), F.col("at"), "nodes"),
    ]
    found = orphans.orphan_cascade(refs, parents, edges)
    assert {(r["ref_key"], r["kind"], r["depth"]) for r in found.collect()} == {("1", "direct", 0), ("n1", "inherited", 1), ("n2", "inherited", 2), ("n3", "inherited", 3)}
    report = {r["ref_table"]: (r["n_direct"], r["n_inherited"]) for r in orphans.orphan_report(found).collect()}
    assert report == {"links": (1, 0), "nodes": (0, 3)}


def test_empty_tables_have_no_orphans(spark):
    refs, parents = graph(spark, [], [])
    assert orphans.orphan_cascade(refs, parents, []).count() == 0
    refs, parents = graph(spark, [("1", "a", T(3), None)], [])
    assert [r["reason"] for r in orphans.direct_orphans(refs, parents).collect()] == ["missing"]


def test_skew_lookup_equals_a_join(spark):
    left = spark.createDataFrame([(None, 0)] + [("hot", i) for i in range(300)] + [(f"k{i % 7}", i) for i in range(50)], "k STRING, n INT")
    right = spark.createDataFrame([("hot", "x"), ("k1", "y"), ("k2", "z"), ("other", "w")], "k STRING, v STRING")
    for how in ("left", "inner", "left_semi", "left_anti"):
        for most in (1, 3, 100):
            a, b = skew_lookup(left, right, ["k"], how, most), left.join(right, ["k"], how)
            assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect())), (how, most)


def test_hot_keys(spark):
    df = spark.createDataFrame([("hot", i) for i in range(300)] + [(None, 0)] * 400 + [(f"k{i}", i) for i in range(500)], "k STRING, n INT")
    counted = df.groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    hot = df.where("k = 'hot'").select(F.xxhash64("k")).head()[0]
    assert skew.hot_hashes(df, ["k"], 200, 100) == [hot] and skew.hot_counted(counted.where("k IS NOT NULL"), ["k"], "c", 1200, 200, 100) == [hot]
    assert skew.hot_hashes(df, ["k"]) == [] and skew.hot_hashes(df.limit(0), ["k"], 1, 1) == []
    right = spark.createDataFrame([("hot", "x"), ("k1", "y")], "k STRING, v STRING")
    split = skew_lookup(df, right, ["k"], "left", heavy=[hot])
    assert sorted(map(str, split.collect())) == sorted(map(str, df.join(right, ["k"], "left").select(split.columns).collect()))


def test_shred_typed_columns(spark):
    df = spark.createDataFrame([("a", [{"f": [{"v": "1"}, None, {"v": "2"}]}, None, {"f": None}, {"f": []}]), ("b", None), ("c", []), (None, [{"f": [{"v": None}]}])], "id STRING, items ARRAY<STRUCT<f: ARRAY<STRUCT<v: STRING>>>>")
    tables = dewey.shred(df, F.col("id"), "items")
    assert sorted(tables) == ["items[]", "items[].f[]"]
    items = [(r["owner"], r["dewey"], r["parent"], r["node"] is None) for r in tables["items[]"].collect()]
    assert items == [("a", "0", None, False), ("a", "1", None, True), ("a", "2", None, False), ("a", "3", None, False), (None, "0", None, False)]
    fields = [(r["owner"], r["dewey"], r["parent"]) for r in tables["items[].f[]"].collect()]
    assert fields == [("a", "0.0", "0"), ("a", "0.1", "0"), ("a", "0.2", "0"), (None, "0.0", "0")]
    derived = tables["items[].f[]"].withColumn("p", dewey.parent_label(F.col("dewey"))).where("NOT p <=> parent").count()
    assert derived == 0


def test_shred_json_shapes(spark):
    deep = "x"
    for _ in range(60):
        deep = [deep]
    texts = [
        ("list", json.dumps([{"fields": {"column_2": {"value": "v"}, "column_3": None}, "n": 1}, None, {"record": {"fields": [{"column_index": 4}, None]}}])),
        ("lone", json.dumps({"fields": {"column_1": "text"}})),
        ("twice", json.dumps(json.dumps([{"a": "é"}]))),
        ("null", "null"), ("bad", "{"), ("empty", ""), ("none", None), ("scalar", "3"), ("deep", json.dumps(deep)),
    ]
    rows = dewey.shred_json(spark.createDataFrame(texts, "id STRING, t STRING"), F.col("id"), F.col("t")).collect()
    by = {}
    for r in rows:
        by.setdefault(r["owner"], []).append((r["path"], r["dewey"], r["kind"]))
    assert set(by) == {"list", "lone", "twice", "deep"}
    assert ("[].fields.column_#", "0.0.0", "object") in by["list"] and ("[].fields.column_#", "0.0.1", "null") in by["list"]
    assert ("[]", "1", "null") in by["list"] and ("[].record.fields[]", "2.0.0.0", "object") in by["list"]
    assert by["lone"][0] == ("[]", "0", "object")
    assert [r["attributes"] for r in rows if r["owner"] == "twice"] == [{"a": "é"}]
    assert max(len(d.split(".")) for _, d, _ in by["deep"]) == 60
    labels = {(r["owner"], r["dewey"]) for r in rows}
    assert all((r["owner"], r["parent"]) in labels for r in rows if r["parent"] is not None)
