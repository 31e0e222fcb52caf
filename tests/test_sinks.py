"""Sinks: what is rewritten, and writers that meet."""

import threading

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.sources import sinks


def folders(spark, path):
    return {p: tuple(f) for p, f in sinks.manifest(spark, path)["folders"].items()}


def content(spark, path):
    return sorted(map(tuple, sinks.read_table(spark, path).collect()))


def test_an_upsert_rewrites_only_its_parts(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    sinks.upsert_rows(rows, path, ["k"], parts=32)
    before = folders(spark, path)
    sinks.upsert_rows(spark.createDataFrame([(3, "new"), (2000, "new")], "k long, v string"), path, ["k"])
    after = folders(spark, path)
    assert len(before) == 32 and 1 <= sum(before[p] != after[p] for p in after) <= 2
    assert content(spark, path) == sorted([(k, "new" if k == 3 else "old") for k in range(1000)] + [(2000, "new")])
    assert [r.v for r in sinks.read_key(spark, path, k=3).collect()] == ["new"]
    assert len(sinks.read_key(spark, path, k=3).inputFiles()) == 1


def test_two_writers_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert_rows(spark.createDataFrame([(-1, "x")], "k long, v string"), path, ["k"], parts=4)
    errors = []

    def work(n):
        try:
            for i in range(3):
                sinks.upsert_rows(spark.createDataFrame([(n * 100 + i, f"w{n}"), (-1, f"w{n}")], "k long, v string"), path, ["k"])
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in (1, 2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    got = content(spark, path)
    assert [k for k, _ in got] == sorted([-1] + [n * 100 + i for n in (1, 2, 3) for i in range(3)])
    assert sinks.manifest(spark, path)["number"] == 9


def test_cache_entries_are_added_beside_the_others(spark, tmp_path):
    path = str(tmp_path / "c")
    entry = lambda lo, hi, v: spark.range(lo, hi).select(F.col("id").alias("h"), F.lit(v).alias("v"))
    sinks.add_to_cache(entry(0, 40, "a"), path, ["h"], parts=4)
    first = folders(spark, path)
    sinks.add_to_cache(entry(0, 80, "b"), path, ["h"])
    second = folders(spark, path)
    assert all(second[p][: len(first[p])] == first[p] for p in first)
    number = sinks.manifest(spark, path)["number"]
    sinks.add_to_cache(entry(0, 80, "c"), path, ["h"])
    assert sinks.manifest(spark, path)["number"] == number
    for i in range(10):
        sinks.add_to_cache(entry(80 + 40 * i, 120 + 40 * i, "d"), path, ["h"])
    assert max(map(len, folders(spark, path).values())) <= sinks.FOLDERS
    assert content(spark, path) == sorted([(h, "a") for h in range(40)] + [(h, "b") for h in range(40, 80)] + [(h, "d") for h in range(80, 480)])


def test_groups_are_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "g")
    rows = lambda *r: spark.createDataFrame(list(r), "g long, v long")
    sinks.replace_groups(rows((1, 1), (1, 2), (2, 3)), path, "g", rows((1, 0), (2, 0)), parts=4)
    sinks.replace_groups(rows((2, 9), (3, 4)), path, "g", rows((1, 0), (2, 0), (3, 0)))
    assert content(spark, path) == [(2, 9), (3, 4)]
    sinks.delete_keys(rows((3, 0)), path, ["g"])
    assert content(spark, path) == [(2, 9)]


def test_columns_are_added_and_keys_changed(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), path)
    sinks.upsert_rows(spark.createDataFrame([(2, "c", 5)], "k long, v string, n long"), path, ["k"])
    assert content(spark, path) == [(1, "a", None), (2, "c", 5)]
    sinks.upsert_rows(spark.createDataFrame([], "k long, v string, n long"), path, ["k"])
    assert len(content(spark, path)) == 2


def test_old_folders_go_and_a_cleared_table_keeps_its_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(5):
        sinks.replace_table(spark.createDataFrame([(i,)], "k long"), path)
    names = [p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")]
    assert sorted(n for n in names if n.startswith("manifest")) == ["manifest-0000000003", "manifest-0000000004"] and len([n for n in names if n.startswith("data")]) == 2
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    sinks.clear(spark, path, schema, ["k"])
    assert sinks.read_table(spark, path).schema == schema and content(spark, path) == []
    sinks.upsert_rows(spark.createDataFrame([(1, "x")], "k long, v string"), path, ["k"])
    assert content(spark, path) == [(1, "x")]
