"""Seeks read few row groups, by the scans' own metrics."""

from pathlib import Path

from pyspark.sql import functions as F

from quillspark.operators import lookup
from quillspark.plans.adapter import portfolio
from quillspark.sources import layout, scratch


def test_seeks_open_few_row_groups(spark, tmp_path):
    n = 60_000
    rows = spark.range(n).select((F.col("id") * 7919 % 2000).alias("case_id"), F.md5(F.col("id").cast("string")).alias("code"), F.col("id").alias("v"))
    t = layout.write_sorted(rows.repartition(4), str(tmp_path / "t"), "case_id", ("code",), group_bytes=64 << 10)
    by_case = layout.scanned(t.where("case_id = 77"))
    assert by_case["rows"] < n / 8 and t.where("case_id = 77").count() == n // 2000
    code = F.md5(F.lit("1234"))
    by_code = layout.scanned(t.where(F.col("code") == spark.range(1).select(code).first()[0]))
    assert by_code["rows"] < n / 4 and t.where(F.col("code") == code).first().v == 1234
    assert layout.scanned(t.where(f"v = {n // 2}"))["rows"] > n / 2  # neither sorted nor filtered


def test_lookups_on_sorted_tables_equal_those_on_any(spark, tmp_path):
    p = portfolio(spark, "/root/testdata/sf0.001")
    case = p.facts.groupBy("case_id").count().orderBy(F.desc("count"), "case_id").first().case_id
    q = layout.laid_out(p, str(tmp_path / "p"), group_bytes=16 << 10)
    again = layout.laid_out(p, str(tmp_path / "p"))
    rows = lambda df: [tuple(r) for r in df.collect()]
    for ask in (lookup.documents_of, lookup.communications_of, lookup.facts_of):
        assert rows(ask(q, case)) == rows(ask(p, case)) == rows(ask(again, case))
    assert rows(lookup.overview(lookup.of_case(q, case))) == rows(lookup.overview(p).where(F.col("case_id") == case))


def test_written_tables_are_deleted_when_a_result_is_done(spark):
    scratch.release(spark)
    made = [scratch.materialize(spark.range(5), "released") for _ in range(3)]
    assert [t.count() for t in made] == [5, 5, 5] and scratch.release(spark) == 3 and scratch.release(spark) == 0
    assert not list(Path(scratch.scratch_dir(spark).removeprefix("file:")).glob("released-*"))
