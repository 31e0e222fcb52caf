from pyspark.sql import functions as F

from quillspark.streaming import rollup


def test_micro_batches_equal_the_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    ev = spark.range(200).select(F.col("id").alias("event_id"), (F.col("id") % 5).alias("user_id"), F.timestamp_seconds(F.col("id") * 977).alias("ts"), F.when(F.col("id") % 3 == 0, "view").otherwise("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    ev.repartition(4).write.parquet(src)
    got = rollup.run_rollup(spark, src, str(tmp_path / "out"), str(tmp_path / "cp"))
    want = rollup.fold(rollup.observations(ev).selectExpr("case_id", "signal_key", "observed_at first_observed", "observed_at last_observed", "1L observations"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    again = rollup.run_rollup(spark, src, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert again.agg(F.sum("observations")).first()[0] == 200


def test_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(10).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"), F.timestamp_seconds(F.col("id") * 86400).alias("ts"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props")).write.parquet(src)
    q = rollup.daily_counts(rollup.event_stream(spark, src)).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select count(*), sum(n) from daily").first() == (10, 10)
    assert rollup.sliding_counts(spark.read.schema(rollup.SCHEMA).parquet(src)).count() > 10
    assert rollup.sessions(spark.read.schema(rollup.SCHEMA).parquet(src)).count() == 10
