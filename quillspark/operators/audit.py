"""Counts and distributions that show whether a build is whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.functions.stats import whole_days


def node_counts(p) -> DataFrame:
    """Rows, or distinct keys of bridges, by kind of node."""
    keys = {"cases": None, "documents": None, "communications": None, "activities": None, "stage_events": None, "injuries": "normalized", "body_parts": "normalized", "insurers": "normalized", "experts": "key", "contacts": None, "valuations": None, "facts": None}
    each = [getattr(p, n).agg((F.countDistinct(k) if k else F.count("*")).alias("n")).select(F.lit(n).alias("label"), "n") for n, k in keys.items()]
    return reduce(DataFrame.union, each)


def stage_sources(p) -> DataFrame:
    return p.stage_events.groupBy("stage", "source").agg(F.count("*").alias("events"), F.countDistinct("case_id").alias("cases"))


def facts_by_kind(p) -> DataFrame:
    return p.facts.groupBy("kind", "subtype").agg(F.count("*").alias("facts"), F.countDistinct("case_id").alias("cases"), F.round(F.avg("confidence"), 6).alias("confidence"))


def timing_funnel(reach: DataFrame) -> DataFrame:
    """Per stage: cases that reached it, have an event date, are timed by the activity log, and have a span of 0 days or more."""
    dated, logged = F.col("event_date").isNotNull(), F.col("source") == "activity_log"
    return reach.groupBy("stage").agg(F.count("*").alias("reached"), F.count_if(dated).alias("dated"), F.count_if(dated & logged).alias("logged"), F.count_if(logged & (whole_days("event_date", "reached_at") >= 0)).alias("timed"))


def staleness(source: DataFrame, graph: DataFrame, limit: int = 10) -> DataFrame:
    """Cases whose source changed after the graph, the most behind first."""
    j = source.groupBy("case_id").agg(F.max("source_at").alias("s")).join(graph.groupBy("case_id").agg(F.max("graph_at").alias("g")), "case_id").where("g < s")
    return j.select("case_id", whole_days("g", "s").alias("days_behind")).orderBy(F.desc("days_behind"), "case_id").limit(limit)


def similarity_buckets(pairs: DataFrame) -> DataFrame:
    s = F.col("combined_score")
    return pairs.groupBy(F.when(s >= 0.7, "0.7+").when(s >= 0.5, "0.5-0.7").when(s >= 0.3, "0.3-0.5").otherwise("<0.3").alias("bucket")).agg(F.count("*").alias("pairs"))


def last_turns(conversations: DataFrame, n: int = 20) -> DataFrame:
    """The last n turns of each conversation."""
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return conversations.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")
