"""Readiness cohorts: cases that reached a stage, and the signals that mark them beforehand.

Every step is an equi-join or an aggregation with map-side combine. Controls are never listed:
their counts follow from the scope's counts less the members'."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark import constants as K
from quillspark.functions.stats import confidence_band, floor_days, quantiles
from quillspark.sources.scratch import materialize

KEYS = ["scope", "scope_type", "stage", "sub_stage"]


def reaches(stage_events: DataFrame, cases: DataFrame) -> DataFrame:
    """First time a case reached a stage (and sub-stage), and the source of that event."""
    first = stage_events.groupBy("case_id", "stage", F.coalesce("sub_stage", F.lit("")).alias("sub_stage")).agg(F.min(F.struct("occurred_at", "source")).alias("e"))
    return first.select("case_id", "stage", "sub_stage", F.col("e.occurred_at").alias("reached_at"), F.col("e.source").alias("source")).join(cases.select("case_id", "case_type", "event_date"), "case_id")


def _scoped(df: DataFrame) -> DataFrame:
    """Each row in the global scope and in its case type's; 'all' stands for every type."""
    scopes = F.array(F.struct(F.lit("global").alias("scope"), F.lit("all").alias("scope_type")), F.struct(F.lit("caseType").alias("scope"), F.col("case_type").alias("scope_type")))
    return df.select("*", F.explode(scopes).alias("_s")).select("*", "_s.scope", "_s.scope_type").drop("_s").where("scope_type is not null")


def cohort_key() -> F.Column:
    return F.concat_ws("|", "scope", "stage", "sub_stage", "scope_type")


def cohorts(reach: DataFrame, min_size: int = K.MIN_COHORT_SIZE, min_timed: int = K.MIN_TIMED_MEMBERS) -> DataFrame:
    """Cohorts with size, source mix, confidence, and quartiles of days from event to stage."""
    s = _scoped(reach).withColumn("days", floor_days("event_date", "reached_at"))
    timed = (F.col("source") == "activity_log") & (F.col("days") >= 0)
    mid, low, high = quantiles("days", 0.5, 0.25, 0.75, where=timed)
    out = s.groupBy(*KEYS).agg(F.count("*").alias("members"), F.count_if(F.col("source") == "activity_log").alias("logged"), F.count_if(timed).alias("timed"), mid.alias("median_days"), low.alias("p25_days"), high.alias("p75_days"))
    out = out.where(F.col("members") >= min_size)
    band = confidence_band("members", K.CONFIDENCE_MEDIUM, K.CONFIDENCE_HIGH)
    band = F.when((band == "high") & (F.col("logged") < K.CONFIDENCE_HIGH), "medium").otherwise(band)
    kept = lambda c: F.when(F.col("timed") >= min_timed, F.col(c)).alias(c)
    return out.select(cohort_key().alias("cohort_key"), *KEYS, "members", "logged", (F.col("members") - F.col("logged")).alias("snapshots"), band.alias("confidence"), "timed", kept("median_days"), kept("p25_days"), kept("p75_days"))


def members(reach: DataFrame, min_size: int = K.MIN_COHORT_SIZE) -> DataFrame:
    s = _scoped(reach)
    return s.join(s.groupBy(*KEYS).agg(F.count("*").alias("n")).where(F.col("n") >= min_size), KEYS).select(cohort_key().alias("cohort_key"), *KEYS, "n", "case_id", "reached_at", "source")


def common_signals(reach: DataFrame, case_signals: DataFrame, cases: DataFrame, top: int = K.TOP_SIGNALS, min_support: float = K.MIN_SUPPORT, min_lift: float = K.MIN_LIFT, min_size: int = K.MIN_COHORT_SIZE) -> DataFrame:
    """Per cohort the signals that members show before the stage more often than the other cases of the scope."""
    # Cohorts and signals are counted by number; their names come back when few rows are left.
    m = materialize(members(reach, min_size), "members")
    ids = materialize(m.select("cohort_key", *KEYS, "n").distinct().withColumn("cid", F.monotonically_increasing_id()), "cohort-ids")
    m = materialize(m.select("cohort_key", "case_id", "reached_at").join(ids.select("cohort_key", "cid"), "cohort_key").select("cid", "case_id", "reached_at"), "numbered-members")
    seen = materialize(case_signals.where("first_observed is not null").select("case_id", "signal_key", "first_observed"), "signals")
    names = materialize(seen.select("signal_key").distinct().withColumn("sid", F.monotonically_increasing_id()), "signal-ids")
    seen = materialize(seen.join(names, "signal_key").select("case_id", "sid", "first_observed"), "numbered-signals")
    scope_size = _scoped(cases.select("case_id", "case_type")).groupBy("scope", "scope_type").agg(F.count("*").alias("scope_n"))
    # Cases of the scope with the signal, whenever observed; less the members among them.
    in_scope = _scoped(seen.join(cases.select("case_id", "case_type"), "case_id")).groupBy("scope", "scope_type", "sid").agg(F.count("*").alias("scope_hits"))
    told = names.where("signal_key not like 'caseType:%'").select("sid")
    both = m.join(seen.join(told, "sid", "left_semi"), "case_id")
    before = F.col("first_observed") < F.col("reached_at")
    lead = floor_days("first_observed", "reached_at")
    hits = both.groupBy("cid", "sid").agg(F.count_if(before).alias("member_hits"), F.count("*").alias("member_any")).join(ids, "cid")
    # At most as many rows are left as cohorts have signals of the least support.
    hits = hits.withColumn("support", F.col("member_hits") / F.col("n")).where(F.col("support") >= min_support)
    out = hits.join(scope_size, ["scope", "scope_type"]).join(in_scope, ["scope", "scope_type", "sid"])
    controls = F.col("scope_n") - F.col("n")
    share = F.when(controls > 0, F.greatest((F.col("scope_hits") - F.col("member_any")) / controls, F.lit(0.01))).otherwise(F.lit(0.01))
    out = out.withColumn("lift", F.col("support") / share).where(F.col("lift") >= min_lift).withColumn("weight", F.col("support") * F.log1p("lift"))
    rank = F.row_number().over(W.partitionBy("cohort_key").orderBy(F.desc(F.round("weight", 9)), "signal_key"))
    out = materialize(out.join(names, "sid").withColumn("position", rank).where(F.col("position") <= top), "common")
    # Medians of the few signals that stay; days are few, so a buffer holds them.
    spans = both.join(out.select("cid", "sid"), ["cid", "sid"], "left_semi").where(before & (lead >= 0))
    medians = spans.groupBy("cid", "sid").agg(F.percentile(lead, F.lit(0.5)).alias("median_lead_days"))
    return out.join(medians, ["cid", "sid"], "left").select("cohort_key", *KEYS, "signal_key", "support", "lift", "weight", "median_lead_days", "position")
