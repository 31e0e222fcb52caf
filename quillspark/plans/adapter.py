"""The portfolio's tables: a dataclass of DataFrames, and their derivation from the star-schema test tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Reference day of all relative times.
AS_OF = "2002-01-01"


@dataclass
class Portfolio:
    """One DataFrame for each kind of node, and one for each kind of edge with more than two ends."""

    cases: DataFrame
    documents: DataFrame
    communications: DataFrame
    activities: DataFrame
    stage_events: DataFrame
    injuries: DataFrame
    body_parts: DataFrame
    insurers: DataFrame
    experts: DataFrame
    contacts: DataFrame
    case_contacts: DataFrame
    valuations: DataFrame
    components: DataFrame
    facts: DataFrame
    embeddings: DataFrame
    texts: DataFrame
    #: Where the tables come from; what is published of them is kept under this name.
    name: str = ""


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def portfolio(spark: SparkSession, sf_dir: str) -> Portfolio:
    t = lambda name: _t(spark, sf_dir, name)
    ids = t("events").select(F.col("user_id").alias("case_id")).distinct()
    orders = t("orders").withColumnRenamed("o_custkey", "case_id").join(ids, "case_id", "left_semi")
    per_order = orders.groupBy("case_id").agg(
        F.min("o_orderdate").alias("event_date"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"), F.collect_set("o_orderpriority").alias("used")
    )
    latest = t("events").groupBy(F.col("user_id").alias("case_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("legal_stage"), F.max("ts").alias("stage_entered_at"))
    regions = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("phase"))
    priorities = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    lines = t("lineitem").join(orders.select("case_id", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    parts = lines.join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    suppliers = lines.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    injuries = parts.groupBy("case_id", F.col("p_type").alias("name")).agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("_c"))
    injuries = injuries.select("case_id", F.lower("name").alias("normalized"), "name", F.when(F.col("_c") == 1, "current").otherwise("initial").alias("status"))
    c = (
        t("customer").withColumnRenamed("c_custkey", "case_id").join(ids, "case_id", "left_semi").join(per_order, "case_id", "left").join(latest, "case_id", "left")
        .join(F.broadcast(regions), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(injuries.groupBy("case_id").agg(F.min("normalized").alias("main_injury")), "case_id", "left")
    )
    created = F.col("event_date") + F.expr("INTERVAL 30 DAYS")
    cases = c.select(
        "case_id", F.col("c_name").alias("case_name"), F.concat(F.lit("N-"), F.lpad(F.col("case_id").cast("string"), 6, "0")).alias("case_number"), F.col("c_mktsegment").alias("case_type"),
        "legal_stage", "stage_entered_at", "phase", "status", (F.col("c_acctbal") > 0).alias("is_signed"), ((F.col("case_id") % 101) / 100.0).alias("completion_rate"),
        F.array_sort(F.array_except(priorities, F.coalesce("used", F.array().cast("array<string>")))).alias("missing_critical"), "event_date", created.alias("created_at"),
        F.when(F.col("c_acctbal") > 0, created + F.expr("INTERVAL 10 DAYS")).alias("signed_at"), F.floor(F.datediff(F.lit(AS_OF), "event_date") / 30).alias("months_since_event"),
        (F.col("case_id") % 4 == 0).alias("is_overdue"), "main_injury", (F.col("case_id") % 60 + 18).alias("client_age"), (F.col("case_id") % 3 == 0).alias("work_accident"),
    )
    documents = orders.select(
        F.col("o_orderkey").alias("document_id"), "case_id", F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("type"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("document_date"), (F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS")).alias("uploaded_at"), F.concat(F.lit("doc-"), F.col("o_orderkey").cast("string")).alias("file_name"),
    )
    # The number of cases is one aggregated row, joined by key like any other side.
    n = ids.agg(F.count("*").alias("n"), F.lit(1).alias("one"))
    talks = t("conversations").withColumn("one", F.lit(1)).join(F.broadcast(n), "one")
    communications = talks.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("comm_id"), (F.col("conv_id") % F.col("n")).alias("case_id"),
        F.when(F.col("role") == "user", "incoming").when(F.col("role") == "assistant", "outgoing").otherwise("internal").alias("direction"), F.col("role").alias("sender_type"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).cast("timestamp_ntz").alias("sent_at"), F.substring(F.coalesce("text", F.lit("")), 1, 500).alias("preview"),
    )
    activities = t("events").select("event_id", F.col("user_id").alias("case_id"), F.col("event_type").alias("category"), F.col("ts").alias("at"), "value")
    stage_events = activities.select(
        "event_id", "case_id", F.when(F.col("value") >= 100, F.concat("category", F.lit("_high"))).otherwise(F.col("category")).alias("stage"), F.when(F.col("event_id") % 7 == 0, "review").alias("sub_stage"),
        F.col("at").alias("occurred_at"), F.when(F.col("event_id") % 4 == 0, "activity_log").otherwise("current_stage_snapshot").alias("source"),
    )
    named = F.lower(F.concat(F.lit("contact "), (F.col("s_suppkey") % 40).cast("string")))
    kind = F.element_at(F.array(F.lit("insurer"), F.lit("lawyer"), F.lit("client")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    contacts = t("supplier").select(F.col("s_suppkey").alias("contact_id"), F.col("s_name").alias("name"), named.alias("normalized_name"), kind.alias("contact_type"), (F.col("s_suppkey") % 2 == 0).alias("has_phone"), (F.col("s_acctbal") > 0).alias("has_email"))
    wide = lines.groupBy("case_id").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.sum("l_extendedprice"), 2)).toDF("case_id", "future_losses", "past_losses", "pain_and_suffering")
    valuations = orders.groupBy("case_id", "o_orderstatus").agg(
        F.min("o_totalprice").alias("compensation_min"), F.max("o_totalprice").alias("compensation_max"), F.round(F.sum("o_totalprice"), 2).alias("_total"), F.count("*").alias("_n"), F.max("o_orderdate").alias("analysis_date")
    )
    valuations = valuations.select(
        F.concat_ws(":", "case_id", F.lit("valuation"), "o_orderstatus").alias("valuation_id"), "case_id", "compensation_min", "compensation_max",
        F.coalesce(F.when(F.col("_n") > 1, F.col("_total")), "compensation_max", "compensation_min").alias("total_estimate"), F.when(F.col("o_orderstatus") == "O", "current").otherwise("draft").alias("status"), "analysis_date",
    )
    facts = lines.where("l_discount >= 0.05").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("fact_id"), "case_id", F.col("l_orderkey").alias("document_id"),
        F.when(F.col("l_returnflag") == "A", "disability_period").when(F.col("l_returnflag") == "R", "income_evidence").otherwise("nii_decision").alias("kind"),
        F.when(F.col("l_linestatus") == "O", "permanent").otherwise("temporary").alias("subtype"), F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).alias("numeric_value"), F.col("l_shipdate").alias("observed_date"), F.round(1 - F.col("l_tax"), 2).alias("confidence"),
    )
    texts = t("documents").withColumn("one", F.lit(1)).join(F.broadcast(n), "one").select("doc_id", (F.col("doc_id") % F.col("n")).alias("case_id"), "text", "lang")
    return Portfolio(
        cases=cases, documents=documents, communications=communications, activities=activities, stage_events=stage_events, injuries=injuries,
        body_parts=parts.select("case_id", F.lower("p_brand").alias("normalized"), F.col("p_brand").alias("name")).distinct(),
        insurers=suppliers.join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("case_id", F.lower("n_name").alias("normalized"), F.col("n_name").alias("name")).distinct(),
        experts=suppliers.where("l_returnflag in ('A', 'R')").select("case_id", F.lower("s_name").alias("key"), F.col("s_name").alias("name"), F.when(F.col("l_returnflag") == "A", "ours").otherwise("court").alias("side")).distinct(),
        contacts=contacts, case_contacts=suppliers.select("case_id", F.col("l_suppkey").alias("contact_id")).distinct(),
        valuations=valuations, components=wide, facts=facts, embeddings=t("embeddings").select(F.col("vec_id").alias("case_id"), "embedding"), texts=texts, name=sf_dir,
    )


def first_per(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
