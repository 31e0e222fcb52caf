"""Signal mining: observations from every source, rolled up by case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("documentCategory", "documentType", "communicationDirection", "communicationParty", "activity", "caseType", "injury", "bodyPart", "insurer", "contactRole", "evidenceFactKind", "evidenceFactSubtype")


def _long(df: DataFrame, at: Column, source: str, emits: bool, **kinds: Column) -> DataFrame:
    """One row for each kind whose value is not null, from one pass over df."""
    each = F.array(*(F.struct(F.lit(k).alias("kind"), v.cast("string").alias("label")) for k, v in kinds.items()))
    source_id = F.col("source_id").cast("string") if emits else F.lit(None).cast("string")
    return df.select("case_id", at.cast("timestamp_ntz").alias("observed_at"), F.lit(source).alias("source_kind"), source_id.alias("source_id"), F.explode(each).alias("s")).where("s.label is not null and s.label <> ''").select(
        "case_id", F.concat_ws(":", "s.kind", F.regexp_replace("s.label", "\u001f", ":")).alias("signal_key"), "s.label", "s.kind", "observed_at", "source_kind", "source_id"
    )


def observations(p) -> DataFrame:
    """(case_id, signal_key, label, kind, observed_at, source_kind, source_id) of a portfolio."""
    at_case = F.coalesce("created_at", "event_date")
    when = p.cases.select("case_id", "created_at", "event_date")
    docs = _long(p.documents.withColumn("source_id", F.col("document_id")), F.coalesce("document_date", "uploaded_at"), "document", True, documentCategory=F.col("category"), documentType=F.col("type"))
    comms = _long(p.communications.withColumn("source_id", F.col("comm_id")), F.col("sent_at"), "communication", True, communicationDirection=F.col("direction"), communicationParty=F.concat(F.lit("from:"), F.col("sender_type")))
    acts = p.activities.select("case_id", F.col("category").alias("c"), "at", F.col("event_id").cast("string").alias("source_id"))
    # A stage event counts as an activity of its own name, but emits no signal.
    stages = p.stage_events.select("case_id", F.concat(F.lit("stage:"), "stage").alias("c"), F.col("occurred_at").alias("at"), F.lit(None).cast("string").alias("source_id"))
    acts = _long(acts.union(stages).distinct(), F.col("at"), "activity", True, activity=F.col("c"))
    context = _long(p.cases, at_case, "case", False, caseType=F.col("case_type"))
    for kind, bridge, column in (("injury", p.injuries, "normalized"), ("bodyPart", p.body_parts, "normalized"), ("insurer", p.insurers, "normalized")):
        context = context.unionByName(_long(bridge.select("case_id", column).distinct().join(when, "case_id"), at_case, "case", False, **{kind: F.col(column)}))
    roles = p.case_contacts.join(p.contacts.select("contact_id", "contact_type"), "contact_id").select("case_id", "contact_type").distinct().join(when, "case_id")
    context = context.unionByName(_long(roles, at_case, "case", False, contactRole=F.col("contact_type")))
    facts = _long(p.facts.withColumn("source_id", F.col("fact_id")), F.col("observed_date"), "fact", True, evidenceFactKind=F.col("kind"), evidenceFactSubtype=F.concat_ws(":", "kind", "subtype"))
    return docs.unionByName(comms).unionByName(acts).unionByName(context).unionByName(facts)


def rollup(obs: DataFrame) -> DataFrame:
    """One row for each case and signal: first and last observation, how many, from which sources."""
    return obs.groupBy("case_id", "signal_key").agg(
        F.min("observed_at").alias("first_observed"), F.max("observed_at").alias("last_observed"), F.count("*").alias("observations"), F.array_sort(F.collect_set("source_kind")).alias("source_kinds")
    )


def dictionary(obs: DataFrame) -> DataFrame:
    """One label and kind for each signal."""
    return obs.groupBy("signal_key").agg(F.max("label").alias("label"), F.max("kind").alias("kind"))


def emissions(obs: DataFrame) -> DataFrame:
    """Which source row emits which signal."""
    return obs.where("source_id is not null and source_id <> ''").select(F.col("source_kind").alias("emitter"), "source_id", "signal_key").distinct()
