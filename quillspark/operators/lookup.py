"""Lookups of single cases: search by name or number, overview, evidence, documents, communications, profile, timeline."""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark import constants as K
from quillspark.functions.stats import floor_days


def limitation(months: Column) -> tuple[Column, Column]:
    """Months left to the limitation date, and whether it is near (within a year either way)."""
    left = F.lit(K.LIMITATION_MONTHS) - months
    return left, F.coalesce((left >= -K.LIMITATION_WARNING) & (left <= K.LIMITATION_WARNING), F.lit(False))


def find_case(cases: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Cases whose id equals the query, whose number holds it, or whose name and number hold all of its words."""
    query = query.strip().lower()
    words = [w for w in re.split(r"[\s,;]+", query) if w]
    digits = re.search(r"\d{3,}", query)
    hay = F.lower(F.concat_ws(" ", "case_name", "case_number"))
    same = F.col("case_id").cast("string") == query
    number = F.lower("case_number").contains(digits[0]) if digits else F.lit(False)
    start = F.lower("case_name").startswith(query)
    every = F.lit(bool(words))
    for w in words:
        every = every & hay.contains(w)
    rank = F.when(same, 0).when(number, 1).when(start, 2).when(every, 3)
    out = cases.select("case_id", "case_name", "case_number", rank.alias("rank")).where("rank is not null")
    return out.withColumn("reason", F.when(F.col("rank").isNotNull(), F.element_at(F.array(*map(F.lit, ("id", "number", "name_prefix", "tokens"))), F.col("rank") + 1))).orderBy("rank", "case_name", "case_id").limit(min(max(limit, 1), 10))


def overview(p, case_id: int | None = None) -> DataFrame:
    """Case facts with counts of documents, communications, contacts and experts, and limitation flags."""
    pick = (lambda df: df) if case_id is None else (lambda df: df.where(F.col("case_id") == case_id))
    count = lambda df, key, name: pick(df).groupBy("case_id").agg(F.countDistinct(key).alias(name))
    out = pick(p.cases)
    client = pick(p.case_contacts).join(p.contacts.where("contact_type = 'client'"), "contact_id").groupBy("case_id").agg(F.min(F.struct("contact_id", "name"))["name"].alias("client_name"))
    for df in (client, count(p.documents, "document_id", "documents"), count(p.communications, "comm_id", "communications"), count(p.case_contacts, "contact_id", "contacts")):
        out = out.join(df, "case_id", "left")
    sides = pick(p.experts).groupBy("case_id").agg(F.countDistinct(F.when(F.col("side") == "ours", F.col("key"))).alias("our_experts"), F.countDistinct(F.when(F.col("side") == "court", F.col("key"))).alias("court_experts"))
    left, near = limitation(F.col("months_since_event"))
    names = ("documents", "communications", "contacts", "our_experts", "court_experts")
    out = out.join(sides, "case_id", "left")
    return out.select("case_id", "case_name", "case_type", "legal_stage", "phase", "status", "client_name", *(F.coalesce(n, F.lit(0)).alias(n) for n in names), left.alias("months_to_limitation"), near.alias("limitation_near"))


def of_case(p, case_id):
    """The portfolio of one case: whatever is asked of it reads that case's rows alone where tables are sorted by case."""
    tables = {f.name: getattr(p, f.name) for f in dataclasses.fields(p)}
    return dataclasses.replace(p, **{n: df.where(F.col("case_id") == case_id) for n, df in tables.items() if isinstance(df, DataFrame) and "case_id" in df.columns})


def evidence_by_category(p, examples: int = 3) -> DataFrame:
    """Per case and document category: distinct documents and the first file names."""
    names = F.slice(F.array_sort(F.collect_set("file_name")), 1, examples)
    return p.documents.groupBy("case_id", "category").agg(F.countDistinct("document_id").alias("documents"), names.alias("examples"))


def documents_of(p, case_id: int, category: str | None = None, limit: int = 20) -> DataFrame:
    """A case's documents, the latest first; documents without a date come first."""
    d = p.documents.where(F.col("case_id") == case_id)
    d = d if category is None else d.where(F.col("category") == category)
    return d.orderBy(F.desc_nulls_first("document_date"), F.desc_nulls_first("uploaded_at"), "document_id").limit(min(max(limit, 1), 50))


def communications_of(p, case_id: int, limit: int = 10, direction: str | None = None, sender_type: str | None = None) -> DataFrame:
    """A case's communications, the latest first, with previews of 300 characters; a sender type overrides the direction."""
    c = p.communications.where(F.col("case_id") == case_id)
    if sender_type is not None:
        c = c.where(F.col("sender_type") == sender_type)
    elif direction is not None:
        c = c.where(F.col("direction") == direction)
    preview = F.when(F.length("preview") > 300, F.concat(F.left("preview", F.lit(300)), F.lit("…"))).otherwise(F.col("preview"))
    return c.withColumn("preview", preview).orderBy(F.desc_nulls_first("sent_at"), "comm_id").limit(min(max(limit, 1), 30))


def facts_of(p, case_id: int, kinds: tuple[str, ...] = (), limit: int = 40) -> DataFrame:
    """A case's evidence facts with their documents, by kind, confidence and date."""
    f = p.facts.where(F.col("case_id") == case_id)
    f = f.where(F.col("kind").isin(*kinds)) if kinds else f
    # A document belongs to the case of its facts, so both sides are sought by case.
    docs = p.documents.where(F.col("case_id") == case_id).select("document_id", "file_name", "category")
    return f.join(docs, "document_id").orderBy("kind", F.desc("confidence"), F.desc_nulls_first("observed_date"), "fact_id").limit(min(max(limit, 1), 100))


def injury_profile(p) -> DataFrame:
    """Per case: injuries with status (anything but current counts as initial), and body parts."""
    status = F.when(F.col("status") == "current", "current").otherwise("initial")
    inj = p.injuries.groupBy("case_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "name", status))).alias("injuries"))
    body = p.body_parts.groupBy("case_id").agg(F.array_sort(F.collect_set("name")).alias("body_parts"))
    return p.cases.select("case_id").join(inj, "case_id", "left").join(body, "case_id", "left")


def stage_timeline(reach: DataFrame) -> DataFrame:
    """Stages that each case reached, with their order and whole days from the event."""
    first = reach.groupBy("case_id", "stage").agg(F.min("reached_at").alias("reached_at"), F.first("event_date").alias("event_date"))
    place = F.row_number().over(W.partitionBy("case_id").orderBy("reached_at", "stage"))
    return first.select("case_id", "stage", "reached_at", floor_days("event_date", "reached_at").alias("days_from_event"), place.alias("position"))


def readiness_metadata(p, as_of: str) -> DataFrame:
    """Completion, whole days since the last communication, and covered document categories."""
    last = p.communications.groupBy("case_id").agg(F.max("sent_at").alias("last_sent"))
    cats = p.documents.groupBy("case_id").agg(F.array_sort(F.collect_set("category")).alias("categories"))
    out = p.cases.select("case_id", "completion_rate").join(last, "case_id", "left").join(cats, "case_id", "left")
    return out.select("case_id", "completion_rate", floor_days("last_sent", F.lit(as_of).cast("timestamp")).alias("days_since_communication"), "categories")


def same_stage_leaders(p, case_id: int, limit: int = 5) -> DataFrame:
    """Other cases in the same stage, the most complete and then the youngest first."""
    own = p.cases.where(F.col("case_id") == case_id).select("legal_stage")
    peers = p.cases.where(F.col("case_id") != case_id).join(own, "legal_stage")
    return peers.orderBy(F.desc("completion_rate"), F.coalesce("months_since_event", F.lit(9999)), "case_id").limit(min(max(limit, 1), 10))


def graph_context(p, obs: DataFrame, per_kind: int = 6) -> DataFrame:
    """Per case and signal kind: the first labels; pre-aggregated, so bridges do not multiply."""
    label = obs.select("case_id", "kind", "label").distinct()
    rank = F.row_number().over(W.partitionBy("case_id", "kind").orderBy("label"))
    top = label.withColumn("_r", rank).where(F.col("_r") <= per_kind)
    return top.groupBy("case_id", "kind").agg(F.array_sort(F.collect_list("label")).alias("labels"))
