"""Portfolio-wide queries: aggregates by dimension, contacts, experts, filtered search, rankings, stage benchmarks."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import constants as K
from quillspark.functions.stats import exact_quantiles, whole_days
from quillspark.functions.text import normalize
from quillspark.functions.text import term as canonical
from quillspark.sources.scratch import materialize

#: Dimension: whether its buckets partition the cases.
DIMENSIONS = {
    "legalStage": True, "caseType": True, "phase": True, "status": True, "insurer": False, "injury": False, "bodyPart": False,
    "missingCritical": False, "documentCategory": False, "contactType": False, "expertSide": False,
}


def _memberships(p, dimension: str) -> tuple[DataFrame, str]:
    """(label, counted key) rows of a dimension, and the key."""
    column = {"legalStage": "legal_stage", "caseType": "case_type", "phase": "phase", "status": "status"}.get(dimension)
    if column:
        return p.cases.select(F.col(column).alias("label"), "case_id").where("label is not null"), "case_id"
    if dimension == "missingCritical":
        return p.cases.select(F.explode("missing_critical").alias("label"), "case_id"), "case_id"
    if dimension == "documentCategory":
        return p.documents.select(F.col("category").alias("label"), "case_id").where("label is not null").distinct(), "case_id"
    if dimension == "contactType":
        used = p.case_contacts.select("contact_id").distinct()
        return p.contacts.join(used, "contact_id", "left_semi").select(F.col("contact_type").alias("label"), "contact_id"), "contact_id"
    if dimension == "expertSide":
        return p.experts.select(F.col("side").alias("label"), "case_id", "key"), "case_id"
    bridge = {"insurer": p.insurers, "injury": p.injuries, "bodyPart": p.body_parts}[dimension]
    return bridge.select(F.col("name").alias("label"), "case_id"), "case_id"


def aggregate(p, dimension: str, limit: int = 25) -> DataFrame:
    """Buckets of a dimension by size, each with the number of all memberships and all buckets, and whether some are cut off."""
    if dimension not in DIMENSIONS:
        raise ValueError(f"unknown dimension {dimension}")
    rows, key = _memberships(p, dimension)
    limit = min(max(limit, 1), 50)
    buckets = rows.groupBy("label").agg(F.countDistinct(key).alias("cases"), F.count("*").alias("n"))
    total = buckets.agg(F.sum("n").alias("memberships"), F.count("*").alias("buckets")).withColumn("one", F.lit(1))
    top = buckets.orderBy(F.desc("cases"), "label").limit(limit).withColumn("one", F.lit(1))
    return top.join(F.broadcast(total), "one").select("label", "cases", "memberships", "buckets", (F.col("buckets") > limit).alias("truncated"), F.lit(DIMENSIONS[dimension]).alias("partitioning"))


def list_contacts(p, contact_type: str | None = None, shared_only: bool = False, limit: int = 25) -> DataFrame:
    """Contacts by normalised name and type, with the cases they take part in."""
    c = p.contacts if contact_type is None else p.contacts.where(F.col("contact_type") == contact_type)
    rows = p.case_contacts.join(c, "contact_id")
    out = rows.groupBy("normalized_name", "contact_type").agg(
        F.countDistinct("case_id").alias("cases"), F.bool_or("has_phone").alias("has_phone"), F.bool_or("has_email").alias("has_email"), F.array_join(F.array_sort(F.collect_set("contact_id")), ",").alias("contact_ids")
    )
    return out.where(F.col("cases") >= (2 if shared_only else 1)).orderBy(F.desc("cases"), "normalized_name", "contact_type").limit(min(max(limit, 1), 100))


def list_experts(p, side: str | None = None, limit: int = 25) -> DataFrame:
    """Experts with the number of cases on our side and the court's; the cases are told ours first."""
    mine = lambda s: F.when(F.col("side") == s, F.col("case_id"))
    ids = lambda s: F.array_sort(F.collect_set(mine(s)))
    out = p.experts.groupBy("key").agg(F.min("name").alias("name"), F.countDistinct(mine("ours")).alias("our_cases"), F.countDistinct(mine("court")).alias("court_cases"), F.array_join(F.concat(ids("ours"), ids("court")), ",").alias("case_ids"))
    if side is not None:
        out = out.where(F.col({"ours": "our_cases", "court": "court_cases"}[side]) > 0)
    return out.orderBy(F.desc(F.col("our_cases") + F.col("court_cases")), "key").limit(min(max(limit, 1), 100))


@dataclass
class CaseFilter:
    """Conjunctive filters; neutral values (blank, false, non-positive bounds) filter nothing, and so does a value outside `vocabulary`."""

    case_type: str | None = None
    legal_stage: str | None = None
    phase: str | None = None
    status: str | None = None
    is_signed: bool | None = None
    is_overdue: bool | None = None
    main_injury: str | None = None
    client_name: str | None = None
    completion_min: float | None = None
    completion_max: float | None = None
    months_min: int | None = None
    months_max: int | None = None
    months_to_limitation_max: int | None = None
    limitation_expired: bool | None = None
    event_from: datetime | str | None = None
    event_to: datetime | str | None = None
    created_from: datetime | str | None = None
    created_to: datetime | str | None = None
    signed_from: datetime | str | None = None
    signed_to: datetime | str | None = None
    missing_category: str | None = None
    injury: str | None = None
    body_part: str | None = None
    insurer: str | None = None
    has_category: str | None = None
    sort_by: str = "case_name"
    descending: bool = False
    limit: int = 20


SORTS = ("case_name", "completion_rate", "months_since_event", "event_date", "created_at", "signed_at", "case_number")


def filter_cases(p, f: CaseFilter, vocabulary: dict[str, set[str]] | None = None) -> DataFrame:
    """Cases that pass all filters; bridges are semi-joined, so no case is repeated."""
    c, tests = p.cases, []
    for name in ("case_type", "legal_stage", "phase", "status"):
        v = (getattr(f, name) or "").strip()
        if v and (vocabulary is None or v in vocabulary.get(name, {v})):
            tests.append(F.col(name) == v)
    for name in ("is_signed", "is_overdue"):
        if getattr(f, name) is True:
            tests.append(F.col(name))
    for name, column in (("main_injury", "main_injury"), ("client_name", "case_name")):
        if v := (getattr(f, name) or "").strip():
            tests.append(normalize(column).contains(normalize(F.lit(v))))
    for value, column, low in ((f.completion_min, "completion_rate", True), (f.months_min, "months_since_event", True), (f.months_max, "months_since_event", False)):
        if value is not None and value > 0:
            tests.append(F.col(column) >= value if low else F.col(column) <= value)
    if f.completion_max is not None and f.completion_max < 1:
        tests.append(F.col("completion_rate") <= f.completion_max)
    left = F.lit(K.LIMITATION_MONTHS) - F.col("months_since_event")
    if f.months_to_limitation_max is not None and f.months_to_limitation_max > 0:
        tests.append(left.between(0, f.months_to_limitation_max))
    if f.limitation_expired is True:
        tests.append(left <= 0)
    for name, column in (("event", "event_date"), ("created", "created_at"), ("signed", "signed_at")):
        if v := getattr(f, f"{name}_from"):
            tests.append(F.col(column) >= F.lit(v).cast("timestamp_ntz"))
        if v := getattr(f, f"{name}_to"):
            tests.append(F.col(column) <= F.lit(v).cast("timestamp_ntz"))
    if v := (f.missing_category or "").strip():
        tests.append(F.array_contains("missing_critical", v))
    for t in tests:
        c = c.where(t)
    for value, bridge, domain in ((f.injury, p.injuries, "injury"), (f.body_part, p.body_parts, "bodyPart")):
        if (value or "").strip():
            c = c.join(bridge.where(F.col("normalized") == canonical(domain, F.lit(value))), "case_id", "left_semi")
    if (f.insurer or "").strip():
        held = F.col("normalized").contains(canonical("insurer", F.lit(f.insurer))) | F.lower("name").contains(f.insurer.strip().lower())
        c = c.join(p.insurers.where(held), "case_id", "left_semi")
    if (f.has_category or "").strip():
        c = c.join(p.documents.where(F.lower("category") == f.has_category.strip().lower()), "case_id", "left_semi")
    return c


def search_cases(p, f: CaseFilter, vocabulary: dict[str, set[str]] | None = None) -> DataFrame:
    """One page of filter_cases(), with documents, insurers and injuries of those cases only."""
    if f.sort_by not in SORTS:
        raise ValueError(f"cannot sort by {f.sort_by}")
    key = F.coalesce("months_since_event", F.lit(9999)) if f.sort_by == "months_since_event" else F.col(f.sort_by)
    order = key.desc_nulls_first() if f.descending else key.asc_nulls_last()
    page = filter_cases(p, f, vocabulary).orderBy(order, F.asc("case_name"), F.asc("case_id")).limit(min(max(f.limit, 1), 200))
    docs = p.documents.join(F.broadcast(page.select("case_id")), "case_id", "left_semi").groupBy("case_id").agg(F.count("*").alias("documents"))
    out = page.join(docs, "case_id", "left")
    for name, bridge in (("insurers", p.insurers), ("injuries", p.injuries)):
        own = bridge.join(F.broadcast(page.select("case_id")), "case_id", "left_semi").groupBy("case_id").agg(F.array_sort(F.collect_set("name")).alias(name))
        out = out.join(own, "case_id", "left")
    return out.withColumn("documents", F.coalesce("documents", F.lit(0))).withColumn("months_to_limitation", F.lit(K.LIMITATION_MONTHS) - F.col("months_since_event")).withColumn("missing_count", F.size("missing_critical"))


def vocabulary(cases: DataFrame) -> DataFrame:
    """Distinct values of the closed fields, as (field, value)."""
    each = F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in ("case_type", "legal_stage", "phase", "status")))
    return cases.select(F.explode(each).alias("v")).select("v.*").where("value is not null").distinct()


def stage_transitions(reach: DataFrame, cases: DataFrame, stage: str) -> DataFrame:
    """Whole days from event to stage: of the first time it was reached, else of the entry into the current stage."""
    got = reach.where(F.col("stage") == stage).groupBy("case_id").agg(F.min(F.struct("reached_at", "source")).alias("e"))
    now = F.when(F.col("legal_stage") == stage, F.col("stage_entered_at"))
    j = cases.join(got, "case_id", "left").withColumn("at_stage", F.coalesce("e.reached_at", now)).where("at_stage is not null")
    return j.select("case_id", "case_name", "at_stage", whole_days("event_date", "at_stage").alias("days"), F.coalesce("e.source", F.lit("current_stage_snapshot")).alias("source"))


def rank_stage_transitions(reach: DataFrame, cases: DataFrame, stage: str, limit: int = 10) -> DataFrame:
    """The fastest transitions; cases without an event date or with a negative span are left out."""
    rows = stage_transitions(reach, cases, stage).where("days is not null and days >= 0")
    return rows.orderBy("days", "case_name", "case_id").limit(min(max(limit, 1), 50))


def stage_benchmark(p, reach: DataFrame, stage: str) -> DataFrame:
    """Quartiles of completion, months to the stage and covered categories of cases that are in the stage or reached it."""
    got = reach.where(F.col("stage") == stage).groupBy("case_id").agg(F.min("reached_at").alias("reached_at"))
    cats = p.documents.groupBy("case_id").agg(F.countDistinct("category").alias("categories"))
    peers = p.cases.join(got, "case_id", "left").where(F.col("reached_at").isNotNull() | (F.col("legal_stage") == stage)).join(cats, "case_id", "left")
    months = whole_days("event_date", F.coalesce("reached_at", "stage_entered_at")) / 30.0
    peers = materialize(peers.select("completion_rate", months.alias("months"), F.coalesce("categories", F.lit(0)).alias("categories")), "peers")
    # All peers are one group, so no buffer holds their values.
    out = peers.agg(F.count("*").alias("peers")).withColumn("one", F.lit(1))
    for name in ("completion_rate", "months", "categories"):
        q = exact_quantiles(peers, [], name, **{f"{name}_p25": 0.25, f"{name}_p50": 0.5, f"{name}_p75": 0.75})
        out = out.join(F.broadcast(q.withColumn("one", F.lit(1))), "one", "left")
    return out.drop("one")


def position(value: Column, p25: Column, p75: Column) -> Column:
    """Where a case stands among its peers."""
    return F.when(value < p25, "below").when(value > p75, "above").otherwise("within")
