"""Source collections to node and edge tables. Ids and dates arrive as strings (see sources.contracts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.functions.dates import observation_time
from quillspark.functions.text import blank_to_null, contact_point, normalize, term

SKIPPED_CONTACT_TYPES = ("admin", "system")


def keep_first(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def latest_projection(projections: DataFrame) -> DataFrame:
    """One projection for each case: the one of the greatest version."""
    return keep_first(projections, ["caseId"], F.desc_nulls_last("version"), F.desc_nulls_last("analysisDate"))


def case_nodes(cases: DataFrame, projections: DataFrame) -> DataFrame:
    """Cases with defaults, and work accident flag and birth date from the projection where the case has none."""
    extra = latest_projection(projections).select("caseId", F.col("workAccidentFlag").alias("_work"), F.col("birthDate").alias("_birth"))
    c = cases.join(extra, "caseId", "left")
    return c.select(
        F.col("_id").alias("source_id"), F.col("caseId").alias("case_id"), "caseName", "caseNumber", "caseType", "legalStage", "subStage", "phase", "status", F.coalesce("isSigned", F.lit(False)).alias("is_signed"),
        F.coalesce("completionRate", F.lit(0.0)).alias("completion_rate"), F.coalesce("missingCritical", F.array().cast("array<string>")).alias("missing_critical"), "monthsSinceEvent", "isOverdue", "mainInjury", "clientAge",
        *(F.try_to_timestamp(n).alias(n) for n in ("createdAt", "updatedAt", "eventDate", "signedAt", "legalStageEnteredAt")), F.coalesce("workAccidentFlag", "_work").alias("work_accident"), F.coalesce("birthDate", "_birth").alias("birth_date"),
    )


def resolve_clients(cases: DataFrame, contacts: DataFrame) -> DataFrame:
    """case_id, contact_id: the contact that the case names, else the only client that lists the case."""
    known = contacts.select(F.col("_id").alias("clientContactId")).distinct()
    named = cases.where("clientContactId is not null").join(known, "clientContactId", "left_semi").select(F.col("caseId").alias("case_id"), F.col("clientContactId").alias("named"))
    listed = contacts.where(F.lower("contactType") == "client").select(F.explode("caseIds").alias("case_id"), "_id").distinct()
    only = listed.groupBy("case_id").agg(F.count("*").alias("n"), F.min("_id").alias("only")).where("n = 1").drop("n")
    out = cases.select(F.col("caseId").alias("case_id")).distinct().join(named, "case_id", "left").join(only, "case_id", "left")
    return out.select("case_id", F.coalesce("named", "only").alias("contact_id")).where("contact_id is not null")


def resolve_files(files: DataFrame, cases: DataFrame) -> DataFrame:
    """files with case_id: their own case if known, else the first known legacy reference; others are left out."""
    known = cases.select(F.col("caseId").alias("case_id")).distinct()
    refs = files.select("_id", F.posexplode(F.concat(F.array("caseId"), F.coalesce("legacyCaseRefs", F.array().cast("array<string>")))).alias("pos", "case_id"))
    hit = refs.join(known, "case_id", "left_semi").groupBy("_id").agg(F.min_by("case_id", "pos").alias("case_id"))
    return files.drop("caseId").join(hit, "_id")


def contact_nodes(contacts: DataFrame) -> DataFrame:
    """Contacts merged by dedup key: first name and type, first known phone and email, all sources and cases."""
    c = contacts.where(F.coalesce(F.lower("contactType"), F.lit("")).isin(*SKIPPED_CONTACT_TYPES) == F.lit(False))
    point = contact_point("email", "phone")
    key = F.when(point == "", F.concat(F.lit("uniq:"), "_id")).otherwise(F.concat_ws("|", normalize("name"), F.coalesce("contactType", F.lit("")), point))
    first = lambda x: F.min(F.when(F.col(x).isNotNull() & (F.col(x) != ""), F.struct("_id", x)))[x]
    out = c.withColumn("dedup_key", key).groupBy("dedup_key").agg(
        first("name").alias("name"), first("contactType").alias("contact_type"), first("phone").alias("phone"), first("email").alias("email"),
        F.array_sort(F.collect_set("_id")).alias("source_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("caseIds", F.array().cast("array<string>")))))).alias("case_ids"),
    )
    return out.withColumn("normalized_name", normalize("name")).withColumn("has_phone", F.col("phone").isNotNull()).withColumn("has_email", F.col("email").isNotNull())


def contact_edges(nodes: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, dedup_key, role for the known cases of each contact."""
    known = cases.select(F.col("caseId").alias("case_id")).distinct()
    return nodes.select(F.explode("case_ids").alias("case_id"), "dedup_key", F.col("contact_type").alias("role")).join(known, "case_id", "left_semi").distinct()


def injury_edges(projections: DataFrame) -> DataFrame:
    """case_id, normalized, name, status; a current injury overrides an initial one, the first name stays."""
    p = latest_projection(projections)
    part = lambda c, status, o: p.select("caseId", F.posexplode(c).alias("pos", "name"), F.lit(status).alias("status"), F.lit(o).alias("o"))
    rows = part("initialInjuries", "initial", 0).union(part("currentInjuries", "current", 1)).withColumn("name", blank_to_null("name")).where("name is not null").withColumn("normalized", term("injury", "name"))
    return rows.groupBy(F.col("caseId").alias("case_id"), "normalized").agg(F.min_by("name", F.struct("o", "pos")).alias("name"), F.max_by("status", "o").alias("status"))


def body_part_edges(projections: DataFrame) -> DataFrame:
    rows = latest_projection(projections).select(F.col("caseId").alias("case_id"), F.posexplode("bodyParts").alias("pos", "name")).withColumn("name", blank_to_null("name")).where("name is not null")
    return rows.groupBy("case_id", term("bodyPart", "name").alias("normalized")).agg(F.min_by("name", "pos").alias("name"))


def insurer_edges(projections: DataFrame) -> DataFrame:
    rows = latest_projection(projections).select(F.col("caseId").alias("case_id"), blank_to_null("insuranceCompany").alias("name")).where("name is not null")
    return rows.select("case_id", term("insurer", "name").alias("normalized"), "name")


def expert_edges(projections: DataFrame) -> DataFrame:
    """case_id, key (name and specialty, normalised), name, specialty, side."""
    p = latest_projection(projections)
    side = lambda c, s: p.select(F.col("caseId").alias("case_id"), F.explode(c).alias("e"), F.lit(s).alias("side"))
    rows = side("ourExperts", "ours").union(side("courtExperts", "court")).select("case_id", "side", blank_to_null("e.name").alias("name"), blank_to_null("e.specialty").alias("specialty")).where("name is not null")
    key = F.concat_ws("|", normalize("name"), F.coalesce(normalize("specialty"), F.lit("")))
    return keep_first(rows.withColumn("key", key), ["case_id", "key", "side"], "name")


def document_nodes(files: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (files and their archived versions), and (child_id, parent_id) of derived ones whose parent exists."""
    f = resolve_files(files, cases)
    archived = F.coalesce(F.exists("versions", lambda v: v["gcsPath"].isNotNull()), F.lit(False))
    own = f.select(
        F.col("_id").alias("document_id"), "case_id", "fileName", "mimeType", F.coalesce(blank_to_null("documentType"), F.lit("unclassified")).alias("type"), F.coalesce(blank_to_null("documentCategory"), F.lit("other")).alias("category"),
        observation_time("documentDate").alias("document_date"), F.try_to_timestamp("uploadedAt").alias("uploaded_at"), (F.coalesce("isModified", F.lit(False)) | archived).alias("is_modified"), F.lit(False).alias("archived"),
    )
    versions = f.select("_id", "case_id", F.explode("versions").alias("v")).where("v.gcsPath is not null").withColumn("document_id", F.concat(F.lit("archived:"), "v.gcsPath"))
    old = keep_first(versions, ["document_id"], "_id").select("document_id", "case_id", F.substring_index("v.gcsPath", "/", -1).alias("fileName"), F.lit(True).alias("is_modified"), F.lit(True).alias("archived"))
    nodes = own.unionByName(old, allowMissingColumns=True)
    edges = f.where("sourceFileId is not null").selectExpr("_id child_id", "sourceFileId parent_id").union(versions.selectExpr("_id child_id", "document_id parent_id")).distinct()
    return nodes, edges.join(nodes.select(F.col("document_id").alias("parent_id")), "parent_id", "left_semi")


def communication_nodes(comms: DataFrame, cases: DataFrame) -> DataFrame:
    known = cases.select("caseId").distinct()
    c = comms.join(known, "caseId", "left_semi")
    unknown = lambda n: F.coalesce(blank_to_null(n), F.lit("unknown")).alias(n)
    body = F.coalesce(blank_to_null("body"), blank_to_null("summary"), blank_to_null("ocrText"), F.lit(""))
    return c.select(F.col("_id").alias("comm_id"), F.col("caseId").alias("case_id"), unknown("type"), unknown("direction"), unknown("status"), F.coalesce(F.try_to_timestamp("sentAt"), F.try_to_timestamp("createdAt")).alias("sent_at"), F.substring(F.coalesce("subject", F.lit("")), 1, 200).alias("subject"), F.substring(body, 1, 500).alias("preview"))


def participant_edges(comms: DataFrame, contacts: DataFrame) -> DataFrame:
    """comm_id, kind (from, to, cc), dedup_key: the linked contact's, else one made of the participant's own name and address."""
    none = F.array().cast("array<struct<contactId:string,name:string,email:string,phone:string>>")
    lists = F.create_map(F.lit("from"), F.when(F.col("sender").isNotNull(), F.array("sender")).otherwise(none), F.lit("to"), F.coalesce("to", none), F.lit("cc"), F.coalesce("cc", none))
    rows = comms.select(F.col("_id").alias("comm_id"), F.explode(lists).alias("kind", "ps")).select("comm_id", "kind", F.posexplode("ps").alias("i", "p"))
    linked = contact_nodes(contacts).select(F.explode("source_ids").alias("contact_id"), F.col("dedup_key").alias("_linked"))
    point = contact_point("p.email", "p.phone")
    made = F.when(point == "", F.concat(F.lit("uniq:"), F.concat_ws(":", "comm_id", "kind", F.col("i").cast("string")))).otherwise(F.concat_ws("|", normalize(F.coalesce("p.name", F.lit(""))), F.lit("communication_party"), point))
    return rows.join(linked, F.col("p.contactId") == F.col("contact_id"), "left").select("comm_id", "kind", F.coalesce("_linked", made).alias("dedup_key")).distinct()


def stage_events(activity: DataFrame, cases: DataFrame) -> DataFrame:
    """Stage changes of the activity log, and a snapshot event for current stages that the log never mentions."""
    known = cases.select("caseId").distinct()
    pick = lambda *names: F.coalesce(*(blank_to_null(F.try_element_at("details", F.lit(n))) for n in names))
    log = activity.join(known, "caseId", "left_semi").where("action = 'stage_changed'").select(
        F.concat(F.lit("log:"), "_id").alias("key"), F.col("caseId").alias("case_id"), pick("toStage", "to", "newStage", "stage").alias("stage"), pick("toSubStage", "subStage", "newSubStage").alias("sub_stage"), F.try_to_timestamp("at").alias("occurred_at"), F.lit("activity_log").alias("source")
    ).where("stage is not null and occurred_at is not null")
    now = cases.select(F.concat_ws(":", F.lit("snapshot"), "caseId", "legalStage").alias("key"), F.col("caseId").alias("case_id"), F.col("legalStage").alias("stage"), F.col("subStage").alias("sub_stage"), F.try_to_timestamp("legalStageEnteredAt").alias("occurred_at"), F.lit("current_stage_snapshot").alias("source"))
    return log.unionByName(backfill(now.where("stage is not null and occurred_at is not null"), log))


def stage_names(cases: DataFrame) -> DataFrame:
    """The stage dimension: one row for each stage that a case is in."""
    return cases.where("legalStage is not null").select(F.col("legalStage").alias("name")).distinct()


def reached_stages(events: DataFrame) -> DataFrame:
    """case_id, stage, at, source of the event written last: the greatest time, then key."""
    last = F.max_by(F.struct("occurred_at", "source"), F.struct("occurred_at", "key"))
    return events.groupBy("case_id", "stage").agg(last.alias("e")).select("case_id", "stage", F.col("e.occurred_at").alias("at"), "e.source")


def backfill(snapshots: DataFrame, events: DataFrame) -> DataFrame:
    """Snapshots of stages for which the case has no event."""
    return snapshots.join(events.select("case_id", "stage").distinct(), ["case_id", "stage"], "left_anti").select(*snapshots.columns)


def valuation_rows(projections: DataFrame) -> DataFrame:
    p = latest_projection(projections).where("coalesce(totalEstimate, compensationMax, compensationMin) is not null")
    part = F.coalesce(F.col("version").cast("long").cast("string"), F.lit("current"))
    return p.select(
        F.concat_ws(":", "caseId", F.lit("valuation"), part).alias("valuation_id"), F.col("caseId").alias("case_id"), F.col("compensationMin").alias("compensation_min"), F.col("compensationMax").alias("compensation_max"), F.col("feeMin").alias("fee_min"), F.col("feeMax").alias("fee_max"),
        F.coalesce("totalEstimate", "compensationMax", "compensationMin").alias("total_estimate"), F.coalesce(blank_to_null("basis"), blank_to_null("reasoning")).alias("basis"), "status", "analysisDate",
    )


def damage_components(projections: DataFrame) -> DataFrame:
    """caseId, kind, amount of the seven damage kinds; absent ones are left out."""
    p = latest_projection(projections).select("caseId", "damageBreakdown.*")
    return p.unpivot(["caseId"], [c for c in p.columns if c != "caseId"], "kind", "amount").where("amount is not null")
