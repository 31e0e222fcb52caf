"""Queries over source collections: read by their contracts, turned into nodes, edges, chunks and facts, and written to sinks.

The collections are derived from the star-schema test tables by formulas on their keys, written as JSON and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quillspark.functions import dates
from quillspark.functions import text as tx
from quillspark.operators import chunks, cohorts, edges, facts, ingest, readiness
from quillspark.sources import contracts, sinks
from quillspark.sources.scratch import materialize, scratch_path

from .adapter import AS_OF
from .catalog_analytics import case_signals, kept_cohorts, kept_common, kept_signals, near, reach
from .catalog_tools import CASE, STAGE
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


# ---------------------------------------------------------------- collections


def _null(kind="string"):
    return F.lit(None).cast(kind)


def _collection(spark, sf_dir, name, build, allow_invalid=False):
    """A derived collection, through JSON and its contract."""
    path = scratch_path(spark, name)
    build(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")).write.json(path)
    return contracts.read_collection(spark, path, name, allow_invalid=allow_invalid)


def _cases(t):
    k = F.col("c_custkey")
    day = F.lpad((k % 28 + 1).cast("string"), 2, "0")
    return t("customer").select(
        F.concat(F.lit("m"), k.cast("string")).alias("_id"), F.when(k % 50 != 0, k.cast("string")).alias("caseId"), F.col("c_name").alias("caseName"), F.col("c_mktsegment").alias("caseType"),
        F.when(k % 4 == 0, "purchase").when(k % 4 == 1, "review").when(k % 4 == 2, "closed").alias("legalStage"), F.when(k % 3 == 0, True).alias("isSigned"), F.concat(F.lit("2020-01-"), day).alias("createdAt"),
        F.when(k % 8 != 0, F.concat(F.lit("2021-02-"), day)).alias("legalStageEnteredAt"), F.when(k % 6 != 0, (k % 100) / 100.0).alias("completionRate"),
        F.when(k % 5 != 0, F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (k % 3).cast("int"))).alias("missingCritical"), F.when(k % 2 != 0, k % 3 == 0).alias("workAccidentFlag"), F.lit(7).alias("unknownField"),
    )


def _projections(t):
    k, two = F.col("c_custkey"), F.col("version") == 2.0
    if_two = lambda c: F.when(two, c)
    paid = two & (k % 7 != 0)
    expert = lambda name, specialty: F.struct(name.alias("name"), specialty.alias("specialty"))
    wound = lambda w: F.concat(F.lit(w), (k % 10).cast("string"))
    rows = t("customer").where("c_custkey % 5 <> 0").select("c_custkey", F.explode(F.array(F.lit(1.0), F.lit(2.0))).alias("version"))
    return rows.select(
        k.cast("string").alias("caseId"), "version", F.lit("current").alias("status"), F.lit("2021-05-05").alias("analysisDate"), if_two(k % 4 == 0).alias("workAccidentFlag"), F.concat(F.lit("1980-01-0"), F.col("version").cast("int").cast("string")).alias("birthDate"),
        F.when(two, F.array(F.lit(" שבר סגור "), wound("Wound "), F.lit(""))).otherwise(F.array(F.lit("old"))).alias("initialInjuries"), F.when(two & (k % 2 == 0), F.array(F.lit("שבר מרוסק"), wound("WOUND "))).alias("currentInjuries"),
        if_two(F.array(F.lit(" ברך ימין"), F.lit("כתף שמאל"), F.lit("ברך שמאל"), F.lit("Hand"))).alias("bodyParts"),
        if_two(F.when(k % 3 == 0, "Group; נימרוד חברה לביטוח").when(k % 3 == 1, "Acme חברה לביטוח").otherwise(" ")).alias("insuranceCompany"),
        if_two(F.array(expert(F.concat(F.lit(" Dr. A"), (k % 3).cast("string")), F.lit("Ortho")), expert(F.lit(""), F.lit("x")))).alias("ourExperts"), if_two(F.array(expert(F.lit("Dr. B"), _null()))).alias("courtExperts"),
        F.when(paid, k * 10.0).alias("compensationMin"), F.when(paid & (k % 2 == 0), k * 20.0).alias("compensationMax"), F.when(paid & (k % 4 == 0), k * 15.0).alias("totalEstimate"), F.lit(" ").alias("basis"), F.concat(F.lit("r"), k.cast("string")).alias("reasoning"),
        if_two(F.struct((k * 1.0).alias("past_losses"), F.lit(5.0).alias("pain_and_suffering"))).alias("damageBreakdown"),
    )


def _contacts(t):
    s = F.col("s_suppkey")
    return t("supplier").select(
        s.cast("string").alias("_id"), F.concat(F.lit("Person "), (s % 50).cast("string")).alias("name"), F.when(s % 3 == 0, "lawyer").otherwise("client").alias("contactType"),
        F.when(s % 2 == 0, F.concat(F.lit("P"), (s % 50).cast("string"), F.lit("@x.org"))).alias("email"), F.when(s % 2 == 1, F.concat(F.lit("05-"), (s % 40).cast("string"))).alias("phone"), F.array(s.cast("string")).alias("caseIds"),
    )


def _files(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    word = lambda x: F.concat(F.lit(x), k.cast("string"))
    path = F.concat(F.lit("a/b"), (k % 40).cast("string"), F.lit("/p"), (k % 40).cast("string"), F.lit(".pdf"))
    part = lambda n, s, p: F.struct(F.lit(n).alias("chunk_number"), word(s).alias("extracted_text"), p.alias("page_range"))
    data = F.struct(
        F.when(k % 4 == 1, F.array(part(2.0, "Second ", _null()), part(1.0, "First ", F.lit("1-2")), F.struct(F.lit(3.0).alias("chunk_number"), F.lit(" ").alias("extracted_text"), _null().alias("page_range")))).alias("chunks"),
        F.when(k % 4 == 2, F.concat(F.lit("Line one  \r\n\n\n\n\nLine two "), k.cast("string"))).alias("combined_text"), F.when(k % 4 == 3, word("Extract ")).alias("extractedText"), word("Sum ").alias("summary"),
    )
    return t("orders").select(
        word("f").alias("_id"), F.when(k % 3 == 0, "zzz").otherwise(c).alias("caseId"), F.when(k % 3 == 0, F.array(F.lit("nope"), c, F.lit("1"))).alias("legacyCaseRefs"), word("doc ").alias("fileName"),
        F.when(k % 2 == 0, " ").otherwise(F.concat(F.lit(" "), "o_orderstatus")).alias("documentType"), F.when(k % 5 != 0, F.col("o_orderpriority")).alias("documentCategory"),
        F.when(k % 11 == 0, "31/02/2020").when(k % 2 == 0, F.date_format("o_orderdate", "d/M/yyyy")).otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00Z"))).alias("documentDate"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("uploadedAt"),
        F.when(k % 6 == 0, "f1").when(k % 6 == 1, "missing").alias("sourceFileId"), F.when(k % 4 == 0, F.array(F.struct(path.alias("gcsPath")), F.struct(_null().alias("gcsPath")))).alias("versions"), data.alias("processedData"),
    )


def _activity(t):
    n = F.col("event_id")
    return t("events").select(
        F.concat(F.lit("a"), n.cast("string")).alias("_id"), F.col("user_id").cast("string").alias("caseId"), F.when(n % 2 == 0, "stage_changed").otherwise("note").alias("action"), F.when(n % 9 != 0, F.col("ts").cast("string")).alias("at"),
        F.when(n % 4 == 0, F.create_map(F.lit("toStage"), F.lit(" "), F.lit("to"), F.col("event_type"))).otherwise(F.create_map(F.lit("stage"), F.col("event_type"), F.lit("subStage"), F.lit("x"))).alias("details"),
    )


def _communications(t):
    n, c = F.col("turn"), F.col("conv_id")
    return t("conversations").select(
        F.concat_ws(":", c.cast("string"), n.cast("string")).alias("_id"), (c % 60 + 1).cast("string").alias("caseId"), F.when(n % 2 == 1, "email").alias("type"), F.when(n % 2 == 0, " ").otherwise("incoming").alias("direction"),
        F.when(n % 3 != 0, "2022-03-04").alias("sentAt"), F.lit("2022-01-01").alias("createdAt"), F.col("text").alias("subject"), F.when(n % 4 == 0, " ").otherwise(F.col("text")).alias("body"), F.lit("sum").alias("summary"),
        F.struct(F.when(n % 2 == 0, (c % 40 + 1).cast("string")).alias("contactId"), F.lit("Ann").alias("name"), F.lit("12-3").alias("phone")).alias("sender"), F.array(F.struct(F.lit("No One").alias("name"))).alias("to"),
    )


_BUILD = {"cases": _cases, "case_financial_projections": _projections, "contacts": _contacts, "files": _files, "case_activity_log": _activity, "communications": _communications}


def source(spark, sf_dir, name):
    return _collection(spark, sf_dir, name, _BUILD[name], allow_invalid=name == "cases")


_K = "k AS (SELECT *, c_custkey AS k FROM customer WHERE c_custkey % 50 <> 0)"
_V = "v AS (SELECT c_custkey AS k, c_custkey::VARCHAR AS case_id FROM customer WHERE c_custkey % 5 <> 0)"


@R.add("source_case_nodes", f"""WITH {_K} SELECT k::VARCHAR AS case_id, 'm' || k AS source_id, k % 3 = 0 AS is_signed, CASE WHEN k % 6 <> 0 THEN (k % 100) / 100.0::DOUBLE ELSE 0 END AS completion_rate, CASE WHEN k % 5 <> 0 THEN k % 3 ELSE 0 END::INT AS missing,
  CASE WHEN k % 2 <> 0 THEN k % 3 = 0 WHEN k % 5 <> 0 THEN k % 4 = 0 END AS work_accident, CASE WHEN k % 5 <> 0 THEN '1980-01-02' END AS birth_date, TIMESTAMP '2020-01-01' + to_days((k % 28)::INT) AS created_at FROM k""", base=False)  # fmt: skip
def _(spark, sf_dir):
    nodes = ingest.case_nodes(source(spark, sf_dir, "cases"), source(spark, sf_dir, "case_financial_projections"))
    return nodes.select("case_id", "source_id", "is_signed", "completion_rate", F.size("missing_critical").alias("missing"), "work_accident", "birth_date", F.col("createdAt").cast("timestamp_ntz").alias("created_at"))


@R.add("source_stage_names", "SELECT unnest(['purchase', 'review', 'closed']) AS name", base=False)
def _(spark, sf_dir):
    return ingest.stage_names(source(spark, sf_dir, "cases"))


@R.add("source_valuations", f"WITH {_V} SELECT k || ':valuation:2' AS valuation_id, case_id, k * 10.0::DOUBLE AS compensation_min, CASE WHEN k % 2 = 0 THEN k * 20.0::DOUBLE END AS compensation_max, CASE WHEN k % 4 = 0 THEN k * 15.0 WHEN k % 2 = 0 THEN k * 20.0 ELSE k * 10.0 END::DOUBLE AS total_estimate, 'r' || k AS basis FROM v WHERE k % 7 <> 0", base=False)
def _(spark, sf_dir):
    return ingest.valuation_rows(source(spark, sf_dir, "case_financial_projections")).select("valuation_id", "case_id", "compensation_min", "compensation_max", "total_estimate", "basis")


@R.add("source_damages", f"WITH {_V} SELECT case_id, 'past_losses' AS kind, k::DOUBLE AS amount FROM v UNION ALL SELECT case_id, 'pain_and_suffering', 5.0 FROM v", base=False)
def _(spark, sf_dir):
    return ingest.damage_components(source(spark, sf_dir, "case_financial_projections")).withColumnRenamed("caseId", "case_id")


@R.add("source_injuries", f"WITH {_V} SELECT case_id, 'שבר' AS normalized, 'שבר סגור' AS name, CASE WHEN k % 2 = 0 THEN 'current' ELSE 'initial' END AS status FROM v UNION ALL SELECT case_id, 'wound ' || k % 10, 'Wound ' || k % 10, CASE WHEN k % 2 = 0 THEN 'current' ELSE 'initial' END FROM v", base=False)
def _(spark, sf_dir):
    return ingest.injury_edges(source(spark, sf_dir, "case_financial_projections")).select("case_id", "normalized", "name", "status")


@R.add("source_body_parts", f"WITH {_V}, n AS (SELECT unnest(['ברכ', 'כתפ', 'hand']) AS normalized, unnest(['ברך ימין', 'כתף שמאל', 'Hand']) AS name) SELECT case_id, normalized, name FROM v, n", base=False)
def _(spark, sf_dir):
    return ingest.body_part_edges(source(spark, sf_dir, "case_financial_projections"))


@R.add("source_insurers", f"WITH {_V} SELECT case_id, CASE k % 3 WHEN 0 THEN 'נימרוד' ELSE 'acme' END AS normalized FROM v WHERE k % 3 < 2", base=False)
def _(spark, sf_dir):
    return ingest.insurer_edges(source(spark, sf_dir, "case_financial_projections")).select("case_id", "normalized")


@R.add("source_experts", f"WITH {_V} SELECT case_id, 'dr. a' || k % 3 || '|ortho' AS key, 'ours' AS side, 'Dr. A' || k % 3 AS name, 'Ortho' AS specialty FROM v UNION ALL SELECT case_id, 'dr. b|', 'court', 'Dr. B', NULL FROM v", base=False)
def _(spark, sf_dir):
    return ingest.expert_edges(source(spark, sf_dir, "case_financial_projections")).select("case_id", "key", "side", "name", "specialty")


_F = """known AS (SELECT c_custkey AS c FROM customer WHERE c_custkey % 50 <> 0),
f AS (SELECT o_orderkey AS k, 'f' || o_orderkey AS id, o_orderdate, o_orderstatus, o_orderpriority, CASE WHEN o_custkey IN (SELECT c FROM known) THEN o_custkey::VARCHAR WHEN o_orderkey % 3 = 0 THEN '1' END AS case_id FROM orders),
g AS (SELECT * FROM f WHERE case_id IS NOT NULL),
arch AS (SELECT 'archived:a/b' || k % 40 || '/p' || k % 40 || '.pdf' AS id, 'p' || k % 40 || '.pdf' AS file_name, arg_min(case_id, id) AS case_id FROM g WHERE k % 4 = 0 GROUP BY 1, 2)"""


@R.add(
    "source_documents",
    f"""WITH {_F} SELECT id AS document_id, case_id, 'doc ' || k AS file_name, CASE WHEN k % 2 = 0 THEN 'unclassified' ELSE o_orderstatus END AS type, CASE WHEN k % 5 = 0 THEN 'other' ELSE o_orderpriority END AS category,
  CASE WHEN k % 11 <> 0 THEN o_orderdate::DATE::TIMESTAMP END AS document_date, k % 4 = 0 AS is_modified, false AS archived FROM g
UNION ALL SELECT id, case_id, file_name, NULL, NULL, NULL, true, true FROM arch""",
    base=False,
)
def _(spark, sf_dir):
    nodes, _ = ingest.document_nodes(source(spark, sf_dir, "files"), source(spark, sf_dir, "cases"))
    return nodes.select("document_id", "case_id", F.col("fileName").alias("file_name"), "type", "category", F.col("document_date").cast("timestamp_ntz").alias("document_date"), "is_modified", "archived")


@R.add("source_document_edges", f"WITH {_F} SELECT id AS child_id, 'f1' AS parent_id FROM g WHERE k % 6 = 0 AND EXISTS (SELECT 1 FROM g WHERE id = 'f1') UNION ALL SELECT id, 'archived:a/b' || k % 40 || '/p' || k % 40 || '.pdf' FROM g WHERE k % 4 = 0", base=False)
def _(spark, sf_dir):
    _, edges = ingest.document_nodes(source(spark, sf_dir, "files"), source(spark, sf_dir, "cases"))
    return edges.select("child_id", "parent_id")


@R.add(
    "source_file_chunks",
    """WITH t AS (SELECT o_orderkey AS k, unnest(CASE o_orderkey % 4 WHEN 1 THEN ['First ' || o_orderkey, 'Second ' || o_orderkey] WHEN 2 THEN ['Line one' || chr(10) || chr(10) || 'Line two ' || o_orderkey] WHEN 3 THEN ['Extract ' || o_orderkey] ELSE ['Sum ' || o_orderkey] END) AS x,
  generate_subscripts(CASE WHEN o_orderkey % 4 = 1 THEN [1, 2] ELSE [1] END, 1) AS n FROM orders)
SELECT 'f' || k || ':chunk:' || n AS chunk_id, n::INT AS chunk_number, x AS text, CASE k % 4 WHEN 1 THEN 'chunk' WHEN 2 THEN 'combined_text' WHEN 3 THEN 'extracted_text' ELSE 'summary' END AS source, CASE WHEN k % 4 = 1 AND n = 1 THEN '1-2' END AS page_range FROM t""",
    base=False,
)
def _(spark, sf_dir):
    return chunks.file_chunks(source(spark, sf_dir, "files")).select("chunk_id", "chunk_number", "text", "source", "page_range")


@R.add("page_ranges", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'cover' WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 5)::VARCHAR ELSE o_orderkey % 5 || '-' || o_orderkey % 5 + 1 END AS pages FROM orders", base=False)
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k, chunks.page_range(F.when(k % 7 == 0, "cover"), k % 5, k % 5 + k % 2).alias("pages"))


_E = f"""{_K}, log AS (SELECT user_id::VARCHAR AS case_id, event_type AS stage, CASE WHEN event_id % 4 <> 0 THEN 'x' END AS sub_stage, ts AS occurred_at, 'activity_log' AS source, 'log:a' || event_id AS key FROM events JOIN k ON k = user_id WHERE event_id % 2 = 0 AND event_id % 9 <> 0),
snap AS (SELECT k::VARCHAR AS case_id, (['purchase', 'review', 'closed'])[k % 4 + 1] AS stage, NULL AS sub_stage, TIMESTAMP '2021-02-01' + to_days((k % 28)::INT) AS occurred_at, 'current_stage_snapshot' AS source, k FROM k WHERE k % 4 < 3 AND k % 8 <> 0),
ev AS (SELECT * FROM log UNION ALL SELECT case_id, stage, sub_stage, occurred_at, source, 'snapshot:' || case_id || ':' || stage FROM snap WHERE NOT EXISTS (SELECT 1 FROM log WHERE log.case_id = snap.case_id AND log.stage = snap.stage))"""


def _stage_events(spark, sf_dir):
    return ingest.stage_events(source(spark, sf_dir, "case_activity_log"), source(spark, sf_dir, "cases")).withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz"))


@R.add("source_stage_events", f"WITH {_E} SELECT key, case_id, stage, sub_stage, occurred_at, source FROM ev", base=False)
def _(spark, sf_dir):
    return _stage_events(spark, sf_dir).select("key", "case_id", "stage", "sub_stage", "occurred_at", "source")


@R.add("source_reached_stages", f"WITH {_E} SELECT case_id, stage, arg_max(occurred_at, (occurred_at, key)) AS at, arg_max(source, (occurred_at, key)) AS source FROM ev GROUP BY 1, 2", base=False)
def _(spark, sf_dir):
    return ingest.reached_stages(_stage_events(spark, sf_dir))


@R.add(
    "source_communications",
    """SELECT conv_id || ':' || turn AS comm_id, (conv_id % 60 + 1)::VARCHAR AS case_id, CASE WHEN turn % 2 = 1 THEN 'email' ELSE 'unknown' END AS type, CASE WHEN turn % 2 = 1 THEN 'incoming' ELSE 'unknown' END AS direction, 'unknown' AS status,
  CASE WHEN turn % 3 <> 0 THEN TIMESTAMP '2022-03-04' ELSE TIMESTAMP '2022-01-01' END AS sent_at, left(coalesce(text, ''), 200) AS subject, CASE WHEN turn % 4 = 0 OR trim(coalesce(text, '')) = '' THEN 'sum' ELSE left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 500) END AS preview
FROM conversations WHERE (conv_id % 60 + 1) % 50 <> 0 AND conv_id % 60 + 1 IN (SELECT c_custkey FROM customer)""",
    base=False,
)
def _(spark, sf_dir):
    nodes = ingest.communication_nodes(source(spark, sf_dir, "communications"), source(spark, sf_dir, "cases"))
    return nodes.withColumn("sent_at", F.col("sent_at").cast("timestamp_ntz"))


@R.add(
    "source_participants",
    """SELECT conv_id || ':' || turn AS comm_id, 'from' AS kind, CASE WHEN turn % 2 = 1 OR s_suppkey IS NULL THEN 'ann|communication_party|p:123' ELSE 'person ' || s_suppkey % 50 || '|' || CASE WHEN s_suppkey % 3 = 0 THEN 'lawyer' ELSE 'client' END || '|' || CASE WHEN s_suppkey % 2 = 0 THEN 'e:p' || s_suppkey % 50 || '@x.org' ELSE 'p:05' || s_suppkey % 40 END END AS dedup_key
FROM conversations LEFT JOIN supplier ON s_suppkey = conv_id % 40 + 1 UNION ALL SELECT conv_id || ':' || turn, 'to', 'uniq:' || conv_id || ':' || turn || ':to:0' FROM conversations""",
    base=False,
)
def _(spark, sf_dir):
    return ingest.participant_edges(source(spark, sf_dir, "communications"), source(spark, sf_dir, "contacts"))


# ---------------------------------------------------------------- terms and dates


@R.add("canonical_terms", "SELECT l_orderkey, l_linenumber, (['כאב גב', 'דיסק', 'wound'])[l_linenumber % 3 + 1] AS injury, (['גב', 'כתפ', 'hand'])[l_linenumber % 3 + 1] AS body_part, (['ביטוח ישיר', 'ביטוח לאומי', 'acme'])[l_linenumber % 3 + 1] AS insurer FROM lineitem", base=False)
def _(spark, sf_dir):
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), F.col("l_linenumber") % 3 + 1)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select("l_orderkey", "l_linenumber", tx.term("injury", pick(" כאבי  גב תחתון", "פריצת דיסק", "Wound")).alias("injury"), tx.term("bodyPart", pick("עמוד שדרה", 'כתף "ימין"', "Hand ")).alias("body_part"), tx.term("insurer", pick("ביטוח ישיר", 'Group, המוסד לביטוח לאומי', 'ACME ביטוח בע"מ')).alias("insurer"))


@R.add("observation_times", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN o_orderdate::DATE::TIMESTAMP WHEN o_orderkey % 5 = 2 THEN o_orderdate::DATE::TIMESTAMP WHEN o_orderkey % 5 = 3 THEN NULL ELSE o_orderdate::DATE::TIMESTAMP END AS at FROM orders", base=False)
def _(spark, sf_dir):
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    said = F.when(k == 0, "soon").when(k == 1, F.date_format(d, "yyyy-M-d")).when(k == 2, F.date_format(d, "d-M-yyyy")).when(k == 3, "2020-02-31").otherwise(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T23:59:59Z")))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", dates.observation_time(said).cast("timestamp_ntz").alias("at"))


@R.add("dates_in_texts", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 3 = 0 THEN ',2031-02-31' ELSE '' END AS dates FROM orders", base=False)
def _(spark, sf_dir):
    d = F.col("o_orderdate")
    said = F.concat(F.lit("from "), F.date_format(d, "d.M.yyyy"), F.lit(" or "), F.date_format(d, "dd/MM/yyyy"), F.lit(", not 32.1.2020, 1.13.2020 nor 1.1.1800"), F.when(F.col("o_orderkey") % 3 == 0, " till 31-2-31").otherwise(""))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.array_join(dates.dates_in(said), ",").alias("dates"))


# ---------------------------------------------------------------- facts

# A Hebrew text for each family of rules; {p} is a number.
_TEXTS = (
    "נקבעה נכות זמנית של {p}% מיום 1/2/2020 עד 3/4/2021.", "תקנה 15 לא הופעלה בתיק {p}.", "המוסד לביטוח לאומי דוחה את התביעה {p} ביום 05.06.2019.", "זכאות {p}: ניתן לפנות תוך 60 יום.", "אנא לשלוח טופס בל/250 מספר {p}.",
    "ירידה בהכנסה {p} מיום 1.1.2018.", "ועדה רפואית {p}: בדיקה נוירולוגית נמשכה.", "תאונת עבודה {p} ביום 7/8/2017.", "{p} אחוזי נכות צמיתה.",
    # One for each rule that the first nine don't hit.
    "התביעה {p} אושרה במוסד לביטוח לאומי ביום 02.03.2018.", "החלטת הוועדה {p} הועברה לביטוח לאומי.", "הוגש ערר {p} לביטוח לאומי.", "זכאות {p}: ניתן לפנות תוך שישים יום.", "זכאות מספר {p}: ניתן לפנות תוך 12 חודשים.",
    "זכאות {p}: ניתן לפנות בתוך שנים עשר חודשים.", "אנא לשלוח תלושי שכר {p}.", "אנא לשלוח מכתב מהמעסיק {p}.", "נדרש רופא תעסוקתי {p}.", "חסר תיעוד רפואי {p}.", "נדרש דיסק של בדיקות {p}.", "נדרש אישור משטרה {p}.",
    "עבודה {p} בהיקף חצי משרה מיום 1.2.2019.", "העובד {p} חזר לעבודה ביום 3.4.2019.", "תביעת נפגעי עבודה {p} הוגשה ביום 5.6.2019.", "דמי פגיעה {p} שולמו.", "תאריך פגיעה {p}: 7.8.2019.",
)


def _hebrew(spark, sf_dir):
    k = F.col("doc_id")
    pieces = [F.concat(*(x for i, part in enumerate(t.split("{p}")) for x in ([(k % 120 + 1).cast("string")] if i else []) + [F.lit(part)])) for t in _TEXTS]
    text = F.concat(F.element_at(F.array(*pieces), (k % len(_TEXTS) + 1).cast("int")), F.lit(" #"), k.cast("string"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("d"), k.cast("string")).alias("chunk_id"), text.alias("text"))
    return docs.withColumn("chunk_hash", tx.content_hash("text"))


_H = f"""h AS (SELECT doc_id AS k, doc_id % 120 + 1 AS p, (doc_id % {len(_TEXTS)})::INT AS t, 'd' || doc_id AS chunk_id, replace(([{", ".join(f"'{t}'" for t in _TEXTS)}])[doc_id % {len(_TEXTS)} + 1], '{{p}}', (doc_id % 120 + 1)::VARCHAR) || ' #' || doc_id AS text FROM documents),
e(t, kind, subtype, value, numeric_value, unit, from_date, to_date, confidence) AS (VALUES (0, 'disability_period', 'temporary', '%', NULL, 'percent', '2020-02-01', '2021-04-03', 0.86), (1, 'regulation_15', 'not_applied', 'not_applied', NULL, NULL, NULL, NULL, 0.9),
  (2, 'nii_decision', 'rejected', 'rejected', NULL, NULL, '2019-06-05', NULL, 0.86), (3, 'appeal_deadline', 'days', '60 days', 60, 'days', NULL, NULL, 0.84), (4, 'required_document', 'btl_250_form', 'btl_250_form', NULL, NULL, NULL, NULL, 0.78),
  (5, 'income_evidence', 'income_reduction', 'income_reduction', NULL, NULL, '2018-01-01', NULL, 0.82), (6, 'medical_committee', 'נוירולוגי', 'נוירולוגי', NULL, NULL, NULL, NULL, 0.82), (7, 'work_accident', 'work_accident', 'work_accident', NULL, NULL, '2017-08-07', NULL, 0.82),
  (8, 'disability_period', 'permanent', '%', NULL, 'percent', NULL, NULL, 0.86), (9, 'nii_decision', 'accepted', 'accepted', NULL, NULL, '2018-03-02', NULL, 0.82), (10, 'nii_decision', 'committee_decision', 'committee_decision', NULL, NULL, NULL, NULL, 0.84),
  (11, 'nii_decision', 'appeal_notice', 'appeal_notice', NULL, NULL, NULL, NULL, 0.78), (12, 'appeal_deadline', 'days', '60 days', 60, 'days', NULL, NULL, 0.84), (13, 'appeal_deadline', 'months', '12 months', 12, 'months', NULL, NULL, 0.84), (14, 'appeal_deadline', 'months', '12 months', 12, 'months', NULL, NULL, 0.84),
  (15, 'required_document', 'salary_slips', 'salary_slips', NULL, NULL, NULL, NULL, 0.78), (15, 'income_evidence', 'salary_slips', 'salary_slips', NULL, NULL, NULL, NULL, 0.78), (16, 'required_document', 'employer_letter', 'employer_letter', NULL, NULL, NULL, NULL, 0.78), (16, 'income_evidence', 'employer_letter', 'employer_letter', NULL, NULL, NULL, NULL, 0.78),
  (17, 'required_document', 'occupational_doctor', 'occupational_doctor', NULL, NULL, NULL, NULL, 0.78), (18, 'required_document', 'medical_records', 'medical_records', NULL, NULL, NULL, NULL, 0.78), (19, 'required_document', 'imaging_discs', 'imaging_discs', NULL, NULL, NULL, NULL, 0.78), (20, 'required_document', 'police_report', 'police_report', NULL, NULL, NULL, NULL, 0.78),
  (21, 'income_evidence', 'reduced_work_capacity', 'reduced_work_capacity', NULL, NULL, '2019-02-01', NULL, 0.82), (22, 'income_evidence', 'returned_to_work', 'returned_to_work', NULL, NULL, '2019-04-03', NULL, 0.78), (23, 'work_accident', 'work_injury_claim', 'work_injury_claim', NULL, NULL, '2019-06-05', NULL, 0.82),
  (24, 'work_accident', 'injury_allowance', 'injury_allowance', NULL, NULL, NULL, NULL, 0.82), (25, 'work_accident', 'injury_date', 'injury_date', NULL, NULL, '2019-08-07', NULL, 0.82)),
x AS (SELECT chunk_id, CASE WHEN e.t IN (15, 16) AND kind = 'income_evidence' THEN 2 ELSE 1 END AS nth, k, e.t, kind, subtype, CASE WHEN value = '%' THEN p || '%' ELSE value END AS value, CASE WHEN value = '%' THEN p ELSE numeric_value END::DOUBLE AS numeric_value, unit, from_date, to_date, confidence::DOUBLE AS confidence, text AS quote FROM h JOIN e ON h.t = e.t WHERE value <> '%' OR p <= 100)"""


@R.add("evidence_facts_hebrew", f"WITH {_H} SELECT chunk_id || ':fact:' || nth AS fact_id, chunk_id, kind, subtype, value, numeric_value, unit, from_date, to_date, confidence, quote, '1' AS version, sha256(quote) AS chunk_hash FROM x", base=False)
def _(spark, sf_dir):
    rows = facts.extract_facts(_hebrew(spark, sf_dir))
    said = lambda n: F.get_json_object("metadata", f"$.{n}").alias(n)
    return rows.select("fact_id", "chunk_id", "kind", "subtype", "value", "numeric_value", "unit", "from_date", "to_date", "confidence", "quote", said("version"), said("chunk_hash"))


def _drafts(frames):
    """A stand-in for a remote model: for each chunk a fact that rules find as well or a new one, and two that don't hold."""
    for f in frames:
        for i, text in zip(f["chunk_id"], f["text"], strict=True):
            kinds = [("regulation_15", "not_applied" if "15" in text else "mentioned", text, 1.5), ("gossip", "x", text, 0.5), ("regulation_15", "x", "not in the text", 0.5)]
            yield pd.DataFrame([{"chunk_id": i, "kind": k, "subtype": s, "value": s, "numeric_value": None, "unit": None, "from_date": None, "to_date": None, "confidence": c, "quote": q} for k, s, q, c in kinds])


@R.add("facts_llm_merge", f"WITH {_H} SELECT chunk_id, kind, subtype, confidence, 'regex' AS source FROM x UNION ALL SELECT chunk_id, 'regulation_15', CASE WHEN contains(text, '15') THEN 'not_applied' ELSE 'mentioned' END, 1.0, 'llm' FROM h WHERE t <> 1", base=False)
def _(spark, sf_dir):
    texts = _hebrew(spark, sf_dir)
    own = facts.extract_facts(texts)
    said = facts.numbered(facts.validate_drafts(facts.with_provider(texts, _drafts), texts), "llm").withColumn("source", F.lit("llm"))
    return facts.merge_facts(own, said).select("chunk_id", "kind", "subtype", "confidence", "source")


@R.add("facts_cache_replay", f"WITH {_H} SELECT chunk_id, chunk_id || ':fact:1' AS fact_id, CASE WHEN k % 2 = 0 THEN 0.9 ELSE 1.0 END::DOUBLE AS confidence, DATE '2020-01-01' + (k % 100)::INT AS observed_date FROM h", base=False)
def _(spark, sf_dir):
    k = F.substring("chunk_id", 2, 20).cast("long")
    texts = _hebrew(spark, sf_dir).withColumn("observed_date", F.date_add(F.to_date(F.lit("2020-01-01")), (k % 100).cast("int")))
    path = scratch_path(spark, "fact-cache")
    entry = texts.where(k % 2 == 0).select("chunk_hash", F.lit(facts.VERSION).alias("version"), F.lit("gone").alias("chunk_id"), F.lit("regulation_15").alias("kind"), F.lit("old").alias("subtype"), F.lit("old").alias("value"), *(_null(t).alias(n) for n, t in (("numeric_value", "double"), ("unit", "string"), ("from_date", "string"), ("to_date", "string"))), F.lit(0.9).alias("confidence"), F.col("text").alias("quote"))
    sinks.add_to_cache(entry, path, ["version", "chunk_hash"])
    sinks.add_to_cache(entry.withColumn("confidence", F.lit(0.1)), path, ["version", "chunk_hash"])  # known entries stay
    drafts = facts.with_provider(texts, _drafts, sinks.read_table(spark, path), facts.VERSION)
    return facts.numbered(facts.validate_drafts(drafts, texts)).select("chunk_id", "fact_id", "confidence", "observed_date")


# ---------------------------------------------------------------- sinks


@R.add("sink_upsert_rows", "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS v FROM customer UNION ALL SELECT -c_custkey - 1, 'new' FROM customer WHERE c_custkey % 2 = 0", base=False)
def _(spark, sf_dir):
    path = scratch_path(spark, "upsert")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    sinks.upsert_rows(rows.withColumn("v", F.lit("old")), path, ["k"])
    even = rows.where("k % 2 = 0").withColumn("v", F.lit("new"))
    sinks.upsert_rows(even.union(even.selectExpr("-k - 1 k", "v")), path, ["k"])
    return sinks.read_table(spark, path)


@R.add("sink_upsert_edges", "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_custkey % 3 = 0 AND o_orderstatus IN ('F', 'O')", base=False)
def _(spark, sf_dir):
    path = scratch_path(spark, "edges")
    edges = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderstatus", "o_orderpriority")
    src = edges.where("o_custkey % 3 = 0").select("o_custkey")
    dst = edges.where("o_orderstatus in ('F', 'O')").select("o_orderstatus")
    for part in (edges, edges):  # the second time adds nothing
        sinks.upsert_edges(part, path, src, dst, "o_custkey", "o_orderstatus", ("o_orderpriority",))
    return sinks.read_table(spark, path)


@R.add("sink_replace_and_clear", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1", base=False)
def _(spark, sf_dir):
    path = scratch_path(spark, "replace")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")
    sinks.replace_table(nations, path)
    sinks.clear(spark, path)
    sinks.replace_table(nations, path)
    sinks.replace_table(sinks.read_table(spark, path).where("n_regionkey = 1").drop("n_regionkey"), path)
    return sinks.read_table(spark, path)


@R.add("sink_cache_misses", "SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS h FROM documents WHERE sha256(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) NOT IN (SELECT sha256(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) FROM documents WHERE doc_id % 3 = 0)", base=False)
def _(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tx.content_hash(F.coalesce("text", F.lit(""))).alias("h"))
    path = scratch_path(spark, "cache")
    sinks.add_to_cache(docs.where("doc_id % 3 = 0").select("h"), path, ["h"])
    return sinks.cache_misses(docs, sinks.read_table(spark, path), ["h"])


@R.add("sink_conversation_history", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'edited' ELSE role END AS role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4", base=False)
def _(spark, sf_dir):
    path = scratch_path(spark, "history")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role")
    sinks.upsert_last(turns, path, "conv_id", "turn", keep=6)
    sinks.upsert_last(turns.where("turn % 2 = 0").withColumn("role", F.lit("edited")), path, "conv_id", "turn", keep=4)
    return sinks.read_table(spark, path)


@R.add("published_similarity", "SELECT case_id, other_id, round(combined_score, 6) AS combined_score FROM near")
def _(p):
    spark = p.cases.sparkSession
    path = scratch_path(spark, "similar-to")
    edges.publish(path, materialize(case_signals(p), "signals"), p.embeddings)
    return edges.read(spark, path).select("case_id", "other_id", F.round("combined_score", 6).alias("combined_score"))


@R.add("published_cohorts", "SELECT cohort_key, members, confidence FROM (SELECT cohort_key, members, CASE WHEN members >= 25 AND logged >= 25 THEN 'high' WHEN members >= 12 THEN 'medium' ELSE 'low' END AS confidence FROM coh)")
def _(p):
    spark = p.cases.sparkSession
    path = scratch_path(spark, "cohorts")
    rows = cohorts.cohorts(reach(p)).select("cohort_key", "members", "confidence")
    sinks.replace_table(rows.limit(0), path)
    sinks.replace_table(rows, path)
    return sinks.read_table(spark, path)


# ---------------------------------------------------------------- readiness decision


@R.add(
    "readiness_decision",
    f""", app AS (SELECT * FROM (SELECT c.case_id, coh.*, row_number() OVER (PARTITION BY c.case_id ORDER BY (coh.scope = 'global')::INT) AS r FROM cases c JOIN coh ON coh.stage = '{STAGE}' AND coh.sub_stage = '' AND coh.scope_type IN ('all', c.case_type) WHERE c.case_id = {CASE}) WHERE r = 1),
cmp AS (SELECT signal_key, CASE WHEN first_observed IS NOT NULL THEN 'matched' WHEN split_part(signal_key, ':', 1) IN ('injury', 'bodyPart', 'insurer', 'contactRole') THEN 'context' ELSE 'missing' END AS status FROM app JOIN common USING (cohort_key) LEFT JOIN sig USING (case_id, signal_key)),
t8 AS (SELECT r.*, coalesce(combined_score, 0) AS s, date_sub('day', r.event_date, reached_at) AS days FROM reaches r LEFT JOIN near n ON n.case_id = {CASE} AND n.other_id = r.case_id WHERE stage = '{STAGE}' AND sub_stage = '' AND r.case_id <> {CASE} ORDER BY round(coalesce(combined_score, 0), 9) DESC, r.case_id LIMIT 8)
SELECT {CASE}::BIGINT AS case_id, '{STAGE}' AS stage, (SELECT count(*) FROM cmp) AS pattern, (SELECT count(*) FROM cmp WHERE status = 'matched') AS matched, (SELECT count(*) FROM cmp WHERE status = 'missing') AS missing,
  (SELECT count(*) FROM t8 WHERE source = 'activity_log' AND days >= 0) AS timed_peers, '' AS reasons""",
)
def _(p):
    r = reach(p)
    # The case itself is no peer of its own.
    told = readiness.explain(p.cases.where(F.col("case_id") == CASE), STAGE, kept_cohorts(p), kept_common(p), kept_signals(p), r.where(F.col("case_id") != CASE), near(p, CASE), AS_OF)
    composer = readiness.ArtifactComposer()
    for part in composer.PARTS:
        made = composer.observe(part, CASE, STAGE, getattr(told, part))
    status = made.comparison.groupBy("case_id").agg(F.count("*").alias("pattern"), F.count_if(F.col("status") == "matched").alias("matched"), F.count_if(F.col("status") == "missing").alias("missing"))
    doubts = made.reasons.select("case_id", F.array_join("reasons", "; ").alias("reasons"))
    return made.estimate.select("case_id", F.lit(made.stage).alias("stage"), "timed_peers").join(doubts, "case_id").join(status, "case_id", "left").fillna(0, ["pattern", "matched", "missing"])
