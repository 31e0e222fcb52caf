"""Queries over ingest transforms, text chunks, facts and full-text search."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import chunks, facts, ingest, search, textindex
from quillspark.sources.scratch import scratch_dir, scratch_path

from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


def _contacts(p):
    """Source contacts of the test tables: few names, shared addresses, some contacts without any."""
    ids = p.case_contacts.groupBy("contact_id").agg(F.array_sort(F.collect_set(F.col("case_id").cast("string"))).alias("caseIds"))
    n = F.col("contact_id")
    email = F.when(n % 3 == 0, F.concat(F.lit(" C"), (n % 25).cast("string"), F.lit("@X.org ")))
    phone = F.when(n % 2 == 0, F.concat(F.lit("+1 (555) "), F.lpad((n % 20).cast("string"), 4, "0")))
    kind = F.when(n % 11 == 0, "admin").otherwise(F.col("contact_type"))
    name = F.concat(F.lit(" Contact  "), (n % 4).cast("string"), F.lit("'"))
    return p.contacts.join(ids, "contact_id", "left").select(n.cast("string").alias("_id"), name.alias("name"), kind.alias("contactType"), phone.alias("phone"), email.alias("email"), "caseIds")


_CONTACTS = """src AS (SELECT contact_id::VARCHAR AS id, 'contact ' || (contact_id % 4) AS nn, CASE WHEN contact_id % 11 = 0 THEN 'admin' ELSE contact_type END AS kind, CASE WHEN contact_id % 3 = 0 THEN 'e:c' || (contact_id % 25) || '@x.org'
  WHEN contact_id % 2 = 0 THEN 'p:1555' || lpad((contact_id % 20)::VARCHAR, 4, '0') ELSE '' END AS point FROM contacts),
node AS (SELECT CASE WHEN point = '' THEN 'uniq:' || id ELSE nn || '|' || kind || '|' || point END AS dedup_key, id, kind FROM src WHERE kind <> 'admin')"""


@R.add("contact_dedup", f", {_CONTACTS} SELECT dedup_key, string_agg(DISTINCT id, ',' ORDER BY id) AS source_ids, (SELECT count(DISTINCT case_id) FROM case_contacts k WHERE k.contact_id IN (SELECT m.id::BIGINT FROM node m WHERE m.dedup_key = node.dedup_key)) AS cases FROM node GROUP BY dedup_key")
def _(p):
    return ingest.contact_nodes(_contacts(p)).select("dedup_key", F.array_join("source_ids", ",").alias("source_ids"), F.size("case_ids").cast("long").alias("cases"))


@R.add("contact_case_edges", f", {_CONTACTS} SELECT DISTINCT dedup_key, case_id::VARCHAR AS case_id FROM node JOIN case_contacts k ON k.contact_id = id::BIGINT")
def _(p):
    known = p.cases.select(F.col("case_id").cast("string").alias("caseId"))
    return ingest.contact_edges(ingest.contact_nodes(_contacts(p)), known).select("dedup_key", "case_id")


@R.add(
    "client_resolution",
    """, named AS (SELECT case_id, '5' AS contact_id FROM cases WHERE case_id % 3 = 0),
one AS (SELECT case_id, min(contact_id)::VARCHAR AS contact_id FROM case_contacts JOIN contacts USING (contact_id) WHERE contact_type = 'client' AND contact_id % 11 <> 0 GROUP BY 1 HAVING count(*) = 1)
SELECT case_id::VARCHAR AS case_id, coalesce(named.contact_id, one.contact_id) AS contact_id FROM cases LEFT JOIN named USING (case_id) LEFT JOIN one USING (case_id) WHERE coalesce(named.contact_id, one.contact_id) IS NOT NULL""",
)
def _(p):
    cases = p.cases.select(F.col("case_id").cast("string").alias("caseId"), F.when(F.col("case_id") % 3 == 0, "5").alias("clientContactId"))
    return ingest.resolve_clients(cases, _contacts(p))


@R.add("insurer_canonical", "SELECT DISTINCT case_id, normalized FROM insurers")
def _(p):
    raw = p.insurers.select("case_id", F.concat(F.lit("Group; "), "name", F.lit(' חברה לביטוח בע"מ')).alias("raw"))
    return raw.select("case_id", tx.term("insurer", "raw").alias("normalized")).distinct()


@R.add("stage_backfill_anti_join", "SELECT case_id, legal_stage AS stage, stage_entered_at AS occurred_at FROM cases c WHERE legal_stage IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stage_events e WHERE e.case_id = c.case_id AND e.stage = c.legal_stage AND source = 'activity_log')")
def _(p):
    snap = p.cases.where("legal_stage is not null").select("case_id", F.col("legal_stage").alias("stage"), F.col("stage_entered_at").alias("occurred_at"))
    return ingest.backfill(snap, p.stage_events.where("source = 'activity_log'"))


@R.add("current_injury_overrides", "SELECT case_id, normalized, CASE WHEN bool_or(l_returnflag = 'R') THEN 'current' ELSE 'initial' END AS status FROM (SELECT case_id, lower(p_type) AS normalized, l_returnflag FROM prt) GROUP BY 1, 2")
def _(p):
    parts = p.injuries.select(F.col("case_id").cast("string").alias("caseId"), F.lit(1.0).alias("version"), F.lit(None).cast("string").alias("analysisDate"), "name", "status")
    some = lambda s: F.array_sort(F.collect_list(F.when(F.lit(s == "initial") | (F.col("status") == s), F.concat(F.col("name"), F.lit(" ")))))
    proj = parts.groupBy("caseId", "version", "analysisDate").agg(some("initial").alias("initialInjuries"), some("current").alias("currentInjuries"))
    return ingest.injury_edges(proj).select(F.col("case_id").cast("long").alias("case_id"), "normalized", "status")


@R.add("content_hashes", "SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS content_hash FROM documents", base=False)
def _(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", tx.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))


_CHUNKS = r"""WITH t AS (SELECT doc_id AS document_id, regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(13), ''), '[ \t]+\n', chr(10), 'g'), '\n{4,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents),
p AS (SELECT document_id, list_filter(list_transform(regexp_split_to_array(t, '\n\s*\n'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM t),
q AS (SELECT document_id, flatten(list_transform(ps, lambda x: CASE WHEN length(x) > 2600 THEN list_transform(range(0, (length(x) - 1) // 2200 + 1), lambda i: substring(x, i * 2200 + 1, 2200)) ELSE [x] END)) AS ps FROM p),
r AS (SELECT document_id, list_reduce(list_transform(ps, lambda x: {'done': []::VARCHAR[], 'open': x}), lambda a, b: CASE WHEN length(a.open || chr(10) || chr(10) || b.open) <= 2600 THEN {'done': a.done, 'open': a.open || chr(10) || chr(10) || b.open}
  ELSE {'done': list_append(a.done, a.open), 'open': CASE WHEN trim(right(a.open, 180)) = '' THEN b.open ELSE trim(right(a.open, 180)) || chr(10) || chr(10) || b.open END} END) AS r FROM q WHERE len(ps) > 0),
c AS (SELECT document_id, unnest(list_append(r.done, r.open)) AS chunk, generate_subscripts(list_append(r.done, r.open), 1) AS n FROM r)"""


@R.add(
    "document_chunks",
    _CHUNKS
    + r"""SELECT document_id || ':chunk:' || n AS chunk_id, document_id, n AS chunk_number, length(chunk) AS char_count, sha256(trim(regexp_replace(chunk, '\s+', ' ', 'g'))) AS chunk_hash FROM c""",
    base=False,
)
def _(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"), "text")
    return chunks.chunk_rows(docs).select("chunk_id", "document_id", F.col("chunk_number").cast("long"), F.col("char_count").cast("long"), "chunk_hash")


_RULES = r"""
x AS (SELECT document_id, document_id || ':chunk:' || n AS chunk_id, chunk AS t FROM c),
rules(rule, p) AS (VALUES (0, '[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]{1,63}\.[A-Za-z]{2,10}'), (1, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b'), (2, '(?i)licensed under|released under')),
m AS (SELECT document_id, chunk_id, t, rule, CASE rule WHEN 0 THEN regexp_extract_all(t, '[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]{1,63}\.[A-Za-z]{2,10}') WHEN 1 THEN regexp_extract_all(t, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b') ELSE regexp_extract_all(t, '(?i)licensed under|released under') END AS f,
  CASE rule WHEN 0 THEN regexp_split_to_array(t, '[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]{1,63}\.[A-Za-z]{2,10}') WHEN 1 THEN regexp_split_to_array(t, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b') ELSE regexp_split_to_array(t, '(?i)licensed under|released under') END AS g FROM x, rules),
hit AS (SELECT document_id, chunk_id, t, rule, f, g, unnest(range(1, len(f) + 1)) AS i FROM m WHERE len(f) > 0),
pos AS (SELECT *, (list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda y: length(y))), 0))::BIGINT AS place FROM hit),
ctx AS (SELECT *, trim(regexp_replace(substring(t, greatest(0, place - 190) + 1, place + 190 - greatest(0, place - 190)), '\s+', ' ', 'g')) AS q FROM pos),
fact AS (SELECT DISTINCT document_id, chunk_id, rule, (['email', 'network', 'licence'])[rule + 1] AS kind, CASE rule WHEN 0 THEN 'address' WHEN 1 THEN 'ip' ELSE CASE WHEN regexp_matches(q, '(?i)apache') THEN 'apache' WHEN regexp_matches(q, '(?i)\bmit\b') THEN 'mit' WHEN regexp_matches(q, '(?i)gnu') THEN 'gpl' WHEN regexp_matches(q, '(?i)\bcc\b') THEN 'cc' ELSE 'notice' END END AS subtype, left(q, 120) AS q FROM ctx)
SELECT chunk_id, kind, subtype, count(*) AS facts, CASE WHEN rule = 0 THEN 0.95 WHEN rule = 1 OR subtype <> 'notice' THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence FROM fact GROUP BY ALL"""


@R.add("evidence_facts_generic", _CHUNKS + "," + _RULES, base=False)
def _(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"), "text")
    rows = facts.extract_facts(chunks.chunk_rows(docs).select("chunk_id", "document_id", "text", "chunk_hash"), facts.GENERIC_PACK)
    return rows.groupBy("chunk_id", "kind", "subtype").agg(F.count("*").alias("facts"), F.max("confidence").alias("confidence"))


@R.add(
    "fulltext_search",
    """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{N}_@.-]+'), lambda w: w <> '') AS w FROM documents),
c AS (SELECT doc_id, len(list_filter(w, lambda x: starts_with(x, 'licen'))) AS a, len(list_filter(w, lambda x: starts_with(x, 'apache'))) AS b FROM d),
n AS (SELECT count(*) AS n, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
SELECT doc_id, round(CASE WHEN a > 0 THEN ln(1 + a) * ln(1 + n / da) ELSE 0 END + CASE WHEN b > 0 THEN ln(1 + b) * ln(1 + n / db) ELSE 0 END, 6) AS score FROM c, n WHERE a > 0 OR b > 0
ORDER BY round(CASE WHEN a > 0 THEN ln(1 + a) * ln(1 + n / da) ELSE 0 END + CASE WHEN b > 0 THEN ln(1 + b) * ln(1 + n / db) ELSE 0 END, 9) DESC, doc_id LIMIT 20""",
    base=False,
)
def _(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search.fulltext(docs, "licen* apache", "doc_id", limit=20).select("doc_id", F.round("score", 6).alias("score"))


def kept_index(spark, name, rows, key):
    """The index of a table's texts: the first query that needs it builds it, once for a session; all others read it."""
    path = f"{scratch_dir(spark)}/index-{spark.sparkContext.applicationId}-{hashlib.md5(name.encode()).hexdigest()}"
    index = textindex.TextIndex(spark, path)
    if not index.segments():
        index.add(rows, key)
    return index


@R.add("fulltext_index_search", ORACLE_SQL["fulltext_search"], base=False)
def _(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = kept_index(spark, f"{sf_dir}/documents", docs, "doc_id").top("licen* apache", 20)
    return found.rows.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@R.add("fulltext_index_delta", ORACLE_SQL["fulltext_search"], base=False)
def _(spark, sf_dir):
    """An index of other texts for every third id and of ids that are gone, brought up to date by a delta segment and a removal."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    third = F.col("doc_id") % 3 == 0
    index = textindex.TextIndex(spark, scratch_path(spark, "index"))
    index.add(docs.withColumn("text", F.when(third, F.concat(F.lit("apache "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))).union(docs.where(third).select(-F.col("doc_id") - 1, "text")), "doc_id")
    index.add(docs.where(third), "doc_id")
    index.remove(docs.where(third).select((-F.col("doc_id") - 1).alias("doc_id")), "doc_id")
    return index.top("licen* apache", 20).rows.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


_NEURO, _SPINE = ("ther", "promo"), ("tion", "brand#2")


@R.add(
    "medical_evidence_score",
    """, chk AS (SELECT doc_id % n AS case_id, lower(coalesce(text, '')) AS t FROM documents, n), pool AS (SELECT case_id FROM cases WHERE contains(main_injury, 'promo') UNION SELECT case_id FROM injuries WHERE contains(normalized, 'promo')),
h AS (SELECT case_id, count(*) FILTER ((contains(t, 'ther') OR contains(t, 'promo')) AND (contains(t, 'tion') OR contains(t, 'brand#2'))) AS combined, count(*) FILTER (contains(t, 'ther') OR contains(t, 'promo')) AS neuro, count(*) FILTER (contains(t, 'tion') OR contains(t, 'brand#2')) AS spine FROM chk GROUP BY 1)
SELECT case_id, case_name, 8 + CASE WHEN EXISTS (SELECT 1 FROM body_parts b WHERE b.case_id = c.case_id AND contains(b.normalized, 'brand#2')) THEN 4 ELSE 0 END + 3 * least(coalesce(combined, 0), 5) + least(coalesce(neuro, 0), 5) + least(coalesce(spine, 0), 5) AS score,
  coalesce(combined, 0) AS combined, coalesce(neuro, 0) AS neuro, coalesce(spine, 0) AS spine FROM cases c JOIN pool USING (case_id) LEFT JOIN h USING (case_id) ORDER BY score DESC, case_name, case_id LIMIT 20""",
)
def _(p):
    rows = p.texts.select(F.col("doc_id").cast("string").alias("chunk_id"), "case_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("char_count", F.length("text"))
    index = kept_index(p.cases.sparkSession, f"{p.name}/chunks", rows.select("chunk_id", "text"), "chunk_id")
    return search.medical_evidence(p.cases, p.injuries, p.body_parts, rows, "promo", neurological=_NEURO, spine=_SPINE, index=index).drop("snippets")


@R.add("reach_from_log_only", "SELECT case_id, stage, min(occurred_at) AS reached_at FROM stage_events WHERE source = 'activity_log' GROUP BY 1, 2")
def _(p):
    from quillspark.operators.cohorts import reaches

    return reaches(p.stage_events.where("source = 'activity_log'"), p.cases).groupBy("case_id", "stage").agg(F.min("reached_at").alias("reached_at"))


@R.add(
    "search_document_evidence",
    """, cc AS (SELECT case_id, case_name FROM cases WHERE case_type = 'BUILDING'),
d AS (SELECT doc_id::VARCHAR AS id, case_id, case_name, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{N}_@.-]+'), lambda w: starts_with(w, 'licensed')) AS a, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{N}_@.-]+'), lambda w: starts_with(w, 'permanent')) AS b
  FROM (SELECT doc_id, doc_id % n AS case_id, text FROM documents, n) JOIN cc USING (case_id)),
f AS (SELECT fact_id AS id, case_id, case_name, CASE WHEN subtype = 'permanent' THEN 1 ELSE 0 END AS b FROM facts JOIN cc USING (case_id)),
hits AS (SELECT 'chunk' AS hit, id, case_id, case_name, CASE WHEN len(a) > 0 THEN ln(1 + len(a)) * ln(1 + (SELECT count(*) FROM d) / (SELECT count(*) FROM d WHERE len(a) > 0)) ELSE 0 END + CASE WHEN len(b) > 0 THEN ln(1 + len(b)) * ln(1 + (SELECT count(*) FROM d) / (SELECT count(*) FROM d WHERE len(b) > 0)) ELSE 0 END AS score FROM d WHERE len(a) > 0 OR len(b) > 0
  UNION ALL SELECT 'fact', id, case_id, case_name, ln(2) * ln(1 + (SELECT count(*) FROM f) / (SELECT count(*) FROM f WHERE b > 0)) FROM f WHERE b > 0),
top AS (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY round(score, 9) DESC, id) AS r FROM hits)
SELECT hit, id, case_id, round(score, 6) AS score FROM top WHERE r <= 12 ORDER BY round(top.score, 9) DESC, case_name, id LIMIT 12""",
)
def _(p):
    rows = p.texts.select(F.col("doc_id").cast("string").alias("chunk_id"), "case_id", "text")
    index = kept_index(p.cases.sparkSession, f"{p.name}/chunks", rows.select("chunk_id", "text"), "chunk_id")
    said = p.facts.select("fact_id", "case_id", "kind", "subtype", F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("quote"))
    return search.search_evidence(rows, said, p.cases, "licensed permanent", limit=12, index=index, case_type="BUILDING").select("hit", "id", "case_id", F.round("score", 6).alias("score"))
