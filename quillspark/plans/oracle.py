"""Oracle SQL (DuckDB) of the portfolio's queries, written independently of the DataFrame plans."""

from __future__ import annotations

BASE = """
ids AS (SELECT DISTINCT user_id AS case_id FROM events),
n AS (SELECT count(*) AS n FROM ids),
ord AS (SELECT o.*, o.o_custkey AS case_id FROM orders o JOIN ids ON o_custkey = case_id),
lin AS (SELECT l.*, ord.case_id FROM lineitem l JOIN ord ON l_orderkey = o_orderkey),
prt AS (SELECT * FROM lin JOIN part ON l_partkey = p_partkey),
sup AS (SELECT * FROM lin JOIN supplier ON l_suppkey = s_suppkey),
injuries AS (SELECT case_id, lower(p_type) AS normalized, p_type AS name, CASE WHEN bool_or(l_returnflag = 'R') THEN 'current' ELSE 'initial' END AS status FROM prt GROUP BY case_id, p_type),
body_parts AS (SELECT DISTINCT case_id, lower(p_brand) AS normalized, p_brand AS name FROM prt),
insurers AS (SELECT DISTINCT case_id, lower(n_name) AS normalized, n_name AS name FROM sup JOIN nation ON s_nationkey = n_nationkey),
experts AS (SELECT DISTINCT case_id, lower(s_name) AS key, s_name AS name, CASE l_returnflag WHEN 'A' THEN 'ours' ELSE 'court' END AS side FROM sup WHERE l_returnflag IN ('A', 'R')),
contacts AS (SELECT s_suppkey AS contact_id, s_name AS name, 'contact ' || (s_suppkey % 40) AS normalized_name, (['insurer', 'lawyer', 'client'])[s_suppkey % 3 + 1] AS contact_type, s_suppkey % 2 = 0 AS has_phone, s_acctbal > 0 AS has_email FROM supplier),
case_contacts AS (SELECT DISTINCT case_id, l_suppkey AS contact_id FROM sup),
po AS (SELECT case_id, min(o_orderdate) AS event_date, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, list(DISTINCT o_orderpriority) AS used FROM ord GROUP BY 1),
lat AS (SELECT user_id AS case_id, arg_max(event_type, (ts, event_id)) AS legal_stage, max(ts) AS stage_entered_at FROM events GROUP BY 1),
cases AS (SELECT c_custkey AS case_id, c_name AS case_name, 'N-' || lpad(c_custkey::VARCHAR, 6, '0') AS case_number, c_mktsegment AS case_type, legal_stage, stage_entered_at, r_name AS phase, status, c_acctbal > 0 AS is_signed,
  (c_custkey % 101) / 100.0::DOUBLE AS completion_rate, list_sort(list_filter(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], lambda x: NOT list_contains(coalesce(used, []), x))) AS missing_critical,
  event_date, event_date + INTERVAL 30 DAY AS created_at, CASE WHEN c_acctbal > 0 THEN event_date + INTERVAL 40 DAY END AS signed_at,
  floor(date_diff('day', event_date::DATE, DATE '2002-01-01') / 30)::BIGINT AS months_since_event, c_custkey % 4 = 0 AS is_overdue,
  (SELECT min(normalized) FROM injuries i WHERE i.case_id = c_custkey) AS main_injury, c_custkey % 60 + 18 AS client_age, c_custkey % 3 = 0 AS work_accident
  FROM customer JOIN ids ON c_custkey = ids.case_id LEFT JOIN po ON po.case_id = c_custkey LEFT JOIN lat ON lat.case_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
docs AS (SELECT o_orderkey AS document_id, case_id, o_orderpriority AS category, o_orderstatus AS type, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS document_date, o_orderdate + INTERVAL 2 DAY AS uploaded_at, 'doc-' || o_orderkey AS file_name FROM ord),
comms AS (SELECT conv_id * 1000 + turn AS comm_id, conv_id % n AS case_id, CASE role WHEN 'user' THEN 'incoming' WHEN 'assistant' THEN 'outgoing' ELSE 'internal' END AS direction, role AS sender_type,
  TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS sent_at, left(coalesce(text, ''), 500) AS preview FROM conversations, n),
acts AS (SELECT event_id, user_id AS case_id, event_type AS category, ts AS happened, value FROM events),
stage_events AS (SELECT event_id, case_id, CASE WHEN value >= 100 THEN category || '_high' ELSE category END AS stage, CASE WHEN event_id % 7 = 0 THEN 'review' END AS sub_stage, happened AS occurred_at, CASE WHEN event_id % 4 = 0 THEN 'activity_log' ELSE 'current_stage_snapshot' END AS source FROM acts),
valuations AS (SELECT case_id || ':valuation:' || o_orderstatus AS valuation_id, case_id, min(o_totalprice) AS compensation_min, max(o_totalprice) AS compensation_max, CASE WHEN count(*) > 1 THEN round(sum(o_totalprice), 2) ELSE max(o_totalprice) END AS total_estimate,
  CASE o_orderstatus WHEN 'O' THEN 'current' ELSE 'draft' END AS status, max(o_orderdate) AS analysis_date FROM ord GROUP BY case_id, o_orderstatus),
facts AS (SELECT l_orderkey || ':' || l_linenumber AS fact_id, case_id, l_orderkey AS document_id, CASE l_returnflag WHEN 'A' THEN 'disability_period' WHEN 'R' THEN 'income_evidence' ELSE 'nii_decision' END AS kind,
  CASE l_linestatus WHEN 'O' THEN 'permanent' ELSE 'temporary' END AS subtype, CASE WHEN l_returnflag = 'A' THEN l_quantity END AS numeric_value, l_shipdate AS observed_date, round(1 - l_tax, 2) AS confidence FROM lin WHERE l_discount >= 0.05),
at_case AS (SELECT case_id, coalesce(created_at, event_date) AS t FROM cases),
obs AS (
  SELECT case_id, 'documentCategory:' || category AS signal_key, category AS label, 'documentCategory' AS kind, coalesce(document_date, uploaded_at) AS observed_at, 'document' AS source_kind, document_id::VARCHAR AS source_id FROM docs
  UNION ALL SELECT case_id, 'documentType:' || type, type, 'documentType', coalesce(document_date, uploaded_at), 'document', document_id::VARCHAR FROM docs
  UNION ALL SELECT case_id, 'communicationDirection:' || direction, direction, 'communicationDirection', sent_at, 'communication', comm_id::VARCHAR FROM comms
  UNION ALL SELECT case_id, 'communicationParty:from:' || sender_type, 'from:' || sender_type, 'communicationParty', sent_at, 'communication', comm_id::VARCHAR FROM comms WHERE sender_type IS NOT NULL
  UNION ALL SELECT case_id, 'activity:' || c, c, 'activity', happened, 'activity', source_id FROM (SELECT case_id, category AS c, happened, event_id::VARCHAR AS source_id FROM acts UNION SELECT case_id, 'stage:' || stage, occurred_at, NULL FROM stage_events)
  UNION ALL SELECT case_id, 'caseType:' || case_type, case_type, 'caseType', coalesce(created_at, event_date), 'case', NULL FROM cases
  UNION ALL SELECT case_id, 'injury:' || normalized, normalized, 'injury', t, 'case', NULL FROM injuries JOIN at_case USING (case_id)
  UNION ALL SELECT case_id, 'bodyPart:' || normalized, normalized, 'bodyPart', t, 'case', NULL FROM body_parts JOIN at_case USING (case_id)
  UNION ALL SELECT case_id, 'insurer:' || normalized, normalized, 'insurer', t, 'case', NULL FROM insurers JOIN at_case USING (case_id)
  UNION ALL SELECT DISTINCT case_id, 'contactRole:' || contact_type, contact_type, 'contactRole', t, 'case', NULL FROM case_contacts JOIN contacts USING (contact_id) JOIN at_case USING (case_id)
  UNION ALL SELECT case_id, 'evidenceFactKind:' || kind, kind, 'evidenceFactKind', observed_date, 'fact', fact_id FROM facts
  UNION ALL SELECT case_id, 'evidenceFactSubtype:' || kind || ':' || subtype, kind || ':' || subtype, 'evidenceFactSubtype', observed_date, 'fact', fact_id FROM facts),
sig AS (SELECT case_id, signal_key, min(observed_at) AS first_observed, max(observed_at) AS last_observed, count(*) AS observations, list_sort(list(DISTINCT source_kind)) AS source_kinds FROM obs GROUP BY 1, 2),
reach AS (SELECT case_id, stage, coalesce(sub_stage, '') AS sub_stage, min((occurred_at, source)) AS e FROM stage_events GROUP BY 1, 2, 3),
reaches AS (SELECT r.case_id, stage, sub_stage, e[1] AS reached_at, e[2] AS source, case_type, event_date FROM reach r JOIN cases USING (case_id)),
scoped AS (SELECT *, 'global' AS scope, 'all' AS scope_type FROM reaches UNION ALL SELECT *, 'caseType', case_type FROM reaches WHERE case_type IS NOT NULL),
sizes AS (SELECT scope, scope_type, stage, sub_stage, count(*) AS n FROM scoped GROUP BY ALL HAVING count(*) >= 5),
mem AS (SELECT concat_ws('|', scope, stage, sub_stage, scope_type) AS cohort_key, s.*, n FROM scoped s JOIN sizes USING (scope, scope_type, stage, sub_stage)),
universe AS (SELECT case_id, 'global' AS scope, 'all' AS scope_type FROM cases UNION ALL SELECT case_id, 'caseType', case_type FROM cases),
usize AS (SELECT scope, scope_type, count(*) AS un FROM universe GROUP BY ALL),
mh AS (SELECT cohort_key, scope, scope_type, stage, sub_stage, n, signal_key, count(*) AS mh, median(CASE WHEN first_observed < reached_at THEN floor((epoch_us(reached_at) - epoch_us(first_observed)) / 86400000000.0) END) AS lead
  FROM mem JOIN sig USING (case_id) WHERE first_observed < reached_at AND signal_key NOT LIKE 'caseType:%' GROUP BY ALL),
ch AS (SELECT z.cohort_key, signal_key, count(*) AS ch FROM (SELECT DISTINCT cohort_key, scope, scope_type FROM mem) z JOIN universe u USING (scope, scope_type) JOIN sig s ON s.case_id = u.case_id
  WHERE first_observed IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mem m WHERE m.cohort_key = z.cohort_key AND m.case_id = u.case_id) GROUP BY ALL),
rated AS (SELECT mh.*, mh / n AS support, (mh / n) / CASE WHEN un - n > 0 THEN greatest(coalesce(ch, 0) / (un - n), 0.01) ELSE 0.01 END AS lift FROM mh JOIN usize USING (scope, scope_type) LEFT JOIN ch USING (cohort_key, signal_key)),
common AS (SELECT * FROM (SELECT cohort_key, scope, scope_type, stage, sub_stage, signal_key, support, lift, support * ln(1 + lift) AS weight, lead AS median_lead_days,
  row_number() OVER (PARTITION BY cohort_key ORDER BY round(support * ln(1 + lift), 9) DESC, signal_key) AS position FROM rated WHERE support >= 0.6 AND lift >= 1.5) WHERE position <= 12),
timed AS (SELECT *, floor((epoch_us(reached_at) - epoch_us(event_date)) / 86400000000.0) AS days FROM scoped),
coh AS (SELECT concat_ws('|', scope, stage, sub_stage, scope_type) AS cohort_key, scope, scope_type, stage, sub_stage, count(*) AS members, count(*) FILTER (source = 'activity_log') AS logged,
  count(*) FILTER (source = 'activity_log' AND days >= 0) AS timed, quantile_cont(days, 0.5) FILTER (source = 'activity_log' AND days >= 0) AS q2, quantile_cont(days, 0.25) FILTER (source = 'activity_log' AND days >= 0) AS q1, quantile_cont(days, 0.75) FILTER (source = 'activity_log' AND days >= 0) AS q3
  FROM timed GROUP BY ALL HAVING count(*) >= 5),
idf AS (SELECT signal_key, count(DISTINCT case_id) AS cases, ln((1 + (SELECT count(DISTINCT case_id) FROM sig)) / (1 + count(DISTINCT case_id))) + 1 AS weight FROM sig GROUP BY 1),
tot AS (SELECT case_id, sum(weight) AS t FROM sig JOIN idf USING (signal_key) GROUP BY 1),
ov AS (SELECT a.case_id AS case_a, b.case_id AS case_b, sum(weight) AS w FROM sig a JOIN sig b ON a.signal_key = b.signal_key AND a.case_id < b.case_id JOIN idf ON idf.signal_key = a.signal_key GROUP BY 1, 2),
emb AS (SELECT vec_id AS case_id, embedding::DOUBLE[] AS e FROM embeddings),
blend AS (SELECT case_a, case_b, w / (ta.t + tb.t - w) AS signal_score, list_cosine_similarity(ea.e, eb.e) AS semantic_score FROM ov JOIN tot ta ON ta.case_id = case_a JOIN tot tb ON tb.case_id = case_b LEFT JOIN emb ea ON ea.case_id = case_a LEFT JOIN emb eb ON eb.case_id = case_b),
pairs AS (SELECT *, CASE WHEN semantic_score IS NULL THEN signal_score ELSE 0.55 * signal_score + 0.45 * semantic_score END AS combined_score FROM blend WHERE CASE WHEN semantic_score IS NULL THEN signal_score ELSE 0.55 * signal_score + 0.45 * semantic_score END >= 0.18),
sp AS (SELECT case_a, case_b, signal_score FROM blend WHERE signal_score >= 0.18),
ends AS (SELECT case_a AS c, case_b AS o, * FROM pairs UNION ALL SELECT case_b, case_a, * FROM pairs),
best AS (SELECT DISTINCT case_a, case_b FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY round(combined_score, 9) DESC, o) AS r FROM ends) WHERE r <= 8),
sim AS (SELECT pairs.* FROM pairs JOIN best USING (case_a, case_b)),
near AS (SELECT case_a AS case_id, case_b AS other_id, combined_score FROM sim UNION ALL SELECT case_b, case_a, combined_score FROM sim)
"""


def with_base(sql: str) -> str:
    sql = sql.strip()
    return f"WITH {BASE.strip()}{sql}" if sql.startswith(",") else f"WITH {BASE.strip()}\n{sql}"
