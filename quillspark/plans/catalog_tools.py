"""Queries of the tool catalogue: lookups, portfolio aggregates, search, readiness, comparables, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.stats import exact_quantiles
from quillspark.operators import audit, comparables, lookup, portfolio, readiness, signals
from quillspark.operators.portfolio import CaseFilter
from quillspark.sources.scratch import materialize

from .adapter import AS_OF
from .catalog_analytics import kept_cohorts, kept_common, kept_signals, near, near_pairs, r6, reach, sought
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
#: Parameters of the registered queries.
CASE, STAGE = 7, "purchase"


# ---------------------------------------------------------------- portfolio

_DIM = {
    "legalStage": "SELECT legal_stage AS label, case_id AS k FROM cases WHERE legal_stage IS NOT NULL",
    "caseType": "SELECT case_type AS label, case_id AS k FROM cases WHERE case_type IS NOT NULL",
    "phase": "SELECT phase AS label, case_id AS k FROM cases WHERE phase IS NOT NULL",
    "status": "SELECT status AS label, case_id AS k FROM cases WHERE status IS NOT NULL",
    "insurer": "SELECT name AS label, case_id AS k FROM insurers",
    "injury": "SELECT name AS label, case_id AS k FROM injuries",
    "bodyPart": "SELECT name AS label, case_id AS k FROM body_parts",
    "missingCritical": "SELECT unnest(missing_critical) AS label, case_id AS k FROM cases",
    "documentCategory": "SELECT DISTINCT category AS label, case_id AS k FROM docs",
    "contactType": "SELECT contact_type AS label, contact_id AS k FROM contacts WHERE contact_id IN (SELECT contact_id FROM case_contacts)",
    "expertSide": "SELECT side AS label, case_id AS k FROM experts",
}
for _name, _sql in _DIM.items():
    _part = "true" if portfolio.DIMENSIONS[_name] else "false"
    R.add(
        f"portfolio_{_name}",
        f""", m AS ({_sql}), b AS (SELECT label, count(DISTINCT k) AS cases, count(*) AS n FROM m GROUP BY 1)
SELECT label, cases, (SELECT sum(n)::BIGINT FROM b) AS memberships, (SELECT count(*) FROM b) AS buckets, (SELECT count(*) FROM b) > 25 AS truncated, {_part} AS partitioning FROM b ORDER BY cases DESC, label LIMIT 25""",
    )((lambda d: lambda p: portfolio.aggregate(p, d))(_name))


@R.add(
    "portfolio_contacts",
    """SELECT normalized_name, contact_type, count(DISTINCT case_id) AS cases, bool_or(has_phone) AS has_phone, bool_or(has_email) AS has_email, array_to_string(list_sort(list(DISTINCT contact_id)), ',') AS contact_ids
FROM contacts JOIN case_contacts USING (contact_id) GROUP BY 1, 2 HAVING count(DISTINCT case_id) >= 2 ORDER BY cases DESC, normalized_name, contact_type LIMIT 25""",
)
def _(p):
    return portfolio.list_contacts(p, shared_only=True)


@R.add(
    "portfolio_experts",
    """SELECT key, min(name) AS name, count(DISTINCT case_id) FILTER (side = 'ours') AS our_cases, count(DISTINCT case_id) FILTER (side = 'court') AS court_cases,
  array_to_string(coalesce(list_sort(list(DISTINCT case_id) FILTER (side = 'ours')), []) || coalesce(list_sort(list(DISTINCT case_id) FILTER (side = 'court')), []), ',') AS case_ids
FROM experts GROUP BY key ORDER BY our_cases + court_cases DESC, key LIMIT 25""",
)
def _(p):
    return portfolio.list_experts(p)


_FILTER = CaseFilter(case_type="BUILDING", completion_min=0.05, months_to_limitation_max=60, injury="promo", has_category="2-high", insurer="nation_1", sort_by="months_since_event", limit=15)
_WHERE = """case_type = 'BUILDING' AND completion_rate >= 0.05 AND 84 - months_since_event BETWEEN 0 AND 60 AND case_id IN (SELECT case_id FROM injuries WHERE normalized = 'promo')
  AND case_id IN (SELECT case_id FROM docs WHERE lower(category) = '2-high') AND case_id IN (SELECT case_id FROM insurers WHERE contains(normalized, 'nation_1') OR contains(lower(name), 'nation_1'))"""


@R.add(
    "search_cases_filtered",
    f"""SELECT case_id, case_name, case_type, months_since_event, 84 - months_since_event AS months_to_limitation, len(missing_critical) AS missing_count, (SELECT count(*) FROM docs d WHERE d.case_id = c.case_id) AS documents,
  (SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM injuries i WHERE i.case_id = c.case_id) AS injuries FROM cases c WHERE {_WHERE} ORDER BY coalesce(months_since_event, 9999), case_name, case_id LIMIT 15""",
)
def _(p):
    rows = portfolio.search_cases(p, _FILTER)
    return rows.select("case_id", "case_name", "case_type", "months_since_event", "months_to_limitation", F.col("missing_count").cast("long"), "documents", F.array_join("injuries", ",").alias("injuries"))


@R.add("search_cases_count", f"SELECT count(*) AS matches FROM cases WHERE {_WHERE}")
def _(p):
    return portfolio.filter_cases(p, _FILTER).agg(F.count("*").alias("matches"))


@R.add("vocabulary", "SELECT 'case_type' AS field, case_type AS value FROM cases WHERE case_type IS NOT NULL UNION SELECT 'legal_stage', legal_stage FROM cases WHERE legal_stage IS NOT NULL UNION SELECT 'phase', phase FROM cases WHERE phase IS NOT NULL UNION SELECT 'status', status FROM cases WHERE status IS NOT NULL")
def _(p):
    return portfolio.vocabulary(p.cases)


_TRANS = f"""tr AS (SELECT c.case_id, case_name, coalesce(r.t, CASE WHEN legal_stage = '{STAGE}' THEN stage_entered_at END) AS at_stage, coalesce(r.src, 'current_stage_snapshot') AS source, event_date
  FROM cases c LEFT JOIN (SELECT case_id, min(reached_at) AS t, arg_min(source, (reached_at, source)) AS src FROM reaches WHERE stage = '{STAGE}' GROUP BY 1) r USING (case_id))"""


@R.add("rank_stage_transition", f", {_TRANS} SELECT case_id, case_name, at_stage, date_sub('day', event_date, at_stage) AS days, source FROM tr WHERE at_stage IS NOT NULL AND date_sub('day', event_date, at_stage) >= 0 ORDER BY days, case_name, case_id LIMIT 10")
def _(p):
    return portfolio.rank_stage_transitions(reach(p), p.cases, STAGE)


@R.add(
    "benchmark_against_stage",
    f""", {_TRANS}, pe AS (SELECT c.completion_rate, date_sub('day', c.event_date, coalesce(t.at_stage, c.stage_entered_at)) / 30.0::DOUBLE AS months, coalesce((SELECT count(DISTINCT category) FROM docs d WHERE d.case_id = c.case_id), 0)::DOUBLE AS categories
  FROM cases c JOIN tr t USING (case_id) WHERE at_stage IS NOT NULL)
SELECT count(*) AS peers, """
    + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {c}_{n}" for c in ("completion_rate", "months", "categories") for n, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)))
    + " FROM pe",
)
def _(p):
    b = portfolio.stage_benchmark(p, reach(p), STAGE)
    return b.select("peers", *r6(*b.columns[1:]))


# ---------------------------------------------------------------- lookups


@R.add("find_case_tokens", "SELECT case_id, case_name, case_number, CASE WHEN contains(lower(case_number), '000007') THEN 1 WHEN starts_with(lower(case_name), 'customer 000007') THEN 2 ELSE 3 END AS rank, CASE WHEN contains(lower(case_number), '000007') THEN 'number' ELSE 'tokens' END AS reason FROM cases WHERE contains(lower(case_number), '000007') OR (contains(lower(case_name || ' ' || case_number), 'customer') AND contains(lower(case_name || ' ' || case_number), '000007')) ORDER BY rank, case_name, case_id LIMIT 5")
def _(p):
    return lookup.find_case(p.cases, "customer 000007")


@R.add(
    "case_overview",
    """SELECT case_id, case_name, case_type, legal_stage, phase, status, (SELECT arg_min(name, contact_id) FROM contacts JOIN case_contacts k USING (contact_id) WHERE k.case_id = c.case_id AND contact_type = 'client') AS client_name,
  (SELECT count(*) FROM docs d WHERE d.case_id = c.case_id) AS documents, (SELECT count(*) FROM comms m WHERE m.case_id = c.case_id) AS communications, (SELECT count(*) FROM case_contacts k WHERE k.case_id = c.case_id) AS contacts,
  (SELECT count(DISTINCT key) FROM experts e WHERE e.case_id = c.case_id AND side = 'ours') AS our_experts, (SELECT count(DISTINCT key) FROM experts e WHERE e.case_id = c.case_id AND side = 'court') AS court_experts,
  84 - months_since_event AS months_to_limitation, coalesce(84 - months_since_event BETWEEN -12 AND 12, false) AS limitation_near FROM cases c""",
)
def _(p):
    return lookup.overview(p)


@R.add("case_evidence_by_category", "SELECT case_id, category, count(DISTINCT document_id) AS documents, array_to_string(list_slice(list_sort(list(DISTINCT file_name)), 1, 3), ',') AS examples FROM docs GROUP BY 1, 2")
def _(p):
    return lookup.evidence_by_category(p).withColumn("examples", F.array_join("examples", ","))


@R.add("case_documents", f"SELECT * FROM docs WHERE case_id = {CASE} ORDER BY document_date DESC NULLS FIRST, uploaded_at DESC NULLS FIRST, document_id LIMIT 20")
def _(p):
    return lookup.documents_of(sought(p), CASE)


@R.add("case_communications", f"SELECT comm_id, case_id, direction, sender_type, sent_at, CASE WHEN length(preview) > 300 THEN left(preview, 300) || '…' ELSE preview END AS preview FROM comms WHERE case_id = {CASE} AND sender_type = 'user' ORDER BY sent_at DESC, comm_id LIMIT 10")
def _(p):
    return lookup.communications_of(sought(p), CASE, sender_type="user")


@R.add("case_card", f"SELECT case_id, case_name, legal_stage, (SELECT count(*) FROM docs d WHERE d.case_id = c.case_id) AS documents, (SELECT string_agg(name || ':' || status, ',' ORDER BY name || ':' || status) FROM injuries i WHERE i.case_id = c.case_id) AS injuries FROM cases c WHERE case_id = {CASE}")
def _(p):
    """Overview and injuries of one case, by seeks."""
    own = lookup.of_case(sought(p), CASE)
    card = lookup.overview(own).select("case_id", "case_name", "legal_stage", "documents")
    return card.join(lookup.injury_profile(own).select("case_id", F.array_join("injuries", ",").alias("injuries")), "case_id")


@R.add("case_document_facts", f"SELECT f.fact_id, f.kind, f.subtype, f.numeric_value, f.confidence, file_name, category FROM facts f JOIN docs d USING (document_id) WHERE f.case_id = {CASE} AND kind IN ('disability_period', 'income_evidence') ORDER BY kind, confidence DESC, observed_date DESC, fact_id LIMIT 40")
def _(p):
    return lookup.facts_of(sought(p), CASE, ("disability_period", "income_evidence")).select("fact_id", "kind", "subtype", "numeric_value", "confidence", "file_name", "category")


@R.add("case_injury_profile", "SELECT case_id, (SELECT string_agg(name || ':' || status, ',' ORDER BY name || ':' || status) FROM injuries i WHERE i.case_id = c.case_id) AS injuries, (SELECT string_agg(name, ',' ORDER BY name) FROM body_parts b WHERE b.case_id = c.case_id) AS body_parts FROM cases c")
def _(p):
    return lookup.injury_profile(p).select("case_id", F.array_join("injuries", ",").alias("injuries"), F.array_join("body_parts", ",").alias("body_parts"))


@R.add("stage_timeline", "SELECT case_id, stage, t AS reached_at, floor((epoch_us(t) - epoch_us(event_date)) / 86400000000.0)::BIGINT AS days_from_event, row_number() OVER (PARTITION BY case_id ORDER BY t, stage)::INT AS position FROM (SELECT case_id, stage, min(reached_at) AS t, any_value(event_date) AS event_date FROM reaches GROUP BY 1, 2)")
def _(p):
    return lookup.stage_timeline(reach(p))


@R.add("readiness_metadata", "SELECT case_id, completion_rate, (SELECT floor((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(max(sent_at))) / 86400000000.0)::DOUBLE FROM comms m WHERE m.case_id = c.case_id) AS days_since_communication, (SELECT string_agg(DISTINCT category, ',' ORDER BY category) FROM docs d WHERE d.case_id = c.case_id) AS categories FROM cases c")
def _(p):
    return lookup.readiness_metadata(p, AS_OF).withColumn("categories", F.array_join("categories", ",")).withColumn("days_since_communication", F.col("days_since_communication").cast("double"))


@R.add("same_stage_leaders", f"SELECT case_id, case_name, completion_rate, months_since_event FROM cases WHERE case_id <> {CASE} AND legal_stage = (SELECT legal_stage FROM cases WHERE case_id = {CASE}) ORDER BY completion_rate DESC, coalesce(months_since_event, 9999), case_id LIMIT 5")
def _(p):
    return lookup.same_stage_leaders(p, CASE).select("case_id", "case_name", "completion_rate", "months_since_event")


@R.add("case_graph_context", "SELECT case_id, kind, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT *, row_number() OVER (PARTITION BY case_id, kind ORDER BY label) AS r FROM (SELECT DISTINCT case_id, kind, label FROM obs)) WHERE r <= 6 GROUP BY 1, 2")
def _(p):
    return lookup.graph_context(p, signals.observations(p)).withColumn("labels", F.array_join("labels", ","))


# ---------------------------------------------------------------- similarity tools


@R.add("similar_cases_for_seed", f"SELECT other_id, case_name, round(combined_score, 6) AS combined_score FROM near JOIN cases c ON c.case_id = other_id WHERE near.case_id = {CASE} AND EXISTS (SELECT 1 FROM reaches r WHERE r.case_id = other_id AND stage = '{STAGE}') ORDER BY round(near.combined_score, 9) DESC, case_name LIMIT 5")
def _(p):
    own = near(p, CASE).select("other_id", "combined_score")
    there = reach(p).where(F.col("stage") == STAGE).select(F.col("case_id").alias("other_id")).distinct()
    names = p.cases.select(F.col("case_id").alias("other_id"), "case_name")
    return own.join(there, "other_id", "left_semi").join(names, "other_id").orderBy(F.desc(F.round("combined_score", 9)), "case_name").limit(5).select("other_id", "case_name", *r6("combined_score"))


@R.add("most_similar_pairs", "SELECT case_a, case_b, round(combined_score, 6) AS combined_score FROM sim JOIN cases a ON a.case_id = case_a JOIN cases b ON b.case_id = case_b WHERE a.case_type = b.case_type ORDER BY round(combined_score, 9) DESC, a.case_name, b.case_name LIMIT 10")
def _(p):
    side = lambda x: p.cases.select(F.col("case_id").alias(f"case_{x}"), F.col("case_type").alias(f"type_{x}"), F.col("case_name").alias(f"name_{x}"))
    rows = near_pairs(p).join(side("a"), "case_a").join(side("b"), "case_b").where("type_a = type_b")
    return rows.orderBy(F.desc(F.round("combined_score", 9)), "name_a", "name_b").limit(10).select("case_a", "case_b", *r6("combined_score"))


_FACTSEED = f"""seed AS (SELECT * FROM cases WHERE case_id = {CASE}),
sf AS (SELECT * FROM facts WHERE kind = 'disability_period'),
cv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY (status = 'current') DESC, analysis_date DESC NULLS FIRST, valuation_id) AS r FROM valuations) WHERE r = 1),
sc AS (SELECT c.case_id, c.case_name, c.case_type, c.legal_stage, coalesce((SELECT combined_score FROM near n WHERE n.case_id = {CASE} AND n.other_id = c.case_id), 0)
  + CASE WHEN c.case_type = s.case_type THEN 2 ELSE 0 END + CASE WHEN c.work_accident = s.work_accident THEN 2 ELSE 0 END + CASE WHEN abs(c.client_age - s.client_age) <= 10 THEN 1 ELSE 0 END
  + CASE WHEN EXISTS (SELECT 1 FROM injuries i JOIN injuries j ON i.normalized = j.normalized WHERE i.case_id = c.case_id AND j.case_id = {CASE}) THEN 1.5 ELSE 0 END
  + CASE WHEN EXISTS (SELECT 1 FROM body_parts i JOIN body_parts j ON i.normalized = j.normalized WHERE i.case_id = c.case_id AND j.case_id = {CASE}) THEN 1 ELSE 0 END
  + CASE WHEN EXISTS (SELECT 1 FROM sf i JOIN sf j ON abs(i.numeric_value - j.numeric_value) <= 5 OR (i.subtype = 'permanent' AND j.subtype = 'permanent') WHERE i.case_id = c.case_id AND j.case_id = {CASE}) THEN 2 ELSE 0 END
  + CASE WHEN c.legal_stage = s.legal_stage THEN 0.75 ELSE 0 END AS m FROM cases c, seed s WHERE c.case_id <> {CASE}),
comp AS (SELECT sc.*, valuation_id, compensation_min, compensation_max, m + CASE WHEN valuation_id IS NOT NULL THEN 0.5 ELSE 0 END AS score FROM sc LEFT JOIN cv USING (case_id) WHERE m > 0 ORDER BY round(m + CASE WHEN valuation_id IS NOT NULL THEN 0.5 ELSE 0 END, 9) DESC, case_name, case_id LIMIT 10)"""


def _comparables(p):
    return comparables.comparable_cases(p, comparables.ComparableFilter(case_id=CASE), near(p, CASE))


@R.add("comparable_cases", f", {_FACTSEED} SELECT case_id, case_name, case_type, legal_stage, round(score::DOUBLE, 6) AS score, CASE WHEN score >= 5 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS confidence, valuation_id FROM comp")
def _(p):
    return _comparables(p).select("case_id", "case_name", "case_type", "legal_stage", *r6("score"), "confidence", "valuation_id")


@R.add("comparable_cases_filtered", """, cv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY (status = 'current') DESC, analysis_date DESC NULLS FIRST, valuation_id) AS r FROM valuations) WHERE r = 1)
SELECT case_id, case_type, (2 + 1 + 1.5 + 2 + CASE WHEN valuation_id IS NOT NULL THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM cases LEFT JOIN cv USING (case_id) WHERE case_type = 'MACHINERY' AND client_age BETWEEN 20 AND 60
AND case_id IN (SELECT case_id FROM injuries WHERE normalized = 'economy') AND case_id IN (SELECT case_id FROM facts WHERE kind = 'disability_period' AND numeric_value >= 30) ORDER BY score DESC, case_name, case_id LIMIT 10""")
def _(p):
    f = comparables.ComparableFilter(case_type="MACHINERY", age_min=20, age_max=60, injury="ECONOMY", disability_min=30)
    return comparables.comparable_cases(p, f).select("case_id", "case_type", "score")


@R.add("case_value_context", f", {_FACTSEED} SELECT count(DISTINCT case_id) AS comparables, min(v) AS low, round(median(v), 6) AS median, max(v) AS high FROM (SELECT case_id, unnest([compensation_min, compensation_max]) AS v FROM comp WHERE valuation_id IS NOT NULL)")
def _(p):
    return comparables.value_range(_comparables(p)).select("comparables", "low", *r6("median"), "high")


@R.add("valuation_components_unpivot", "SELECT case_id, kind, amount FROM (SELECT case_id, CASE l_returnflag WHEN 'A' THEN 'future_losses' WHEN 'N' THEN 'past_losses' ELSE 'pain_and_suffering' END AS kind, round(sum(l_extendedprice), 2) AS amount FROM lin GROUP BY ALL)")
def _(p):
    return comparables.components_long(p.components)


# ---------------------------------------------------------------- readiness


def _pattern(p, case_id=None):
    target = p.cases if case_id is None else p.cases.where(F.col("case_id") == case_id)
    return readiness.pattern(kept_cohorts(p), kept_common(p), target, STAGE), kept_signals(p)


_PAT = f"""app AS (SELECT * FROM (SELECT c.case_id, coh.*, row_number() OVER (PARTITION BY c.case_id ORDER BY (coh.scope = 'global')::INT) AS r FROM cases c JOIN coh ON coh.stage = '{STAGE}' AND coh.sub_stage = '' AND coh.scope_type IN ('all', c.case_type)) WHERE r = 1),
pat AS (SELECT a.case_id, a.cohort_key, a.members, k.signal_key, k.support, k.lift, k.weight FROM app a JOIN common k USING (cohort_key)),
cmp AS (SELECT p.*, first_observed, CASE WHEN first_observed IS NOT NULL THEN 'matched' WHEN split_part(signal_key, ':', 1) IN ('injury', 'bodyPart', 'insurer', 'contactRole') THEN 'context' ELSE 'missing' END AS status FROM pat p LEFT JOIN sig USING (case_id, signal_key))"""


@R.add(
    "derive_readiness_pattern",
    f""", {_PAT}, st AS (SELECT count(DISTINCT r.case_id) AS m FROM reaches r JOIN cases c ON c.case_id = {CASE} AND r.case_type = c.case_type WHERE stage = '{STAGE}' AND sub_stage = '')
SELECT pat.case_id, cohort_key, signal_key, round(support, 6) AS support, round(lift, 6) AS lift, round(weight, 6) AS weight, m AS same_type_members, starts_with(cohort_key, 'global') AND m BETWEEN 3 AND 4 AS thin_same_type FROM pat, st WHERE case_id = {CASE}""",
)
def _(p):
    rows = readiness.with_same_type(_pattern(p, CASE)[0], reach(p), p.cases, STAGE)
    return rows.select("case_id", "cohort_key", "signal_key", *r6("support", "lift", "weight"), "same_type_members", "thin_same_type")


@R.add(
    "selected_cohorts",
    f""", app AS (SELECT * FROM (SELECT c.case_id, c.case_type, coh.*, row_number() OVER (PARTITION BY c.case_id, stage, sub_stage ORDER BY (coh.scope = 'global')::INT) AS r FROM cases c JOIN coh ON coh.scope_type IN ('all', c.case_type)) WHERE r = 1),
st AS (SELECT case_type, stage, sub_stage, count(DISTINCT case_id) AS m FROM reaches GROUP BY ALL)
SELECT case_id, app.stage, app.sub_stage, cohort_key, members, coalesce(m, 0) AS same_type_members, scope = 'global' AND coalesce(m, 0) BETWEEN 3 AND 4 AS thin_same_type FROM app LEFT JOIN st ON st.case_type = app.case_type AND st.stage = app.stage AND st.sub_stage = app.sub_stage""",
)
def _(p):
    """The cohort of each case and stage, and how many of the case's own type stand behind a widened one."""
    r = reach(p)
    own = readiness.applicable_cohorts(kept_cohorts(p), p.cases)
    return readiness.with_same_type(own, r, p.cases).select("case_id", "stage", "sub_stage", "cohort_key", "members", "same_type_members", "thin_same_type")


@R.add("compare_case_to_pattern", f", {_PAT} SELECT case_id, cohort_key, signal_key, status FROM cmp")
def _(p):
    return readiness.compare(*_pattern(p)).select("case_id", "cohort_key", "signal_key", "status")


@R.add("pattern_coverage", f", {_PAT} SELECT case_id, cohort_key, round(coalesce(sum(weight) FILTER (status = 'matched'), 0) / sum(weight), 6) AS coverage, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'context') AS context FROM cmp GROUP BY 1, 2")
def _(p):
    return readiness.coverage(readiness.compare(*_pattern(p))).select("case_id", "cohort_key", *r6("coverage"), "matched", "missing", "context")


@R.add(
    "estimate_time_to_stage",
    f""", pe AS (SELECT c.case_id, r.case_id AS other_id, coalesce(combined_score, 0) AS s, r.source, date_sub('day', r.event_date, reached_at) AS days, floor((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(c.event_date)) / 86400000000.0) AS age
  FROM cases c JOIN reaches r ON stage = '{STAGE}' AND sub_stage = '' LEFT JOIN near n ON n.case_id = c.case_id AND n.other_id = r.case_id),
t8 AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(s, 9) DESC, other_id) AS r FROM pe),
tm AS (SELECT case_id, days - age AS rem, greatest(s, 0.05) AS w, s FROM t8 WHERE r <= 8 AND source = 'activity_log' AND days >= 0),
cu AS (SELECT *, sum(w) OVER (PARTITION BY case_id ORDER BY rem RANGE UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY case_id) AS tot FROM tm),
q AS (SELECT case_id, count(*) AS n, median(s) AS ms, min(rem) FILTER (run >= tot * 0.5) AS p50, min(rem) FILTER (run >= tot * 0.25) AS p25, min(rem) FILTER (run >= tot * 0.75) AS p75 FROM cu GROUP BY 1)
SELECT c.case_id, CASE WHEN coalesce(n, 0) < 3 THEN 'no_estimate' WHEN p50 < 0 THEN 'behind' ELSE 'future' END AS status, CASE WHEN n >= 3 THEN abs(p50)::DOUBLE END AS median_days,
  CASE WHEN n >= 3 THEN CASE WHEN p50 < 0 AND p25 < 0 THEN -p25 WHEN p50 >= 0 AND p25 >= 0 THEN p25 END END::DOUBLE AS p25_days, CASE WHEN n >= 3 THEN CASE WHEN p50 < 0 AND p75 < 0 THEN -p75 WHEN p50 >= 0 AND p75 >= 0 THEN p75 END END::DOUBLE AS p75_days,
  coalesce(n, 0) AS timed_peers, CASE WHEN n >= 10 AND ms >= 0.375 THEN 'high' WHEN n >= 4 AND ms >= 0.225 THEN 'medium' ELSE 'low' END AS confidence FROM cases c LEFT JOIN q USING (case_id)""",
)
def _(p):
    target = p.cases.select("case_id", "event_date")
    out = readiness.estimate(reach(p), target, STAGE, near(p), AS_OF)
    return out.withColumns({c: F.col(c).cast("double") for c in ("median_days", "p25_days", "p75_days")})


@R.add(
    "estimate_time_sparse",
    f""", o AS (SELECT case_id AS other_id, date_sub('day', event_date, reached_at) AS days FROM reaches WHERE stage = '{STAGE}' AND sub_stage = '' AND event_date IS NOT NULL AND date_sub('day', event_date, reached_at) >= 0),
t8 AS (SELECT * FROM (SELECT c.case_id, days - floor((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(event_date)) / 86400000000.0) AS rem, row_number() OVER (PARTITION BY c.case_id ORDER BY days, other_id) AS r FROM cases c JOIN o ON other_id <> c.case_id) WHERE r <= 8),
cu AS (SELECT *, count(*) OVER (PARTITION BY case_id ORDER BY rem RANGE UNBOUNDED PRECEDING) AS run, count(*) OVER (PARTITION BY case_id) AS tot FROM t8)
SELECT case_id, min(rem) FILTER (run >= tot * 0.5)::BIGINT AS median_days, 'low' AS confidence FROM cu GROUP BY 1""",
)
def _(p):
    return readiness.sparse_estimate(reach(p), p.cases.select("case_id", "event_date"), STAGE, AS_OF).select("case_id", "median_days", "confidence")


@R.add(
    "matched_signal_evidence",
    f""", {_PAT}, ow AS (SELECT 'document' AS emitter, document_id::VARCHAR AS source_id, case_id, coalesce(document_date, uploaded_at) AS t FROM docs UNION ALL SELECT 'communication', comm_id::VARCHAR, case_id, sent_at FROM comms UNION ALL SELECT 'activity', event_id::VARCHAR, case_id, happened FROM acts),
e AS (SELECT DISTINCT source_kind AS emitter, source_id, signal_key FROM obs WHERE source_id IS NOT NULL AND source_kind <> 'fact')
SELECT case_id, signal_key, emitter, source_id FROM (SELECT cmp.case_id, signal_key, emitter, source_id, row_number() OVER (PARTITION BY cmp.case_id, signal_key, emitter ORDER BY t DESC NULLS FIRST, source_id) AS r
  FROM cmp JOIN e USING (signal_key) JOIN ow USING (emitter, source_id) WHERE ow.case_id = cmp.case_id AND status = 'matched' AND cmp.case_id = {CASE}) WHERE r <= 2""",
)
def _(p):
    pat, sig = _pattern(p, CASE)
    own = lambda df, emitter, key, at: df.select(F.lit(emitter).alias("emitter"), F.col(key).cast("string").alias("source_id"), "case_id", at.cast("timestamp_ntz").alias("at"))
    owners = own(p.documents, "document", "document_id", F.coalesce("document_date", "uploaded_at")).union(own(p.communications, "communication", "comm_id", F.col("sent_at"))).union(own(p.activities, "activity", "event_id", F.col("at")))
    return readiness.evidence_for(readiness.compare(pat, sig), signals.emissions(signals.observations(p)), owners).select("case_id", "signal_key", "emitter", "source_id")


@R.add("stage_position", f", {_TRANS}, d AS (SELECT case_id, date_sub('day', event_date, at_stage) AS days FROM tr WHERE at_stage IS NOT NULL) SELECT case_id, CASE WHEN days < (SELECT quantile_cont(days, 0.25) FROM d) THEN 'below' WHEN days > (SELECT quantile_cont(days, 0.75) FROM d) THEN 'above' ELSE 'within' END AS position FROM d")
def _(p):
    rows = materialize(portfolio.stage_transitions(reach(p), p.cases, STAGE).select("case_id", "days", F.lit(1).alias("one")), "transitions")
    q = exact_quantiles(rows, [], "days", p25=0.25, p75=0.75).withColumn("one", F.lit(1))
    return rows.join(F.broadcast(q), "one").select("case_id", portfolio.position(F.col("days"), F.col("p25"), F.col("p75")).alias("position"))


# ---------------------------------------------------------------- audit


@R.add("graph_node_counts", "SELECT 'cases' AS label, count(*) AS n FROM cases UNION ALL SELECT 'documents', count(*) FROM docs UNION ALL SELECT 'communications', count(*) FROM comms UNION ALL SELECT 'activities', count(*) FROM acts UNION ALL SELECT 'stage_events', count(*) FROM stage_events UNION ALL SELECT 'injuries', count(DISTINCT normalized) FROM injuries UNION ALL SELECT 'body_parts', count(DISTINCT normalized) FROM body_parts UNION ALL SELECT 'insurers', count(DISTINCT normalized) FROM insurers UNION ALL SELECT 'experts', count(DISTINCT key) FROM experts UNION ALL SELECT 'contacts', count(*) FROM contacts UNION ALL SELECT 'valuations', count(*) FROM valuations UNION ALL SELECT 'facts', count(*) FROM facts")
def _(p):
    return audit.node_counts(p)


@R.add("stage_source_distribution", "SELECT stage, source, count(*) AS events, count(DISTINCT case_id) AS cases FROM stage_events GROUP BY 1, 2")
def _(p):
    return audit.stage_sources(p)


@R.add("facts_by_kind", "SELECT kind, subtype, count(*) AS facts, count(DISTINCT case_id) AS cases, round(avg(confidence), 6) AS confidence FROM facts GROUP BY 1, 2")
def _(p):
    return audit.facts_by_kind(p)


@R.add("timing_funnel", "SELECT stage, count(*) AS reached, count(event_date) AS dated, count(*) FILTER (event_date IS NOT NULL AND source = 'activity_log') AS logged, count(*) FILTER (source = 'activity_log' AND date_sub('day', event_date, reached_at) >= 0) AS timed FROM reaches GROUP BY 1")
def _(p):
    return audit.timing_funnel(reach(p))


@R.add("staleness_top", "SELECT c.case_id, date_sub('day', max(happened), stage_entered_at) AS unused, date_sub('day', (SELECT max(sent_at) FROM comms m WHERE m.case_id = c.case_id), max(happened)) AS days_behind FROM cases c JOIN acts USING (case_id) GROUP BY c.case_id, stage_entered_at HAVING (SELECT max(sent_at) FROM comms m WHERE m.case_id = c.case_id) < max(happened) ORDER BY days_behind DESC, c.case_id LIMIT 10".replace("date_sub('day', max(happened), stage_entered_at) AS unused, ", ""))
def _(p):
    return audit.staleness(p.activities.select("case_id", F.col("at").alias("source_at")), p.communications.select("case_id", F.col("sent_at").alias("graph_at")))


@R.add("similarity_buckets", "SELECT CASE WHEN combined_score >= 0.7 THEN '0.7+' WHEN combined_score >= 0.5 THEN '0.5-0.7' WHEN combined_score >= 0.3 THEN '0.3-0.5' ELSE '<0.3' END AS bucket, count(*) AS pairs FROM sim GROUP BY 1")
def _(p):
    return audit.similarity_buckets(near_pairs(p))


@R.add("conversation_last_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3", base=False)
def _(spark, sf_dir):
    return audit.last_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), 3).select("conv_id", "turn", "role")
