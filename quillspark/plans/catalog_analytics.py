"""Queries over signals, cohorts and similarity."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from quillspark.functions.stats import exact_quantiles
from quillspark.operators import cohorts, edges, signals, similarity
from quillspark.sources import layout, sinks
from quillspark.sources.scratch import materialize, scratch_dir, scratch_path

from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def case_signals(p):
    return signals.rollup(signals.observations(p))


def reach(p):
    return cohorts.reaches(p.stage_events, p.cases)


def neighbours(p):
    """The similarity edges, compared anew."""
    return materialize(similarity.neighbours(materialize(case_signals(p), "signals"), p.embeddings), "neighbours")


def kept(p, name: str, build):
    """A derived table of these source tables (signals, cohorts, their common signals) that tools read: made by the first query that needs it, once for a session and its tables."""
    spark = p.cases.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{spark.sparkContext.applicationId}-{hashlib.md5(p.name.encode()).hexdigest()}"
    if sinks.manifest(spark, path) is None:
        sinks.replace_table(build(), path)
    return sinks.read_table(spark, path)


def sought(p):
    """The portfolio with its tables sorted by case, for lookups of single cases; laid out once for a session and its tables."""
    spark = p.cases.sparkSession
    return layout.laid_out(p, f"{scratch_dir(spark)}/sorted-{spark.sparkContext.applicationId}-{hashlib.md5(p.name.encode()).hexdigest()}")


def kept_signals(p):
    return kept(p, "signals", lambda: case_signals(p))


def kept_cohorts(p):
    return kept(p, "cohorts", lambda: cohorts.cohorts(reach(p)))


def kept_common(p):
    return kept(p, "common", lambda: cohorts.common_signals(reach(p), kept_signals(p), p.cases))


def published_path(p) -> str:
    """Where the edges of these tables lie: the first query that needs them publishes them, once for a session and its tables; all others read them."""
    spark = p.cases.sparkSession
    path = f"{scratch_dir(spark)}/similar-{spark.sparkContext.applicationId}-{hashlib.md5(p.name.encode()).hexdigest()}"
    if sinks.manifest(spark, f"{path}/stamps") is None:
        edges.publish(path, kept_signals(p), p.embeddings)
    return path


def near(p, case_id=None):
    """The published edges both ways, of all cases or of one, whose part alone is opened."""
    spark, path = p.cases.sparkSession, published_path(p)
    return edges.read(spark, path) if case_id is None else edges.read_case(spark, path, case_id)


def near_pairs(p):
    return edges.pairs(p.cases.sparkSession, published_path(p))


@R.add("cohort_common_signals", "SELECT cohort_key, scope, scope_type, stage, sub_stage, signal_key, round(support, 6) AS support, round(lift, 6) AS lift, round(weight, 6) AS weight, median_lead_days, position FROM common")
def _(p):
    return cohorts.common_signals(reach(p), case_signals(p), p.cases).select("cohort_key", *cohorts.KEYS, "signal_key", *r6("support", "lift", "weight"), "median_lead_days", F.col("position").cast("long"))


@R.add("cohort_reach", "SELECT case_id, stage, sub_stage, reached_at, source FROM reaches")
def _(p):
    return reach(p).select("case_id", "stage", "sub_stage", "reached_at", "source")


@R.add(
    "cohort_rows",
    """SELECT cohort_key, scope, scope_type, stage, sub_stage, members, logged, members - logged AS snapshots,
  CASE WHEN members >= 25 AND logged >= 25 THEN 'high' WHEN members >= 12 THEN 'medium' ELSE 'low' END AS confidence, timed,
  CASE WHEN timed >= 3 THEN q2 END AS median_days, CASE WHEN timed >= 3 THEN q1 END AS p25_days, CASE WHEN timed >= 3 THEN q3 END AS p75_days FROM coh""",
)
def _(p):
    return cohorts.cohorts(reach(p))


@R.add("cohort_members", "SELECT cohort_key, case_id, reached_at, source FROM mem")
def _(p):
    return cohorts.members(reach(p)).select("cohort_key", "case_id", "reached_at", "source")


@R.add("case_signal_rollup", "SELECT case_id, signal_key, first_observed, last_observed, observations, array_to_string(source_kinds, ',') AS source_kinds FROM sig")
def _(p):
    return case_signals(p).withColumn("source_kinds", F.array_join("source_kinds", ","))


@R.add("signal_dictionary", "SELECT signal_key, max(label) AS label, max(kind) AS kind FROM obs GROUP BY 1")
def _(p):
    return signals.dictionary(signals.observations(p))


@R.add("signal_emissions", "SELECT DISTINCT source_kind AS emitter, source_id, signal_key FROM obs WHERE source_id IS NOT NULL")
def _(p):
    return signals.emissions(signals.observations(p))


@R.add("idf_weights", "SELECT signal_key, cases, round(weight, 6) AS weight FROM idf")
def _(p):
    return similarity.idf(case_signals(p)).select("signal_key", "cases", *r6("weight"))


@R.add("similar_pairs_signal", "SELECT case_a, case_b, round(signal_score, 6) AS signal_score FROM sp")
def _(p):
    return similarity.similar_pairs(materialize(case_signals(p), "signals"), digits=6).select("case_a", "case_b", "signal_score")


@R.add("similar_pairs_blended", "SELECT case_a, case_b, round(signal_score, 6) AS signal_score, round(semantic_score, 6) AS semantic_score, round(combined_score, 6) AS combined_score FROM pairs")
def _(p):
    return similarity.similar_pairs(materialize(case_signals(p), "signals"), p.embeddings, digits=6).select("case_a", "case_b", *edges.SCORES)


@R.add("similar_top_k_either_side", "SELECT case_a, case_b, round(combined_score, 6) AS combined_score FROM sim")
def _(p):
    return neighbours(p).select("case_a", "case_b", *r6("combined_score"))


@R.add(
    "similarity_score_distribution",
    """SELECT count(*) AS pairs, round(min(combined_score), 6) AS lowest, round(max(combined_score), 6) AS highest, round(avg(combined_score), 6) AS mean,
  round(quantile_cont(combined_score, 0.5), 6) AS p50, round(quantile_cont(combined_score, 0.9), 6) AS p90, round(quantile_cont(combined_score, 0.99), 6) AS p99 FROM sim""",
)
def _(p):
    s = F.col("combined_score")
    q = [F.round(F.percentile(s, F.lit(x)), 6).alias(n) for n, x in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))]
    return near_pairs(p).agg(F.count("*").alias("pairs"), F.round(F.min(s), 6).alias("lowest"), F.round(F.max(s), 6).alias("highest"), F.round(F.avg(s), 6).alias("mean"), *q)


@R.add(
    "similarity_reasons",
    """SELECT case_a, case_b, array_to_string(list_slice(list(a.signal_key ORDER BY round(weight, 9) DESC, a.signal_key), 1, 3), ',') || CASE WHEN any_value(semantic_score) >= 0.7 THEN ',Semantic summary match' ELSE '' END AS reasons
  FROM sim JOIN sig a ON a.case_id = case_a JOIN sig b ON b.case_id = case_b AND a.signal_key = b.signal_key JOIN idf ON idf.signal_key = a.signal_key GROUP BY 1, 2""",
)
def _(p):
    own = materialize(case_signals(p), "signals")
    pairs = similarity.reasons(similarity.overlaps(materialize(similarity.neighbours(own, p.embeddings), "neighbours"), own))
    return pairs.select("case_a", "case_b", F.array_join("reasons", ",").alias("reasons"))


@R.add("refreshed_similarity", "SELECT case_id, other_id, round(combined_score, 6) AS combined_score FROM near")
def _(p):
    """Edges published when every fiftieth embedding was another one, and refreshed since."""
    spark, path = p.cases.sparkSession, scratch_path(p.cases.sparkSession, "refreshed")
    own = materialize(case_signals(p), "signals")
    edges.publish(path, own, p.embeddings.withColumn("embedding", F.when(F.col("case_id") % 50 == 0, F.reverse("embedding")).otherwise(F.col("embedding"))))
    edges.refresh(path, own, p.embeddings)
    return edges.read(spark, path).select("case_id", "other_id", *r6("combined_score"))


@R.add(
    "embedding_texts",
    """, x AS (SELECT case_id, string_agg(DISTINCT name, ', ' ORDER BY name) AS t FROM injuries GROUP BY 1), y AS (SELECT case_id, string_agg(DISTINCT name, ', ' ORDER BY name) AS t FROM body_parts GROUP BY 1), z AS (SELECT case_id, string_agg(DISTINCT name, ', ' ORDER BY name) AS t FROM insurers GROUP BY 1)
SELECT case_id, concat_ws(chr(10), 'name: ' || case_name, 'type: ' || case_type, 'stage: ' || legal_stage, 'phase: ' || phase, 'main injury: ' || main_injury, 'injuries: ' || x.t, 'body parts: ' || y.t, 'insurers: ' || z.t) AS text FROM cases LEFT JOIN x USING (case_id) LEFT JOIN y USING (case_id) LEFT JOIN z USING (case_id)""",
)
def _(p):
    return similarity.embedding_text(p.cases, p.injuries, p.body_parts, p.insurers)


def _lengths(batches):
    """A stand-in for an embedding model: numbers of a text that SQL can count as well."""
    for b in batches:
        yield b.assign(embedding=[[float(len(t)), float(t.count("o")), float(t.count("e")), 1.0] for t in b["text"]])[["case_id", "embedding"]]


@R.add(
    "similarity_with_provider",
    """, x AS (SELECT case_id, case_name || chr(10) || case_type AS t FROM cases), e AS (SELECT case_id, [length(t), length(t) - length(replace(t, 'o', '')), length(t) - length(replace(t, 'e', '')), 1]::DOUBLE[] AS e FROM x)
SELECT case_a, case_b, round(list_cosine_similarity(a.e, b.e), 6) AS semantic_score FROM sp JOIN e a ON a.case_id = case_a JOIN e b ON b.case_id = case_b WHERE 0.55 * signal_score + 0.45 * list_cosine_similarity(a.e, b.e) >= 0.8""",
)
def _(p):
    made = similarity.with_embeddings(p.cases.select("case_id", F.concat_ws("\n", "case_name", "case_type").alias("text")), _lengths)
    return similarity.similar_pairs(materialize(case_signals(p), "signals"), made, min_score=0.8, digits=6).select("case_a", "case_b", "semantic_score")


@R.add(
    "weighted_quantiles",
    """SELECT case_type, min(months_since_event) FILTER (run >= total * 0.25) AS p25, min(months_since_event) FILTER (run >= total * 0.5) AS p50, min(months_since_event) FILTER (run >= total * 0.75) AS p75
  FROM (SELECT *, sum(client_age) OVER (PARTITION BY case_type ORDER BY months_since_event RANGE UNBOUNDED PRECEDING) AS run, sum(client_age) OVER (PARTITION BY case_type) AS total FROM cases WHERE months_since_event IS NOT NULL) GROUP BY 1""",
)
def _(p):
    q = exact_quantiles(p.cases, ["case_type"], "months_since_event", "client_age", p25=0.25, p50=0.5, p75=0.75)
    return q.select("case_type", *(F.col(c).cast("long").alias(c) for c in ("p25", "p50", "p75")))
