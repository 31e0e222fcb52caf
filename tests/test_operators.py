from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.operators import chunks, cohorts, comparables, facts, ingest, lookup, portfolio, readiness, signals, similarity
from quillspark.sources import contracts, sinks

DAY = timedelta(days=1)
T0 = datetime(2026, 1, 1)


def _cohort(spark, source="activity_log", logged=12):
    """Twelve members with a signal in eight of them ten days before the stage, twelve controls with it in one."""
    cases = [(i, "liability", T0) for i in range(24)]
    events = [(i, "file_claim", None, T0 + 100 * DAY, source if i < logged else "current_stage_snapshot") for i in range(12)]
    sig = [(i, "documentCategory:medical", T0 + 90 * DAY) for i in range(8)] + [(12, "documentCategory:medical", T0)]
    sig += [(i, "caseType:liability", T0) for i in range(24)]
    return (
        spark.createDataFrame(cases, "case_id long, case_type string, event_date timestamp"),
        spark.createDataFrame(events, "case_id long, stage string, sub_stage string, occurred_at timestamp, source string"),
        spark.createDataFrame(sig, "case_id long, signal_key string, first_observed timestamp"),
    )


def test_cohort_signals_by_hand(spark):
    cases, events, sig = _cohort(spark)
    rows = cohorts.common_signals(cohorts.reaches(events, cases), sig, cases).collect()
    assert {r.scope for r in rows} == {"global", "caseType"}
    for r in rows:
        assert (r.signal_key, r.support, r.median_lead_days) == ("documentCategory:medical", 8 / 12, 10)
        assert r.lift == pytest.approx(8) and r.weight == pytest.approx(8 / 12 * 2.1972245773)


@pytest.mark.parametrize(("logged", "want"), [(0, None), (2, None), (3, 100)])
def test_timing_needs_three_logged_members(spark, logged, want):
    cases, events, _ = _cohort(spark, logged=logged)
    assert {r.median_days for r in cohorts.cohorts(cohorts.reaches(events, cases)).collect()} == {want}


def test_small_groups_form_no_cohort(spark):
    cases, events, _ = _cohort(spark)
    assert cohorts.cohorts(cohorts.reaches(events.where("case_id < 4"), cases)).count() == 0


def test_rollup_counts_and_ignores_null_times(spark):
    obs = spark.createDataFrame([(1, "a:x", "x", "a", None, "document", "d1"), (1, "a:x", "x", "a", T0, "activity", None)], "case_id long, signal_key string, label string, kind string, observed_at timestamp, source_kind string, source_id string")
    r = signals.rollup(obs).first()
    assert (r.first_observed, r.observations, r.source_kinds) == (T0, 2, ["activity", "document"])
    assert signals.emissions(obs).count() == 1


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=8), min_size=2, max_size=8))
def test_similarity_matches_brute_force(spark, sets):
    import math

    rows = [(i, f"k{x}") for i, s in enumerate(sets) for x in s]
    got = {(r.case_a, r.case_b): r.combined_score for r in similarity.similar_pairs(spark.createDataFrame(rows, "case_id long, signal_key string")).collect()}
    n = len(sets)
    w = {x: math.log((1 + n) / (1 + sum(x in s for s in sets))) + 1 for x in range(13)}
    want = {}
    for a in range(n):
        for b in range(a + 1, n):
            j = sum(w[x] for x in sets[a] & sets[b]) / sum(w[x] for x in sets[a] | sets[b])
            if j >= 0.18:
                want[a, b] = j
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_prune_keeps_pairs_of_either_side(spark):
    pairs = spark.createDataFrame([(0, i, 1.0 - i / 100) for i in range(1, 12)], "case_a long, case_b long, combined_score double")
    assert similarity.prune(pairs, 3).count() == 11  # every pair is the best of its second case
    ring = pairs.unionByName(spark.createDataFrame([(i, j, 0.99) for i in range(1, 12) for j in range(i + 1, 12)], pairs.schema))
    kept = {(r.case_a, r.case_b) for r in similarity.prune(ring, 3).collect()}
    assert {(0, 1), (0, 2), (0, 3)} <= kept and (0, 11) not in kept


def test_estimate_shapes(spark):
    rows = spark.createDataFrame([(1, 10.0, 5.0, 20.0, 4, 0.5), (2, -10.0, -30.0, 5.0, 3, 0.1), (3, 10.0, 5.0, 20.0, 2, 0.9)], "case_id long, p50 double, p25 double, p75 double, timed_peers long, median_score double")
    got = {r.case_id: (r.status, r.median_days, r.p25_days, r.p75_days, r.confidence) for r in readiness.shape(rows).collect()}
    assert got == {1: ("future", 10, 5, 20, "medium"), 2: ("behind", 10, 30, None, "low"), 3: ("no_estimate", None, None, None, "low")}


def test_artifact_once(spark):
    c, df = readiness.ArtifactComposer(), spark.range(1)
    assert all(c.observe(part, 1, "s", df) is None for part in c.PARTS[:-1])
    assert c.observe("reasons", 1, "s", df).reasons is df
    assert c.observe("estimate", 1, "s", df) is None
    with pytest.raises(ValueError):
        c.observe("other", 1, "s", df)


@pytest.mark.parametrize(("months", "left", "near"), [(24, 60, False), (73, 11, True), (91, -7, True), (100, -16, False), (None, None, False)])
def test_limitation(spark, months, left, near):
    a, b = lookup.limitation(F.col("m"))
    r = spark.createDataFrame([(months,)], "m long").select(a.alias("l"), b.alias("n")).first()
    assert (r.l, r.n) == (left, near)


def test_filters_drop_neutral_values(spark):
    cases = spark.createDataFrame([(1, "a", 0.0, 10), (2, "b", 0.5, None)], "case_id long, case_type string, completion_rate double, months_since_event long")
    p = SimpleNamespace(cases=cases, injuries=None, body_parts=None)
    assert portfolio.filter_cases(p, portfolio.CaseFilter(case_type=" ", is_signed=False, completion_min=0, completion_max=1, months_min=0)).count() == 2
    assert portfolio.filter_cases(p, portfolio.CaseFilter(case_type="zzz"), {"case_type": {"a", "b"}}).count() == 2
    assert portfolio.filter_cases(p, portfolio.CaseFilter(completion_min=0.1)).count() == 1
    with pytest.raises(ValueError):
        portfolio.aggregate(p, "colour")


def test_comparable_policy():
    f = comparables.ComparableFilter(injury="תאונת דרכים", age_min=0, age_max=130, disability_min=0)
    assert f.case_types() == comparables.TRAFFIC_TYPES and f.part("injury") is None and f.bound("age_min", 0, 130) is None
    assert comparables.diagnose(comparables.ComparableFilter(age_min=3), 0) == "filter_too_restrictive"
    assert len(comparables.missing_value_evidence(True, False, set(), 0)) == 5


TEXT = "נקבעה נכות זמנית של 40% מיום 1/2/2020 עד 3/4/2021. ועדה רפואית קבעה 10 אחוזי נכות צמיתה. תקנה 15 לא הופעלה. המוסד לביטוח לאומי דוחה את הערעור. ניתן להגיש ערעור תוך 60 יום. אנא להעביר תלושי שכר."


def test_hebrew_facts(spark):
    rows = facts.extract_facts(spark.createDataFrame([("c1", TEXT)], "chunk_id string, text string")).collect()
    got = {(r.kind, r.subtype, r.numeric_value) for r in rows}
    assert {("disability_period", "temporary", 40.0), ("disability_period", "permanent", 10.0), ("regulation_15", "not_applied", None), ("nii_decision", "rejected", None), ("appeal_deadline", "days", 60.0), ("required_document", "salary_slips", None)} <= got
    first = next(r for r in rows if r.numeric_value == 40)
    assert (first.from_date, first.to_date, first.confidence, first.fact_id.startswith("c1:fact:")) == ("2020-02-01", "2021-04-03", 0.86, True)


def test_drafts_are_checked_and_merged(spark):
    ch = spark.createDataFrame([("c1", TEXT)], "chunk_id string, text string")
    drafts = spark.createDataFrame([("c1", "regulation_15", "תקנה  15 לא", 3.0), ("c1", "regulation_15", "nowhere here", 0.5), ("c1", "gossip", "תקנה 15 לא", 0.5), ("c1", "regulation_15", "x", None)], "chunk_id string, kind string, quote string, confidence double")
    rows = facts.validate_drafts(drafts, ch).collect()
    assert [(r.kind, r.confidence) for r in rows] == [("regulation_15", 1.0)]
    own = facts.extract_facts(ch)
    assert facts.merge_facts(own, own.withColumn("source", F.lit("llm"))).where("source = 'llm'").count() == 0


def _pack(text):
    """Plain Python version of compaction, paragraphs, slices and packing."""
    import re

    parts = []
    for para in (x.strip(" ") for x in re.split(r"\n\s*\n", re.sub(r"[ \t]+\n", "\n", text.replace("\r", "")).strip())):
        parts += [para[i : i + 2200] for i in range(0, len(para), 2200)] if len(para) > 2600 else [para] if para else []
    out, cur = [], ""
    for x in parts:
        joined = f"{cur}\n\n{x}" if cur else x
        if cur and len(joined) > 2600:
            out.append(cur)
            tail = cur[-180:].strip(" ")
            cur = f"{tail}\n\n{x}" if tail else x
        else:
            cur = joined
    return out + ([cur] if cur else [])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 6000), min_size=0, max_size=8))
def test_chunks_match_plain_python(spark, sizes):
    text = "\n\n".join(("abcdefg " * 1000)[:n].strip() or "z" for n in sizes)
    got = [r.text for r in chunks.chunk_rows(spark.createDataFrame([("d", text)], "document_id string, text string")).orderBy("chunk_number").collect()]
    assert got == _pack(text) and all(len(x) <= 2782 for x in got)


def test_chunks_of_null_and_own_chunks(spark):
    assert chunks.chunk_rows(spark.createDataFrame([("d", None)], "document_id string, text string")).count() == 0
    s = contracts.FILES
    row = {"_id": "f", "processedData": {"chunks": [{"chunk_number": 2.0, "extracted_text": "b"}, {"chunk_number": 1.0, "extracted_text": " "}], "combined_text": "c"}}
    out = chunks.source_texts(spark.createDataFrame([row], s)).collect()
    assert [(r.source, r.text) for r in out] == [("chunk", "b")]


def test_contacts_merge(spark):
    rows = [("1", "Dana", "client", "05-1", None, ["a"]), ("2", "dana ", "client", "051", "", ["b", "zz"]), ("3", "Dana", "client", None, None, ["a"]), ("4", "Root", "admin", "1", None, ["a"])]
    n = ingest.contact_nodes(spark.createDataFrame(rows, contracts.CONTACTS))
    got = {r.dedup_key: (r.name, r.source_ids, r.case_ids) for r in n.collect()}
    assert got == {"dana|client|p:051": ("Dana", ["1", "2"], ["a", "b", "zz"]), "uniq:3": ("Dana", ["3"], ["a"])}
    assert ingest.contact_edges(n, spark.createDataFrame([("a",), ("b",)], "caseId string")).count() == 3


def test_stage_events_and_backfill(spark):
    cases = spark.createDataFrame([{"_id": "1", "caseId": "a", "legalStage": "s1", "legalStageEnteredAt": "2024-01-01 00:00:00"}, {"_id": "2", "caseId": "b", "legalStage": "s2", "legalStageEnteredAt": "2024-01-01 00:00:00"}], contracts.CASES)
    log = spark.createDataFrame([{"_id": "x", "caseId": "a", "action": "stage_changed", "at": "2024-02-01 00:00:00", "details": {"toStage": " ", "to": "s1"}}, {"_id": "y", "caseId": "a", "action": "note", "at": "2024-02-01 00:00:00", "details": {"to": "s9"}}], contracts.ACTIVITY)
    got = {(r.case_id, r.stage, r.source) for r in ingest.stage_events(log, cases).collect()}
    assert got == {("a", "s1", "activity_log"), ("b", "s2", "current_stage_snapshot")}


def test_valuations_and_components(spark):
    p = spark.createDataFrame([{"caseId": "a", "version": 2.0, "compensationMin": 100.0, "compensationMax": 130.0, "damageBreakdown": {"future_losses": 5.0}}, {"caseId": "a", "version": 1.0, "totalEstimate": 9.0}], contracts.PROJECTIONS)
    v = ingest.valuation_rows(p).collect()
    assert [(r.valuation_id, r.total_estimate) for r in v] == [("a:valuation:2", 130.0)]
    assert [(r.kind, r.amount) for r in ingest.damage_components(p).collect()] == [("future_losses", 5.0)]


def test_participants(spark):
    c = spark.createDataFrame([{"_id": "m", "caseId": "a", "sender": {"contactId": "1"}, "to": [{"name": "Bo", "email": "b@x.y"}, {"name": "No One"}]}], contracts.COMMUNICATIONS)
    contacts = spark.createDataFrame([{"_id": "1", "name": "Dana", "contactType": "client", "phone": "051"}], contracts.CONTACTS)
    got = {(r.kind, r.dedup_key) for r in ingest.participant_edges(c, contacts).collect()}
    assert got == {("from", "dana|client|p:051"), ("to", "bo|communication_party|e:b@x.y"), ("to", "uniq:m:to:1")}


def test_contract_rejects_or_skips(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"_id": "1", "caseId": "a", "extra": 1}\n{"_id": "2"}\n')
    with pytest.raises(contracts.SchemaViolation):
        contracts.read_collection(spark, str(tmp_path), "cases")
    assert contracts.read_collection(spark, str(tmp_path), "cases", allow_invalid=True).count() == 1


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    assert sinks.read_table(spark, path) is None
    sinks.upsert_rows(rows((1, "a"), (2, "b")), path, ["k"])
    sinks.upsert_rows(rows((2, "c"), (3, "d")), path, ["k"])
    assert sorted(map(tuple, sinks.read_table(spark, path).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    bad = spark.range(1).select(F.raise_error(F.lit("no")).alias("k"))
    with pytest.raises(Exception, match="no"):
        sinks.replace_table(bad, path)
    assert sinks.read_table(spark, path).count() == 3
    edges = spark.createDataFrame([(1, 2), (1, 2), (1, 9)], "k long, k2 long")
    sinks.upsert_edges(edges, str(tmp_path / "e"), rows((1, "a")), rows((2, "b")).withColumnRenamed("k", "k2"), "k", "k2")
    assert [(r.k, r.k2) for r in sinks.read_table(spark, str(tmp_path / "e")).collect()] == [(1, 2)]
    sinks.clear(spark, path)
    assert sinks.read_table(spark, path) is None


def test_decision_for_target_and_sparse_stage(spark):
    """Twelve peers reach file_claim 94 days after their event; the target lacks evidence. The sparse stage has one peer."""
    day = lambda n: T0 + n * DAY
    cases = spark.createDataFrame([(0, "liability", day(0)), (1, "liability", None), *((10 + i, "liability", day(i)) for i in range(1, 13))], "case_id long, case_type string, event_date timestamp")
    events = [(10 + i, "file_claim", None, day(i + 94), "activity_log") for i in range(1, 13)] + [(11, "rare", None, day(101), "activity_log")]
    reach = cohorts.reaches(spark.createDataFrame(events, "case_id long, stage string, sub_stage string, occurred_at timestamp, source string"), cases)
    sig = [(10 + i, f"documentCategory:{c}", day(i + 1)) for i in range(1, 13) for c in ("medical", "evidence")] + [(0, "documentCategory:medical", day(5))]
    sig = spark.createDataFrame(sig, "case_id long, signal_key string, first_observed timestamp")
    rows, common = cohorts.cohorts(reach), cohorts.common_signals(reach, sig, cases)
    near = spark.createDataFrame([(0, 10 + i, 0.5) for i in range(1, 13)] + [(1, 11, 0.5)], "case_id long, other_id long, combined_score double")
    assert {r.members for r in rows.collect()} == {12}
    a = readiness.explain(cases.where("case_id = 0"), "file_claim", rows, common, sig, reach, near, "2026-02-10")
    assert {(r.signal_key, r.status) for r in a.comparison.collect()} == {("documentCategory:evidence", "missing"), ("documentCategory:medical", "matched")}
    said = lambda x: [r for row in x.reasons.collect() for r in row.reasons]
    assert 0 < readiness.coverage(a.comparison).first().coverage < 1 and said(a) == []
    e = a.estimate.first()
    assert (e.status, e.median_days, e.timed_peers, e.confidence) == ("future", 94 - 40, 8, "medium")
    undated = readiness.explain(cases.where("case_id = 1"), "file_claim", rows, common, sig, reach, near, "2026-02-10")
    assert undated.estimate.first().status == "no_estimate" and said(undated) == ["no_event_date"]
    sparse = readiness.explain(cases.where("case_id = 0"), "rare", rows, common, sig, reach, near, "2026-02-10")
    assert sparse.estimate.first().confidence == "low" and sparse.estimate.first().median_days == 60 and said(sparse) == ["few_peers:1"]
    both = readiness.explain(cases.where("case_id < 2"), "file_claim", rows, common, sig, reach, near, "2026-02-10")
    assert {r.case_id: (r.status, r.timed_peers) for r in both.estimate.collect()} == {0: ("future", 8), 1: ("no_estimate", undated.estimate.first().timed_peers)}


def test_thin_same_type_context(spark):
    """Four cases of a type reached the stage: too few for their cohort, enough to be told of."""
    n = {"car": 4, "work": 9, "other": 2}
    cases = spark.createDataFrame([(100 * k + i, t, T0) for k, (t, m) in enumerate(n.items()) for i in range(m)] + [(901, "car", T0), (902, "work", T0), (903, "other", T0), (904, None, T0)], "case_id long, case_type string, event_date timestamp")
    events = [(100 * k + i, "file_claim", None, T0 + DAY, "activity_log") for k, m in enumerate(n.values()) for i in range(m)]
    reach = cohorts.reaches(spark.createDataFrame(events, "case_id long, stage string, sub_stage string, occurred_at timestamp, source string"), cases)
    asked = cases.where("case_id > 900")
    own = readiness.with_same_type(readiness.applicable_cohorts(cohorts.cohorts(reach), asked), reach, asked)
    assert {r.case_id: (r.scope, r.same_type_members, r.thin_same_type) for r in own.collect()} == {901: ("global", 4, True), 902: ("caseType", 9, False), 903: ("global", 2, False), 904: ("global", 0, False)}
    got = {r.case_id: (r.basis, r.peers, r.thin_same_type) for r in readiness.availability(cohorts.cohorts(reach), reach, asked, "file_claim").collect()}
    assert got == {901: ("cohort", 15, True), 902: ("cohort", 15, False), 903: ("cohort", 15, False), 904: ("cohort", 15, False)}


def test_literals_of_patterns():
    words = lambda p: facts.literals(p)
    assert words(r"ab+c\s+long(?:er)?words") == (frozenset({"words"}), False)
    assert words(r"(?i)Licensed under|released under") == (frozenset({"licensed under", "released under"}), True)
    assert words(r"x\d|[ab]") is None and words(r"(?:abc)?") is None and words(r"(abc|de)f*") == (frozenset({"abc", "de"}), False)
    assert all(facts.literals(r.pattern) for r in (*facts.HEBREW_PACK, *facts.GENERIC_PACK))


def test_every_rule_is_hit_by_the_registered_texts(spark):
    from quillspark.plans.catalog_sources import _TEXTS

    import re

    hit = {i for i, r in enumerate(facts.HEBREW_PACK) for t in _TEXTS if re.search(r.pattern, t.replace("{p}", "33"))}
    assert hit == set(range(27)) == set(range(len(facts.HEBREW_PACK)))


RETRIED = """
import os, sys
from pyspark.sql import SparkSession
from quillspark.operators import facts

def lost_once(frames):
    import pandas as pd
    from pyspark import TaskContext
    for f in frames:
        yield pd.DataFrame([{"chunk_id": i, "kind": "k", "quote": t, "tokens_in": 10.0, "tokens_out": 2.0} for i, t in zip(f["chunk_id"], f["text"], strict=True)])
        if TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("lost after a call")

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
ch = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(23)], "chunk_id string, text string")
drafts, meter = facts.asked(ch, lost_once, batch=5, calls=3)
print("TOLD", drafts.count(), meter.first().chunks, meter.first().tokens_in)
"""


def test_retried_partitions_count_once():
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", RETRIED], capture_output=True, text=True, timeout=300, check=False)
    assert "TOLD 23 23 230.0" in out.stdout, out.stderr[-2000:]


def test_cost_counts_each_chunk_once(spark):
    def steady(frames):
        import pandas as pd

        for f in frames:
            yield pd.DataFrame([{"chunk_id": i, "kind": "work_accident", "subtype": "x", "quote": t, "tokens_in": 10.0, "tokens_out": 2.0} for i, t in zip(f["chunk_id"], f["text"], strict=True)])

    ch = spark.createDataFrame([(f"c{i}", f"text number {i}") for i in range(23)], "chunk_id string, text string")
    drafts, meter = facts.asked(ch, steady, batch=5, calls=3, price_in=0.5, price_out=1.0)
    m = meter.first()
    assert drafts.count() == 23 and (m.chunks, m.drafts, m.tokens_in, m.tokens_out, m.cost) == (23, 23, 230.0, 46.0, 161.0) and 5 <= m.calls <= 7
    seen = []
    facts.with_provider(ch, steady, told=seen.append)
    assert seen[0].first().chunks == 23
    assert facts.asked(ch.limit(0), steady)[1].first().chunks == 0
