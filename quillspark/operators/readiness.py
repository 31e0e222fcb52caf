"""Readiness decisions: which cohort applies, how a case compares with it, and when it will reach the stage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark import constants as K
from quillspark.functions.stats import floor_days, weighted_quantiles, whole_days
from quillspark.sources.scratch import materialize

CONTEXT_KINDS = ("injury", "bodyPart", "insurer", "contactRole")


def applicable_cohorts(cohort_rows: DataFrame, cases: DataFrame) -> DataFrame:
    """For each case and each (stage, sub-stage) the cohort of its own type, else the global one."""
    typed = cases.select("case_id", F.explode(F.array(F.col("case_type"), F.lit("all"))).alias("scope_type")).where("scope_type is not null")
    j = typed.join(cohort_rows, "scope_type")
    rank = F.row_number().over(W.partitionBy("case_id", "stage", "sub_stage").orderBy((F.col("scope") == "global").cast("int")))
    return j.withColumn("_r", rank).where("_r = 1").drop("_r")


def pattern(cohort_rows: DataFrame, common: DataFrame, case: DataFrame, stage: str, sub_stage: str = "") -> DataFrame:
    """The signals of the cohort that applies to the case(s), heaviest first."""
    own = applicable_cohorts(cohort_rows.where((F.col("stage") == stage) & (F.col("sub_stage") == sub_stage)), case)
    return own.select("case_id", "cohort_key", "scope", "members", "confidence").join(common.select("cohort_key", "signal_key", "support", "lift", "weight", "median_lead_days"), "cohort_key")


def with_same_type(rows: DataFrame, reach: DataFrame, cases: DataFrame, stage: str | None = None, sub_stage: str = "") -> DataFrame:
    """rows (case_id, scope, and stage and sub_stage unless they are given) with same_type_members, the cases of the case's type that reached the stage, and
    thin_same_type: the global cohort was taken although some, but too few for a cohort, are of the own type."""
    keys = ["stage", "sub_stage"] if stage is None else []
    there = reach if stage is None else reach.where((F.col("stage") == stage) & (F.col("sub_stage") == sub_stage))
    counts = there.where("case_type is not null").groupBy("case_type", *keys).agg(F.countDistinct("case_id").alias("same_type_members"))
    out = rows.drop("case_type").join(cases.select("case_id", "case_type"), "case_id", "left").join(counts, ["case_type", *keys], "left")
    n = F.coalesce("same_type_members", F.lit(0).cast("long"))
    thin = (F.col("scope") == "global") & (n >= K.THIN_SAME_TYPE) & (n < K.MIN_COHORT_SIZE)
    return out.withColumns({"same_type_members": n, "thin_same_type": thin})


def compare(pattern_rows: DataFrame, case_signals: DataFrame) -> DataFrame:
    """pattern rows with status matched, missing or context."""
    seen = case_signals.where("first_observed is not null").select("case_id", "signal_key", "first_observed")
    kind = F.substring_index("signal_key", ":", 1)
    status = F.when(F.col("first_observed").isNotNull(), "matched").when(kind.isin(*CONTEXT_KINDS), "context").otherwise("missing")
    return pattern_rows.join(seen, ["case_id", "signal_key"], "left").withColumn("status", status)


def coverage(compared: DataFrame) -> DataFrame:
    """Share of the pattern's weight that the case matches, and counts by status."""
    hit = F.col("status") == "matched"
    return compared.groupBy("case_id", "cohort_key").agg(
        F.when(F.sum("weight") > 0, F.coalesce(F.sum(F.when(hit, F.col("weight"))), F.lit(0.0)) / F.sum("weight")).otherwise(0.0).alias("coverage"),
        F.count_if(hit).alias("matched"), F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "context").alias("context"),
    )


def evidence_for(compared: DataFrame, emissions: DataFrame, owners: DataFrame, per_emitter: int = 2) -> DataFrame:
    """Up to per_emitter source rows of each kind (documents, communications, activities) for each matched signal."""
    hits = compared.where("status = 'matched'").select("case_id", "signal_key")
    rows = hits.join(owners.where("emitter <> 'fact'"), "case_id").join(emissions, ["emitter", "source_id", "signal_key"])
    rank = F.row_number().over(W.partitionBy("case_id", "signal_key", "emitter").orderBy(F.desc_nulls_first("at"), "source_id"))
    return rows.withColumn("_r", rank).where(F.col("_r") <= per_emitter).drop("_r")


def estimate(reach: DataFrame, target: DataFrame, stage: str, neighbours: DataFrame, as_of: str, sub_stage: str = "", peers: int = K.TOP_PEERS) -> DataFrame:
    """Days until the target cases reach the stage, from their most similar peers that did.

    target: (case_id, event_date). Peers are the `peers` cases of the greatest combined score (0 without an edge); a peer's remaining days are its own days to
    the stage less the target's age. At least MIN_TIMED_MEMBERS peers timed by the activity log are needed."""
    members = reach.where((F.col("stage") == stage) & (F.col("sub_stage") == sub_stage)).select(F.col("case_id").alias("other_id"), "reached_at", "source", F.col("event_date").alias("peer_event"))
    near = neighbours.select("case_id", "other_id", "combined_score")
    # Without an edge the score is 0: only the least case ids among those can be among the first peers.
    filler = members.orderBy("other_id").limit(2 * peers)
    linked = target.select("case_id", "event_date").join(near, "case_id").join(members, "other_id")
    # target and filler are bounded, so each target is paired with the few fillers by a constant key.
    others = target.select("case_id", "event_date", F.lit(1).alias("one")).join(F.broadcast(filler.withColumn("one", F.lit(1))), "one").drop("one").join(near.select("case_id", "other_id"), ["case_id", "other_id"], "left_anti").withColumn("combined_score", F.lit(0.0))
    rows = linked.unionByName(others)
    rank = F.row_number().over(W.partitionBy("case_id").orderBy(F.desc(F.round("combined_score", 9)), "other_id"))
    rows = rows.withColumn("_r", rank).where(F.col("_r") <= peers)
    days = whole_days("peer_event", "reached_at")
    age = floor_days("event_date", F.lit(as_of).cast("timestamp"))
    timed = rows.where(F.col("source") == "activity_log").withColumn("days", days).where("days >= 0").withColumn("remaining", days - age).withColumn("w", F.greatest("combined_score", F.lit(0.05)))
    q = weighted_quantiles(timed, ["case_id"], "remaining", "w", p50=0.5, p25=0.25, p75=0.75)
    counts = timed.groupBy("case_id").agg(F.count("*").alias("timed_peers"), F.percentile("combined_score", F.lit(0.5)).alias("median_score"))
    return shape(target.select("case_id").join(counts, "case_id", "left").join(q, "case_id", "left"))


def shape(rows: DataFrame) -> DataFrame:
    """Status, days and confidence from p50, p25, p75, timed_peers and median_score."""
    enough = F.coalesce(F.col("timed_peers"), F.lit(0)) >= K.MIN_TIMED_MEMBERS
    mid = F.when(enough, F.col("p50"))
    behind = mid < 0
    side = lambda c: F.when(behind & (F.col(c) < 0), -F.col(c)).when(~behind & (F.col(c) >= 0), F.col(c))
    band = F.when((F.col("timed_peers") >= 10) & (F.col("median_score") >= 0.375), "high").when((F.col("timed_peers") >= 4) & (F.col("median_score") >= 0.225), "medium").otherwise("low")
    return rows.select(
        "case_id", F.when(mid.isNull(), "no_estimate").when(behind, "behind").otherwise("future").alias("status"), F.abs(mid).alias("median_days"),
        F.when(mid.isNotNull(), side("p25")).alias("p25_days"), F.when(mid.isNotNull(), side("p75")).alias("p75_days"), F.coalesce("timed_peers", F.lit(0)).alias("timed_peers"), band.alias("confidence"),
    )


def sparse_estimate(reach: DataFrame, target: DataFrame, stage: str, as_of: str, sub_stage: str = "", peers: int = K.TOP_PEERS) -> DataFrame:
    """The estimate where no cohort exists: the fastest other cases, each with score 1, and low confidence."""
    other = reach.where((F.col("stage") == stage) & (F.col("sub_stage") == sub_stage) & F.col("event_date").isNotNull()).withColumn("days", whole_days("event_date", "reached_at")).where("days >= 0")
    # One more than needed, since a target may be among them.
    other = other.select(F.col("case_id").alias("other_id"), "days", "source").orderBy("days", "other_id").limit(peers + 1).withColumn("one", F.lit(1))
    rows = target.select("case_id", "event_date", F.lit(1).alias("one")).join(F.broadcast(other), "one").where("case_id <> other_id")
    rank = F.row_number().over(W.partitionBy("case_id").orderBy("days", "other_id"))
    rows = rows.withColumn("_r", rank).where(F.col("_r") <= peers).withColumn("remaining", F.col("days") - floor_days("event_date", F.lit(as_of).cast("timestamp"))).withColumn("w", F.lit(1.0))
    q = weighted_quantiles(rows, ["case_id"], "remaining", "w", p50=0.5, p25=0.25, p75=0.75)
    out = shape(target.select("case_id").join(rows.groupBy("case_id").agg(F.lit(K.MIN_TIMED_MEMBERS).alias("timed_peers"), F.count("*").alias("n"), F.lit(0.0).alias("median_score")), "case_id", "left").join(q, "case_id", "left"))
    return out.withColumn("confidence", F.lit("low"))


@dataclass
class ReadinessArtifact:
    """What readiness decisions for a stage rest on, a row or more for each case: pattern, comparison, estimate, and reasons (case_id, basis, peers, reasons)."""

    stage: str
    pattern: DataFrame
    comparison: DataFrame
    estimate: DataFrame
    reasons: DataFrame


class ArtifactComposer:
    """Collects the parts of a decision as they are observed, and gives the artifact once for each key (a case or a set of them) and stage."""

    PARTS = ("pattern", "comparison", "estimate", "reasons")

    def __init__(self):
        self._parts: dict[tuple, dict[str, DataFrame]] = {}
        self._given: set[tuple] = set()

    def observe(self, part: str, key, stage: str, frame: DataFrame) -> ReadinessArtifact | None:
        if part not in self.PARTS:
            raise ValueError(part)
        parts = self._parts.setdefault((key, stage), {})
        parts[part] = frame
        if len(parts) < len(self.PARTS) or (key, stage) in self._given:
            return None
        self._given.add((key, stage))
        return ReadinessArtifact(stage, **parts)


def availability(cohort_rows: DataFrame, reach: DataFrame, cases: DataFrame, stage: str, sub_stage: str = "") -> DataFrame:
    """case_id, basis (cohort, sparse_stage or none), peers (how many other cases reached the stage) and what with_same_type tells, for each case."""
    there = reach.where((F.col("stage") == stage) & (F.col("sub_stage") == sub_stage))
    own = applicable_cohorts(cohort_rows.where((F.col("stage") == stage) & (F.col("sub_stage") == sub_stage)), cases).select("case_id", "scope")
    all_peers = there.agg(F.countDistinct("case_id").alias("reached"), F.lit(1).alias("one"))
    rows = cases.select("case_id", F.lit(1).alias("one")).join(F.broadcast(all_peers), "one").drop("one").join(own, "case_id", "left")
    rows = rows.join(there.select("case_id", F.lit(1).alias("_own")).distinct(), "case_id", "left")
    peers = F.col("reached") - F.coalesce("_own", F.lit(0))
    basis = F.when(peers == 0, "none").when(F.col("scope").isNull(), "sparse_stage").otherwise("cohort")
    return with_same_type(rows.select("case_id", "scope", basis.alias("basis"), peers.alias("peers")), reach, cases, stage, sub_stage).select("case_id", "basis", "peers", "same_type_members", F.coalesce("thin_same_type", F.lit(False)).alias("thin_same_type"))


def explain(cases: DataFrame, stage: str, cohort_rows: DataFrame, common: DataFrame, case_signals: DataFrame, reach: DataFrame, neighbours: DataFrame, as_of: str, sub_stage: str = "") -> ReadinessArtifact:
    """Pattern, comparison, estimate and reasons for doubt (codes, with a number after a colon) of the cases. The basis of each case chooses its estimate by a join; nothing comes to the driver."""
    basis = materialize(availability(cohort_rows, reach, cases, stage, sub_stage), "basis")
    told = pattern(cohort_rows, common, cases, stage, sub_stage)
    target = cases.select("case_id", "event_date")
    good = F.col("basis") == "cohort"
    by_peers = estimate(reach, target.join(basis.where(good), "case_id", "left_semi"), stage, neighbours, as_of, sub_stage)
    by_speed = sparse_estimate(reach, target.join(basis.where(~good), "case_id", "left_semi"), stage, as_of, sub_stage)
    code = lambda name, n: F.concat(F.lit(f"{name}:"), F.col(n).cast("string"))
    reasons = F.array_compact(F.array(F.when(~good, code("few_peers", "peers")), F.when(F.col("thin_same_type"), code("thin_same_type", "same_type_members")), F.when(F.col("event_date").isNull(), F.lit("no_event_date"))))
    doubts = basis.join(target, "case_id").select("case_id", "basis", "peers", reasons.alias("reasons"))
    return ReadinessArtifact(stage, told, compare(told, case_signals), by_peers.unionByName(by_speed), doubts)
