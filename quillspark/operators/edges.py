"""Published similarity edges: a table by case that tools read, kept up to date case by case.

At a path lie the edges (case_id, other_id, own, scores), both ways and dealt by case_id, and the stamps of the cases' profiles. A row is own if the other case is
among the case's best; a pair is there if it is own from either side. Readers of one case open one part of the table.

A refresh compares stamps. Cases whose profile changed, or is new, are compared with all cases; cases that had eight neighbours and lose one of them are too, since
the one that takes its place is unknown; any other case keeps its list, less the cases that are gone, and gains what the changed ones bring. Only the
parts of the table that hold cases with another list are rewritten. The result is that of publishing anew. Weights depend on all cases: a refresh by new
weights changes the profile of each case that holds a signal with another weight; one by the published weights changes only the cases that changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import constants as K
from quillspark.sources import sinks
from quillspark.sources.scratch import materialize

from . import allpairs, similarity

SCORES = ("signal_score", "semantic_score", "combined_score")


def _rows(best: DataFrame) -> DataFrame:
    """case_id, other_id, own and scores, both ways, from directed rows of the best."""
    there = best.select("case_id", "other_id", F.lit(True).alias("own"), *SCORES)
    back = best.select(F.col("other_id").alias("case_id"), F.col("case_id").alias("other_id"), F.lit(False).alias("own"), *SCORES)
    return there.union(back).groupBy("case_id", "other_id").agg(F.max("own").alias("own"), *(F.first(c).alias(c) for c in SCORES))


def publish(path: str, case_signals: DataFrame, embeddings: DataFrame | None = None, top: int = K.TOP_NEIGHBOURS, parts: int = sinks.PARTS) -> None:
    """Writes the edges of all cases, their stamps, and the weights they go by."""
    weights = materialize(similarity.signal_weights(case_signals), "weights")
    own = similarity.profiles(case_signals, embeddings, weights)
    sinks.replace_table(_rows(allpairs.nearest(own, top).best), f"{path}/edges", ["case_id"], parts)
    sinks.replace_table(weights, f"{path}/weights", ["signal_key"], parts)
    sinks.replace_table(own.select("case_id", "stamp"), f"{path}/stamps", ["case_id"], parts)


def read(spark: SparkSession, path: str) -> DataFrame | None:
    return sinks.read_table(spark, f"{path}/edges")


def read_case(spark: SparkSession, path: str, case_id) -> DataFrame | None:
    """The edges of one case."""
    return sinks.read_key(spark, f"{path}/edges", case_id=case_id)


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """Each published pair once."""
    return read(spark, path).where("case_id < other_id").select(F.col("case_id").alias("case_a"), F.col("other_id").alias("case_b"), *SCORES)


def refresh(path: str, case_signals: DataFrame, embeddings: DataFrame | None = None, top: int = K.TOP_NEIGHBOURS, new_weights: bool = True, parts: int = sinks.PARTS) -> int:
    """Brings the edges at path up to date and returns how many cases were compared with all. Without new_weights signals keep their
    published weights, and signals that are new get theirs from the present cases."""
    spark = case_signals.sparkSession
    old = read(spark, path)
    if old is None:
        publish(path, case_signals, embeddings, top, parts)
        return case_signals.select("case_id").distinct().count()
    weights = materialize(similarity.signal_weights(case_signals), "weights")
    if not new_weights:
        known = sinks.read_table(spark, f"{path}/weights")
        weights = materialize(known.unionByName(weights.join(known, "signal_key", "left_anti")), "weights")
    now = similarity.profiles(case_signals, embeddings, weights)
    was = sinks.read_table(spark, f"{path}/stamps")
    both = now.select("case_id", "stamp").join(was.select("case_id", F.col("stamp").alias("before")), "case_id", "full")
    moved = materialize(both.where(~F.col("stamp").eqNullSafe(F.col("before"))).select("case_id", F.col("stamp").isNull().alias("gone")), "moved")
    if moved.isEmpty():
        return 0
    own = old.where("own").drop("own")
    lost = own.join(moved.select(F.col("case_id").alias("other_id")), "other_id", "left_semi").select("case_id").distinct()
    full = own.groupBy("case_id").agg(F.count("*").alias("n")).where(F.col("n") >= top).select("case_id")
    ids = moved.where("not gone").select("case_id").union(lost.join(full, "case_id", "left_semi").join(moved, "case_id", "left_anti"))
    ids = materialize(ids.distinct(), "compared")
    found = allpairs.between(materialize(now.join(ids, "case_id", "left_semi"), "asked"), now, top)
    # Lists of cases that were compared are made anew; of the others the rest of the old list competes with what was found.
    rest = own.join(ids, "case_id", "left_anti").join(moved.select("case_id"), "case_id", "left_anti").join(moved.select(F.col("case_id").alias("other_id")), "other_id", "left_anti")
    lists = rest.unionByName(found.select(*rest.columns)).dropDuplicates(["case_id", "other_id"])
    lists = materialize(allpairs.best_of(lists, top), "lists")
    # Lists that differ from the old ones, and the cases at the other end of what came or went.
    gone = own.join(lists, ["case_id", "other_id"], "left_anti").select("case_id", "other_id", *SCORES)
    same = F.lit(True)
    for c in SCORES:
        same = same & F.round(f"l.{c}", 9).eqNullSafe(F.round(f"o.{c}", 9))
    came = lists.alias("l").join(own.alias("o"), ["case_id", "other_id"], "left").where(F.col("o.combined_score").isNull() | ~same).select("case_id", "other_id")
    changes = gone.select("case_id", "other_id").union(came)
    touched = changes.select("case_id").union(changes.select(F.col("other_id").alias("case_id"))).union(moved.select("case_id")).distinct()
    touched = materialize(touched, "touched")
    sinks.replace_groups(_rows(lists).join(touched, "case_id", "left_semi"), f"{path}/edges", "case_id", touched, parts)
    sinks.upsert_rows(weights, f"{path}/weights", ["signal_key"], parts=parts)
    sinks.upsert_rows(now.select("case_id", "stamp").join(moved, "case_id", "left_semi"), f"{path}/stamps", ["case_id"], parts=parts)
    sinks.delete_keys(moved.where("gone"), f"{path}/stamps", ["case_id"])
    return ids.count()
