"""Explainable case similarity: IDF-weighted Jaccard over signals, blended with embedding cosine.

Pairs come from `allpairs` (blocks of alike cases, bounds, matrix products). No signal is a join key, so a signal that all cases share costs no more than others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark import constants as K
from quillspark.sources.scratch import materialize

from . import allpairs


def idf(case_signals: DataFrame) -> DataFrame:
    """signal_key, cases, weight = ln((1 + N) / (1 + cases)) + 1."""
    pairs = case_signals.select("case_id", "signal_key").distinct()
    n = pairs.agg(F.countDistinct("case_id").alias("n"), F.lit(1).alias("one"))
    df = pairs.groupBy("signal_key").agg(F.count("*").alias("cases")).withColumn("one", F.lit(1)).join(F.broadcast(n), "one")
    return df.select("signal_key", "cases", (F.ln((1 + F.col("n")) / (1 + F.col("cases"))) + 1).alias("weight"))


def signal_weights(case_signals: DataFrame) -> DataFrame:
    return idf(case_signals).select("signal_key", F.round("weight", 12).alias("weight"))


def weighted_signals(case_signals: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """case_id, signal_key, weight; by given weights, signals that have none there leave no trace."""
    weights = signal_weights(case_signals) if weights is None else weights
    return case_signals.select("case_id", "signal_key").distinct().join(weights, "signal_key").select("case_id", "signal_key", "weight")


def profiles(case_signals: DataFrame, embeddings: DataFrame | None = None, weights: DataFrame | None = None) -> DataFrame:
    """case_id, keys (a number for each signal) and weights in step, e (embedding or null), and stamp, which changes with any of them."""
    weights = signal_weights(case_signals) if weights is None else weights
    # Numbers are given once, when the table is written, so no two signals share one.
    named = materialize(weights.select("signal_key", "weight").withColumn("k", F.monotonically_increasing_id()), "signal-weights")
    own = case_signals.select("case_id", "signal_key").distinct().join(named, "signal_key")
    own = own.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("signal_key", "weight", "k"))).alias("s"))
    if embeddings is None:
        own = own.withColumn("e", F.lit(None).cast("array<double>"))
    else:
        own = own.join(embeddings.groupBy("case_id").agg(F.first("embedding").cast("array<double>").alias("e")), "case_id", "left")
    stamp = F.sha2(F.to_json(F.struct(F.transform("s", lambda x: F.struct(x["signal_key"], x["weight"])).alias("s"), "e")), 256)
    return materialize(own.select("case_id", F.col("s.k").alias("keys"), F.col("s.weight").alias("weights"), "e", stamp.alias("stamp")), "profiles")


def similar_pairs(case_signals: DataFrame, embeddings: DataFrame | None = None, min_score: float = K.MIN_SIMILARITY, digits: int | None = None) -> DataFrame:
    """case_a < case_b, signal_score, semantic_score, combined_score (rounded to so many digits), for pairs that share a signal and reach the least combined score."""
    return allpairs.above(profiles(case_signals, embeddings), min_score, digits=digits)


def overlaps(pairs: DataFrame, case_signals: DataFrame) -> DataFrame:
    """pairs with overlap: the shared signals as (weight, signal_key)."""
    own = weighted_signals(case_signals)
    shared = pairs.select("case_a", "case_b").join(own.withColumnRenamed("case_id", "case_a"), "case_a").join(own.select(F.col("case_id").alias("case_b"), "signal_key"), ["case_b", "signal_key"])
    return pairs.join(shared.groupBy("case_a", "case_b").agg(F.collect_list(F.struct("weight", "signal_key")).alias("overlap")), ["case_a", "case_b"])


def reasons(pairs: DataFrame, top: int = 3) -> DataFrame:
    """pairs with the heaviest shared signals, and a note where the embeddings are close."""
    order = F.array_sort(F.transform("overlap", lambda x: F.struct((-F.round(x["weight"], 9)).alias("w"), x["signal_key"].alias("k"))))
    keys = F.transform(F.slice(order, 1, top), lambda x: x["k"])
    note = F.when(F.col("semantic_score") >= K.SEMANTIC_REASON, F.array(F.lit("Semantic summary match"))).otherwise(F.array().cast("array<string>"))
    return pairs.withColumn("reasons", F.concat(keys, note))


def prune(pairs: DataFrame, top: int = K.TOP_NEIGHBOURS) -> DataFrame:
    """Pairs among the best `top` of either of their cases."""
    score = F.desc(F.round("combined_score", 9))
    a = F.row_number().over(W.partitionBy("_c").orderBy(score, "_o"))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("case_a").alias("c"), F.col("case_b").alias("o")), F.struct(F.col("case_b").alias("c"), F.col("case_a").alias("o")))).alias("e"), "case_a", "case_b", "combined_score")
    ends = ends.select(F.col("e.c").alias("_c"), F.col("e.o").alias("_o"), "case_a", "case_b", "combined_score").withColumn("r", a).where(F.col("r") <= top)
    return pairs.join(ends.select("case_a", "case_b").distinct(), ["case_a", "case_b"], "left_semi")


def undirected(best: DataFrame) -> DataFrame:
    """The pairs of directed rows, each once."""
    pairs = best.withColumns({"case_a": F.least("case_id", "other_id"), "case_b": F.greatest("case_id", "other_id")})
    return pairs.groupBy("case_a", "case_b").agg(*(F.first(c).alias(c) for c in ("signal_score", "semantic_score", "combined_score")))


def neighbours(case_signals: DataFrame, embeddings: DataFrame | None = None, top: int = K.TOP_NEIGHBOURS) -> DataFrame:
    """The edges to publish: pairs among the best `top` of either case."""
    return undirected(allpairs.nearest(profiles(case_signals, embeddings), top).best)


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair from either of its cases: case_id, other_id and the pair's columns."""
    return allpairs.directed(pairs)


def embedding_text(cases: DataFrame, injuries: DataFrame, body_parts: DataFrame, insurers: DataFrame) -> DataFrame:
    """case_id, text: what describes a case to an embedding model, one labelled line for each known field."""
    names = lambda df, alias: df.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias(alias))
    c = cases.join(names(injuries, "_injuries"), "case_id", "left").join(names(body_parts, "_parts"), "case_id", "left").join(names(insurers, "_insurers"), "case_id", "left")
    fields = (("name", "case_name"), ("type", "case_type"), ("stage", "legal_stage"), ("phase", "phase"), ("main injury", "main_injury"), ("injuries", "_injuries"), ("body parts", "_parts"), ("insurers", "_insurers"))
    # concat_ws leaves out fields that are null.
    return c.select("case_id", F.concat_ws("\n", *(F.concat(F.lit(f"{label}: "), F.col(name)) for label, name in fields)).alias("text"))


def with_embeddings(texts: DataFrame, provider=None) -> DataFrame | None:
    """case_id, embedding by a provider (a mapInPandas function from case_id, text); None without one, so that signals alone decide."""
    if provider is None:
        return None
    case = texts.schema["case_id"].dataType.simpleString()
    return texts.select("case_id", "text").mapInPandas(provider, f"case_id {case}, embedding array<double>")
