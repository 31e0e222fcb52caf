"""Exact similar pairs by blocks of alike cases, with bounds that rule most pairs of blocks out.

Cases are dealt to the most similar of 2 n / BLOCK pivots, and pivots with many are split, so a block holds cases that are alike. A block's summary
has the signals that occur in it, the least and greatest weight of a case, and the centroid of its embeddings with the greatest angle
from it. From a case and a summary follows the most that the case can score in the block:

* shared weight s is at most that of the case's signals that occur in the block, and at most the block's greatest total; with the least
  total t that goes with it, Jaccard is at most s / (own + max(s, t) - s);
* the angle to any embedding of the block is at least the angle to the centroid less the block's greatest one.

A pair of blocks is compared (one matrix product) only if some case of either could still get a better neighbour there than its
present eighth. Blocks visit their most promising partners first, a few a round and then more, until no pair is left that could change
anything, so the result is that of comparing all pairs.

Cases with equal profiles are one kind, and only kinds are compared, each under its least case: of equal scores the least case comes first, so a
case's best are among the first cases of its own kind and of the best kinds. Pairs of kinds become pairs of cases as they are read.

The disk that comparing takes is in proportion to the cases: a round moves at most MOVED copies of each profile and frees what it has shuffled, and
all pairs above a score come from a product of packed blocks, which is not shuffled."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quillspark import constants as K
from quillspark.sources.scratch import drop, materialize

#: Cases of a block, signals of a matrix product, summaries that a group bounds at once, blocks of such a group.
BLOCK, SIGNALS, SUMMARIES, TOGETHER = 1024, 4096, 2048, 16
#: Blocks up to which all pairs are compared at once: bounds would take longer than they save.
DIRECT = 8
#: Partners that a block visits in the first round, and how many times more in each later one.
FIRST, MORE = 2, 4
#: Copies of each profile that are shuffled at once; below LEAST_MOVED rows in all it doesn't matter.
MOVED, LEAST_MOVED = 8, 200_000
#: All pairs above a score: blocks of few cases, cases of one kind that are paired as one list, rows that are sent to all tasks.
SPLIT, LIST, SENT = 16, 256, 200_000
#: Scores are compared after rounding to nine digits; bounds get that much more.
SLACK = 1e-8


# ---------------------------------------------------------------- scores


def common_weights(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """Weights of the shared signals, left x right."""
    keys = [np.concatenate(side["keys"].to_list()) for side in (left, right)]
    weights = np.concatenate(left["weights"].to_list())
    kinds = np.intersect1d(*keys)
    rows = [np.repeat(np.arange(len(side)), side["keys"].map(len)) for side in (left, right)]
    out = np.zeros((len(left), len(right)))
    at = [np.searchsorted(kinds, k) for k in keys]
    known = [(a < len(kinds)) & (kinds[np.minimum(a, len(kinds) - 1)] == k) if len(kinds) else np.zeros(len(k), bool) for a, k in zip(at, keys, strict=True)]
    for lo in range(0, len(kinds), SIGNALS):
        width = min(SIGNALS, len(kinds) - lo)
        sides = []
        for n, (row, a, ok) in zip(map(len, (left, right)), zip(rows, at, known, strict=True), strict=True):
            here = ok & (a >= lo) & (a < lo + width)
            m = np.zeros((n, width))
            m[row[here], a[here] - lo] = 1.0 if sides else weights[here]
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def cosines(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Cosines, left x right; not a number where one is missing or zero, or lengths differ."""
    out = np.full((len(left), len(right)), np.nan)
    sizes = [np.array([-1 if e is None else len(e) for e in side]) for side in (left, right)]
    for d in np.intersect1d(*sizes):
        if d > 0:
            at = [np.flatnonzero(s == d) for s in sizes]
            x, y = (np.array(side.iloc[i].to_list(), float) for side, i in zip((left, right), at, strict=True))
            norms = np.sqrt((x**2).sum(axis=1)[:, None] * (y**2).sum(axis=1)[None, :])
            with np.errstate(divide="ignore", invalid="ignore"):
                out[np.ix_(*at)] = np.where(norms > 0, x @ y.T / norms, np.nan)
    return out


def totals(side: pd.DataFrame) -> np.ndarray:
    return np.array([np.sum(w) for w in side["weights"]], float)


def blend(signal: np.ndarray, semantic: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(semantic), signal, K.SIGNAL_SHARE * signal + K.SEMANTIC_SHARE * semantic)


def scores(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shared weight, Jaccard, cosine and blend, left x right."""
    shared = common_weights(left, right)
    signal = shared / np.maximum(totals(left)[:, None] + totals(right)[None, :] - shared, 1e-300)
    semantic = cosines(left["e"], right["e"])
    return shared, signal, semantic, blend(signal, semantic)


def _best(score: np.ndarray, ok: np.ndarray, top: int) -> np.ndarray:
    """Which cells are among the best `top` of their row; of equal scores the first columns."""
    if score.shape[1] <= top:
        return ok
    low = -np.where(ok, np.round(score, 9), -np.inf)
    last = np.partition(low, top - 1, axis=1)[:, top - 1 : top]
    better, equal = low < last, low == last
    return (better | equal & (equal.cumsum(axis=1) <= top - better.sum(axis=1, keepdims=True))) & ok


NAMES = ("case_a", "case_b", "signal_score", "semantic_score", "combined_score")


def _cells(left: pd.DataFrame, right: pd.DataFrame, min_score: float, top: int | None) -> list[np.ndarray]:
    """case_a < case_b and scores (not a number where there is none) of pairs of left and right, or of those among the best `top` of either case."""
    left, right = (side.sort_values("case_id", kind="stable") for side in (left, right))
    shared, signal, semantic, score = scores(left, right)
    a, b = left["case_id"].to_numpy(), right["case_id"].to_numpy()
    ok = (shared > 0) & (score >= min_score) & (a[:, None] != b[None, :])
    if top is not None:
        ok = _best(score, ok, top) | _best(score.T, ok.T, top).T
    if len(np.intersect1d(a, b)):  # where blocks share cases, a pair lies on both sides of the diagonal
        p, q = np.minimum(np.searchsorted(a, b), len(a) - 1), np.minimum(np.searchsorted(b, a), len(b) - 1)
        ok &= ~((a[:, None] > b[None, :]) & (a[p] == b)[None, :] & (b[q] == a)[:, None] & ok[p[None, :], q[:, None]])
    x, y = np.nonzero(ok)
    swap = a[x] > b[y]
    return [np.where(swap, b[y], a[x]), np.where(swap, a[x], b[y]), signal[x, y], semantic[x, y], score[x, y]]


def _schema(case: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in zip(NAMES, (case, case, *[T.DoubleType()] * 3), strict=True)])


def compare(left: DataFrame, right: DataFrame, pairs: DataFrame, min_score: float = K.MIN_SIMILARITY, top: int | None = None) -> DataFrame:
    """Pairs of cases of the pairs of blocks (i of left, j of right)."""

    def group(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({n: [] for n in NAMES})
        cells = dict(zip(NAMES, _cells(x, y, min_score, top), strict=True))
        cells["semantic_score"] = pd.Series(cells["semantic_score"]).astype(object).where(~np.isnan(cells["semantic_score"]), None)
        return pd.DataFrame(cells)

    # Both sides may be one table: aliases keep their columns apart.
    side = lambda df, key: df.select(*(F.col(c).alias(c) for c in ("case_id", "keys", "weights", "e")), F.col("block").alias(key)).join(pairs.select(F.col("i").alias("i"), F.col("j").alias("j")), key)
    return side(left, "i").groupBy("i", "j").cogroup(side(right, "j").groupBy("i", "j")).applyInPandas(group, _schema(left.schema["case_id"].dataType))


def _rounds(pairs: int, blocks: int, cases: int) -> int:
    """How many rounds share the pairs of blocks, so that one moves MOVED copies of each case or fewer."""
    return max(1, -(-2 * pairs * cases // (blocks * max(MOVED * cases, LEAST_MOVED))))


def _share(pairs: DataFrame, rounds: int, r: int) -> DataFrame:
    return pairs if rounds == 1 else pairs.where(F.pmod(F.xxhash64("i", "j"), F.lit(rounds)) == r)


# ---------------------------------------------------------------- blocks


def _nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """For each case of left the most similar pivot of right."""
    out = [pd.DataFrame({"case_id": [], "pivot": [], "score": []})]
    for lo in range(0, len(left) if len(right) else 0, BLOCK):
        part = left.iloc[lo : lo + BLOCK]
        score = scores(part, right)[3]
        best = score.argmax(axis=1)
        out.append(pd.DataFrame({"case_id": part["case_id"].to_numpy(), "pivot": right["pivot"].to_numpy()[best], "score": score[np.arange(len(part)), best]}))
    return pd.concat(out[1:] or out)


def with_blocks(profiles: DataFrame, block: int = BLOCK) -> DataFrame:
    """profiles (case_id, keys, weights, e) with block: cases that share a nearest pivot, at most about `block` of them."""
    n = profiles.count()
    if n <= block:
        return profiles.withColumn("block", F.lit("0"))
    groups, wanted = -(-n // (TOGETHER * block)), -(-2 * n // block)
    salt = F.xxhash64(F.lit("pivot"), "case_id")
    pivots = materialize(profiles.orderBy(salt, "case_id").limit(wanted).select("keys", "weights", "e", F.col("case_id").cast("string").alias("pivot")), "pivots")
    # A group holds TOGETHER blocks of cases and SUMMARIES pivots, so the pivots are copied for few groups.
    chunks = -(-wanted // SUMMARIES)
    left = profiles.withColumn("g", F.pmod(F.xxhash64("case_id"), F.lit(groups)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = pivots.withColumn("c", F.pmod(F.xxhash64("pivot"), F.lit(chunks)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    case = profiles.schema["case_id"].dataType.simpleString()
    near = left.groupBy("g", "c").cogroup(right.groupBy("g", "c")).applyInPandas(_nearest, f"case_id {case}, pivot string, score double")
    near = materialize(near.groupBy("case_id").agg(F.max_by("pivot", F.struct("score", "pivot")).alias("pivot")), "nearest")
    pieces = near.groupBy("pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("pieces"))
    named = near.join(pieces, "pivot").select("case_id", F.concat_ws(":", "pivot", F.pmod(F.xxhash64("case_id"), F.col("pieces")).cast("string")).alias("block"))
    out = materialize(profiles.join(named, "case_id"), "blocks")
    drop(pivots, near)
    return out


def hashed_blocks(profiles: DataFrame, block: int = BLOCK) -> DataFrame:
    """profiles with block, of about `block` cases by hash: for those that all have to be compared."""
    return profiles.withColumn("block", F.pmod(F.xxhash64("case_id"), F.lit(max(1, -(-profiles.count() // block)))).cast("string"))


def _summary(rows: pd.DataFrame) -> pd.DataFrame:
    t = totals(rows)
    sizes = {0 if e is None else len(e) for e in rows["e"]}
    centre, reach, gaps = None, np.pi, True
    if len(sizes) == 1 and sizes != {0}:
        x = np.array(rows["e"].to_list(), float)
        norms = np.sqrt((x**2).sum(axis=1))
        if (norms > 0).all() and np.isfinite(norms).all():
            x /= norms[:, None]
            mean = x.sum(axis=0)
            length = np.sqrt((mean**2).sum())
            gaps = False
            if length > 1e-9:
                centre = mean / length
                reach = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "keys": [np.unique(np.concatenate(rows["keys"].to_list()))], "least": [t.min()], "most": [t.max()], "centre": [centre], "reach": [reach], "gaps": [gaps]})


SUMMARY = "block string, keys array<long>, least double, most double, centre array<double>, reach double, gaps boolean"


def summaries(blocks: DataFrame) -> DataFrame:
    return materialize(blocks.groupBy("block").applyInPandas(_summary, SUMMARY), "summaries")


def bounds(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """The most that a case of left can score in a block that right sums up; -inf where they share no signal."""
    shared = np.minimum(common_weights(left, right), right["most"].to_numpy()[None, :])
    other = np.maximum(shared, right["least"].to_numpy()[None, :])
    signal = shared / np.maximum(totals(left)[:, None] + other - shared, 1e-300)
    angle = np.arccos(np.clip(cosines(left["e"], right["centre"]), -1, 1)) - right["reach"].to_numpy()[None, :] - 1e-7
    semantic = np.where(np.isnan(angle), 1.0, np.cos(np.clip(angle, 0, np.pi)))
    both = K.SIGNAL_SHARE * signal + K.SEMANTIC_SHARE * semantic
    # Without an embedding on either side signals alone decide.
    alone = np.array([e is None for e in left["e"]])[:, None] | right["gaps"].to_numpy(bool)[None, :]
    best = np.where(alone, np.maximum(signal, both), both)
    return np.where(shared > 0, best + SLACK, -np.inf)


def _promising(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Blocks where a case of left could still find something, and the most that one could."""
    out = [pd.DataFrame({"i": [], "j": [], "bound": []})]
    for name, part in left.groupby("block", sort=False) if len(right) else ():
        b = bounds(part, right)
        b = np.where(b >= part["least"].to_numpy()[:, None], b, -np.inf).max(axis=0)
        at = np.flatnonzero(b > -np.inf)
        out.append(pd.DataFrame({"i": name, "j": right["block"].to_numpy()[at], "bound": b[at]}))
    return pd.concat(out[1:] or out)


def promising(blocks: DataFrame, sums: DataFrame, least: DataFrame | None, min_score: float) -> DataFrame:
    """i, j, bound: blocks j in which a case of block i could score at least its own (case_id, least), or min_score."""
    n = sums.count()
    chunks = -(-n // SUMMARIES)
    rows = blocks if least is None else blocks.join(least, "case_id", "left")
    rows = rows.withColumn("least", F.coalesce(F.col("least") if least is not None else F.lit(None).cast("double"), F.lit(min_score)))
    groups = -(-n // TOGETHER)
    left = rows.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = sums.withColumn("c", F.pmod(F.xxhash64("block", F.lit("c")), F.lit(chunks)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return left.groupBy("g", "c").cogroup(right.groupBy("g", "c")).applyInPandas(_promising, "i string, j string, bound double")


# ---------------------------------------------------------------- kinds


def distinct(profiles: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """One of each kind of equal profiles, under its least case, and kind and case_id of all cases; None for these where no two are equal."""
    least = profiles.groupBy("stamp").agg(F.min("case_id").alias("kind"))
    copies = materialize(profiles.select("case_id", "stamp").join(least, "stamp").select("kind", "case_id"), "copies")
    n = copies.agg(F.count("*").alias("cases"), F.count_if(F.col("kind") == F.col("case_id")).alias("kinds")).first()
    if n["cases"] == n["kinds"]:
        drop(copies)
        return profiles, None
    return materialize(profiles.join(copies.where("kind = case_id").select("case_id"), "case_id", "left_semi"), "kinds"), copies


def _alike(kinds: DataFrame, copies: DataFrame, min_score: float) -> DataFrame:
    """case_id and the scores that a case has with its equals, of kinds with two or more cases; computed as for any pair."""
    several = copies.groupBy("kind").agg(F.count("*").alias("n")).where("n > 1").select(F.col("kind").alias("case_id"))
    square = F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)
    norm = F.sqrt(F.col("_q") * F.col("_q"))
    rows = kinds.join(several, "case_id", "left_semi").where(F.aggregate("weights", F.lit(0.0), lambda s, x: s + x) > 0).withColumn("_q", square)
    rows = rows.select("case_id", F.lit(1.0).alias("signal_score"), F.when((norm > 0) & ~F.isnan(norm), F.col("_q") / norm).alias("semantic_score"))
    rows = rows.withColumn("semantic_score", F.when(~F.isnan("semantic_score"), F.col("semantic_score")))
    blended = F.coalesce(K.SIGNAL_SHARE * F.col("signal_score") + K.SEMANTIC_SHARE * F.col("semantic_score"), F.col("signal_score"))
    return rows.withColumn("combined_score", blended).where(F.col("combined_score") >= min_score)


def _spread(best: DataFrame, kinds: DataFrame, copies: DataFrame, top: int, min_score: float) -> DataFrame:
    """The best `top` rows of each case from those of each kind."""
    number = F.row_number().over(W.partitionBy("kind").orderBy("case_id"))
    first = copies.withColumn("_n", number).where(F.col("_n") <= top + 1).select(F.col("kind").alias("other_id"), F.col("case_id").alias("_o"))
    own = _alike(kinds, copies, min_score)
    rows = best.unionByName(own.select("case_id", F.col("case_id").alias("other_id"), *NAMES[2:]))
    # A case of the kind may be one of its list.
    rows = best_of(rows.join(first, "other_id").select("case_id", F.col("_o").alias("other_id"), *NAMES[2:]), top + 1)
    rank = F.struct((-F.round("combined_score", 9)).alias("_s"), "other_id", *NAMES[2:])
    lists = rows.groupBy(F.col("case_id").alias("kind")).agg(F.array_sort(F.collect_list(rank)).alias("_l"))
    lists = materialize(lists, "lists")
    if lists.count() * (top + 1) <= SENT:
        lists = F.broadcast(lists)
    each = copies.join(lists, "kind").select("case_id", F.slice(F.filter("_l", lambda x: x["other_id"] != F.col("case_id")), 1, top).alias("_l"))
    return each.select("case_id", F.inline("_l")).drop("_s")


# ---------------------------------------------------------------- pairs


def _dealt(profiles: DataFrame, block: int, direct: int) -> tuple[DataFrame, DataFrame, int] | None:
    """Few profiles dealt to blocks by hash, all pairs of blocks, and how many; None for more than `direct` blocks of them."""
    wanted = max(1, -(-profiles.count() // block))
    if wanted > direct:
        return None
    blocks = profiles.withColumn("block", F.pmod(F.xxhash64("case_id"), F.lit(wanted)).cast("string"))
    pairs = [(str(i), str(j)) for i in range(wanted) for j in range(i, wanted)]
    return blocks, profiles.sparkSession.createDataFrame(pairs, "i string, j string"), len(pairs)


def _packed(blocks: DataFrame, name: str) -> DataFrame:
    """One row for each block: its cases as a list."""
    return blocks.groupBy(F.col("block").alias(name)).agg(F.collect_list(F.struct("case_id", "keys", "weights", "e")).alias(f"{name}_cases"))


def _unpacked(cases: pa.StructArray) -> pd.DataFrame:
    return pd.DataFrame({n: x.to_pandas() for n, x in zip(("case_id", "keys", "weights", "e"), cases.flatten(), strict=True)})


def _product(min_score: float):
    """All pairs of the pairs of packed blocks that reach min_score."""

    def run(batches):
        known: tuple = (None, None)  # of one block on the left there are many rows in a row
        for b in batches:
            names, left, right = b.column("i").to_pylist(), b.column("i_cases"), b.column("j_cases")
            for r, name in enumerate(names):
                if known[0] != name:
                    known = (name, _unpacked(left[r].values))
                a, c, *scored = _cells(known[1], _unpacked(right[r].values), min_score, None)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), *(pa.array(x, mask=np.isnan(x)) for x in scored)], list(NAMES))

    return run


def _pairs_of_kinds(profiles: DataFrame, min_score: float, block: int, direct: int) -> DataFrame:
    n = profiles.count()
    pairs = None
    if n <= block * direct:
        blocks = hashed_blocks(profiles, max(1, min(block, -(-n // SPLIT))))
    else:
        blocks = with_blocks(profiles, block)
        pairs = materialize(promising(blocks, summaries(blocks), None, min_score).select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct(), "pairs")
    packed = materialize(_packed(blocks, "i"), "packed")
    many = packed.count()
    parts = max(1, min(many, SPLIT // 2), -(-many // SPLIT))
    # So many files are read as about so many partitions, and each pair of them is a task.
    packed = materialize(packed.repartition(parts), "packed")
    both = packed.hint("shuffle_replicate_nl").join(packed.toDF("j", "j_cases"), F.col("i") <= F.col("j"))
    if pairs is not None and pairs.count() <= SENT:  # beyond that all pairs are compared
        both = both.join(F.broadcast(pairs), ["i", "j"], "left_semi")
    return both.select("i", "i_cases", "j_cases").mapInArrow(_product(min_score), _schema(profiles.schema["case_id"].dataType))


def above(profiles: DataFrame, min_score: float, block: int = BLOCK, direct: int = DIRECT, digits: int | None = None) -> DataFrame:
    """All pairs that reach min_score: case_a < case_b and their scores, rounded to so many digits. They are made as they are read: none is shuffled or kept."""
    kinds, copies = distinct(profiles)
    pairs = _pairs_of_kinds(kinds, min_score, block, direct)
    if copies is not None:
        pairs = pairs.union(_alike(kinds, copies, min_score).select(F.col("case_id").alias("case_a"), F.col("case_id").alias("case_b"), *NAMES[2:]))
    if digits is not None:
        pairs = pairs.withColumns({n: F.round(n, digits) for n in NAMES[2:]})
    if copies is None:
        return pairs
    pieces = copies.groupBy("kind").agg(F.ceil(F.count("*") / LIST).alias("pieces"))
    lists = copies.join(pieces, "kind").groupBy("kind", F.pmod(F.xxhash64("case_id"), F.col("pieces"))).agg(F.collect_list("case_id").alias("x"))
    lists = materialize(lists.select("kind", "x"), "lists")
    side = lambda c, x: lists.select(F.col("kind").alias(c), F.col("x").alias(x))
    sent = F.broadcast if copies.count() <= 4 * SENT else lambda df: df
    pairs = pairs.join(sent(side("case_a", "x")), "case_a").join(sent(side("case_b", "y")), "case_b")
    pairs = pairs.withColumn("x", F.explode("x")).withColumn("y", F.explode("y")).where("case_a <> case_b or x < y")
    return pairs.select(F.least("x", "y").alias("case_a"), F.greatest("x", "y").alias("case_b"), *NAMES[2:])


def directed(pairs: DataFrame) -> DataFrame:
    """Each pair from either of its cases: case_id, other_id and the pair's columns."""
    rest = [c for c in pairs.columns if c not in ("case_a", "case_b")]
    return pairs.selectExpr("case_a case_id", "case_b other_id", *rest).union(pairs.selectExpr("case_b case_id", "case_a other_id", *rest))


def best_of(rows: DataFrame, top: int) -> DataFrame:
    """The best `top` rows (case_id, other_id, combined_score, ...) of each case."""
    rank = F.row_number().over(W.partitionBy("case_id").orderBy(F.desc(F.round("combined_score", 9)), "other_id"))
    return rows.withColumn("_r", rank).where(F.col("_r") <= top).drop("_r")


@dataclass
class Search:
    """What a search for the best neighbours gave: directed rows (case_id, other_id, scores), and how much of the work it took."""

    best: DataFrame
    blocks: int
    compared: int
    rounds: int


def nearest(profiles: DataFrame, top: int = K.TOP_NEIGHBOURS, min_score: float = K.MIN_SIMILARITY, block: int = BLOCK, direct: int = DIRECT) -> Search:
    """The best `top` neighbours of each case, exactly."""
    kinds, copies = distinct(profiles)
    found = _search(kinds, top, min_score, block, direct)
    if copies is not None:
        found.best = materialize(_spread(found.best, kinds, copies, top, min_score), "best")
    return found


def _search(profiles: DataFrame, top: int, min_score: float, block: int, direct: int) -> Search:
    few = _dealt(profiles, block, direct)
    if few is not None:
        best = best_of(directed(compare(few[0], few[0], few[1], min_score, top)), top)
        return Search(materialize(best, "best"), max(1, -(-profiles.count() // block)), few[2], 1)
    blocks = with_blocks(profiles, block)
    ids = blocks.select("block").distinct()
    n, cases = ids.count(), blocks.count()
    own = ids.select(F.col("block").alias("i"), F.col("block").alias("j"))
    sums = summaries(blocks)
    best, visited, visits, rounds = None, own.limit(0), FIRST, 0
    while True:
        least = None
        if best is not None:
            full = best.groupBy("case_id").agg(F.count("*").alias("n"), F.min("combined_score").alias("least"))
            least = full.where(F.col("n") >= top).select("case_id", (F.col("least") - SLACK).alias("least"))
        left = promising(blocks, sums, least, min_score).withColumns({"lo": F.least("i", "j"), "hi": F.greatest("i", "j")})
        left = materialize(left.join(visited.select(F.col("i").alias("lo"), F.col("j").alias("hi")), ["lo", "hi"], "left_anti"), "promising")
        # A block's first visit is to itself.
        order = W.partitionBy("i").orderBy((F.col("i") != F.col("j")).cast("int") if best is None else F.lit(0), F.desc("bound"), "j")
        todo = left.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= visits).select(F.col("lo").alias("i"), F.col("hi").alias("j")).distinct()
        todo = materialize(todo, "todo")
        drop(left)
        many = todo.count()
        if not many:
            break
        parts = _rounds(many, n, cases)
        for r in range(parts):
            found = directed(compare(blocks, blocks, _share(todo, parts, r), min_score, top))
            before, best = best, materialize(best_of(found if best is None else best.unionByName(found), top), "best")
            if before is not None:
                drop(before)
        before, visited = visited, materialize(visited.unionByName(todo), "visited")
        drop(todo, *([before] if rounds else []))
        visits, rounds = visits * MORE, rounds + 1
    if best is None:
        best = directed(compare(blocks, blocks, own.limit(0), min_score, top))
    return Search(best, n, visited.count(), rounds)


def between(some: DataFrame, profiles: DataFrame, top: int = K.TOP_NEIGHBOURS) -> DataFrame:
    """Directed rows that hold the best `top` neighbours of some of the cases, and the best of these cases for all others."""
    left, right = hashed_blocks(some), hashed_blocks(profiles)
    ids = [df.select(F.col("block").alias(c), F.lit(1).alias("one")).distinct() for df, c in ((left, "i"), (right, "j"))]
    pairs = materialize(ids[1].join(ids[0], "one").select("i", "j"), "product")
    # A block of either side goes to each of the other.
    cases, n = some.count() + profiles.count(), ids[0].count() + ids[1].count()
    parts, found = _rounds(pairs.count(), max(1, n), cases), None
    for r in range(parts):
        rows = directed(compare(left, right, _share(pairs, parts, r), top=top))
        rows = rows if found is None else found.unionByName(rows)
        before, found = found, materialize(best_of(rows.dropDuplicates(["case_id", "other_id"]), top), "found")
        if before is not None:
            drop(before)
    return found
