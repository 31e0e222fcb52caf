"""Quantiles, weighted quantiles and day differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.sources.scratch import materialize

#: Rows of an interval that are sorted to find a rank in it, and parts that a larger one is split into.
SORTED, SPLITS = 100_000, 1024


def floor_days(start, end) -> Column:
    """Whole days from start to end, rounded down (negative spans round away from zero)."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))
    return F.floor((micros(end) - micros(start)) / F.lit(86_400_000_000))


def whole_days(start, end) -> Column:
    """Whole days from start to end, rounded towards zero."""
    days = floor_days(start, end)
    back = floor_days(end, start)
    return F.when(days >= 0, days).otherwise(-back)


def quantiles(value, *ps: float, where: Column | None = None) -> list[Column]:
    """Linearly interpolated quantiles, ignoring nulls; a group's distinct values are held in one buffer, so they must be few, like days."""
    v = F.col(value) if isinstance(value, str) else value
    v = v if where is None else F.when(where, v)
    return [F.percentile(v, F.lit(p)) for p in ps]


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, **ps: float) -> DataFrame:
    """Per group the first value, in ascending order, at which the running weight reaches each share of the total.
    Rows without value or with a weight that is not positive are left out. For groups that fit into a task; see exact_quantiles."""
    ok = df.where(F.col(value).isNotNull() & (F.col(weight) > 0) & ~F.isnan(F.col(weight).cast("double")))
    by = W.partitionBy(*keys)
    ok = ok.withColumn("_run", F.sum(weight).over(by.orderBy(value).rangeBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum(weight).over(by))
    return ok.groupBy(*keys).agg(*(F.min(F.when(F.col("_run") >= F.col("_all") * p, F.col(value))).alias(name) for name, p in ps.items()))


def _narrowed(rows: DataFrame, targets: DataFrame, splits: int) -> DataFrame:
    """targets (g, t, goal, lo, hi, before, inside) with the part of their interval in which the running weight reaches the goal."""
    width = (F.col("hi") - F.col("lo")) / splits
    held = rows.join(targets.select("g", "t", "goal", "lo", "hi", "before"), "g").where("v between lo and hi")
    part = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(splits - 1)).alias("part")
    parts = held.groupBy("g", "t", "goal", "before", part).agg(F.sum("w").alias("weight"), F.count("*").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    run = F.col("before") + F.sum("weight").over(W.partitionBy("g", "t").orderBy("part").rowsBetween(W.unboundedPreceding, 0))
    parts = parts.withColumn("run", run)
    # Rounding of weights may leave the goal just above the last sum: the last part then.
    rank = F.row_number().over(W.partitionBy("g", "t").orderBy((F.col("run") < F.col("goal")).cast("int"), F.when(F.col("run") >= F.col("goal"), F.col("part")).otherwise(-F.col("part"))))
    found = parts.withColumn("_r", rank).where("_r = 1")
    return found.select("g", "t", "goal", "lo", "hi", (F.col("run") - F.col("weight")).alias("before"), "inside")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, weight: str | None = None, most: int = SORTED, splits: int = SPLITS, **ps: float) -> DataFrame:
    """keys and a column for each share: linearly interpolated quantiles (like percentile), or with a weight the first value at which the running weight
    reaches the share of the total. Values are finite; rows without value, or with a weight that is not positive, are left out.

    Ranks are found by selection: an interval of more than `most` rows is split, parts are counted (before anything is sent), and only the part
    that holds the rank is looked at again, until few rows are left to sort. No group's values are in one buffer or task."""
    name = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    rows = df.select(name.alias("g"), F.struct(*(keys or [F.lit(0)])).alias("k"), F.col(value).cast("double").alias("v"), w.alias("w")).where(F.col("v").isNotNull() & (F.col("w") > 0))
    rows = materialize(rows.where(~F.isnan(F.col("w").cast("double"))), "values")
    totals = materialize(rows.groupBy("g", "k").agg(F.sum("w").alias("n"), F.count("*").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi")), "totals")
    goals = []
    for x, p in ps.items():
        at = (F.col("n") - 1) * p
        goals += [(x, F.col("n") * p)] if weight else [(f"{x}<", F.floor(at) + 1), (f"{x}>", F.ceil(at) + 1)]
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), goal.cast("double").alias("goal")) for t, goal in goals)))
    rows = rows.select("g", "v", "w")
    targets = totals.select("g", "lo", "hi", "inside", each.alias("x")).select("g", "x.t", "x.goal", "lo", "hi", F.lit(0.0).alias("before"), "inside")
    done = None
    while True:
        targets = materialize(targets, "targets")
        wide = (F.col("inside") > most) & (F.col("lo") < F.col("hi"))
        settled = targets.where(~wide)
        done = settled if done is None else done.unionByName(settled)
        if targets.where(wide).isEmpty():
            break
        targets = _narrowed(rows, targets.where(wide), splits)
    held = rows.join(done.select("g", "t", "goal", "lo", "hi", "before"), "g").where("v between lo and hi")
    values = held.groupBy("g", "t", "goal", "before", "v").agg(F.sum("w").alias("weight"))
    run = F.col("before") + F.sum("weight").over(W.partitionBy("g", "t").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    values = values.withColumn("run", run).groupBy("g", "t").agg(F.coalesce(F.min(F.when(F.col("run") >= F.col("goal"), F.col("v"))), F.max("v")).alias("v"))
    found = values.groupBy("g").agg(*(F.max(F.when(F.col("t") == t, F.col("v"))).alias(f"_{t}") for t, _ in goals))
    out = []
    for x, p in ps.items():
        at = (F.col("n") - 1) * p
        part = at - F.floor(at)
        low, high = F.col(f"`_{x}<`"), F.col(f"`_{x}>`")
        out.append((F.col(f"_{x}") if weight else F.when(low == high, low).otherwise((1 - part) * low + part * high)).alias(x))
    return totals.join(found, "g").select(*(F.col("k")[c].alias(c) for c in keys), *out)


def confidence_band(n, medium: int, high: int) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n >= high, "high").when(n >= medium, "medium").otherwise("low")
