"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Sources, in code point order with null last, weigh 5, 2, 1, repeating, and share EPOCHS times
the words of all documents; a source's target stops at MOST times its own words, and the excess is
shared again by weight until no target is above its stop. Of a source, complete epochs are
taken first; the rest is a weighted sample without replacement: each document draws an
exponential key divided by its quality weight (the share of its words that differ from each other),
and keys are taken in ascending order, prefix-summed, up to the budget; the document at the limit
gives only the words still wanted.

Prefix sums are two-level: keys fall into BUCKETS ordered buckets, whose sums show in which bucket a source's
budget ends; only that bucket's rows are sorted. No source, however large, is ordered in one task.

Defined cases: null texts have size 0 and are taken 0 times; equal rows share a key and follow
each other; an empty table gives no rows; very long texts are counted whole; extra columns are left out,
or kept by mix_rows, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import join_sized, pick, row_key, table, written

WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 1.5
MOST = 2
BUCKETS = 4096
SPACE = r"[\x20\x09-\x0D]+"


def _draw(doc_id: Column, text: Column, weight: Column) -> Column:
    """An exponential key from a hash of the id, or of the text where there is none, over the weight."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit(""))), 1, 13), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / float(2**52)) / weight


def source_targets(sizes: DataFrame) -> DataFrame:
    """src, source_size, target from (src, source_size): water-filling in closed form.

    Ordered by stop / weight, a source is at its stop if the level that the sources from it on could
    reach is above; the first source that isn't sets the level of all after it."""
    total = W.partitionBy()
    order = W.orderBy("src")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    s = sizes.withColumn("weight", weight).withColumn("stop", F.col("source_size").cast("double") * MOST)
    s = s.withColumn("ratio", F.col("stop") / F.col("weight")).withColumn("all", F.sum("source_size").over(total) * EPOCHS)
    before = W.orderBy("ratio", "src").rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy("ratio", "src").rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.col("all") - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(total)["level"])
    return s.select("src", "source_size", F.least("stop", F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and k (identifies a row by id and text)."""
    docs = pick(docs, doc_id="long", text="string", source="string")
    tokens = F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE, -1), "")
    rows = docs.select("doc_id", "source", "text", row_key("doc_id", "text").alias("k"), tokens.alias("w"))
    size = F.size("w")
    weight = F.when(size > 0, F.size(F.array_distinct("w")) / size).otherwise(1.0)
    rows = rows.select("doc_id", "source", "text", "k", size.cast("long").alias("size"), weight.alias("weight"))
    rows = rows.select("doc_id", "source", "k", "size", _draw(F.col("doc_id"), F.col("text"), F.col("weight")).alias("key"))
    # "s..." sorts before "~", so null comes last and joins like any other source.
    rows = rows.withColumn("src", F.when(F.col("source").isNull(), "~").otherwise(F.concat(F.lit("s"), "source")))
    rows = written(rows.withColumn("bucket", F.floor(F.col("key") / (F.col("key") + 1) * BUCKETS)), "sizes")

    sums = written(rows.groupBy("src", "bucket").agg(F.sum("size").alias("words")), "buckets")
    targets = source_targets(sums.groupBy("src").agg(F.sum("words").alias("source_size")))
    whole = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("epochs", epochs).withColumn("rest", whole - F.col("epochs") * F.col("source_size"))
    upto = F.sum("words").over(W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
    ends = sums.withColumn("upto", upto).join(targets, "src").where("upto > rest").groupBy("src").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("cut"))
    targets = written(targets.join(ends, "src", "left"), "targets")

    placed = join_sized(rows, targets, "src", "k")
    cols = ["doc_id", "source", "k", "size", "source_size", "target", "epochs"]
    # Without a cut (an empty source) nothing is taken beyond whole epochs.
    below = placed.where("cut is null or bucket <> cut.bucket").select(*cols, F.when(F.col("bucket") < F.col("cut.bucket"), F.col("size")).otherwise(0).alias("part"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("src").orderBy("key", "doc_id", "k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = placed.where("bucket = cut.bucket").withColumn("left", F.col("rest") - F.col("cut.before") - before)
    edge = edge.select(*cols, F.least("size", F.greatest("left", F.lit(0))).alias("part"))
    return below.union(edge).select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), "k")


def mix_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes words of, with all their columns and size, source_size, target, taken."""
    names = docs.columns
    plain = docs.toDF(*(f"_p{i}" for i in range(len(names))))
    k = row_key(F.col(f"_p{names.index('doc_id')}").cast("long"), F.col(f"_p{names.index('text')}").cast("string"))
    # Rows of one id and text may be taken in different parts: the n-th of them, by all columns, gets the n-th part.
    nth = F.row_number().over(W.partitionBy("_k").orderBy(F.to_json(F.struct(*plain.columns))))
    more = ("size", "source_size", "target", "taken")
    taken = mix(docs).withColumn("_k", F.col("k")).withColumn("_n", F.row_number().over(W.partitionBy("_k").orderBy(F.desc("taken"))))
    taken = written(taken.select("_k", "_n", *(F.col(c).alias(f"_{c}") for c in more)), "taken")
    unique = taken.where("_n > 1").isEmpty()
    taken = taken.where("_taken > 0")
    plain = plain.withColumn("_k", k)
    out = plain.join(taken, "_k") if unique else plain.withColumn("_n", nth).join(taken, ["_k", "_n"])
    return out.select(*(f"_p{i}" for i in range(len(names))), *(f"_{c}" for c in more)).toDF(*names, *more)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(documents: str = "documents") -> str:
    """The same mix in DuckDB SQL over a relation with doc_id, text and source."""
    return f"""
WITH r0 AS (SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {documents}),
r AS (SELECT doc_id, source, len(w)::BIGINT AS size, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
  / CASE WHEN len(w) > 0 THEN len(list_distinct(w))::DOUBLE / len(w) ELSE 1.0 END AS k FROM r0),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
s1 AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight, 2.0::DOUBLE * source_size AS stop, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s0),
s2 AS (SELECT *, stop / weight AS ratio FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(stop) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM s2),
lv AS (SELECT lvl FROM s3 WHERE lvl <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
s4 AS (SELECT source, source_size, least(stop, coalesce((SELECT lvl FROM lv), 0.0) * weight) AS target FROM s3),
s AS (SELECT *, round(target)::BIGINT AS whole, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM s4),
p AS (SELECT r.*, s.source_size, s.target, s.whole, s.epochs, coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, whole - epochs * source_size - before)))::BIGINT AS taken FROM p"""


OP8_SQL = mix_sql()
