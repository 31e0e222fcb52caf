"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are maximal runs of digits, letters and non-ASCII characters after A-Z are lower-cased.
A window is WINDOW consecutive words of a benchmark item; an item of fewer words, but
not none, is one window. Document words inside any occurrence of a window are hit.

Winnowing: every run of GRAM words is hashed; of each WINDOW - GRAM + 1 consecutive
hashes, which cover exactly WINDOW words, the least is kept. Two texts that share WINDOW words share that
least hash, so looking up the kept hashes finds every document that can have a hit. Items shorter than a window have one hash, of all
their words, and texts are looked up by runs of as many. Hits are then extended: only windows and runs whose hash is a benchmark
fingerprint are compared, word by word, with the benchmark's.

Up to KNOWN fingerprints, of 8 bytes each, are looked up in the scan of the texts itself, so that no text is sent anywhere. Beyond
that the texts' distinct fingerprints are joined to them, and texts with a hit are scanned again.

Defined cases: null and empty texts have no words; very long texts are looked up whole; equal rows repeat their result; items
with a null item_id hit words but are not counted; several items with one id count once; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import join_sized, let, pick, row_key, small, table, written

WINDOW = 10
GRAM = 4
KNOWN = 20_000
#: Fingerprints (8 bytes each) beyond that which are sent to all tasks for a join inside the scan of the texts.
PRINTS = 600_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, -1), "")


def _least(words: Column) -> Column:
    """For each window start the least hash of GRAM words inside the window."""
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda i: F.xxhash64(*(F.element_at(words, i + j) for j in range(GRAM))))
    least = let(grams, lambda g: F.transform(F.sequence(F.lit(1), F.size(g) - (WINDOW - GRAM)), lambda i: F.array_min(F.slice(g, i, WINDOW - GRAM + 1))))
    return F.when(n >= WINDOW, least).otherwise(F.array().cast("array<long>"))


def _run_hash(words: Column, at, n: int) -> Column:
    """Hash of n words from a place."""
    return F.xxhash64(*(F.try_element_at(words, (at + j).cast("int") if isinstance(at, Column) else F.lit(at + j)) for j in range(n)), F.lit(n))


def _runs(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: _run_hash(words, i, n))).otherwise(F.array().cast("array<long>"))


def _windows_of(words: Column, lengths: list[int], known) -> Column:
    """(start, len, win) of the windows of a text, and its runs of the lengths of short items, whose hash is known."""

    def some(hashes: Column, n: int) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(hashes)), lambda i: known(F.element_at(hashes, i)))
        return F.when(F.size(hashes) > 0, F.transform(at, lambda i: F.struct(i.alias("start"), F.lit(n).alias("len"), F.array_join(F.slice(words, i, n), " ").alias("win")))).otherwise(F.array().cast("array<struct<start:int,len:int,win:string>>"))

    return F.concat(let(_least(words), lambda m: some(m, WINDOW)), *(_with_runs(words, n, some) for n in lengths))


def _with_runs(words: Column, n: int, some) -> Column:
    return let(_runs(words, n), lambda m: some(m, n))


def _keyed(docs: DataFrame) -> DataFrame:
    return pick(docs, doc_id="long", text="string").withColumn("k", row_key("doc_id", "text"))


def find_windows(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k, n_words) of all documents, and (k, start, len, item_id) of all
    occurrences of benchmark windows; k identifies a document row by id and text."""
    items = pick(items, item_id="string", text="string").withColumn("words", words_of(F.col("text"))).drop("text").where(F.size("words") > 0)
    items = written(items.withColumn("least", let(F.col("words"), _least)), "items")
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1)))
    windows = items.select("item_id", "words", F.explode(starts).alias("s")).select(
        "item_id", F.least(n, F.lit(WINDOW)).alias("len"), F.array_join(F.slice("words", F.col("s"), WINDOW), " ").alias("win")
    )
    windows = written(windows.distinct(), "windows")
    short = items.where(n < WINDOW)
    lengths = sorted(r["n"] for r in short.select(n.alias("n")).distinct().collect())  # fewer than WINDOW
    prints = items.select(F.explode("least").alias("m"))
    for m in lengths:
        prints = prints.union(short.where(n == m).select(_run_hash(F.col("words"), 1, m).alias("m")))
    prints = written(prints.distinct(), "prints")
    some = [r["m"] for r in prints.limit(KNOWN + 1).collect()]  # bounded by KNOWN

    keyed = _keyed(docs)
    if len(some) <= KNOWN:
        near = keyed.select("doc_id", "k", let(words_of(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), _windows_of(w, lengths, lambda x: x.isin(some)).alias("ws"))).alias("f"))
        feats = written(near.select("doc_id", "k", "f.*"), "fingerprints")
        candidates = feats.where(F.size("ws") > 0).select("k", F.explode("ws").alias("w"))
    else:
        prints_of = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), F.array_distinct(F.concat(_least(w), *(_runs(w, m) for m in lengths))).alias("prints")))
        feats = written(keyed.select("doc_id", "k", prints_of.alias("f")).select("doc_id", "k", "f.*"), "fingerprints")
        hits = join_sized(feats.select("k", F.explode("prints").alias("m")), prints, "m", "k", PRINTS)
        hits = written(hits.groupBy("k").agg(F.collect_set("m").alias("ms")), "hits")
        near = keyed.select("k", "text").join(small(hits), "k")
        candidates = near.select("k", F.explode(let(words_of(F.col("text")), lambda w: _windows_of(w, lengths, lambda x: F.array_contains("ms", x)))).alias("w"))
    found = join_sized(candidates.select("k", "w.*"), windows, ["win", "len"], "k").select("k", "start", "len", "item_id").distinct()
    return feats.select("doc_id", "k", "n_words"), written(found, "occurrences")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row per document row."""
    feats, found = find_windows(docs, items)
    seen = W.partitionBy("k").orderBy("start", "len").rowsBetween(W.unboundedPreceding, -1)
    spans = found.select("k", "start", "len").distinct().withColumn("upto", F.max(F.col("start") + F.col("len")).over(seen))
    words = spans.groupBy("k").agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest("start", F.coalesce("upto", "start")))).alias("n_hit"))
    ids = found.where("item_id is not null").select("k", "item_id").distinct().groupBy("k").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("ids"))
    hits = written(words.join(ids, "k", "left"), "contaminated")
    out = feats.join(small(hits), "k", "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def clean_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark window."""
    _, found = find_windows(docs, items)
    names = docs.columns
    k = row_key(F.col("_p%d" % names.index("doc_id")).cast("long"), F.col("_p%d" % names.index("text")).cast("string"))
    keyed = docs.toDF(*(f"_p{i}" for i in range(len(names)))).withColumn("_k", k)
    kept = keyed.join(small(found.select(F.col("k").alias("_k")).distinct()), "_k", "left_anti")
    return kept.drop("_k").toDF(*names)


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s, w FROM b WHERE len(w) > 0),
bt AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM bw),
lens AS (SELECT DISTINCT n FROM bt),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, lens WHERE len(w) >= n),
dt AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS t FROM dw),
f AS (SELECT doc_id, item_id, dt.n, s FROM dt JOIN bt ON dt.t = bt.t AND dt.n = bt.n),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM f) GROUP BY 1),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM f GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)
"""
