"""A kept full-text index with exact top-k by block maxima.

Texts are dealt to blocks of like length, at most about TEXTS of them, and numbered within. For each word and block one table has the
greatest count of the word in a text of the block, and the numbers of the texts that hold it; another has the counts by text, in a folder for each block.
A search reads the first table for the words that its terms prefix. Bitmaps of the numbers, united over words, give each term's document frequency exactly; maxima, added over words,
give the most that a text of a block can score. The most promising blocks are read first, and then those blocks alone that
could still reach the k-th score found there. What comes out equals `search.fulltext` over all texts.

New and changed texts go into a segment of their own, which marks the earlier versions of its texts as dead; reads unite segments and leave the dead out (a
united bitmap with the dead added, less the dead, counts the living). Beyond SEGMENTS they are merged into one."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.sources import sinks
from quillspark.sources.scratch import drop, materialize, shuffles_freed

from .search import query_terms, words_of

#: Texts of a block (a bitmap has room for 32768), blocks that are read first, segments that are not merged.
TEXTS, FIRST, SEGMENTS = 4096, 4, 8
#: Words of a block's texts, about, so that no block of long texts is much more work than others; and words that are counted at once. One text may have more.
MOST_WORDS, WORDS = 1 << 21, 1 << 20


#: A text's different words and how often they occur.
COUNTS = "counts array<struct<word:string,count:bigint>>"


@dataclass
class Found:
    """The best texts (key, score), how many blocks hold a term, and how many of them were read."""

    rows: DataFrame
    blocks: int
    read: int


def _prefixed(terms: list[str]) -> Column:
    """Whether a term prefixes the word; pushed down to the word's row groups."""
    out = F.lit(False)
    for t in terms:
        out = out | F.col("word").startswith(t)
    return out


def _counted(batches):
    """Each text's words to its different words and how often they occur; no text's words are shuffled for that."""
    for b in batches:
        words = b.column("words")
        ends = np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + WORDS, "right")))
            part = b.slice(lo, hi - lo)
            own = part.column("words")
            sizes = own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            coded = own.flatten().dictionary_encode()
            kinds = max(1, len(coded.dictionary))
            pairs, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * kinds + coded.indices.to_numpy(), return_counts=True)
            counts = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(pairs % kinds)), pa.array(n.astype(np.int64))], ["word", "count"])
            offsets = np.searchsorted(pairs, np.arange(len(sizes) + 1) * kinds).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(offsets, counts)], ["key", "length", "counts"])
            lo = hi


class TextIndex:
    def __init__(self, spark: SparkSession, path: str, texts: int = TEXTS):
        self.spark, self.path, self.texts = spark, path, texts

    # ------------------------------------------------------------ segments

    def segments(self) -> list:
        """name, texts and dead of each segment; at most SEGMENTS + 1 rows."""
        rows = sinks.read_table(self.spark, f"{self.path}/segments")
        return [] if rows is None else sorted(rows.collect(), key=lambda r: r["name"])

    def _table(self, name: str, segments=None) -> DataFrame:
        paths = [f"{self.path}/{s['name']}/{name}" for s in (self.segments() if segments is None else segments)]
        tables = [self.spark.read.parquet(p) for p in paths]
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def _key(self) -> str:
        segments = self.segments()
        return self._table("docs", segments).schema["key"].dataType.simpleString() if segments else "bigint"

    def add(self, rows: DataFrame, key: str, text: str = "text") -> None:
        """Indexes new texts, and anew those whose key is there."""
        words = rows.select(F.col(key).alias("key"), F.filter(words_of(F.col(text)), lambda w: w != "").alias("words"))
        kind = words.schema["key"].dataType.simpleString()
        self._segment(materialize(words.mapInArrow(_counted, f"key {kind}, length int, {COUNTS}"), "words"))
        if len(self.segments()) > SEGMENTS:
            self.merge()

    def remove(self, keys: DataFrame, key: str) -> None:
        """Takes texts out: a segment without texts that marks them as dead."""
        self._segment(materialize(keys.select(F.col(key).alias("key"), F.lit(0).alias("length")).distinct(), "removed"), only_dead=True)

    def _segment(self, texts: DataFrame, only_dead: bool = False, replaces=None) -> None:
        """Writes a segment of texts (key, length, counts), a table of materialize that is deleted then."""
        conf, key = self.spark.conf, "spark.sql.requireAllClusterKeysForCoPartition"
        before = conf.get(key)
        conf.set(key, "false")  # tables dealt by block alone are joined as they lie
        try:
            with shuffles_freed(self.spark):
                self._write(texts, only_dead, replaces)
        finally:
            conf.set(key, before)
        drop(texts)

    def _write(self, texts: DataFrame, only_dead: bool, replaces) -> None:
        old = self.segments() if replaces is None else []
        name = f"segment-{max((int(s['name'].split('-')[1]) for s in (old or replaces or [])), default=-1) + 1:06d}-{uuid.uuid4().hex}"
        path = f"{self.path}/{name}"
        if only_dead:
            texts = texts.withColumns({"block": F.lit(""), "counts": F.lit(None).cast(COUNTS.partition(" ")[2])})
            docs = texts.limit(0).select("key", "block", F.lit(0).alias("at"))
        else:
            # Blocks of like length: maxima then tell blocks apart. There are few classes, and each is cut into pieces by hash.
            texts = texts.withColumn("class", F.floor(F.log2(F.col("length") + 1) * 2).cast("int"))
            pieces = texts.groupBy("class").agg(F.ceil(F.greatest(F.count("*") / self.texts, F.sum("length") / MOST_WORDS)).cast("int").alias("pieces"))
            block = F.concat_ws("-", F.lit(name[8:20]), "class", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("string"))
            texts = texts.join(F.broadcast(pieces), "class").select("key", block.alias("block"), "counts")
            docs = texts.select("key", "block").withColumn("at", F.row_number().over(W.partitionBy("block").orderBy("key")) - 1)
        docs.write.parquet(f"{path}/docs")
        docs = self.spark.read.parquet(f"{path}/docs")
        dead = self._live(old).join(texts.select("key"), "key", "left_semi").select("block", "at") if old else docs.limit(0).select("block", "at")
        dead.write.parquet(f"{path}/dead")
        # Whole texts go to their block, where they meet their numbers and words are brought together without another shuffle.
        own = texts.repartition("block").join(docs.repartition("block").hint("shuffle_hash"), ["block", "key"])
        postings = own.select("block", "key", "at", F.inline("counts")).groupBy("block", "word").agg(F.collect_list(F.struct("key", "at", "count")).alias("texts"))
        postings.sortWithinPartitions("block", "word").write.partitionBy("block").parquet(f"{path}/postings")
        if only_dead or docs.isEmpty():
            meta = self.spark.createDataFrame([], "word string, block string, most long, at array<int>")
        else:
            postings = self.spark.read.parquet(f"{path}/postings")
            meta = postings.select("word", F.col("block").cast("string").alias("block"), F.array_max("texts.count").alias("most"), F.col("texts.at").alias("at"))
        meta.repartitionByRange("word").sortWithinPartitions("word").write.parquet(f"{path}/meta")
        row = self.spark.createDataFrame([(name, docs.count(), self.spark.read.parquet(f"{path}/dead").count())], "name string, texts long, dead long")
        if replaces is None:
            sinks.upsert_rows(row, f"{self.path}/segments", ["name"], parts=1)
        else:
            sinks.replace_table(row, f"{self.path}/segments", ["name"], 1)

    def _live(self, segments) -> DataFrame:
        return self._table("docs", segments).join(self._table("dead", segments), ["block", "at"], "left_anti")

    def merge(self) -> None:
        """One segment of all, without the dead."""
        segments = self.segments()
        each = self._postings(segments).select("block", "word", F.inline("texts"))
        each = each.join(self._table("dead", segments), ["block", "at"], "left_anti")
        texts = each.groupBy("key").agg(F.sum("count").cast("int").alias("length"), F.collect_list(F.struct("word", "count")).alias("counts"))
        # Texts without words count among all texts.
        texts = self._live(segments).select("key").join(texts, "key", "left").select("key", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("counts", F.array().cast("array<struct<word:string,count:bigint>>")).alias("counts"))
        self._segment(materialize(texts, "merged"), replaces=segments)

    def _postings(self, segments) -> DataFrame:
        held = [s for s in segments if s["texts"]]
        if not held:
            return self.spark.createDataFrame([], f"word string, texts array<struct<key:{self._key()},at:int,count:bigint>>, block string")
        return self._table("postings", held).withColumn("block", F.col("block").cast("string"))

    # ------------------------------------------------------------ searches

    def _scored(self, postings: DataFrame, segments, terms: list[str]) -> DataFrame:
        """key and the count of each term, of living texts that hold one."""
        each = postings.where(_prefixed(terms)).select("block", "word", F.inline("texts"))
        if any(s["dead"] for s in segments):
            each = each.join(self._table("dead", segments), ["block", "at"], "left_anti")
        return each.groupBy("key").agg(*(F.sum(F.when(F.col("word").startswith(t), F.col("count")).otherwise(0)).alias(f"_c{i}") for i, t in enumerate(terms)))

    def counts(self, query: str) -> DataFrame:
        """key, _c0, _c1, ... of all texts that hold a term of the query: what a search under filters starts from."""
        segments = self.segments()
        return self._scored(self._postings(segments), segments, query_terms(query))

    def top(self, query: str, limit: int = 10) -> Found:
        """The best `limit` texts by score, of equal ones the lesser key."""
        terms, segments = query_terms(query), self.segments()
        n = sum(s["texts"] - s["dead"] for s in segments)
        held = [s for s in segments if s["texts"]]
        none = self.spark.createDataFrame([], f"key {self._key()}, score double")
        if not held:
            return Found(none, 0, 0)
        which = F.filter(F.array(*(F.when(F.col("word").startswith(t), F.lit(i)) for i, t in enumerate(terms))), lambda x: x.isNotNull())
        meta = self._table("meta", held).where(_prefixed(terms)).select("block", "most", "at", F.explode(which).alias("term"))
        dead = self._table("dead", segments).groupBy("block").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("dead"), F.count("*").alias("n_dead"))
        meta = meta.select("block", "term", "most", F.posexplode("at").alias("i", "at"))
        each = meta.groupBy("block", "term").agg(F.sum(F.when(F.col("i") == 0, F.col("most"))).alias("most"), F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits"))
        if any(s["dead"] for s in segments):
            rows = each.select("block", "term", "bits").union(each.select("block", "term").join(dead, "block").select("block", "term", "dead"))
            living = rows.groupBy("block", "term").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n")).join(dead.select("block", "n_dead"), "block", "left")
            each = each.join(living, ["block", "term"]).select("block", "term", "most", (F.col("n") - F.coalesce("n_dead", F.lit(0))).alias("n"))
        else:
            each = each.select("block", "term", "most", F.bitmap_count("bits").alias("n"))
        each = materialize(each.where("n > 0"), "bounds")
        df = {r["term"]: r["df"] for r in each.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # one row a term
        if not df:
            return Found(none, 0, 0)
        idf = lambda i: F.log1p(F.lit(n) / F.lit(df[i]))
        worth = F.lit(0.0)
        for i in df:
            worth = worth + F.when(F.col("term") == i, F.log1p("most") * idf(i)).otherwise(0.0)
        blocks = materialize(each.groupBy("block").agg(F.sum(worth).alias("bound")), "blocks")

        def best(some: DataFrame) -> DataFrame:
            score = F.lit(0.0)
            for i in range(len(terms)):
                score = score + (F.when(F.col(f"_c{i}") > 0, F.log1p(f"_c{i}") * idf(i)).otherwise(0.0) if i in df else F.lit(0.0))
            return self._scored(some, segments, terms).select("key", score.alias("score"))

        order = (F.desc(F.round("score", 9)), F.col("key"))
        first = [r["block"] for r in blocks.orderBy(F.desc("bound"), "block").limit(FIRST).collect()]
        postings = self._postings(segments)
        found = materialize(best(postings.where(F.col("block").isin(first))).orderBy(*order).limit(limit), "found")
        tail = found.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        rest = blocks.where(~F.col("block").isin(first))
        if tail["n"] >= limit:
            rest = rest.where(F.col("bound") >= tail["least"] - 1e-8)
        rest = materialize(rest.select("block"), "rest")
        total, more = blocks.count(), rest.count()
        if more:
            # The block is the folder: only those that are left are opened.
            found = found.unionByName(best(postings.join(F.broadcast(rest) if more <= 100_000 else rest, "block", "left_semi"))).orderBy(*order).limit(limit)
        return Found(found, total, len(first) + more)
