"""Line dedup by levelled sorted runs of line hashes, in DataFrame functions only.

`LineRuns` is an index of the lines seen so far that never has a line twice. A batch of documents brings its lines as (h, n, top): 128 bits of the line's
key, the number of the batch's documents that hold it, and their greatest doc_id. It is merged with every run by a sort-merge join: lines that no run
holds (the anti-join) are the batch's own run of level 0, the others are hits, kept beside it as counts. When a level has FANOUT
runs they are merged into one of the next, so that a batch meets at most FANOUT - 1 runs a level. Runs are tables bucketed and sorted by h: merging a batch
or a level moves no run, only the batch's counts, which are summed before they are sent, so a line that every document holds is no hot key.

Batches here are ranges of doc_id, greatest first, so that the document which keeps a line is known from the run that has it. Lines of
documents are then joined with the frequent keys alone, and a document's dropped positions with its text.

Defined cases: a null or empty text is one empty line; a null id is less than any other, and equal to other null ids; each row is a document of its own, and
rows of the greatest id that hold a line keep it, all its repeats included; keys of fewer than MIN_CHARS code points are never dropped; a text without lines left becomes empty;
lines of very long texts are told apart by hash, in time linear in the text; an empty table gives no rows; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_skewed, let, pick, row_key, shared_dir, small, table, written

MIN_CHARS, MIN_DOCS = 40, 5
#: Ranges of doc_id that are added one after the other, and runs of a level that are merged.
BATCHES, FANOUT = 6, 3
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hash(line: Column, min_chars: int) -> Column:
    """128 bits of the line's key in hex; null for keys of fewer code points."""

    def folded(key):
        # lower() is fast, and right for ASCII; it would also fold other letters.
        return F.when(F.length(key) >= min_chars, F.md5(F.when(F.octet_length(key) == F.length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))))

    return let(F.btrim(line, F.lit(SPACE)), folded)


class LineRuns:
    """Levelled sorted runs of (h, n, top) in spark.checkpoint.dir; add() takes any number of batches, frequent() reads what was added."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        # As many buckets as an exchange has partitions: a batch's counts fit the runs without a further one.
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.hits: list[str] = []
        self.rewritten = 0

    def _store(self, df: DataFrame, *parts: str) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        out = df.write.format("parquet").option("path", f"{shared_dir(self.spark)}/{name}").bucketBy(self.buckets, "h").sortBy("h")
        (out.partitionBy(*parts) if parts else out).saveAsTable(name)
        return name

    def _new(self, name: str) -> DataFrame:
        """The lines of a run."""
        return self.spark.table(name).where("fresh").select("h", "n", "top")

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch (h, n, top; h once). Returns it with fresh: whether no earlier batch had the line."""
        seen = F.lit(False)
        for i, run in enumerate(self.runs()):
            batch = batch.join(self._new(run).select("h", F.lit(True).alias(f"in_{i}")), "h", "left")
            seen = seen | F.coalesce(F.col(f"in_{i}"), F.lit(False))
        name = self._store(batch.select("h", "n", "top", (~seen).alias("fresh")), "fresh")
        self.hits.append(name)
        self._put(name, 0)
        return self.spark.table(name)

    def _put(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            self._put(self._merge(self.levels[level]), level + 1)
            self.levels[level] = []

    def _merge(self, runs: list[str]) -> str:
        """One run of several, whose lines differ."""
        both = self._new(runs[0])
        for r in runs[1:]:
            both = both.unionByName(self._new(r))
        self.rewritten += 1
        return self._store(both.repartition(self.buckets, "h").withColumn("fresh", F.lit(True)), "fresh")

    def frequent(self, min_docs: int) -> DataFrame:
        """h, n, top of the lines that at least min_docs documents hold."""
        again = None
        for name in self.hits:
            rows = self.spark.table(name).where("not fresh").select("h", "n", "top")
            again = rows if again is None else again.unionByName(rows)
        out = None
        again = again.groupBy("h").agg(F.sum("n").alias("more"), F.max("top").alias("higher"))
        for run in self.runs():
            total = self._new(run).join(again, "h", "left").select("h", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("top", "higher").alias("top"))
            out = total.where(F.col("n") >= min_docs) if out is None else out.unionByName(total.where(F.col("n") >= min_docs))
        return out

    def drop(self) -> None:
        """Forgets the tables; their files stay in the shared folder like other written tables."""
        for name in {*self.hits, *self.runs()}:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _ranges(docs: DataFrame, batches: int) -> list:
    """Conditions that split docs by doc_id, greatest first; null ids are in the last."""
    if batches < 2:
        return [F.lit(True)]
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    if not cuts:
        return [F.lit(True)]
    within = [(F.col("doc_id") > lo) & (F.col("doc_id") <= hi) for hi, lo in zip(cuts, cuts[1:], strict=False)]
    return [F.col("doc_id") > cuts[0], *within, F.col("doc_id").isNull() | (F.col("doc_id") <= cuts[-1])]


def frequent_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """h, n, top of keys that at least min_docs rows of docs (doc_id, text) hold."""
    runs = LineRuns(docs.sparkSession, fanout)
    for within in _ranges(docs, batches):
        hashes = F.array_distinct(F.array_compact(F.transform(lines_of(F.col("text")), lambda x: line_hash(x, min_chars))))
        held = docs.where(within).select("doc_id", F.explode(hashes).alias("x"))
        runs.add(held.groupBy(F.unhex("x").alias("h")).agg(F.count("*").alias("n"), F.max("doc_id").alias("top")))
    found = written(runs.frequent(min_docs), "frequent")
    runs.drop()
    return found


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, kept (the text of the lines that stay)."""
    docs = pick(docs, doc_id="long", text="string")
    found = frequent_lines(docs, min_chars, min_docs, batches, fanout)
    rows = docs.select("doc_id", "text", row_key("doc_id", "text").alias("k"))
    hashes = F.transform(lines_of(F.col("text")), lambda x: line_hash(x, min_chars))
    held = rows.select("k", "doc_id", F.posexplode(hashes).alias("at", "x")).where("x is not null").select("k", "doc_id", "at", F.unhex("x").alias("h"))
    few = small(found)
    hit = held.join(few, "h") if few is not found else join_skewed(held, found, "h", "n", docs.count())
    hit = hit.where(F.col("top").isNotNull() & F.coalesce(F.col("doc_id") < F.col("top"), F.lit(True)))
    drops = written(hit.groupBy("k").agg(F.collect_list("at").alias("drops")), "drops")
    out = rows.join(drops, "k", "left").select("doc_id", lines_of(F.col("text")).alias("lines"), F.coalesce("drops", F.array().cast("array<int>")).alias("drops"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drops")
    out = out.select("doc_id", "lines", stay.alias("stay"))
    kept = F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n")
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("stay")).cast("long").alias("n_dropped"), kept.alias("kept"))


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH r AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM r),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
f AS (SELECT key, max(doc_id) AS top FROM (SELECT DISTINCT rid, doc_id, key FROM k WHERE length(key) >= 40) GROUP BY key HAVING count(*) >= 5),
d AS (SELECT rid, k.doc_id, pos, line, top IS NOT NULL AND coalesce(k.doc_id < top, true) AS dropped FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256 FROM d GROUP BY rid"""
