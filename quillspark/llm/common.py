"""Shared parts of the training-data operators: column picking, written
intermediate tables, connected components, and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes handled at once inside a Python worker; longer texts form a chunk of their own.
CHUNK_BYTES = 1 << 20
#: Rows handled at once, so that a row number fits into 16 bits.
CHUNK_ROWS = 1 << 15
#: Largest table that is sent to every executor, in bytes and in rows; beyond it a shuffled join is used.
BROADCAST_BYTES, BROADCAST_ROWS = 16 << 20, 200_000
#: A key with more than this share of a table's rows is joined by broadcast: there are at most 1 / HEAVY of them.
HEAVY = 1 / 2000


# ---------------------------------------------------------------- tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **types: str) -> DataFrame:
    """The named columns, cast; exact names win, so extra columns that differ
    only in case, or share a name with an internal column, do no harm."""
    names = df.columns
    plain = df.toDF(*(f"_p{i}" for i in range(len(names))))
    return plain.select(*(F.col(f"_p{names.index(c)}").cast(t).alias(c) for c, t in types.items()))


def row_key(doc_id, text):
    """128 bits that stand for a row's id and text; a null text counts as an empty one."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.unhex(F.md5(F.concat(F.coalesce(c(doc_id).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(c(text), F.lit("")))))


def share(key, rows: int, of: int):
    """A condition that keeps about `rows` of `of` rows by a 64-bit hash column; exact at every size."""
    if rows >= of:
        return F.lit(True)
    return key < F.lit((rows << 64) // of - (1 << 63))


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or, only
    where that is unset and the session is local (tests), a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillspark-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    # What was shuffled for the table goes with the write; else it stays until the driver happens to collect its garbage.
    conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes a table that written() has made, once all that is read of it is written itself."""
    jvm, path = df.sparkSession._jvm, df.inputFiles()[0].rpartition("/")[0]
    folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
    folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def _bytes(field: T.StructField):
    """About how many bytes a value takes."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return F.lit(8)


def fits(df: DataFrame, most: int | None = None, rows: int | None = None) -> bool:
    """Whether df has at most `most` bytes (BROADCAST_BYTES) and `rows` rows (BROADCAST_ROWS), which are counted."""
    most, rows = BROADCAST_BYTES if most is None else most, BROADCAST_ROWS if rows is None else rows
    sized = df.limit(rows + 1).select(sum((_bytes(f) for f in df.schema), F.lit(16)).alias("b")).agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return sized["n"] <= rows and sized["b"] <= most


def small(df: DataFrame, most: int | None = None, rows: int | None = None) -> DataFrame:
    """Marks df for broadcast if it fits; else it joins by shuffle."""
    return F.broadcast(df) if fits(df, most, rows) else df


def join_sized(left: DataFrame, right: DataFrame, key: str | list[str], spread: str, rows: int | None = None) -> DataFrame:
    """left joined to right, which is sent to all tasks if it fits; else both are shuffled, and left's hot keys are dealt by the column spread."""
    return left.join(F.broadcast(right), key) if fits(right, rows=rows) else join_salted(left, right, key, spread)


def join_skewed(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """left joined to right, which has one row for each key and the number n of its rows in left, of total. Keys with more than
    HEAVY of all rows, of which there can only be 1 / HEAVY, are broadcast, so that no task gets all rows of one."""
    limit = max(1, int(total * HEAVY))
    heavy = right.where(F.col(n) > limit)
    rest = left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(right.where(F.col(n) <= limit), key)
    return left.join(F.broadcast(heavy), key).unionByName(rest)


def join_salted(left: DataFrame, right: DataFrame, key: str | list[str], spread: str) -> DataFrame:
    """left joined to right, which has one row, or few, for each key. Keys with more than HEAVY of left's rows, of which there can only be
    1 / HEAVY, are dealt by the column spread over several tasks, which all get right's rows."""
    key = [key] if isinstance(key, str) else key
    counts = left.groupBy(*key).agg(F.count("*").alias("_n"))
    limit = max(1, int(left.count() * HEAVY))
    heavy = F.broadcast(counts.where(F.col("_n") > limit).select(*key, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(heavy, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_parts")
    copies = right.join(heavy, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [*key, "_salt"]).drop("_salt")


def let(value, body):
    """body(value) with value computed once: the optimizer may copy a column into
    a lambda that names it, where it would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


# ---------------------------------------------------------------- components


def _stars(e: DataFrame) -> bool:
    """Whether each node points to one node that points nowhere."""
    ends = e.selectExpr("u", "1 n", "0 head").union(e.selectExpr("v u", "0 n", "1 head"))
    return ends.groupBy("u").agg(F.sum("n").alias("n"), F.max("head").alias("head")).where("n > 1 or n = 1 and head = 1").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star.

    edges: (a, b) of one orderable type. Returns (node, component), where component
    is the least node; nodes without an edge do not occur. A star round moves
    edges, never expands them; minima are pre-aggregated, so hubs do not pile up."""
    e = edges.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) u", "least(a, b) v").distinct()
    e = written(e, "edges")
    for _ in range(max_rounds):
        if _stars(e):
            return e.selectExpr("u node", "v component").union(e.selectExpr("v node", "v component").distinct())
        # There are at most twice as many nodes as edges: few of them are sent to all tasks.
        side = F.broadcast if 2 * e.count() <= BROADCAST_ROWS else lambda df: df
        both = e.union(e.selectExpr("v u", "u v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(side(low), "u").where("v > u and v <> m").selectExpr("v u", "m v").union(low.where("u <> m").selectExpr("u", "m v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = written(e.join(side(low), "u").where("v <> m").selectExpr("v u", "m v").union(low.selectExpr("u", "m v")).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


# ---------------------------------------------------------------- numpy text

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as doubles in [0, 1)."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        m = max(n, CHUNK_BYTES + 1)
        up, down = np.full(m, _R), np.full(m, _RINV)
        up[0] = down[0] = 1
        _POWERS["p"], _POWERS["q"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["p"], _POWERS["q"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 offsets of a string column; nulls count as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunked(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of text each, so that the work arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            to = min(to, at + CHUNK_ROWS)
            yield batch.slice(at, to - at)
            at = to


def word_hashes(raw: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE, fold: np.ndarray = FOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of concatenated texts, split at the bytes in sep: 64-bit hashes of
    the folded bytes, first byte, end byte (exclusive), and row number."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    inside = ~sep[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    p, q = _powers(n + 1)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[fold[raw]] * p[:n], out=c[1:])
    h = mix((c[end] - c[start]) * q[start] ^ (end - start).astype(np.uint64))
    return h, start, end, np.searchsorted(off, start, "right") - 1


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words within a row, and their rows; a row of fewer
    words, but not none, gives one shingle of all its words."""
    counts = np.bincount(row, minlength=n_rows)
    at = np.concatenate(([0], np.cumsum(counts)))
    n = len(h)
    if n >= k:
        s = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            s = s * np.uint64(0xD6E8FEB86659FD93) + h[j : n - k + 1 + j]
        whole = row[: n - k + 1] == row[k - 1 :]
        s, r = mix(s[whole]), row[: n - k + 1][whole]
    else:
        s, r = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for i, d in enumerate(short):
            x = np.uint64(counts[d])
            for w in h[at[d] : at[d + 1]].tolist():
                x = np.uint64((int(x) * 0xD6E8FEB86659FD93 + w) & 0xFFFFFFFFFFFFFFFF)
            extra[i] = x
        s, r = np.concatenate((s, mix(extra))), np.concatenate((r, short))
        order = np.argsort(r, kind="stable")
        s, r = s[order], r[order]
    return s, r
