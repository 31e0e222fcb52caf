"""Sinks over Parquet tables: keyed upsert, edge upsert, replacement, bounded history, cache, clearing.

A table is a folder of Parquet folders and numbered manifests. A manifest names the table's keys, the number of parts that a hash of
the keys deals its rows over, and the folders of each part; the manifest of the greatest number is the table. An upsert reads and
rewrites only the parts that hold its keys, new cache entries only add a folder to theirs, and a reader of one key opens one part.

A manifest is created under the number after the one that its writer started from, and creation fails where that number exists: of
two writers the later one starts again from the other's table, so no row is lost. (That rests on the file system's exclusive create.) Folders
that no manifest names, of writers that failed, are never read. Of the older manifests KEPT stay, for readers that have opened them."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

KEPT = 1
#: Parts of a table that is not told how many, and folders of a part from which an addition rewrites it.
PARTS, FOLDERS = 16, 8
#: Attempts of a writer that others overtake, and seconds that a reader waits for a manifest that is being written.
ATTEMPTS, PATIENCE = 20, 10
PART = "_part"
#: The part of tables without keys.
WHOLE = "*"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = (f.getPath().getName() for f in fs.listStatus(p))
    return sorted(int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-"))


def _load(spark: SparkSession, path: str, number: int) -> dict:
    """A manifest; one that is just being written is waited for."""
    p, fs = _fs(spark, f"{path}/manifest-{number:010d}")
    for _ in range(PATIENCE * 10):
        stream = fs.open(p)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        if text.endswith("\n"):
            return json.loads(text) | {"number": number}
        time.sleep(0.1)
    raise RuntimeError(f"{path}/manifest-{number:010d} is incomplete: its writer died; delete it to go on from the one before")


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The current manifest: number, keys, parts, schema, folders by part; None for a table that was never written."""
    numbers = _numbers(spark, path)
    return _load(spark, path, numbers[-1]) if numbers else None


def _create(spark: SparkSession, path: str, number: int, content: dict) -> bool:
    """Whether this writer is the one that gave the number's manifest."""
    p, fs = _fs(spark, f"{path}/manifest-{number:010d}")
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName() or fs.exists(p):
            return False
        raise
    out.write((json.dumps(content) + "\n").encode())
    out.close()
    return True


def _delete(spark: SparkSession, path: str, names) -> None:
    for name in names:
        p, fs = _fs(spark, f"{path}/{name}")
        fs.delete(p, True)


def _named(m: dict) -> set[str]:
    return {f for folders in m["folders"].values() for f in folders}


def _commit(spark: SparkSession, path: str, before: dict | None, after: dict) -> bool:
    number = before["number"] + 1 if before else 0
    if not _create(spark, path, number, after):
        return False
    old = [n for n in _numbers(spark, path) if n < number - KEPT]
    gone = [_load(spark, path, n) for n in old]
    _delete(spark, path, (f"manifest-{n:010d}" for n in old))  # the manifest first: folders without one are not read
    if gone:
        kept = _named(after).union(*(_named(_load(spark, path, n)) for n in _numbers(spark, path) if n <= number))
        _delete(spark, path, set().union(*map(_named, gone)) - kept)
    return True


def _retried(spark: SparkSession, path: str, attempt: Callable[[dict | None], tuple[dict, list[str]] | None]) -> None:
    """Runs attempt on the current manifest until its result is the next one; attempt returns the manifest and the folders it wrote."""
    for _ in range(ATTEMPTS):
        before = manifest(spark, path)
        made = attempt(before)
        if made is None or _commit(spark, path, before, made[0]):
            return
        _delete(spark, path, made[1])
    raise RuntimeError(f"{path}: overtaken by other writers {ATTEMPTS} times")


def _part_of(keys: list, parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def _write_parts(df: DataFrame, path: str, keys: list[str], parts: int) -> tuple[str, list[int]]:
    """Writes df dealt by its keys; returns the folder and the parts in it."""
    name = f"data-{uuid.uuid4().hex}"
    dealt = df.withColumn(PART, _part_of(keys, parts))
    dealt.hint("rebalance", PART).write.partitionBy(PART).parquet(f"{path}/{name}")
    p, fs = _fs(df.sparkSession, f"{path}/{name}")
    made = [f.getPath().getName() for f in fs.listStatus(p)]
    return name, sorted(int(n.split("=")[1]) for n in made if n.startswith(f"{PART}="))


def _read(spark: SparkSession, path: str, m: dict, parts=None) -> DataFrame:
    """The rows of a manifest's parts, all or some."""
    schema = T.StructType.fromJson(m["schema"])
    folders = [f for p, fs in m["folders"].items() if parts is None or p == WHOLE or int(p) in parts for f in fs]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in folders))


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version, or None for a table that was never written."""
    m = manifest(spark, path)
    return _read(spark, path, m) if m else None


def read_key(spark: SparkSession, path: str, **equal) -> DataFrame | None:
    """The rows whose keys (all of the table's) equal the values; only their part is opened."""
    m = manifest(spark, path)
    if m is None:
        return None
    types = {f.name: f.dataType for f in T.StructType.fromJson(m["schema"])}
    values = {k: F.lit(v).cast(types[k]) for k, v in equal.items()}
    part = None
    if set(m["keys"]) == set(equal):
        part = {spark.range(1).select(_part_of([values[k] for k in m["keys"]], m["parts"])).first()[0]}
    rows = _read(spark, path, m, part)
    for k, v in values.items():
        rows = rows.where(F.col(k) == v)
    return rows


def _content(df: DataFrame, keys: list[str], parts: int, folders: dict[str, list[str]]) -> dict:
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
    return {"keys": keys, "parts": parts, "schema": json.loads(schema.json()), "folders": folders}


def replace_table(df: DataFrame, path: str, keys: list[str] | None = None, parts: int = PARTS) -> None:
    """Publishes df as the table's whole content, dealt by keys if there are any."""
    spark = df.sparkSession
    if keys:
        name, made = _write_parts(df, path, keys, parts)
        folders = {str(p): [f"{name}/{PART}={p}"] for p in made}
    else:
        name = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{path}/{name}")
        folders = {WHOLE: [name]}
    content = _content(df, keys or [], parts, folders)
    _retried(spark, path, lambda before: (content, []))


def merge_rows(fresh: DataFrame, path: str, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], parts: int = PARTS, step: int | None = None) -> None:
    """Puts merge(rows of the parts that fresh touches, fresh) in their place. A numbered step that the table has taken, or a later one, changes nothing."""
    spark = fresh.sparkSession

    def attempt(before: dict | None):
        if before is None:
            name, made = _write_parts(fresh, path, keys, parts)
            return _content(fresh, keys, parts, {str(p): [f"{name}/{PART}={p}"] for p in made}) | {"step": step}, [name]
        taken = before.get("step")
        if step is not None and taken is not None and taken >= step:
            return None
        fits = before["keys"] == keys
        n = before["parts"] if fits else parts
        # At most as many numbers as the table has parts.
        touched = {r[0] for r in fresh.select(_part_of(keys, n)).distinct().collect()} if fits else None
        if touched is not None and not touched:
            return None
        rows = merge(_read(spark, path, before, touched), fresh)
        name, made = _write_parts(rows, path, keys, n)
        kept = {p: f for p, f in before["folders"].items() if fits and int(p) not in touched}
        return _content(rows, keys, n, kept | {str(p): [f"{name}/{PART}={p}"] for p in made}) | {"step": taken if step is None else step}, [name]

    _retried(spark, path, attempt)


def upsert_rows(df: DataFrame, path: str, keys: list[str], order: str | None = None, parts: int = PARTS) -> None:
    """Adds rows by key; of rows with equal keys the new one stays, among new ones the greatest in order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(order) if order else F.lit(0)))
    fresh = df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    merge_rows(fresh, path, keys, lambda old, new: old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True), parts)


def delete_keys(df: DataFrame, path: str, keys: list[str]) -> None:
    """Removes the rows with the keys of df."""
    if manifest(df.sparkSession, path) is not None:
        merge_rows(df.select(*keys).distinct(), path, keys, lambda old, gone: old.join(gone, keys, "left_anti"))


def upsert_edges(df: DataFrame, path: str, src: DataFrame, dst: DataFrame, src_key: str, dst_key: str, extra: tuple[str, ...] = (), parts: int = PARTS) -> None:
    """Adds edges whose ends exist, once for each pair (and the extra columns)."""
    kept = df.join(src.select(src_key).distinct(), src_key, "left_semi").join(dst.select(dst_key).distinct(), dst_key, "left_semi")
    upsert_rows(kept, path, [src_key, dst_key, *extra], parts=parts)


def replace_groups(df: DataFrame, path: str, group: str, groups: DataFrame, parts: int = PARTS) -> None:
    """Puts df's rows in the place of all rows of the groups; df has rows of these groups only."""
    ids = groups.select(group).distinct()

    def merge(old: DataFrame, marked: DataFrame) -> DataFrame:
        rest = old.join(ids, group, "left_anti")
        return rest.unionByName(marked.where("_real").drop("_real"), allowMissingColumns=True)

    # Groups that are left without rows touch their part all the same.
    empty = ids.select(group, *(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name != group), F.lit(False).alias("_real"))
    marked = df.withColumn("_real", F.lit(True)).unionByName(empty)
    if manifest(df.sparkSession, path) is None:
        return replace_table(df, path, [group], parts)
    return merge_rows(marked, path, [group], merge, parts)


def upsert_last(df: DataFrame, path: str, group: str, order: str, keep: int = 20, ceiling: int = 2000, parts: int = PARTS) -> None:
    """Adds rows by (group, order), of which each group keeps the last `keep`, at most `ceiling`: a bounded history."""

    def last(rows: DataFrame) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc(order)))
        return rows.withColumn("_rank", rank).where(F.col("_rank") <= min(keep, ceiling)).drop("_rank")

    merge_rows(last(df), path, [group], lambda old, new: last(old.join(new.select(group, order), [group, order], "left_anti").unionByName(new, allowMissingColumns=True)), parts)


def add_to_cache(df: DataFrame, path: str, keys: list[str], parts: int = PARTS) -> None:
    """Writes entries (keyed by version and content hash) that a cache doesn't hold yet; entries never change. What is there is not
    rewritten, except a part of more than FOLDERS folders."""
    spark = df.sparkSession

    def attempt(before: dict | None):
        fits = before is not None and before["keys"] == keys
        n = before["parts"] if fits else parts
        old = _read(spark, path, before) if before else None
        fresh = cache_misses(df, old, keys).dropDuplicates(keys)
        name, made = _write_parts(fresh if fits or old is None else old.unionByName(fresh), path, keys, n)
        if fits and not made:
            _delete(spark, path, [name])
            return None
        folders = {p: list(f) for p, f in before["folders"].items()} if fits else {}
        for p in made:
            folders.setdefault(str(p), []).append(f"{name}/{PART}={p}")
        after, wrote = _content(df if old is None else old, keys, n, folders), [name]
        long = {int(p) for p, f in folders.items() if len(f) > FOLDERS}
        if long:
            again, parts_made = _write_parts(_read(spark, path, after, long), path, keys, n)
            after["folders"] |= {str(p): [f"{again}/{PART}={p}"] for p in parts_made}
            wrote.append(again)
        return after, wrote

    _retried(spark, path, attempt)


def cache_misses(wanted: DataFrame, cache: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows without an entry in a cache table keyed by version and content hash."""
    return wanted if cache is None else wanted.join(cache.select(*keys).distinct(), keys, "left_anti")


def clear(spark: SparkSession, path: str, schema: T.StructType | None = None, keys: list[str] | None = None) -> None:
    """Deletes the table; with a schema it is there again at once, empty, with that schema and those keys."""
    p, fs = _fs(spark, path)
    fs.delete(p, True)
    if schema is not None:
        replace_table(spark.createDataFrame([], schema), path, keys)
