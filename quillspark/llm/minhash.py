"""Near-duplicate documents by BagMinHash signatures.

A document is the bag of its five-word shingles (white-space words, A-Z lower-cased);
two documents are linked if the weighted Jaccard similarity of their bags,
sum of minima / sum of maxima, is 0.8 or more.

Signature: a shingle of weight c owns the weight axis [0, c). The axis is cut into
dyadic blocks [0,1) [1,2) [2,4) [4,8) ...; each block is a Poisson process whose
rate is its width times the number of registers. Points come in ascending order;
a point lands in a register and at a level within its block, both taken from its hash, and
counts if the level lies below c. A register keeps its first point. Only points
below a limit that follows from the total weight are generated; the limit doubles
for a document with an empty register.

Equal bags collapse first (by a 128-bit bag hash), so copies are never compared.
Signatures are cut into bands; in a bucket of equal bands every bag is compared with
one hub. Members of buckets that still hold several components are compared with HUBS random hubs, and at
last all pairs of a bucket that lie in different components are compared, so no
candidate is given up. All comparisons use the exact bags.

Defined cases: null and empty texts have no shingles and are linked to nothing (class:
their own doc_id); texts of one to four words are one shingle; equal rows repeat their
result; a null doc_id keeps its class, whose id is the least non-null doc_id, or null;
very long texts are bags like others, a chunk of their own in the worker, and compared whole; an empty
table gives no rows; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, chunked, components, mix, pick, row_key, shingles, small, table, text_bytes, unit, word_hashes, written

WORDS = 5
SIMILARITY = 0.8
REGISTERS = 64
BAND = 4
#: Slots of the bound on two bags' overlap.
SLOTS = 64
#: Random hubs of a bucket that still holds several components, before the remaining pairs are compared.
HUBS = 4


def bags(raw: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle hash and count of each row's distinct shingles."""
    n_rows = len(off) - 1
    h, _, _, row = word_hashes(raw, off)
    s, r = shingles(h, row, n_rows, words)
    if not len(s):
        return np.zeros(0, np.int64), s, np.zeros(0, np.int64)
    bits = np.uint64(16)  # of the row number; a chunk has fewer rows
    key = np.sort((r.astype(np.uint64) << (np.uint64(64) - bits)) | (s >> bits))
    new = np.concatenate(([True], key[1:] != key[:-1]))
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> (np.uint64(64) - bits)).astype(np.int64), key << bits, count


def signatures(row: np.ndarray, item: np.ndarray, count: np.ndarray, n_rows: int, registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash signatures, rows x registers of 64-bit point ids (0: empty bag)."""
    total = np.bincount(row, weights=count, minlength=n_rows)
    low = np.zeros(len(row), np.int64)
    part = [(row, item, count, low)]
    top = int(count.max(initial=0))
    b = 1
    while 1 << (b - 1) < top:
        more = count > 1 << (b - 1)
        part.append((row[more], item[more], count[more], np.full(int(more.sum()), 1 << (b - 1), np.int64)))
        b += 1
    row, item, count, low = (np.concatenate(x) for x in zip(*part, strict=True))
    width = np.maximum(low, 1)
    seed = mix(item ^ mix(low.astype(np.uint64) + np.uint64(77)))
    rate = registers * width.astype(np.float64)
    first = -np.log1p(-unit(mix(seed + np.uint64(1)))) / rate

    out = np.zeros((n_rows, registers), np.uint64)
    todo = np.flatnonzero(total > 0)
    limit = np.full(n_rows, np.inf)
    limit[todo] = (np.log(registers) + 3.0) / total[todo]
    live = np.zeros(n_rows, bool)
    live[todo] = True
    while live.any():
        own = np.flatnonzero(live[row] & (first <= limit[row]))
        t, j = first[own], 0
        points = []
        while len(own):
            ident = mix(seed[own] + np.uint64(0x5851F42D4C957F2D * (j + 1) % 2**64))
            level = low[own] + (unit(mix(ident ^ np.uint64(0xA5A5A5A5))) * width[own]).astype(np.int64)
            ok = level < count[own]
            points.append((row[own][ok], (ident[ok] % np.uint64(registers)).astype(np.int64), t[ok], ident[ok]))
            j += 1
            t = t - np.log1p(-unit(mix(seed[own] + np.uint64(2 * j + 1)))) / rate[own]
            go = t <= limit[row[own]]
            own, t = own[go], t[go]
        r, g, t, ident = (np.concatenate(x) for x in zip(*points, strict=True)) if points else (np.zeros(0, np.int64),) * 4
        cell = r * registers + g
        order = np.lexsort((t, cell))
        cell = cell[order]
        lead = np.concatenate(([True], cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, bool)
        filled = np.bincount(cell[lead] // registers, minlength=n_rows)
        done = live & (filled == registers)
        take = lead & done[cell // registers] if len(cell) else lead
        out.reshape(-1)[cell[take]] = ident[order][take] | np.uint64(1)
        live &= ~done
        limit[live] *= 2
    return out


def _features(batches):
    for b in chunked(batches):
        n = b.num_rows
        raw, off = text_bytes(b.column("text"))
        row, item, count = bags(raw, off)
        sig = signatures(row, item, count, n)
        bands = np.zeros((n, REGISTERS // BAND), np.uint64)
        for k in range(BAND):
            bands = mix(bands + sig[:, k::BAND])
        weighted = np.stack([mix(mix(item + np.uint64(c)) ^ count.astype(np.uint64)) for c in (11, 23)])
        at = np.searchsorted(row, np.arange(n + 1))
        acc = np.concatenate((np.zeros((2, 1), np.uint64), np.cumsum(weighted, axis=1)), axis=1)
        bag = np.ascontiguousarray((acc[:, at[1:]] - acc[:, at[:-1]]).T)
        empty = at[1:] == at[:-1]
        text = b.column("text")
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"),
                b.column("k"),
                pa.array([None if e else x.tobytes() for e, x in zip(empty, bag, strict=True)], pa.binary()),
                pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * bands.shape[1], bands.reshape(-1).view(np.int64)),
                pa.array(np.bincount(row, weights=count, minlength=n).astype(np.int64)),
                text,
            ],
            ["doc_id", "k", "bag", "bands", "weight", "text"],
        )


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags (sorted shingles, counts)."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][x], b[1][y]).sum()
    return float(both) / float(a[1].sum() + b[1].sum() - both)


def _bag_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode(), np.uint8)
    _, item, count = bags(raw, np.array([0, len(raw)]))
    return item, count


def _verify(batches):
    for b in batches:
        seen: dict[bytes, tuple] = {}
        keep = []
        hubs, hub_text = b.column("b").to_pylist(), b.column("text_b")
        for i, t in enumerate(b.column("text_a")):
            if hubs[i] not in seen:
                if len(seen) > 64:
                    seen.clear()
                seen[hubs[i]] = _bag_of(hub_text[i].as_py())
            keep.append(similarity(_bag_of(t.as_py()), seen[hubs[i]]) >= SIMILARITY - 1e-12)
        at = pa.array(np.flatnonzero(keep))
        yield pa.RecordBatch.from_arrays([b.column("ca").take(at), b.column("cb").take(at)], ["a", "b"])


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between components, from candidate pairs (a, b, ca, cb), by the exact bags."""
    full = pairs.join(texts.selectExpr("bag a", "text text_a"), "a").join(texts.selectExpr("bag b", "text text_b"), "b")
    return full.select("b", "ca", "cb", "text_a", "text_b").mapInArrow(_verify, "a binary, b binary")


def _shingle_rows(batches):
    for b in chunked(batches):
        row, item, count = bags(*text_bytes(b.column("text")))
        yield pa.RecordBatch.from_arrays([b.column("bag").take(pa.array(row)), pa.array(item.view(np.int64)), pa.array(count.astype(np.int64))], ["bag", "item", "n"])


def _crossing(state: DataFrame, groups: DataFrame, texts: DataFrame) -> DataFrame:
    """All pairs of a bucket whose components differ and that can still be similar, each from the first band that the two share.

    Shingles of one bag alone overlap with nothing, and the others are summed into SLOTS by their hash: two bags
    share at most the sum of the lesser weights of each slot. Copies of one text with edits of their own fall
    under the limit by that, without a comparison."""
    open_bags = small(written(state.select("bag").distinct(), "open-bags"))
    items = texts.join(open_bags, "bag", "left_semi").select("bag", "text").mapInArrow(_shingle_rows, "bag binary, item long, n long")
    items = written(items.withColumn("slot", F.shiftright("item", 16).bitwiseAND(SLOTS - 1).cast("int")), "items")
    own = items.groupBy("item").agg(F.count("*").alias("bags"), F.min("bag").alias("bag"), F.sum("n").alias("n"), F.min("slot").alias("slot")).where("bags = 1").select("bag", "slot", (-F.col("n")).alias("n"))
    slots = items.select("bag", "slot", "n").union(own).groupBy("bag", "slot").agg(F.sum("n").cast("int").alias("n"))
    slots = slots.groupBy("bag").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"), F.sum("n").alias("shared"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    shared = groups.select("bag", "bands", "weight").join(slots.select("bag", "shared", filled.alias("slots")), "bag")
    # A bag with too much of its own is like no other.
    shared = written(shared.where(F.col("shared") >= SIMILARITY * F.col("weight") - 1e-6), "shared")
    full = state.select("band", "h", "bag", "component").join(small(shared, rows=BROADCAST_ROWS // 4), "bag")
    most = full.groupBy("band", "h", "component").agg(F.count("*").alias("m")).groupBy("band", "h").agg(F.max(F.struct("m", "component")).alias("top"))
    minor = full.join(most, ["band", "h"]).where("component <> top.component").selectExpr("band", "h", "bag x", "component cx", "bands bx", "weight wx", "shared sx", "slots vx")
    both = minor.join(full.selectExpr("band", "h", "bag y", "component cy", "bands by", "weight wy", "shared sy", "slots vy"), ["band", "h"])
    met = F.expr("exists(sequence(0, band), i -> i < band and bx[i] = by[i])")
    can = lambda common: common >= SIMILARITY * (F.col("wx") + F.col("wy") - common) - 1e-6
    overlap = F.aggregate(F.zip_with("vx", "vy", lambda m, n: F.least(m, n)), F.lit(0), lambda t, m: t + m)
    both = both.where((F.col("cx") != F.col("cy")) & can(F.least("sx", "sy")) & can(overlap) & ~met)
    swap = F.col("x") > F.col("y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(swap, F.col("cy")).otherwise(F.col("cx")).alias("ca"), F.when(swap, F.col("cx")).otherwise(F.col("cy")).alias("cb")).dropDuplicates(["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), class_size (rows of the class), kept, and
    k, which identifies a row by id and text."""
    rows = pick(docs, doc_id="long", text="string").withColumn("k", row_key("doc_id", "text"))
    feats = written(rows.mapInArrow(_features, "doc_id long, k binary, bag binary, bands array<long>, weight long, text string"), "minhash")
    groups = written(feats.where("bag is not null").groupBy("bag").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.max("bands").alias("bands"), F.max("weight").alias("weight")), "bags")
    rows = groups.select("bag", F.posexplode("bands").alias("band", "h"))
    buckets = rows.groupBy("band", "h").agg(F.min("bag").alias("hub"), F.max("bag").alias("far")).where("hub <> far").drop("far")
    members = written(rows.join(buckets, ["band", "h"]), "buckets")
    used = written(members.select("bag").distinct(), "used")
    texts = written(feats.join(small(used), "bag", "left_semi").groupBy("bag").agg(F.max("text").alias("text")), "texts")

    first = members.where("bag <> hub").selectExpr("bag a", "hub b").distinct()
    label = written(used.join(components(_linked(first.selectExpr("a", "b", "a ca", "b cb"), texts)).withColumnRenamed("node", "bag"), "bag", "left").withColumn("component", F.coalesce("component", "bag")), "labels")
    state = members.select("band", "h", "bag")
    for last in (False, True):
        state = state.select("band", "h", "bag").join(small(label), "bag")
        hubs = F.array(*(F.min(F.struct(F.xxhash64("bag", F.lit(r)).alias("draw"), "bag", "component")) for r in range(HUBS)))
        mixed = state.groupBy("band", "h").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), hubs.alias("hubs")).where("c0 <> c1")
        state = written(state.join(mixed.select("band", "h", "hubs"), ["band", "h"]), "open")
        if last:
            pairs = _crossing(state, groups, texts)
        else:
            pairs = state.select("bag", "component", F.explode("hubs").alias("hub")).where("component <> hub.component")
            pairs = pairs.selectExpr("bag a", "hub.bag b", "component ca", "hub.component cb").dropDuplicates(["a", "b"])
        found = written(_linked(pairs, texts).distinct(), "links")
        if found.isEmpty():
            continue
        moved = components(found).selectExpr("node component", "component moved")
        label = written(label.join(small(moved), "component", "left").select("bag", F.coalesce("moved", "component").alias("component")), "labels")

    placed = groups.select("bag", "least", "n").join(label, "bag", "left").withColumn("component", F.coalesce("component", "bag"))
    whole = placed.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    by_bag = placed.join(whole, "component").select("bag", "class_id", "class_size")
    dup = by_bag.where("class_size > 1")
    # Most bags stand alone: only rows of larger classes need the join.
    out = feats.select("doc_id", "k", "bag").join(small(written(dup, "larger")), "bag", "left")
    return out.select(
        "doc_id",
        F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.when(F.col("class_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"),
        "k",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, less all but one of each class."""
    names = docs.columns
    plain = docs.toDF(*(f"_p{i}" for i in range(len(names))))
    k = row_key(F.col(f"_p{names.index('doc_id')}").cast("long"), F.col(f"_p{names.index('text')}").cast("string"))
    plain = plain.withColumn("_k", k)
    verdict = written(near_duplicates(docs).where("class_size > 1").groupBy(F.col("k").alias("_k")).agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "verdict")
    rest = plain.join(small(verdict.where("not kept").select("_k")), "_k", "left_anti")
    again = verdict.where("kept and n > 1").select("_k")
    if not again.isEmpty():
        again = small(again)
        # Of rows that differ in other columns only, the first by all columns stays.
        first = F.row_number().over(Window.partitionBy("_k").orderBy(F.to_json(F.struct(*(c for c in plain.columns if c != "_k")))))
        one = rest.join(again, "_k", "left_semi").withColumn("_first", first).where("_first = 1").drop("_first")
        rest = rest.join(again, "_k", "left_anti").unionByName(one)
    return rest.drop("_k").toDF(*names)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("k")


#: The exact classes: all pairs that share a shingle, and reachability. The query finds them by LSH, whose misses are rarer than 2e-4 a pair.
OP3_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
c AS (SELECT doc_id, g, count(*) AS n FROM s GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS t FROM c GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS o FROM c a JOIN c b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN t tx ON tx.doc_id = x JOIN t ty ON ty.doc_id = y WHERE 10 * o >= 8 * (tx.t + ty.t - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, label) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.label FROM r JOIN e ON r.node = e.x WHERE r.label < e.y),
k AS (SELECT node, min(label) AS class_id FROM r GROUP BY 1)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM d JOIN k ON node = doc_id
"""
