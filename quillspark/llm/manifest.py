"""A Merkle manifest of documents, in DataFrame functions only.

Each row is a leaf, hashed in one scan of the texts; everything after it works on ids and digests. A row's rank within its source comes
from a radix trie of its key (doc_id as hex digits, then what breaks ties): rows are counted by their first digits, and only where a prefix has more than
MOST rows, or a fixed share of all, are they counted by more digits. A row's rank is the number of rows before its prefix, summed
along the trie, plus its rank among the rows of its prefix, which is never large: nothing is sorted as a whole, and no source, however large, is in one task.

Ranks written in base FANOUT are the keys of a second trie, whose nodes are the tree's: nodes that share all digits but the last have
their hash as parent, longest prefixes first. LEVELS digits are taken off at once, so that a group is a block of at most FANOUT ** LEVELS
digests; blocks hash to nodes of the next round. Subroots are ranked by their source's bytes and reduced likewise to the root. Paths go
down the same blocks, and each leaf's proof and folded root are computed where its path arrives.

Defined cases: nulls are encoded as `-`; the null source is first, and so are null ids in their source; rows of equal ids follow
each other by their leaf, and equal rows are leaves of their own; a lone leaf is its source's subroot, a lone subroot the root; rows
without id are not tampered with; an empty table gives no rows; extra columns are left out, whatever their names; very long texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import let, pick, table, written

FANOUT, LEVELS = 3, 6
#: Rows of a prefix that are ranked by a sort in one task; a larger table allows a 1 / SHARE of its rows, so that at most SHARE prefixes are split again.
MOST, SHARE = 50_000, 50_000
#: Hex digits that a step of the trie adds.
STEP = 2
PATH = "array<struct<left:string,right:string>>"


def encode(value: Column) -> Column:
    """`-` for null, else the value's length in bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return digest(*map(encode, (doc_id, source, lang, n_chars, text)))


def id_key(doc_id: Column) -> Column:
    """Hex digits that sort like the ids, null first."""
    return F.coalesce(F.concat(F.lit("1"), F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")), F.lit("0" * 17))


# ---------------------------------------------------------------- ranks


def radix_ranks(rows: DataFrame, key: Sequence[Column], most: int | None = None, step: int = STEP) -> DataFrame:
    """rows (with a column tree, not null) with rank (from 0, within the tree, in the order of the concatenated hex keys) and leaves (the tree's rows).

    Rows are read once a level of the trie, only tree and key; keys that are equal as a whole are ranked in any order."""
    key = F.concat(*key)
    ends = rows.agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"), F.max(F.length(key)).alias("w")).first()
    if not ends["n"]:
        return rows.withColumns({"rank": F.lit(0).cast("long"), "leaves": F.lit(0).cast("long")})
    most = most or max(MOST, -(-ends["n"] // SHARE))
    # Digits that all keys share come before the first step.
    width = step + next((i for i, (a, b) in enumerate(zip(ends["lo"], ends["hi"], strict=False)) if a != b), min(len(ends["lo"]), len(ends["hi"])))
    rows = rows.withColumn("_key", key).withColumn("_done", F.lit(None).cast("string"))
    walk = rows.select("tree", "_key", "_done")
    parents, found = None, []
    while True:
        prefix = F.substring("_key", 1, width)
        counts = walk.where("_done is null").groupBy("tree", prefix.alias("prefix")).agg(F.count("*").alias("n"))
        # Siblings share all digits but those of this step, so there are at most 16 ** step and one.
        counts = counts.withColumn("up", F.substring("prefix", 1, width - step) if parents else F.lit(""))
        siblings = W.partitionBy("tree", "up")
        counts = counts.withColumn("before", F.sum("n").over(siblings.orderBy("prefix").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n"))
        if parents is None:
            counts = counts.withColumn("leaves", F.sum("n").over(siblings))
        else:
            more = parents.select("tree", F.col("prefix").alias("up"), F.col("before").alias("more"), "leaves")
            counts = counts.join(F.broadcast(more), ["tree", "up"]).withColumn("before", F.col("before") + F.col("more"))
        counts = written(counts.select("tree", "prefix", "n", "before", "leaves"), "digits")
        large = (F.col("n") > most) if width < ends["w"] else F.lit(False)
        found.append(counts.where(~large).select("tree", F.col("prefix").alias("_done"), "before", "leaves"))
        # Each has more than a 1 / SHARE of all rows: few enough to be sent to all tasks.
        parents = counts.where(large)
        if parents.isEmpty():
            rows = rows.withColumn("_done", F.coalesce("_done", prefix))
            break
        split = F.broadcast(parents.select("tree", F.col("prefix").alias("_p"), F.lit(True).alias("_split")))
        settle = F.coalesce("_done", F.when(F.col("_split").isNull(), F.col("_p")))
        rows, walk = (df.withColumn("_p", prefix).join(split, ["tree", "_p"], "left").withColumn("_done", settle).drop("_p", "_split") for df in (rows, walk))
        width += step
    before = found[0]
    for f in found[1:]:
        before = before.unionByName(f)
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("tree", "_done").orderBy("_key")) - 1)
    rows = rows.join(before, ["tree", "_done"]).withColumn("rank", F.col("before") + F.col("_n"))
    return rows.drop("_key", "_done", "_n", "before")


# ---------------------------------------------------------------- the tree


def height(leaves: Column, fanout: int = FANOUT) -> Column:
    """Levels above the leaves of a tree."""
    powers = [p for p in (fanout**i for i in range(64)) if p < 1 << 63]
    return F.size(F.filter(F.array(*map(F.lit, powers)), lambda p: p < leaves))


def _level_up(nodes: Column, fanout: int) -> Column:
    parents = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int"))
    return F.transform(parents, lambda i: F.sha2(F.array_join(F.slice(nodes, i * fanout + 1, fanout), ""), 256))


def _levels(nodes: Column, up: Column, fanout: int, most: int) -> Column:
    """The digests of a block's nodes, level by level, `up` levels above the lowest."""
    start = F.array(nodes).cast("array<array<string>>")
    return F.aggregate(F.slice(F.array(*map(F.lit, range(most))), 1, up), start, lambda acc, _: let(F.element_at(acc, -1), lambda last: F.concat(acc, F.array(_level_up(last, fanout)))))


def _path(levels: Column, at: Column, fanout: int) -> Column:
    """What stands left and right of the nodes above (and at) position `at`, level by level up to the block's top."""

    def siblings(level, depth):
        pos = F.floor(at / F.pow(F.lit(float(fanout)), depth)).cast("int")

        def around(p):
            run = p - p % fanout
            return F.struct(F.array_join(F.slice(level, run + 1, p % fanout), "").alias("left"), F.array_join(F.slice(level, p + 2, fanout - 1 - p % fanout), "").alias("right"))

        return let(pos, around)

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), siblings)


def _blocks(nodes: DataFrame, round_: int, fanout: int, levels: int) -> DataFrame:
    """tree, block, height, nodes (in order: digest and what goes with it), levels, top: nodes (tree, rank, height, node) by their rank's prefix."""
    size = fanout**levels
    up = F.least(F.lit(levels), F.greatest(F.lit(0), F.col("height") - round_ * levels))
    b = nodes.groupBy("tree", F.floor(F.col("rank") / size).alias("block")).agg(F.first("height").alias("height"), F.sort_array(F.collect_list(F.struct("rank", "node"))).alias("nodes"))
    b = b.withColumn("levels", _levels(F.transform("nodes", lambda x: x["node"]["digest"]), up, fanout, levels))
    return b.withColumn("top", F.element_at(F.element_at("levels", -1), 1))


def climb(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """The blocks of trees over nodes (tree, rank, leaves, node: a struct with digest), round by round; the last has one block a tree, whose top is the root."""
    nodes = written(nodes.select("tree", "rank", height(F.col("leaves"), fanout).alias("height"), "node"), "nodes")
    tallest = nodes.agg(F.max("height")).first()[0] or 0
    rounds = []
    for i in range(max(1, -(-tallest // levels))):
        rounds.append(written(_blocks(nodes, i, fanout, levels), "blocks"))
        nodes = rounds[-1].select("tree", F.col("block").alias("rank"), "height", F.struct(F.col("top").alias("digest")).alias("node"))
    return rounds


def descend(rounds: list[DataFrame], above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """For each lowest node tree, node and path: what stands left and right of it and of each node above it, up to the root, and then the path above
    (tree, path, and anything that all nodes of the tree get). Blocks are joined with the one path of their top."""
    on, more = ["tree"], [c for c in above.columns if c not in ("tree", "path")]
    for i, b in enumerate(reversed(rounds)):
        first = F.element_at("nodes", 1)["rank"]
        path = lambda x: F.concat(_path(F.col("levels"), (x["rank"] - first).cast("int"), fanout), F.col("path")).cast(PATH)  # noqa: E731, B023
        nodes = F.transform("nodes", lambda x: F.struct(x["rank"].alias("rank"), x["node"].alias("node"), path(x).alias("path")))  # noqa: B023
        below = b.join(above, on).select("tree", *more, F.inline(nodes))
        if i < len(rounds) - 1:
            above, on = below.select("tree", F.col("rank").alias("block"), "path", *more), ["tree", "block"]
    return below.select("tree", "node", "path", *more)


def fold(start: Column, path: Column) -> Column:
    """The root that start has with the siblings of path."""
    return F.aggregate(path, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def siblings(path: Column) -> Column:
    """The digests of a path, one after the other."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


# ---------------------------------------------------------------- manifest


def leaves_of(docs: DataFrame, tampered: DataFrame | None = None) -> DataFrame:
    """tree (the source, so that it sorts with null first), doc_id, leaf and row (tells equal rows apart)."""
    d = pick(docs, doc_id="long", text="string", lang="string", source="string", n_chars="long")
    tree = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))
    cols = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    broken = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    cut = F.coalesce(broken, F.col("text"))
    d = d.select(tree.alias("tree"), "doc_id", leaf(*cols, F.col("text")).alias("leaf"), F.when(~F.col("text").eqNullSafe(cut), leaf(*cols, cut)).alias("seen"))
    return d.withColumn("row", F.monotonically_increasing_id())


def manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS, most: int | None = None) -> DataFrame:
    """doc_id, source, leaf, seen (the leaf of a row that is tampered with, where it differs), subroot, root, path (up to the root)."""
    rows = written(leaves_of(docs), "leaves")
    key = [id_key(F.col("doc_id")), F.col("leaf"), F.lpad(F.hex("row"), 16, "0")]
    ranked = radix_ranks(rows, key, most).select("tree", "rank", "leaves", F.struct(F.col("leaf").alias("digest"), "doc_id", "seen").alias("node"))
    trees = climb(ranked, fanout, levels)
    subroots = written(trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("top").alias("digest")), "subroots")
    sources = radix_ranks(subroots, [F.hex("of")], most)
    whole = climb(sources.select("tree", "rank", "leaves", F.struct("digest", "of").alias("node")), fanout, levels)
    top = whole[-1].select("tree", F.array().cast(PATH).alias("path"), F.col("top").alias("root"))
    above = written(descend(whole, top, fanout).select(F.col("node.of").alias("tree"), F.col("node.digest").alias("subroot"), "root", "path"), "sources")
    out = descend(trees, above, fanout)
    source = F.when(F.col("tree") != "-", F.substring("tree", 2, 1 << 30))
    return out.select("node.doc_id", source.alias("source"), F.col("node.digest").alias("leaf"), "node.seen", "subroot", "root", "path")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = manifest(table(spark, sf_dir, "documents"))
    out = out.withColumns({"proof_sha256": F.sha2(siblings(F.col("path")), 256), "folded_root": fold(F.coalesce("seen", "leaf"), F.col("path"))})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: CRC-32 (reflected, 0xEDB88320) of a decimal number, bit by bit; a step is a list_reduce over eight zeros.
_CRC = """(xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), 4294967295), 4294967295))"""
_ENC = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_ENC(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
OP11_SQL = f"""
WITH RECURSIVE d0 AS (SELECT *, CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut FROM documents),
d1 AS (SELECT row_number() OVER () AS id, doc_id, coalesce('s' || source, '-') AS tree, {_LEAF("text")} AS leaf, {_LEAF("cut")} AS seen FROM d0),
d AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d1),
up AS (SELECT 0 AS lvl, tree, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM d
  UNION ALL SELECT lvl + 1, tree, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM up WHERE n > 1 GROUP BY lvl, tree, pos // 3),
sub AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, pos, subroot AS h, count(*) OVER () AS n FROM sub
  UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM top WHERE n > 1 GROUP BY lvl, pos // 3),
sib AS (SELECT a.lvl, a.tree, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM up a JOIN up b ON a.lvl = b.lvl AND a.tree = b.tree AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.lvl, a.tree, a.pos),
sibt AS (SELECT a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM top a JOIN top b ON a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.lvl, a.pos),
w AS (SELECT id, 0 AS lvl, d.tree, d.pos, seen AS f, '' AS proof FROM d
  UNION ALL SELECT id, w.lvl + 1, w.tree, w.pos // 3, sha256(l || f || r), proof || l || r FROM w JOIN sib s ON s.lvl = w.lvl AND s.tree = w.tree AND s.pos = w.pos),
w1 AS (SELECT id, arg_max(f, lvl) AS f, arg_max(proof, lvl) AS proof FROM w GROUP BY id),
x AS (SELECT w1.id, 0 AS lvl, sub.pos, f, proof FROM w1 JOIN d USING (id) JOIN sub USING (tree)
  UNION ALL SELECT id, x.lvl + 1, x.pos // 3, sha256(l || f || r), proof || l || r FROM x JOIN sibt s ON s.lvl = x.lvl AND s.pos = x.pos),
x1 AS (SELECT id, arg_max(f, lvl) AS f, arg_max(proof, lvl) AS proof FROM x GROUP BY id)
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = (SELECT h FROM top WHERE n = 1) AS verified FROM d JOIN sub USING (tree) JOIN x1 USING (id)"""
