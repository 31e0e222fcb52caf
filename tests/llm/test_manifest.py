import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm import manifest as m

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, text):
    return H(*map(enc, (r[0], r[3], r[2], r[4], text)))


def tree(nodes, fanout):
    """Root, and for each node the (left, right) siblings level by level."""
    paths, owner = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, own = [], []
        for s in range(0, len(nodes), fanout):
            run = nodes[s : s + fanout]
            for j, members in enumerate(owner[s : s + fanout]):
                for i in members:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(H(*run))
            own.append([i for members in owner[s : s + fanout] for i in members])
        nodes, owner = up, own
    return nodes[0], paths


def plainly(rows, fanout=3):
    """rows: (doc_id, text, lang, source, n_chars)."""
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r, leaf_of(r, r[1])))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs, out = [], []
    for s in order:
        by[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        subs.append(tree([h for _, h in by[s]], fanout))
    root, above = tree([s[0] for s in subs], fanout)
    for s, (sub, paths), more in zip(order, subs, above, strict=True):
        for (r, leaf), path in zip(by[s], paths, strict=True):
            path = path + more
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            at = leaf_of(r, r[1].replace("\n", "")) if tampered else leaf
            for left, right in path:
                at = H(left, at, right)
            out.append((r[0], leaf, sub, root, H(*(a + b for a, b in path)), at, at == root))
    return sorted(out, key=repr)


def told(out):
    out = out.withColumns({"proof": F.sha2(m.siblings(F.col("path")), 256), "folded": m.fold(F.coalesce("seen", "leaf"), F.col("path"))})
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded, r.folded == r.root) for r in out.collect()), key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(n, sources, seed=5):
    rng = random.Random(seed)
    ids = [rng.choice([i, -i * 10**15, i << 33, rng.randrange(-(1 << 63), 1 << 63), None if i % 11 == 0 else i]) for i in range(n)]
    text = lambda k: None if k % 5 == 0 else rng.choice(["a\nb", "one line", "é\n\n", "\n"]) * (1 + k % 3)
    return [(i, text(k), rng.choice(["en", None, "日本"]), rng.choice(sources), rng.choice([None, 3, -4])) for k, i in enumerate(ids)]


@pytest.mark.parametrize("n, levels, most, fanout", [(1, 6, None, 3), (130, 2, 5, 3), (90, 6, None, 2)])
def test_manifest_equals_a_plain_version(spark, n, levels, most, fanout):
    rows = made(n, ["a", "b", "b" * 9 + "x", "b" * 9 + "y", "é", "", None, "z"])
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert told(m.manifest(docs, fanout=fanout, levels=levels, most=most)) == plainly(rows, fanout)


def test_sources_of_any_size(spark):
    rows = [(i, f"t\n{i}", "en", f"s{n}", i) for n in (1, 2, 3, 4, 9, 10, 27, 28, 82) for i in range(n)]
    assert told(m.manifest(spark.createDataFrame(rows, SCHEMA), levels=2, most=50)) == plainly(rows)


def test_repeated_rows_and_ids_are_leaves_of_their_own(spark):
    rows = [(5, "same\ntext", "en", "s", 1)] * 20 + [(5, f"other {i}", "en", "s", 1) for i in range(10)] + [(None, "x", None, None, None)] * 7
    assert told(m.manifest(spark.createDataFrame(rows, SCHEMA), levels=3, most=12)) == plainly(rows)


@pytest.mark.parametrize("most, step", [(1, 2), (40, 2), (10**6, 2)])
def test_ranks_are_exact(spark, most, step):
    rng = random.Random(1)
    ids = {t: sorted({rng.randrange(-(1 << 63), 1 << 63) for _ in range(40)} | set(range(1000, 1060)) | {None}, key=lambda x: (x is not None, x or 0)) for t in ("a", "b")}
    data = [(t, i) for t, own in ids.items() for i in own]
    rng.shuffle(data)
    got = m.radix_ranks(spark.createDataFrame(data, "tree string, id long"), [m.id_key(F.col("id"))], most, step).collect()
    assert {(r.tree, r.id): (r.rank, r.leaves) for r in got} == {(t, i): (k, len(own)) for t, own in ids.items() for k, i in enumerate(own)}


def test_ranks_of_strings_are_bytewise(spark):
    words = ["", "a", "aa", "aab", "ab", "b", "Z", "é", "日本", "https://www.example.org/1", "https://www.example.org/10", "https://www.example.org/2"]
    got = m.radix_ranks(spark.createDataFrame([("", w) for w in words], "tree string, w string"), [F.hex("w")], 3).collect()
    assert [r.w for r in sorted(got, key=lambda r: r["rank"])] == sorted(words, key=lambda w: w.encode())


def test_awkward_tables(spark, awkward, clash, nothing):
    plain = [tuple(r) for r in awkward.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert told(m.manifest(clash)) == plainly(plain)
    assert m.manifest(nothing).count() == 0


def test_a_changed_row_is_told(spark):
    rows = [(i, f"line\nline {i}", "en", f"s{i % 3}", i) for i in range(50)]
    told_of = {r[0]: r[-1] for r in plainly(rows)}
    assert told_of == {i: zlib.crc32(str(i).encode()) % 2 == 1 for i in range(50)}
    leaves = m.leaves_of(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.seen is None for r in leaves} == told_of
