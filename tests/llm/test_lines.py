import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm import lines

SPACE = " \t\n\x0b\x0c\r"
FOLD = str.maketrans(lines.UPPER, lines.LOWER)


def plainly(docs, min_chars=40, min_docs=5):
    """docs: (doc_id, text) rows. Each row is a document; null ids are least."""
    keys = [[ln.strip(SPACE).translate(FOLD) for ln in (t or "").split("\n")] for _, t in docs]
    holders = defaultdict(list)
    for (i, _), own in zip(docs, keys, strict=True):
        for k in set(own):
            if len(k) >= min_chars:
                holders[k].append(float("-inf") if i is None else i)
    top = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for (i, t), own in zip(docs, keys, strict=True):
        at = float("-inf") if i is None else i
        kept = [ln for ln, k in zip((t or "").split("\n"), own, strict=True) if k not in top or at == top[k]]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    common = [f"{'Ä' if i % 3 == 0 else 'A'} common line number {i} that stands in Many documents é" for i in range(6)]
    rare = [f"line {i} of a few documents, which is long enough to count " for i in range(12)]
    exact, less = "x" * 40, "y" * 39
    docs = []
    for d in range(60):
        own = [f"own line {d} {j} " + "z" * rng.randrange(60) for j in range(rng.randrange(4))]
        for c in common:
            if rng.random() < 0.5:
                own.append(rng.choice(["", " ", "\t\x0b", "\r"]) + (c.upper().replace("É", "é") if rng.random() < 0.3 else c) + rng.choice(["", "\r", "  "]))
        own += [rng.choice(rare)] * rng.randrange(3)
        own += [exact] if d % 9 == 0 else []
        own += [less] if d % 2 else []
        own += [""] * rng.randrange(3)
        rng.shuffle(own)
        docs.append((rng.choice([d, d, d, -d, None if d % 20 == 0 else d]), "\n".join(own)))
    one = common[1]
    docs += [(1000, one), (1000, one + "\n" + one), (1001, None), (1002, ""), (1003, "\n\n"), (7, common[0]), (7, common[0])]
    return docs


@pytest.mark.parametrize("batches, fanout", [(1, 3), (5, 2)])
def test_drops_equal_a_plain_version(spark, corpus, batches, fanout):
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    assert rows(lines.dedup_lines(df, batches=batches, fanout=fanout)) == plainly(corpus)


def test_other_bounds_and_a_table_too_large_to_send(spark, corpus, monkeypatch):
    monkeypatch.setattr(lines, "small", lambda df: df)
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    assert rows(lines.dedup_lines(df, min_chars=5, min_docs=2, batches=3)) == plainly(corpus, 5, 2)


def test_runs_are_disjoint_levelled_and_counted(spark):
    runs = lines.LineRuns(spark, fanout=2)
    seen = defaultdict(lambda: [0, -1])
    for b in range(8):
        held = {(b * 7 + j) % 20 for j in range(6)} | {99}
        batch = spark.createDataFrame([(bytes([h]) * 16, 1 + h % 2, b * 10 + h) for h in held], "h binary, n long, top long")
        told = {r.h[0]: r.fresh for r in runs.add(batch).collect()}
        assert told == {h: h not in seen for h in held}
        for h in held:
            seen[h] = [seen[h][0] + 1 + h % 2, max(seen[h][1], b * 10 + h)]
    # Eight batches at a fan-out of two are merged into one run by seven merges.
    assert [len(level) for level in runs.levels] == [0, 0, 0, 1] and runs.rewritten == 7
    kept = [r.h for name in runs.runs() for r in spark.table(name).where("fresh").collect()]
    assert len(kept) == len(set(kept)) == len(seen)
    got = {r.h[0]: [r.n, r.top] for r in runs.frequent(1).collect()}
    assert got == {h: v for h, v in seen.items()}
    assert {r.h[0] for r in runs.frequent(4).collect()} == {h for h, v in seen.items() if v[0] >= 4}
    runs.drop()


def test_merging_a_batch_moves_no_run(spark):
    runs = lines.LineRuns(spark)
    batch = lambda lo: spark.range(lo, lo + 500).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("h"), F.lit(1).cast("long").alias("n"), F.col("id").alias("top"))
    runs.add(batch(0))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run = runs._new(runs.runs()[0])
        plan = batch(250).groupBy("h").agg(F.max("top").alias("top")).join(run.select("h"), "h", "left_anti")
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert plan.count() == 250 and "SortMergeJoin" in text
        assert text.count("Exchange hashpartitioning") == 1  # the batch's counts alone
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        runs.drop()


def test_awkward_tables(spark, awkward, clash, nothing):
    plain = [(r.doc_id, r["text"]) for r in awkward.select("doc_id", "text").collect()]
    assert rows(lines.dedup_lines(clash, batches=2)) == plainly(plain)
    assert lines.dedup_lines(nothing).count() == 0
    many = [(None, "w" * 50)] * 6
    assert rows(lines.dedup_lines(spark.createDataFrame(many, "doc_id long, text string"), batches=1)) == plainly(many)


def test_long_texts_take_linear_time(spark):
    text = "\n".join(f"{i % 30000} {'q' * 45}" for i in range(200_000))
    docs = spark.createDataFrame([(i, text) for i in range(5)], "doc_id long, text string")
    got = lines.dedup_lines(docs, batches=1).select("doc_id", "n_lines", "n_dropped").collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped) for r in got} == {i: (200_000, 0 if i == 4 else 200_000) for i in range(5)}
