"""Bounded all-pairs and published edges against a plain comparison of all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.operators import allpairs, edges, similarity
from quillspark.sources import scratch, sinks


def portfolio(groups, each, seed=1, dims=6, noise=0.05):
    """Cases of groups that share signals and a direction; some have no embedding, one a zero one, two another length."""
    rng, gen = random.Random(seed), np.random.default_rng(seed)
    signals, vectors = [], {}
    for g in range(groups):
        centre = gen.normal(size=dims)
        for c in range(each):
            i = g * each + c
            own = {f"g{g}:{k}" for k in range(8) if rng.random() < 0.8} | {"all"} | ({f"mixed:{rng.randrange(6)}"} if rng.random() < 0.3 else set())
            signals += [(i, s) for s in own]
            if i % 17:
                vectors[i] = (centre + noise * gen.normal(size=dims)).tolist()
    vectors[5] = [0.0] * dims
    vectors[7], vectors[9] = [1.0, 2.0], [1.0, 2.5]
    return signals, vectors


def plainly(signals, vectors, top=8, least=0.18, weights=None):
    """Directed lists of the best."""
    own = {}
    for i, s in signals:
        own.setdefault(i, set()).add(s)
    df = Counter(s for x in own.values() for s in x)
    w = weights or {s: round(math.log((1 + len(own)) / (1 + c)) + 1, 12) for s, c in df.items()}
    total = {i: sum(w[s] for s in x) for i, x in own.items()}

    def score(a, b):
        shared = own[a] & own[b]
        if not shared:
            return None
        x = sum(w[s] for s in shared)
        jac = x / (total[a] + total[b] - x)
        u, v = vectors.get(a), vectors.get(b)
        if u is None or v is None or len(u) != len(v) or not any(u) or not any(v):
            return jac
        return 0.55 * jac + 0.45 * (np.dot(u, v) / math.sqrt(np.dot(u, u) * np.dot(v, v)))

    out = {}
    for a in own:
        found = [(-round(s, 9), b) for b in own if b != a and (s := score(a, b)) is not None and s >= least]
        out[a] = [b for _, b in sorted(found)[:top]]
    return out


def tables(spark, signals, vectors):
    return spark.createDataFrame(signals, "case_id long, signal_key string"), spark.createDataFrame(list(vectors.items()), "case_id long, embedding array<double>")


def lists(rows):
    out = {}
    for r in rows:
        out.setdefault(r.case_id, []).append((-round(r.combined_score, 9), r.other_id))
    return {i: [b for _, b in sorted(x)] for i, x in out.items()}


def test_most_blocks_are_skipped_where_cases_cluster(spark):
    signals, vectors = portfolio(12, 36, dims=16)
    s, e = tables(spark, signals, vectors)
    found = allpairs.nearest(similarity.profiles(s, e), block=32)
    assert lists(found.best.collect()) == {i: x for i, x in plainly(signals, vectors).items() if x}
    all_pairs = found.blocks * (found.blocks + 1) // 2
    assert found.blocks >= 15 and found.compared < 0.4 * all_pairs and found.rounds >= 2


@pytest.mark.parametrize("block, noise, direct", [(16, 3.0, 1), (50, 0.5, 8), (1000, 0.05, 0)])
def test_best_of_any_blocks_are_exact(spark, block, noise, direct):
    signals, vectors = portfolio(4, 30, seed=block, noise=noise)
    s, e = tables(spark, signals, vectors)
    want = {i: x for i, x in plainly(signals, vectors, top=3).items() if x}
    assert lists(allpairs.nearest(similarity.profiles(s, e), top=3, block=block, direct=direct).best.collect()) == want


def test_pairs_above_a_score_are_exact(spark):
    signals, vectors = portfolio(6, 15)
    s, e = tables(spark, signals, vectors)
    got = {(r.case_a, r.case_b) for r in allpairs.above(similarity.profiles(s, e), 0.5, block=12, direct=1).collect()}
    want = plainly(signals, vectors, top=10**6, least=0.5)
    assert got == {(min(a, b), max(a, b)) for a, x in want.items() for b in x}


def test_bounds_hold(spark):
    signals, vectors = portfolio(5, 20, noise=0.4)
    rows = similarity.profiles(*tables(spark, signals, vectors)).toPandas()
    rows["block"] = (rows["case_id"] % 7).astype(str)
    blocks = [g for _, g in rows.groupby("block")]
    sums = pd.concat([allpairs._summary(g) for g in blocks])
    top = allpairs.bounds(rows, sums)
    for j, g in enumerate(blocks):
        shared, _, _, score = allpairs.scores(rows, g)
        most = np.where((shared > 0) & (rows["case_id"].to_numpy()[:, None] != g["case_id"].to_numpy()[None, :]), score, -np.inf).max(axis=1)
        assert (most <= top[:, j]).all()


def published(spark, path):
    return {(r.case_id, r.other_id, r.own, round(r.combined_score, 9)) for r in edges.read(spark, path).collect()}


def written(spark, path):
    return {f for folders in sinks.manifest(spark, f"{path}/edges")["folders"].values() for f in folders}


def test_a_refresh_equals_publishing_anew(spark, tmp_path):
    signals, vectors = portfolio(10, 18)
    s, e = tables(spark, signals, vectors)
    kept, anew = str(tmp_path / "kept"), str(tmp_path / "anew")
    edges.publish(kept, s, e, parts=64)
    before = written(spark, kept)
    assert edges.refresh(kept, s, e) == 0 and written(spark, kept) == before
    # One embedding moves to another group: its old neighbours lose it and the new ones gain it; the rest of the table stays as it is.
    vectors[20] = [x + 0.001 for x in vectors[41]]
    _, e = tables(spark, signals, vectors)
    assert 1 <= edges.refresh(kept, s, e, parts=64) < 60
    assert len(written(spark, kept) & before) > 0
    edges.publish(anew, s, e)
    assert published(spark, kept) == published(spark, anew)
    assert {r.other_id for r in edges.read_case(spark, kept, 20).where("own").collect()} == set(plainly(signals, vectors)[20])
    # Cases go, come and change their signals, so that weights change too.
    signals = [(i, k) for i, k in signals if i not in (3, 50)] + [(999, "g2:1"), (999, "g2:2"), (999, "all"), (60, "fresh")]
    s, _ = tables(spark, signals, vectors)
    edges.refresh(kept, s, e)
    edges.publish(anew, s, e)
    assert published(spark, kept) == published(spark, anew)


def test_a_refresh_by_published_weights_compares_few(spark, tmp_path):
    signals, vectors = portfolio(8, 16)
    s, e = tables(spark, signals, vectors)
    path = str(tmp_path / "edges")
    edges.publish(path, s, e)
    weights = {r.signal_key: r.weight for r in sinks.read_table(spark, f"{path}/weights").collect()}
    changed = [(i, k) for i, k in signals if not (i == 30 and k.startswith("g1"))] + [(30, "g4:1"), (30, "g4:2")]
    s, _ = tables(spark, changed, vectors)
    assert edges.refresh(path, s, e, new_weights=False) < 40
    want = plainly(changed, vectors, weights=weights)
    assert lists(edges.read(spark, path).where("own").collect()) == {i: x for i, x in want.items() if x}


def test_empty_tables(spark, tmp_path):
    s, e = spark.createDataFrame([], "case_id long, signal_key string"), spark.createDataFrame([], "case_id long, embedding array<double>")
    assert allpairs.nearest(similarity.profiles(s, e)).best.count() == 0 and similarity.similar_pairs(s, e).count() == 0
    edges.publish(str(tmp_path / "none"), s, e)
    assert edges.read(spark, str(tmp_path / "none")).where(F.col("case_id") == 1).count() == 0
    one = spark.createDataFrame([(1, "a")], "case_id long, signal_key string")
    assert allpairs.nearest(similarity.profiles(one)).best.count() == 0


def test_equal_cases_are_compared_once(spark):
    """Forty kinds of seven equal cases, and one of 300: what is compared follows from the kinds."""
    signals, vectors = portfolio(5, 8)
    more = [(i + 100 * k, s) for i, s in signals for k in range(7)] + [(i, s) for i in range(2000, 2300) for s in ("all", "g1:2", "g2:3")]
    vectors = {i + 100 * k: v for i, v in vectors.items() for k in range(7)}
    s, e = tables(spark, more, vectors)
    want = plainly(more, vectors)
    found = allpairs.nearest(similarity.profiles(s, e), block=16, direct=1)
    assert lists(found.best.collect()) == {i: x for i, x in want.items() if x}
    assert found.blocks <= 12
    got = [(r.case_a, r.case_b) for r in allpairs.above(similarity.profiles(s, e), 0.6, block=16, direct=1).collect()]
    want = plainly(more, vectors, top=10**6, least=0.6)
    assert len(got) == len(set(got)) and set(got) == {(min(a, b), max(a, b)) for a, x in want.items() for b in x}


def test_rounds_move_few_profiles_at_once_and_leave_no_tables(spark, monkeypatch):
    monkeypatch.setattr(allpairs, "MOVED", 4)
    monkeypatch.setattr(allpairs, "LEAST_MOVED", 0)
    moved, compare = [], allpairs.compare
    monkeypatch.setattr(allpairs, "compare", lambda left, right, pairs, *a, **k: (moved.append(pairs.count()), compare(left, right, pairs, *a, **k))[1])
    signals, vectors = portfolio(4, 30, seed=16, noise=3.0)
    s, e = tables(spark, signals, vectors)
    scratch.release(spark)
    found = allpairs.nearest(similarity.profiles(s, e), block=16, direct=1)
    assert lists(found.best.collect()) == {i: x for i, x in plainly(signals, vectors).items() if x}
    # A round has 2 pairs for each block on average; they are dealt by hash.
    assert max(moved) <= 5 * found.blocks and len(moved) > found.rounds
    kept = [x.rpartition("/")[2].rpartition("-")[0] for x in scratch._MADE[spark.sparkContext.applicationId]]
    assert scratch.release(spark) == len(kept) and kept.count("visited") <= 1 and kept.count("todo") <= 1


def test_what_is_shuffled_for_a_table_goes_with_its_write(spark):
    def shuffled():
        return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().size()

    before = shuffled()
    table = scratch.materialize(spark.range(5000).groupBy((F.col("id") % 50).alias("k")).count(), "counted")
    assert len(table.collect()) == 50 and scratch.drop(table) is None
    assert not [x for x in scratch._MADE.get(spark.sparkContext.applicationId, []) if "counted" in x]
    assert shuffled() <= before
