"""The kept index against the scan."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import search, textindex
from quillspark.sources import scratch

WORDS = [f"{s}{e}" for s in ("contract", "claim", "court", "insur", "medic", "apache", "licen", "report") for e in ("", "s", "ed", "ance")]


def made(n, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.choice([0, 3, 5, 8, 20, 60, 200])
        out.append((i, None if i % 37 == 0 else " ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(len(WORDS))], k=size)) + (f" rare{i % 50}" if i % 9 == 0 else "")))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def told(df, key="id"):
    return [(r[key], round(r["score"], 8)) for r in df.collect()]


QUERIES = ["contract", "licen* apache", "rare7 court", "medic insur claim report", "contracts nothing"]


@pytest.fixture(scope="module")
def texts(spark):
    return table(spark, made(700)).cache()


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    x = textindex.TextIndex(spark, str(tmp_path_factory.mktemp("index")), texts=40)
    x.add(texts, "id")
    return x


@pytest.mark.parametrize("query", QUERIES)
@pytest.mark.parametrize("limit", [7, 5000])
def test_top_equals_the_scan(texts, index, query, limit):
    assert told(index.top(query, limit).rows, "key") == told(search.fulltext(texts, query, "id", limit=limit))


def test_blocks_that_cannot_win_are_not_read(index):
    found = index.top("contract", 5)
    assert found.blocks > 15 and found.read < found.blocks / 2
    assert index.top("contract", 5000).read == found.blocks


def test_filters_take_their_own_statistics(texts, index):
    some = texts.where("id % 3 = 1")
    for query in QUERIES[:2]:
        assert told(search.fulltext(some, query, "id", limit=9, index=index)) == told(search.fulltext(some, query, "id", limit=9))
    assert told(search.fulltext(some, "court", "id", limit=None, index=index)) == told(search.fulltext(some, "court", "id", limit=None))


def test_deltas_and_removals_equal_the_scan_and_are_merged(spark, tmp_path):
    rows = dict(made(300, seed=4))
    x = textindex.TextIndex(spark, str(tmp_path / "index"), texts=30)
    x.add(table(spark, list(rows.items())), "id")
    rng = random.Random(9)
    for step in range(4):
        changed = {i: f"apache {rng.choice(WORDS)} " * rng.randrange(4) for i in rng.sample(range(400), 25)}
        rows |= changed
        x.add(table(spark, list(changed.items())), "id")
        gone = rng.sample(sorted(rows), 5)
        rows = {i: t for i, t in rows.items() if i not in gone}
        x.remove(table(spark, [(i, "") for i in gone]), "id")
        if step in (0, 3):
            for query in ("licen* apache", "contract rare7"):
                assert told(x.top(query, 12).rows, "key") == told(search.fulltext(table(spark, list(rows.items())), query, "id", limit=12)), (step, query)
    assert len(x.segments()) <= textindex.SEGMENTS + 1
    x.merge()
    assert len(x.segments()) == 1 and told(x.top("licen* apache", 12).rows, "key") == told(search.fulltext(table(spark, list(rows.items())), "licen* apache", "id", limit=12))


def test_an_index_of_nothing(spark, tmp_path):
    x = textindex.TextIndex(spark, str(tmp_path / "index"))
    assert x.top("a", 3).rows.count() == 0
    x.add(table(spark, []), "id")
    assert x.top("a", 3).rows.count() == 0 and x.counts("a").count() == 0


def test_medical_candidates_by_index_without_a_limit(spark, tmp_path):
    cases = spark.createDataFrame([(i, f"case {i}", "spine pain" if i == 0 else None) for i in range(12)], "case_id long, case_name string, main_injury string")
    names = spark.createDataFrame([(1, "spine")], "case_id long, name string")
    chunks = spark.createDataFrame([(f"c{i}", i, f"the spine of {i} " * (1 + i % 3) if i != 5 else "nothing") for i in range(12)], "chunk_id string, case_id long, text string").withColumn("char_count", F.length("text"))
    x = textindex.TextIndex(spark, str(tmp_path / "index"))
    x.add(chunks.select("chunk_id", "text"), "chunk_id")
    run = lambda **more: [tuple(r) for r in search.medical_evidence(cases, names, names, chunks, "spine", neurological=("pain",), spine=("spine",), **more).collect()]
    assert run(candidates=None) == run(candidates=None, index=x) and len(run(candidates=None)) == 11
    assert run(candidates=3) == run(candidates=3, index=x)


def test_blocks_are_bounded_by_words_and_an_index_leaves_nothing_in_scratch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "MOST_WORDS", 500, raising=False)
    rows = [(i, "court " * (i % 3) + "claim " * 200) for i in range(40)] + [(100, None), (101, "claim")]
    x = textindex.TextIndex(spark, str(tmp_path / "index"))
    scratch.release(spark)
    x.add(table(spark, rows), "id")
    x.remove(table(spark, rows[:3]), "id")
    assert not scratch._MADE.get(spark.sparkContext.applicationId)
    assert x.top("court", 3).blocks >= 8
    for query in ("court", "claim cour*"):
        assert told(x.top(query, 9).rows, "key") == told(search.fulltext(table(spark, rows[3:]), query, "id", limit=9))
