"""Both sides of the switch between broadcast and shuffled joins give the same rows, also for hot keys."""

import random

import pytest

from quillspark.llm import common, decontaminate, minhash, mixing, passages, pii


@pytest.fixture(scope="module")
def docs(spark, words):
    """Copies and near copies, a word and a line in most documents, personal data with a name beside it, a hot source."""
    rng = random.Random(5)
    line, long, rows = " ".join(words(30)), words(60), []
    for i in range(90):
        w = ["the", *words(40), *([line] if i % 3 else [])]
        if i % 9 == 0:
            w += ["Quillon", "Varga", f"q.varga@mail{i % 2}.example", *words(3)]
        if i % 10 == 1:
            w += [x if rng.random() > 0.03 else "changed" for x in long]
        rows.append((i, " ".join(w), "hot" if i % 3 else f"s{i % 7}"))
    rows += [(100 + i, rows[4][1], None) for i in range(12)] + [(120 + i, rows[5][1] + f" end{i}", "hot") for i in range(12)] + [(7, rows[7][1], "hot"), (None, rows[8][1], "hot"), (140, None, "x"), (141, "", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def benchmark(spark, docs):
    texts = [r.text.split()[5:30] for r in docs.where("doc_id in (3, 5, 11)").collect()]
    return spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(8, "the"), (9, None)], "item_id long, text string")


@pytest.mark.parametrize("name", ["pii", "minhash", "decontaminate", "mix", "passages"])
def test_shuffled_joins_give_the_rows_of_broadcast_ones(name, docs, benchmark, monkeypatch):
    run = {"pii": pii.find_personal_data, "minhash": minhash.near_duplicates, "decontaminate": lambda d: decontaminate.decontaminate(d, benchmark), "mix": mixing.mix, "passages": passages.documents_with_passages}[name]
    rows = lambda: sorted(map(str, run(docs).collect()))
    want = rows()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontaminate, "KNOWN", 0)
    monkeypatch.setattr(decontaminate, "PRINTS", 0)
    monkeypatch.setattr(common, "HEAVY", 1 / 20)
    assert rows() == want and len(want) > 20


def test_salted_join_on_two_keys(spark):
    left = spark.createDataFrame([(1 if i % 4 else i, "a" if i % 2 else "b", i) for i in range(200)], "x long, y string, k long")
    right = spark.createDataFrame([(1, "a", 10), (1, "a", 11), (1, "b", 12), (8, "b", 13), (9, "b", 14)], "x long, y string, v long")
    want = sorted(map(tuple, left.join(right, ["x", "y"]).collect()))
    assert sorted(map(tuple, common.join_salted(left, right, ["x", "y"], "k").collect())) == want and len(want) > 100
