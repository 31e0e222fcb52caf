"""Operators on documents against plain Python versions, and on awkward tables."""

import collections
import hashlib
import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import common, decontaminate, licenses, lm, minhash, mixing, passages, pii, quality

FOLD = {c: c + 32 for c in range(65, 91)}


def ids(df):
    return sorted(((r.doc_id is None, r.doc_id) for r in df.select("doc_id").collect()), key=str)


@pytest.mark.parametrize("name", ["license", "pii", "minhash", "decontaminate", "mix", "quality", "lm"])
def test_every_row_has_a_result(name, awkward, clash, nothing, labels, items):
    run = {
        "license": licenses.documents_with_licenses, "pii": pii.find_personal_data, "minhash": minhash.near_duplicates, "decontaminate": lambda d: decontaminate.decontaminate(d, items),
        "mix": mixing.mix, "quality": lambda d: quality.score_documents(d, quality.fit(d, labels)), "lm": lm.score_texts,
    }[name]
    assert ids(run(clash)) == ids(awkward)
    assert run(nothing).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_word_hashes_split_at_rows_and_spaces():
    texts = ["a B", "", "b  a\n", "ab"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0] + [len(t) for t in texts])
    h, _, _, row = common.word_hashes(raw, off)
    assert row.tolist() == [0, 0, 2, 2, 3] and h[0] == h[3] and h[1] == h[2] and len(set(h.tolist())) == 3


# ---------------------------------------------------------------- near duplicates


def bag(text):
    w = text.translate(FOLD).split()
    return collections.Counter(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def jaccard(a, b):
    o = sum((a & b).values())
    return o / (sum(a.values()) + sum(b.values()) - o)


def test_signatures_are_unbiased(words):
    base = words(300)
    other = base[:240] + words(60)
    texts = [" ".join(base + base[:50]), " ".join(other + other[:20])]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    row, item, count = minhash.bags(raw, np.array([0, len(texts[0]), len(raw)]))
    sig = minhash.signatures(row, item, count, 2, 4096)
    want = jaccard(*map(bag, texts))
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / 4096)


def test_near_duplicates_match_brute_force(spark, words):
    import random

    rng, texts = random.Random(5), []
    for _ in range(12):
        base = words(120)
        for _ in range(6):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = f"z{rng.randrange(10**9)}"
            texts.append(" ".join(t))
    texts += [texts[0], texts[0].upper(), "few words", "few words", "", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.class_size, r.kept) for r in minhash.near_duplicates(docs).collect()}
    bags = [bag(t or "") for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= 0.8:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    size = collections.Counter(root(i) for i in range(len(texts)))
    assert got == {i: (root(i), size[root(i)], root(i) == i) for i in range(len(texts))}
    kept = minhash.keep_one(docs.unionByName(docs.limit(3)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in got if got[i][2])


# ---------------------------------------------------------------- decontamination


def brute_hits(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall((text or "").translate(FOLD))
    hit, found = set(), set()
    for item, t in items:
        v = word.findall((t or "").translate(FOLD))
        n = min(10, len(v))
        for s in range(len(v) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[s : s + n]:
                    hit.update(range(p, p + n))
                    found.add(item)
    return len(w), len(hit), found


@pytest.mark.parametrize("known", [20_000, 0])
def test_decontamination_matches_brute_force(spark, words, monkeypatch, known):
    monkeypatch.setattr(decontaminate, "KNOWN", known)
    its = [(i, " ".join(words(25))) for i in range(5)] + [(7, "Alpha-beta, gamma!"), (8, "é È"), (9, None), (10, "")]
    docs = []
    for i in range(40):
        t = words(60)
        if i % 3 == 0:
            k = i % 14
            t[5:5] = its[i % 5][1].split()[k : k + 12]
        if i % 4 == 0:
            t += ["ALPHA beta", "gamma"]
        docs.append((i, " ; ".join(t)))
    docs += [(50, None), (51, ""), (52, "é È é"), (53, its[0][1] + " " + its[0][1]), (53, its[0][1] + " " + its[0][1])]
    rows = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(its, "item_id long, text string")).collect()
    assert len(rows) == len(docs)
    text = dict(docs)
    for r in rows:
        n, hit, found = brute_hits(text[r.doc_id], its)
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), sha, hit > 0)
    clean = decontaminate.clean_rows(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(its, "item_id long, text string"))
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, t in docs if not brute_hits(t, its)[1])


# ---------------------------------------------------------------- personal data


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    out = []
    for k, (kind, p) in enumerate(kinds):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


AWKWARD = ["a@b.c_d@e.f x+y@z.co.uk 1.2.3.4.5.6.7.8 256.1.1.1 0010.1.1.1", "+1 (234) 567-8901. 4111 1111 1111 1111 +12 ......", "9" * 3000, "+" * 50 + "1" * 20 + " é@é a.b@c a@b-c.d-e..f", "ä 1.1.1.1 😀 2.2.2.2 x@y.z " * 100, "@.@..@", "", None, "5555 5555-5555 4444,", "1-2-3-4 5"]


def test_personal_data_matches_plain_patterns(spark):
    docs = spark.createDataFrame(list(enumerate(AWKWARD)), "doc_id long, text string")
    for r in pii.find_personal_data(docs).collect():
        assert r.base_sha256 == hashlib.sha256(brute_spans(AWKWARD[r.doc_id]).encode()).hexdigest(), AWKWARD[r.doc_id][:60]


def test_revealing_terms_are_found_and_generalised(spark, words):
    rows = [(i, f"{' '.join(words(30))} the office of Zyrandel {i} writes from q@secret.org daily {i} {' '.join(words(30))}") for i in range(6)]
    rows += [(100 + i, " ".join(words(40)) + " the office of the day") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    at = rows[0][1].index("Zyrandel")
    assert f"term:{at}:{at + 8}" in out[0].spans and "email:" in out[0].spans and out[100].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "Zyrandel" not in clean[0] and "[EMAIL]" in clean[0] and "office" in clean[0] and clean[100] == rows[6][1]


def test_terms_match_brute_force(spark, words):
    """Terms by plain counts over documents; a revealing name is found in texts without the address as well."""
    rows = [(i, f"{' '.join(words(10))} near Qorvane{i} ask Zyrandel {i} at q@secret.org or Maro {i} {' '.join(words(10))}") for i in range(8)]
    rows += [(100 + i, " ".join(words(30)) + (" Zyrandel was here; ZYRANDEL again" if i == 3 else " maro" if i % 2 else "")) for i in range(80)]
    word = re.compile(r"[^\W\d_]{3,}")
    texts = [t for _, t in rows]
    has = [set(w.lower() for w in word.findall(t)) for t in texts]
    of, n = [i for i, t in enumerate(texts) if "q@secret.org" in t], len(texts)
    reveals = set()
    for w in set().union(*has):
        df, joint = sum(w in h for h in has), sum(w in has[i] for i in of)
        near = {texts[i] for i in of if w in word.findall(texts[i][max(0, texts[i].index("q@") - 60) : texts[i].index("q@") + 70].lower())}
        if joint and len(near) >= 2 and math.log2(n * joint / (df * len(of))) / math.log2(n / len(of)) >= 0.8:
            reveals.add(w)
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "zyrandel" in reveals and "maro" not in reveals
    for i, t in rows:
        terms = {t[int(a) : int(b)].lower() for a, b in (s.split(":")[1:] for s in got[i].spans.split(",") if s.startswith("term"))}
        assert terms & {"zyrandel", "maro"} == {w for w in ("zyrandel", "maro") if w in reveals and w in t.lower()}
        assert terms <= reveals
    assert got[103].n_term == 2


# ---------------------------------------------------------------- mixing


def test_mix_meets_targets(spark, words):
    rows = [(i, " ".join(words(1 + i * 7 % 90)), s) for i, s in enumerate(["a"] * 120 + ["b"] * 30 + ["c"] * 40 + [None] * 10)]
    docs = spark.createDataFrame([*rows, (500, None, "a"), (500, None, "a")], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    weight = dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True))
    target, total = {}, 1.5 * sum(size.values())
    while True:  # share, stop, share again
        free = [s for s in size if s not in target]
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            target |= share
            break
        target |= {s: 2.0 * size[s] for s in over}
    for s in size:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - target[s]) <= 1 and all(abs(r.target - target[s]) < 1e-6 and r.taken <= 2 * r.size for r in mine)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    out = mixing.mix_rows(docs)
    assert out.columns == [*docs.columns, "size", "source_size", "target", "taken"] and out.where("taken = 0").count() == 0


# ---------------------------------------------------------------- quality


def test_trees_separate_held_out_rows():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    m = quality.train(x[:2000], y[:2000], trees=40)
    assert ((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.93


def test_flattened_trees_equal_a_walk():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 4))
    m = quality.train(x, (x.sum(axis=1) > 0).astype(float), trees=5)
    for row, got in zip(x[:20], m.score(x[:20]), strict=True):
        z = m.base
        for t in range(5):
            at = 0
            for _ in range(quality.DEPTH):
                at = 2 * at + 1 + int(row[m.feature[t, at]] > m.limit[t, at])
            z += m.leaf[t, at - (2**quality.DEPTH - 1)]
        assert got == pytest.approx(1 / (1 + math.exp(-z)))


def test_quality_accuracy_on_held_out_labels(spark):
    from pathlib import Path

    sf = "/root/testdata/sf0.1"
    if not Path(sf).exists():
        pytest.skip("no test tables")
    got = quality.op9_quality(spark, sf).where("held_out").join(common.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    agree, n = got.agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 500 and agree / n > 0.95


# ---------------------------------------------------------------- language model


def test_base_scores_match_brute_force(spark, words):
    rows = [(i, " ".join(words(40)).upper()) for i in range(60)] + [(70, None), (71, ""), (5, None)]
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    tok = [(i, [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(FOLD)) if w] + [None]) for i, t in rows]
    c = collections.Counter(w for i, ws in tok if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((i, zlib.crc32(str(i).encode()) % 7 == 2, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tok)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_windows_predict_each_token_once():
    begin = np.array([0, 3, 4, 90, 203])
    see, goal, row = lm.windows(begin, np.arange(lm.n_windows(begin)))
    last = goal[:, -lm.STRIDE :]
    assert sorted(last[last >= 0].tolist()) == list(range(203))
    for s, g, r in zip(see, goal, row, strict=True):  # a position sees only its own text, up to the token before its goal
        assert all(a == -1 or begin[r] <= a < begin[r + 1] for a in s) and all(a == b - 1 or a == -1 and b == begin[r] for a, b in zip(s, g, strict=True) if b >= 0)


def test_attention_is_causal_and_sums_to_one():
    rng = np.random.default_rng(2)
    m = lm.Attention()
    x = rng.standard_normal((3, lm.CONTEXT, lm.WIDTH)).astype(np.float32)
    lp = m.predict(x)
    assert np.allclose(np.exp(lp).sum(axis=2), 1, atol=1e-4)
    changed = x.copy()
    changed[:, -4] += 1
    again = m.predict(changed)
    assert np.allclose(lp[:, :-4], again[:, :-4]) and not np.allclose(lp[:, -4:], again[:, -4:])


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    m = lm.Attention(seed=3)
    start = np.concatenate(([0], np.cumsum(rng.integers(1, 4, 15))))
    args = (rng.integers(0, 50, start[-1]), start, rng.integers(-1, 15, (3, lm.CONTEXT)), rng.integers(-1, lm.N_CLASSES, (3, lm.CONTEXT)))
    # In double precision, so that a step can be too short to pass a kink of the rectifiers.
    m.w = {n: x.astype(np.float64) for n, x in m.w.items()}
    _, g = m.gradient(*args)
    for n, d in g.items():
        i, e = np.unravel_index(np.argmax(np.abs(d)), d.shape), 1e-4
        m.w[n][i] += e
        up = m.gradient(*args)[0]
        m.w[n][i] -= 2 * e
        down = m.gradient(*args)[0]
        m.w[n][i] += e
        assert (up - down) / (2 * e) == pytest.approx(float(d[i]), rel=1e-5), n


def test_attention_learns_order():
    m = lm.Attention()
    seq = np.arange(400) % 7
    begin = np.array([0, 400])
    see, goal, _ = lm.windows(begin, np.arange(lm.n_windows(begin)))
    batch = (seq + 2, np.arange(401), see, np.where(goal >= 0, seq[goal], -1))
    assert m.fit(lambda step: batch, 150, 0.01) < 0.5 < m.gradient(*batch[:3], rng_goal(batch[3]))[0]


def rng_goal(goal):
    return np.where(goal >= 0, np.random.default_rng(1).integers(0, 7, goal.shape), -1)


def test_sums_of_groups_are_the_whole_sum():
    rng = np.random.default_rng(3)
    w, n = rng.standard_normal((6, 2, 5)), [3, 1, 4, 1, 5, 9]
    batch = lambda part: pa.RecordBatch.from_pydict({"i": pa.array([0, 1] * len(part), pa.int32()), "w": [b.tobytes() for p in part for b in w[p]], "n": [n[p] for p in part for _ in range(2)]})
    groups = [next(lm._sum_blocks(iter([batch([0, 1]), batch([2])]))), next(lm._sum_blocks(iter([batch([3, 4, 5])])))]
    got = next(lm._sum_blocks(iter(groups)))
    assert got.column("i").to_pylist() == [0, 1] and got.column("n").to_pylist() == [23, 23]
    assert np.allclose([np.frombuffer(b) for b in got.column("w").to_pylist()], w.sum(axis=0))
    assert next(lm._sum_blocks(iter([]))).num_rows == 0


def test_scores_beat_the_base_and_are_probabilities(spark):
    """Texts of one of two vocabularies: what stands before tells which. The probabilities of all known words and of an
    unknown one of each class sum to 1 after any text."""
    import random

    rng = random.Random(3)
    kinds = [["red", "blue", "green", "pink"], ["one", "two", "three", "four"]]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(40))) for i in range(120)]
    out = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.2 * sum(r.n_tokens for r in out)


def test_attention_is_fitted_to_all_training_windows(spark, words, monkeypatch):
    """Each token of all training texts is predicted once, however many windows there are; held-out texts give none."""
    monkeypatch.setattr(lm, "FIT_LEAST", 100)
    rows, models, fit = [(i, " ".join(words(1 + 7 * (i % 40)))) for i in range(300)], [], lm.fit_attention
    monkeypatch.setattr(lm, "fit_attention", lambda *args: models.append(fit(*args)) or models[0])
    lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert models[0].fitted == sum(-(-(len(t.split()) + 1) // lm.CONTEXT) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2)


def test_shares_of_a_class_sum_to_one():
    """A class's known tokens and one unknown have all of its probability: (c + 1) / (N + V + 1) for each, 1 / (N + V + 1) for the unknown."""
    counts = np.array([5, 3, 9, 1])
    below = counts.sum() + len(counts) + 1
    assert sum((counts + 1) / below) + 1 / below == pytest.approx(1)


# ---------------------------------------------------------------- passages and licences


def test_planted_passages_are_found(spark, words):
    import random

    rng = random.Random(4)
    planted = [words(60) for _ in range(4)]
    rows, want = [], set()
    for i in range(80):
        t = words(rng.randrange(20, 300))
        if i % 5 == 0:
            p = list(planted[i // 5 % 4])
            if i % 10 == 0:
                p[rng.randrange(20, 40)] = "edit"
            k = rng.randrange(len(t))
            t[k:k] = p
            want.add(i)
        rows.append((i, " ".join(t)))
    rows += [(90, rows[1][1] * 2), (91, rows[1][1] * 2), (92, None), (93, ""), (93, "")]
    got = passages.documents_with_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id for r in got}
    assert want <= found and not found - want - {1, 90, 91}


def test_passages_of_parts_that_others_hold(spark, words):
    shared = words(70)
    rows = [(i, " ".join(words(20) + (shared if i < 2 else shared[:40] if i % 2 else shared[-40:]) + words(20))) for i in range(200)]
    got = {r.doc_id: r for r in passages.documents_with_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {0, 1} and {r.class_id for r in got.values()} == {0} and all(r.n_links == 1 and r.n_words >= 70 for r in got.values())


def test_each_pair_among_frequent_lines_is_found(spark, words):
    """Twelve pairs of texts share 60 words made of two lines of 30 that are common elsewhere."""
    lines = [words(30) for _ in range(24)]
    rows = [(2 * i + j, " ".join(words(25) + lines[2 * i] + lines[2 * i + 1] + words(25))) for i in range(12) for j in range(2)]
    rows += [(100 + i, " ".join(words(20) + lines[i % 24] + words(40))) for i in range(480)]
    got = {r.doc_id: r for r in passages.documents_with_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == set(range(24)) and all(got[i].class_id == i - i % 2 for i in got)


def test_exact_repeats_match_brute_force(spark, words):
    """Texts made of common lines: documents with a run of 50 words of another text, their words in such runs, and their classes."""
    import random

    rng = random.Random(8)
    lines = [words(rng.randrange(5, 40)) for _ in range(40)]
    rows = [(i, " ".join(sum((rng.choice(lines) if rng.random() < 0.7 else words(12) for _ in range(rng.randrange(1, 9))), []))) for i in range(250)]
    texts = [t.split() for _, t in rows]
    held = collections.defaultdict(set)
    for i, t in enumerate(texts):
        for p in range(len(t) - 49):
            held[tuple(t[p : p + 50])].add(i)
    want = {i for s in held.values() if len({rows[i][1] for i in s}) > 1 for i in s}
    got = {r.doc_id: r for r in passages.documents_with_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want and want <= set(got)
    assert all(got[i].class_id == got[j].class_id for s in held.values() for i in s for j in s if len({rows[i][1] for i in s}) > 1)
    # Words in such passages are in the spans.
    for i in want:
        spans = [tuple(map(int, x.split("-"))) for x in got[i].spans.split(",")]
        hit = {p + q for p in range(len(texts[i]) - 49) if len(held[tuple(texts[i][p : p + 50])]) > 1 for q in range(50)}
        assert sum(any(a <= p < b for a, b in spans) for p in hit) >= 0.97 * len(hit)


@pytest.mark.parametrize(("every", "least"), [(20, 0.98), (10, 0.95), (8, 0.8)])
def test_recall_of_edited_passages(spark, words, every, least):
    """Pairs of texts that share 80 words with every n-th replaced."""
    import random

    rng, rows = random.Random(every), []
    for i in range(60):
        p = words(80)
        q = [f"x{rng.randrange(10**9)}" if k % every == every // 2 else w for k, w in enumerate(p)]
        rows += [(2 * i, " ".join(words(30) + p + words(30))), (2 * i + 1, " ".join(words(50) + q + words(10)))]
    got = {r.doc_id for r in passages.documents_with_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(2 * i in got and 2 * i + 1 in got for i in range(60)) >= least * 60


def test_links_are_counted_to_all_holders(spark, words):
    """Thirty texts share an exact passage, thirty others one with every tenth word replaced: each is linked to all of its group."""
    import random

    rng = random.Random(6)
    exact, edited, rows = words(60), words(100), []
    for i in range(60):
        p = [f"x{rng.randrange(10**9)}" if k % 10 == 5 and i >= 30 else w for k, w in enumerate(exact if i < 30 else edited)]
        rows.append((i, " ".join(words(30) + p + words(30))))
    got = {r.doc_id: r for r in passages.documents_with_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].n_links == 29 for i in range(30))
    assert sum(got[i].n_links for i in range(30, 60)) >= 0.95 * 30 * 29


def test_edited_pairs_of_frequent_lines_are_linked(spark, words):
    """Twelve pairs of texts share 60 words of two lines that are common elsewhere, one side with five of them replaced."""
    import random

    rng = random.Random(9)
    lines, rows = [words(30) for _ in range(24)], []
    for i in range(12):
        p = lines[2 * i] + lines[2 * i + 1]
        q = list(p)
        for k in (6, 17, 29, 40, 52):
            q[k] = f"x{rng.randrange(10**9)}"
        rows += [(2 * i, " ".join(words(25) + p + words(25))), (2 * i + 1, " ".join(words(25) + q + words(25)))]
    rows += [(100 + i, " ".join(words(20) + lines[i % 24] + words(40))) for i in range(720)]
    got = {r.doc_id: r for r in passages.documents_with_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == set(range(24)) and all(got[i].class_id == i - i % 2 and got[i].n_links == 1 for i in got)


def test_texts_that_repeat_their_seeds_give_each_key_once():
    """A text of three seeds over and over has nine keys, not one for each two of its places; the text behind it keeps its own."""
    c, seed, pos = np.append(np.zeros(3000, np.int64), [1, 1, 1]), np.append(np.arange(3000) % 3, [7, 8, 9]), np.append(np.arange(3000), [0, 25, 30])
    cut = lambda lo, hi: pa.RecordBatch.from_arrays([pa.array(x[lo:hi]) for x in (c, seed, pos)], ["c", "seed", "pos"])
    got = [(r["c"], r["key"]) for b in passages._seed_pairs(iter([cut(0, 1500), cut(1500, 3001), cut(3001, 3003)])) for r in b.to_pylist()]
    assert len(got) == len(set(got)) and sorted(collections.Counter(t for t, _ in got).items()) == [(0, 9), (1, 2)]


def test_tables_that_are_read_no_more_are_deleted(spark):
    kept, gone = (common.written(spark.range(9), n) for n in ("kept", "gone"))
    files = [f.removeprefix("file://") for f in gone.inputFiles()]
    assert all(map(os.path.exists, files))
    common.release(gone)
    assert not any(map(os.path.exists, files)) and kept.count() == 9


def test_rounds_of_comparing_give_the_same_rows(spark, monkeypatch):
    import random

    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]  # noqa: E731  other tests keep their draws
    p = words(70)
    rows = [(i, " ".join(words(20) + [f"x{rng.randrange(10**9)}" if k % 10 == 5 + i % 2 else w for k, w in enumerate(p)] + words(20))) for i in range(40)]
    docs, got = spark.createDataFrame(rows, "doc_id long, text string"), []
    for share in (1e9, 1.5):
        made, kept = [], common.written
        monkeypatch.setattr(passages, "ROUND", share)
        monkeypatch.setattr(passages, "written", lambda df, name, made=made, kept=kept: made.append(name) or kept(df, name))
        rows = sorted(passages.documents_with_passages(docs).collect())
        got.append((made.count("chains"), rows))
        monkeypatch.setattr(passages, "written", kept)
    (one, whole), (many, parts) = got
    assert one == 1 < many < 30
    assert whole == parts and len(whole) == 40


def test_chains_follow_order():
    a, b = [0, 5, 10, 15, 3], [100, 105, 110, 115, 400]
    assert (0, 15, 100, 115) in passages.chains(a, b)
    assert passages.common_words("a b c d".split(), "a x c d".split()) == 3


def test_passages_of_awkward_tables(clash, nothing):
    got = passages.documents_with_passages(clash).collect()
    assert {r.doc_id for r in got} == {3, 8} and passages.documents_with_passages(nothing).count() == 0


def test_license_families(spark, words):
    notes = {1: "Licensed under the Apache License, Version 2.0.", 2: "Released under the MIT License.", 3: "This work is licensed under the GNU General Public License, version 3.", 4: "Licensed under CC BY-NC 4.0.", 5: "The license plate was lost near the public library.", 6: "", 7: None}
    rows = [(i, None if n is None else f"{' '.join(words(30))}\n{n}\n{' '.join(words(30))}") for i, n in notes.items()]
    rows += [(9, f"{notes[1]}\n{notes[2]}")]
    got = {r.doc_id: r.families for r in licenses.documents_with_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "apache", 2: "mit", 3: "gpl", 4: "cc-by-nc", 5: "", 6: "", 7: "", 9: "apache,mit"}


def test_licenses_of_wrapped_notices(spark, words):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    gpl = " * you can redistribute it and/or modify\n * it under the terms of the GNU General\n *\n * Public License as published by\n * the Free Software Foundation"
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
    notes = {1: mit, 2: gpl, 3: bsd, 4: f"{mit}\n{gpl}", 5: "Released under the MIT License.\nReleased under the MIT License."}
    rows = [(i, f"{' '.join(words(30))}\n{n}\n{' '.join(words(30))}") for i, n in notes.items()]
    got = {r.doc_id: (r.families, r.n_paragraphs) for r in licenses.documents_with_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("mit", 1), 2: ("gpl", 1), 3: ("bsd", 1), 4: ("gpl,mit", 2), 5: ("mit", 2)}


def test_prose_with_marks_writes_next_to_nothing(spark, words, monkeypatch):
    """Ordinary words that licences use as well: only paragraphs around a template's own runs are looked at."""
    text = lambda i: "\n".join(" ".join(words(6)) + " under the general terms published with documentation " + " ".join(words(6)) for _ in range(20)) + ("\nReleased under the\nMIT License." if i % 30 == 0 else "")
    rows = [(i, text(i)) for i in range(120)]
    kept = {}
    monkeypatch.setattr(licenses, "written", lambda df, name: kept.setdefault(name, common.written(df, name)))
    got = {r.doc_id: r.families for r in licenses.documents_with_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: "mit" if i % 30 == 0 else "" for i in range(120)}
    # Four texts have a licence, and about 25 starts of 25 lengths each around it; without the places all 2,400 lines would have.
    assert kept["places"].count() == 4 and kept["grams"].count() < 4 * 25 * 25 * 2


def test_held_out_templates_of_every_family_are_known():
    """Fitted without the last template of a family, the model still prefers that family for it more often than not."""
    _, _, _, temperature, least = licenses.train(["a line of some text"] * 5)
    assert 0.05 <= temperature <= 5 and 0.5 <= least <= 0.9
    assert all(len(t) > 1 for t in licenses.TEMPLATES.values())
