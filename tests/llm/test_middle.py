import hashlib
import re

from quillspark.llm import middle

UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plainly(doc_id, text, seed=42, rate=50, first=80):
    t = text or ""
    units = UNIT.findall(t)
    d = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(d[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", t, None, None
    if h[3] % 100 < first:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


TEXTS = [
    "one two  three\nfour ", "", None, " ", " \t\r\n\x0b\x0c ", "x", "a\x01b \x02a \x02b\x01 \x02\x02 \x01\x01", "\x01", "\x02", "\x02b \x01a", "tagged <P> here", "almost <P here< S>", "ends with <", "<", "ümlaut naïve 日本語　wide space \U0001f600 z",
    "$0 \\1 $1 \\ back", "no\nspace\nbut\nlines\n", "a" * 5000, "(", "<<P", "M>", ">",
]


def rows(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n, r.form, r.output, r.prefix_chars or 0, r.middle_chars or 0) for r in df.collect())


def test_units_parts_and_forms_equal_a_plain_version(spark):
    data = [(i * 100 + j, t) for j, t in enumerate(TEXTS) for i in range(12)]
    for rate, first in ((50, 80), (100, 50), (0, 0)):
        got = middle.rearrange(spark.createDataFrame(data, "doc_id long, text string"), rate=rate, suffix_first=first)
        want = [(i, *plainly(i, t, rate=rate, first=first)) for i, t in data]
        assert rows(got) == sorted((i, n, f, o, p or 0, m or 0) for i, n, f, o, p, m in want)


def test_texts_come_back(spark):
    data = [(i * 100 + j, t) for j, t in enumerate(TEXTS) for i in range(5)]
    out = middle.rearrange(spark.createDataFrame(data, "doc_id long, text string"), rate=100)
    back = out.select("doc_id", middle.restored(out.output, out.form).alias("back"), "form").collect()
    texts = dict(data)
    assert all(r.back == (texts[r.doc_id] or "") for r in back) and {r.form for r in back} == {"plain", "psm", "spm"}


def test_awkward_tables(spark, awkward, clash, nothing):
    for docs in (awkward, clash):
        got = middle.rearrange(docs)
        want = [(r.doc_id, *plainly(r.doc_id, r["text"])) for r in awkward.select("doc_id", "text").collect()]
        assert rows(got) == sorted((-1 if i is None else i, n, f, o, p or 0, m or 0) for i, n, f, o, p, m in want)
    assert middle.rearrange(nothing).count() == 0


def test_nothing_is_shuffled(spark, awkward):
    plan = middle.rearrange(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
