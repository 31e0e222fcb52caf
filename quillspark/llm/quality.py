"""Document quality by histogram gradient-boosted trees over document statistics.

Statistics of whole texts (shares of byte classes, word lengths, letter case, repetition of words, word
triples and lines) are computed with numpy over Arrow buffers. The trees are trained on the driver
from a bounded sample of labelled rows (TRAIN_ROWS, by a hash of the id), never from rows whose
crc32(doc_id as text) mod 5 is 0; labels, lang, source and doc_id are no inputs. The trees have equal depth
and are flattened into arrays, so scoring walks all rows and trees level by level.

Defined cases: null texts count as empty and get the score of an empty text; rows with a null
doc_id are scored and count as held out; equal rows repeat their result; without usable labels
every score is 0.5; several labels of one id count as their minimum;
very long texts are read whole; an empty documents table gives no rows; extra columns are left out, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, chunked, pick, share, shingles, table, text_bytes, word_hashes

#: Bound of the training sample, in rows.
TRAIN_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3
BINS = 64
DEPTH = 4
TREES = 80
RATE = 0.15
L2 = 1.0
LEAST_ROWS = 10

_PUNCT = b".,!?|#$%&*@/:;-_=+<>()[]{}\"'"
_CLASS = np.full(256, 7 + len(_PUNCT), np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 3, 4
_CLASS[128:192], _CLASS[192:] = 5, 6
for _i, _c in enumerate(_PUNCT):
    _CLASS[_c] = 7 + _i
N_CLASSES = 8 + len(_PUNCT)
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True
_SAME = np.arange(256, dtype=np.uint8)


def _repeats(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: distinct values, and the count of the most frequent one."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    key = np.sort((row.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits))
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    of = (key[at] >> (np.uint64(64) - bits)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, of, np.diff(np.append(at, len(key))))
    return np.bincount(of, minlength=n).astype(float), top


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of statistics per text."""
    n = len(off) - 1
    size = np.diff(off).astype(float)
    per = np.maximum(size, 1)
    cls = _CLASS[raw]
    of = np.repeat(np.arange(n), np.diff(off))
    shares = np.bincount(of * N_CLASSES + cls, minlength=n * N_CLASSES).reshape(n, N_CLASSES) / per[:, None]
    h, start, end, row = word_hashes(raw, off, SPACE, _SAME)
    words = np.bincount(row, minlength=n).astype(float)
    w = np.maximum(words, 1)
    mean = lambda x: np.bincount(row, weights=x, minlength=n) / w
    length = (end - start).astype(float)
    upper = np.concatenate(([0], np.cumsum(cls == 1)))
    lower = np.concatenate(([0], np.cumsum((cls == 0) | (cls >= 5) & (cls <= 6))))
    ups, lows = upper[end] - upper[start], lower[end] - lower[start]
    last = cls[end - 1] >= 7 if len(end) else np.zeros(0, bool)
    last2 = last & (length > 2) & (cls[np.maximum(end - 2, 0)] >= 7) if len(end) else last
    none = (ups + lows == 0).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    kinds, top = _repeats(row, h, n)
    s, r = shingles(h, row, n, 3)
    triples, top3 = _repeats(r, s, n)
    n3 = np.maximum(np.bincount(r, minlength=n), 1)
    lh, ls, le, lr = word_hashes(raw, off, NEWLINE, _SAME)
    lines = np.bincount(lr, minlength=n).astype(float)
    line_kinds, top_line = _repeats(lr, lh, n)
    line_len = (le - ls).astype(float)
    short = np.bincount(lr, weights=line_len < 40, minlength=n)
    nl = np.maximum(lines, 1)
    more = [
        np.log1p(size), np.log1p(words), mean(length), mean(length**2), np.log1p(longest),
        mean(length <= 3), mean(length >= 12), mean((ups > 1) & (lows == 0)), mean((ups > 0) & (lows > 0)), mean(last), mean(last2), mean(none),
        kinds / w, top / w, triples / n3, top3 / n3, np.log1p(lines), line_kinds / nl, top_line / nl, short / nl, words / nl,
    ]
    return np.column_stack([shares, *more])


@dataclass
class Trees:
    """Complete trees of DEPTH levels: inner nodes and leaves in level order, trees by rows."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics."""
        total = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))
        for a in range(0, len(x), 2048):
            part = x[a : a + 2048]
            at = np.zeros((len(part), len(trees)), np.int64)
            rows = np.arange(len(part))[:, None]
            for _ in range(DEPTH if len(trees) else 0):
                at = 2 * at + 1 + (part[rows, self.feature[trees, at]] > self.limit[trees, at])
            if len(trees):
                total[a : a + 2048] += self.leaf[trees, at - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Boosts regression trees on the logistic loss from binned statistics."""
    inner = 2**DEPTH - 1
    empty = Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, 2**DEPTH)))
    if not len(y) or y.min() == y.max():
        empty.base = 0.0 if not len(y) else (3.0 if y[0] else -3.0)
        return empty
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    base = float(np.log(y.mean() / (1 - y.mean())))
    f = np.full(n, base)
    feature, limit, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**DEPTH))
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            k, first = 2**level, 2**level - 1
            local = node - first
            best = np.full(k, 1e-6)
            for j in range(d):
                if not len(edges[j]):
                    continue
                key = local * BINS + binned[:, j]
                gs, hs, cs = (np.bincount(key, weights=v, minlength=k * BINS).reshape(k, BINS).cumsum(axis=1) for v in (g, h, None))
                gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                gain[(cs < LEAST_ROWS) | (ct - cs < LEAST_ROWS)] = 0
                gain = gain[:, : len(edges[j])]
                at = gain.argmax(axis=1)
                got = gain[np.arange(k), at]
                for i in np.flatnonzero(got > best):
                    best[i], feature[t, first + i], limit[t, first + i] = got[i], j, edges[j][at[i]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > limit[t, node])
        local = node - inner
        leaf[t] = RATE * np.bincount(local, weights=g, minlength=2**DEPTH) / (np.bincount(local, weights=h, minlength=2**DEPTH) + L2)
        f += leaf[t, local]
    return Trees(base, feature, limit, leaf)


def _measure(batches):
    for b in chunked(batches):
        x = statistics(*text_bytes(b.column("text")))
        yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(x.reshape(-1), x.shape[1]).cast(pa.list_(pa.float64())), b.column("label")], ["x", "label"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees from at most about `rows` labelled rows outside the held-out fold."""
    labels = pick(labels, doc_id="long", quality="int").where("doc_id is not null and quality is not null")
    labels = labels.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0).groupBy("doc_id").agg(F.min("quality").alias("label"))
    n = labels.count()
    labels = labels.where(share(F.xxhash64("doc_id", F.lit("sample")), rows, n))
    chosen = pick(docs, doc_id="long", text="string").join(F.broadcast(labels), "doc_id")  # bounded by `rows`
    got = chosen.select("text", "label").mapInArrow(_measure, "x array<double>, label int").toPandas()
    if not len(got):
        return train(np.zeros((0, 1)), np.zeros(0))
    x, y = np.stack(got["x"].to_list()), got["label"].to_numpy(float)
    order = np.lexsort(np.column_stack([x, y]).T)  # the order in which tasks end doesn't matter
    return train(x[order], y[order])


def _scored(docs: DataFrame, model: Trees) -> DataFrame:
    """docs with columns named by place, and _score."""
    at = docs.columns.index("text")
    plain = docs.toDF(*(f"_p{i}" for i in range(len(docs.columns))))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in plain.schema), T.StructField("_score", T.DoubleType())])

    def run(batches):
        for b in chunked(batches, f"_p{at}"):
            raw, off = text_bytes(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(statistics(raw, off)))], [*b.schema.names, "_score"])

    return plain.mapInArrow(run, schema)


def score_documents(docs: DataFrame, model: Trees, name: str = "_score") -> DataFrame:
    """docs with all their columns, and the score as the last one."""
    return _scored(docs, model).toDF(*docs.columns, name)


def good_rows(docs: DataFrame, model: Trees, least: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score is least or more."""
    return _scored(docs, model).where(F.col("_score") >= least).drop("_score").toDF(*docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(pick(docs, doc_id="long", text="string"), model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
