"""Licence scans by a trained paragraph classifier; the scan itself uses DataFrame functions only.

A paragraph (a line of a text, or several in a row, as notices are often wrapped) is the set of its word 1- to 3-grams (runs of letters and digits, lower-cased). A multinomial
logistic regression over the n-grams of the licence templates scores each family against "unknown". It is trained on the driver, in
numpy, from the templates (whole, cut, and set among corpus words), hard negatives (shuffled and single licence
words among corpus words), and a bounded sample of corpus lines (SAMPLE_LINES of whole texts of SAMPLE_ROWS documents). Held-out
templates calibrate a temperature and the least probability below which a prediction falls to
unknown. A prediction counts only if a template of its family confirms it: CONTAINED of the template's 3-grams occur in the paragraph.

Paragraphs of several lines start at each line and end with any line that the longest template could reach from there; lines
without words count for nothing. One counts only if no shorter one of the same family lies within it, nor an earlier one overlaps it.
Texts and paragraphs without any of MARKS are left out of the scan without loss: a paragraph that holds CONTAINED of a
template's 3-grams holds one of its marks. Weights are a fixed, small table, joined to the n-grams.

Paragraphs are made only around places where a template's 3-gram stands (found in the scan, by a join with the few there are), and only
n-grams with a weight are written, so ordinary prose with words like "under" leaves no trace. One paragraph gives one family, the likeliest.

Defined cases: null and empty texts have no licences; equal rows repeat their result; very long texts are scanned whole; an
empty table gives no rows; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import let, pick, row_key, share, small, table, written

# Customary wordings of licence notices, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": ("licensed under the apache license version 2.0", "distributed under the apache license 2.0", "you may obtain a copy of the license at http www apache org licenses license 2.0", "spdx license identifier apache 2.0", "released under the apache license"),
    "mit": ("released under the mit license", "licensed under the mit license", "this project is licensed under the terms of the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "spdx license identifier mit"),
    "gpl": ("licensed under the gnu general public license version 3", "this work is licensed under the gnu general public license version 2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "released under the gnu general public license", "released under the gpl license", "spdx license identifier gpl 3.0"),
    "lgpl": ("licensed under the gnu lesser general public license version 2.1", "under the terms of the gnu lesser general public license as published by the free software foundation", "spdx license identifier lgpl 2.1"),
    "agpl": ("licensed under the gnu affero general public license version 3", "under the terms of the gnu affero general public license", "spdx license identifier agpl 3.0"),
    "bsd": ("licensed under the bsd license", "released under the 3 clause bsd license", "redistribution and use in source and binary forms with or without modification are permitted under this license", "spdx license identifier bsd 3 clause"),
    "mpl": ("subject to the terms of the mozilla public license version 2.0", "licensed under the mozilla public license", "spdx license identifier mpl 2.0"),
    "cc-by": ("licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "spdx license identifier cc by 4.0"),
    "cc-by-sa": ("licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license", "released under the creative commons attribution sharealike license"),
    "cc-by-nc": ("licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", "licensed under cc by nc sa 4.0", "licensed under cc by nc nd 4.0"),
    "public-domain": ("released into the public domain without any license", "this is free and unencumbered software released into the public domain with no license", "licensed under cc0 1.0 universal", "this work is dedicated to the public domain copyright is waived"),
    "reserved": ("copyright all rights reserved", "all rights reserved no part may be reproduced without permission", "proprietary and confidential all rights reserved", "copyright c 2020 all rights reserved"),
}
UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *TEMPLATES)
CONTAINED = 0.7
#: Bounds of the negatives: about so many documents, and of the lines of their whole texts about so many.
SAMPLE_ROWS, SAMPLE_LINES = 400, 4000
COPIES = 24
ROUNDS = 300


def _tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def _of(template: str) -> list[str]:
    """The 3-grams of a template, or the template, if it has fewer words."""
    words = _tokens(template)
    n = min(3, len(words))
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def _marks(template: str) -> set[str]:
    """Words of which each paragraph that holds CONTAINED of the template's 3-grams has one: without all
    of their 3-grams too few are left. Forms of licence come first, then long words."""
    grams = set(_of(template))
    out: set[str] = set()
    for w in sorted(set(_tokens(template)), key=lambda w: (not w.startswith("licens"), -len(w), w)):
        if sum(not out & set(g.split()) for g in grams) < CONTAINED * len(grams):
            break
        out.add("licens" if w.startswith("licens") else w)
        if "licens" in out:
            out |= {x for x in _tokens(template) if x.startswith("licens")}
    return out


#: Every paragraph of a licence has one of these in its lower-cased text.
MARKS = sorted({"licens" if m.startswith("licens") else m for ts in TEMPLATES.values() for t in ts for m in _marks(t)})
#: Words of the longest template.
LONGEST = max(len(_tokens(t)) for ts in TEMPLATES.values() for t in ts)


def _fitted(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of the regression on rows x of families y."""
    w, b = np.zeros((x.shape[1], len(FAMILIES))), np.zeros(len(FAMILIES))
    goal = np.eye(len(FAMILIES))[y]
    step = 4.0 / max(1.0, float((x**2).sum(axis=1).mean())) * 4
    for _ in range(ROUNDS):
        p = _softmax(x @ w + b)
        w -= step * (x.T @ (p - goal) / len(x) + 1e-4 * w)
        b -= step * (p - goal).mean(axis=0)
    return w, b


def train(filler: list[str], seed: int = 3) -> tuple[list[str], np.ndarray, np.ndarray, float, float]:
    """Vocabulary, weights (n-grams x families), biases, temperature, and least probability.

    The last template of each family, with all rows made of it, is held out of a first fit, which gives temperature and least
    probability: they come from wordings that it hasn't seen. The weights are then fitted on all rows."""
    rng = np.random.default_rng(seed)
    vocabulary = sorted(set().union(*(_grams(_tokens(t)) for ts in TEMPLATES.values() for t in ts)))
    index = {g: i for i, g in enumerate(vocabulary)}
    lines = [w for w in map(_tokens, filler) if w] or [["lorem", "ipsum", "dolor"]]
    some = lambda most: (w := lines[rng.integers(len(lines))])[: rng.integers(0, most + 1)] if most else []
    rows: list[tuple[list[str], int, bool]] = []
    for y, family in enumerate(FAMILIES):
        for i, t in enumerate(TEMPLATES.get(family, ())):
            words, last = _tokens(t), i == len(TEMPLATES[family]) - 1
            for c in range(COPIES):
                part = list(words)
                if c % 4 == 3 and len(part) > 6:  # a cut end
                    part = part[: len(part) - int(rng.integers(1, 3))]
                rows.append((some(12 * (c > 0)) + part + some(40 * (c > 0)), y, last))
                # The same words, but not the wording.
                mixed = list(words)
                rng.shuffle(mixed)
                rows.append((some(12) + (mixed[: int(rng.integers(1, 4))] if c % 2 else mixed) + some(30), 0, last))
    rows += [(w, 0, i % 5 == 4) for i, w in enumerate(lines)]
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, (words, _, _) in enumerate(rows):
        for g in _grams(words):
            if g in index:
                x[i, index[g]] = 1
    y, held = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    w, b = _fitted(x[~held], y[~held])
    z, yh = x[held] @ w + b, y[held]
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(yh)), yh] + 1e-12).mean()
    temperature = min(np.geomspace(0.05, 5, 60), key=loss)
    p = _softmax(z / temperature)
    wrong = p[(p.argmax(axis=1) != yh) & (p.argmax(axis=1) > 0)].max(axis=1) if len(p) else np.zeros(0)
    least = float(min(0.9, max(0.5, np.quantile(wrong, 0.9)))) if len(wrong) else 0.5
    w, b = _fitted(x, y)
    w[np.abs(w) < 1e-3] = 0
    return vocabulary, w, b, float(temperature), least


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _has_mark(text: Column) -> Column:
    def of(lower):
        out = lower.contains(MARKS[0])
        for m in MARKS[1:]:
            out = out | lower.contains(m)
        return out

    # Named once: in a chain of alternatives the lower-cased text would be made anew for each.
    return let(F.lower(text), of)


def _words(p: Column) -> Column:
    return F.array_remove(F.split(F.lower(p), "[^a-z0-9]+", -1), "")


def _lines(text: Column) -> Column:
    """The lines of a text that have words: line, p, n (words)."""
    return F.filter(F.transform(F.split(text, "\n", -1), lambda p, i: F.struct(i.alias("line"), p.alias("p"), F.size(_words(p)).alias("n"))), lambda x: x["n"] > 0)


def _runs(lines: Column, sizes: list[int]) -> Column:
    """Runs of so many words (gram, at): at is the place of the line that the first word is in, from 1."""
    per = F.transform(lines, lambda x, at: F.struct(_words(x["p"]).alias("w"), (at + 1).alias("at")))
    flat = let(per, lambda ls: F.struct(F.flatten(F.transform(ls, lambda x: x["w"])).alias("w"), F.flatten(F.transform(ls, lambda x: F.array_repeat(x["at"], F.size(x["w"])))).alias("at")))
    none = F.array().cast("array<struct<gram:string,at:int>>")

    def of(s, n):
        run = lambda i: F.struct(F.concat_ws(" ", *(F.get(s["w"], i + j) for j in range(n))).alias("gram"), F.get(s["at"], i).alias("at"))
        return F.when(F.size(s["w"]) >= n, F.transform(F.sequence(F.lit(0), F.size(s["w"]) - n), run)).otherwise(none)

    return let(flat, lambda s: F.flatten(F.array(*(of(s, n) for n in sizes))))


def places(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """k and at: the places of lines where a run of words stands that is one of grams. A paragraph that a template confirms holds such a place."""
    sizes = sorted({len(g.split()) for ts in TEMPLATES.values() for t in ts for g in _of(t)})
    lines = docs.select("k", _lines(F.col("text")).alias("lines"))
    runs = lines.select("k", F.inline(_runs(F.col("lines"), sizes)))
    found = runs.join(F.broadcast(grams), "gram", "left_semi")
    return written(found.groupBy("k").agg(F.collect_set("at").alias("places")), "places")


def _paragraphs(lines: Column, starts: Column) -> Column:
    """Lines (line, p, n words) to paragraphs (line, last, p) from each of starts: a line, and as many of the next as LONGEST words need."""

    def from_line(i):
        rest = F.slice(lines, i + 1, F.least(F.size(lines) - i, F.lit(LONGEST)))
        # Lines of which LONGEST words or more lie before, after the first line, are not needed.
        many = F.size(F.filter(F.transform(rest, lambda x, at: F.aggregate(F.slice(rest, 1, at), F.lit(0), lambda a, y: a + y["n"])), lambda before: before < LONGEST))
        return F.transform(F.sequence(F.lit(0), many), lambda m: let(F.slice(lines, i, m + 1), lambda ls: F.struct(F.element_at(ls, 1)["line"].alias("line"), F.element_at(ls, -1)["line"].alias("last"), F.array_join(F.transform(ls, lambda x: x["p"]), "\n").alias("p"))))

    return F.flatten(F.transform(starts, from_line))


def find_licenses(docs: DataFrame) -> DataFrame:
    """(k, line, last, family, probability, template, contained) of licence paragraphs; k identifies a row by id and text."""
    spark = docs.sparkSession
    keyed = pick(docs, doc_id="long", text="string").where("text is not null").withColumn("k", row_key("doc_id", "text"))
    drawn = keyed.where(share(F.xxhash64("doc_id", "text"), SAMPLE_ROWS, docs.count()))
    lines = written(drawn.select("k", F.posexplode(F.split("text", "\n", -1)).alias("i", "p")).where((F.trim("p") != "") & ~_has_mark(F.col("p"))), "negatives")
    sample = lines.where(share(F.xxhash64("k", "i"), SAMPLE_LINES, lines.count())).select("p")
    vocabulary, w, b, temperature, least = train(sorted(r["p"] for r in sample.collect()))

    rows = [(g, [float(v) for v in w[i]]) for i, g in enumerate(vocabulary)]
    weights = spark.createDataFrame(rows, "gram string, w array<double>")
    triples = {(f, f"{f}/{i}", g, len(gs)) for f, ts in TEMPLATES.items() for i, t in enumerate(ts) if (gs := sorted(set(_of(t)))) for g in gs}
    templates = spark.createDataFrame(sorted(triples), "family string, template string, gram string, of int")

    # Only paragraphs around places of the templates' own runs are made: what has a mark by chance is left in the scan.
    marked = keyed.where(_has_mark(F.col("text")))
    near = places(marked, templates.select("gram").distinct())
    hit = marked.join(near, "k").dropDuplicates(["k"])
    reach = F.array_distinct(F.flatten(F.transform("places", lambda m: F.sequence(F.greatest(m - LONGEST, F.lit(1)), m))))
    lines = hit.select("k", reach.alias("starts"), _lines(F.col("text")).alias("lines")).select("k", F.inline(_paragraphs(F.col("lines"), F.col("starts")))).where(_has_mark(F.col("p")))

    def grams(v: Column) -> Column:
        of = lambda m: F.when(F.size(v) >= m, F.transform(F.sequence(F.lit(1), F.size(v) - m + 1), lambda i: F.array_join(F.slice(v, i, m), " "))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(of(1), of(2), of(3)))

    # Grams without a weight add nothing, and a template's own all have one.
    exploded = lines.select("k", "line", "last", F.explode(let(_words(F.col("p")), grams)).alias("gram"))
    grams_of = written(exploded.join(F.broadcast(weights.select("gram")), "gram", "left_semi"), "grams")
    sums = [F.sum(F.element_at("w", i + 1)).alias(f"z{i}") for i in range(len(FAMILIES))]
    logits = grams_of.join(F.broadcast(weights), "gram").groupBy("k", "line", "last").agg(*sums)
    z = F.array(*(F.struct(((F.col(f"z{i}") + float(b[i])) / temperature).alias("z"), F.lit(f).alias("family")) for i, f in enumerate(FAMILIES)))
    best = logits.select("k", "line", "last", z.alias("z")).select("k", "line", "last", "z", F.array_max("z").alias("best"))
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x["z"] - F.col("best.z")))
    best = best.select("k", "line", "last", F.col("best.family").alias("family"), (1 / total).alias("probability")).where((F.col("family") != UNKNOWN) & (F.col("probability") >= least))
    match = grams_of.join(F.broadcast(templates), "gram").groupBy("k", "line", "last", "family", "template").agg((F.count("*") / F.max("of")).alias("contained")).where(F.col("contained") >= CONTAINED)
    match = match.groupBy("k", "line", "last", "family").agg(F.max(F.struct("contained", "template")).alias("m"))
    found = written(best.join(match, ["k", "line", "last", "family"]).select("k", "line", "last", "family", "probability", "m.template", "m.contained"), "found")
    # A paragraph with a shorter one of its family goes: the first and last line of any that starts later end later, too.
    later = W.partitionBy("k", "family").orderBy(F.desc("line"), "last").rowsBetween(W.unboundedPreceding, -1)
    shortest = found.withColumn("within", F.min("last").over(later)).where("within is null or within > last").drop("within")
    before = F.lag("last").over(W.partitionBy("k", "family").orderBy("line"))
    return written(shortest.withColumn("before", before).where("before is null or before < line").drop("before"), "licenses")


def documents_with_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs (with a licence), families (sorted, comma-joined), templates, probability (the least); all document rows."""
    found = find_licenses(docs)
    per = found.groupBy("k").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"), F.array_join(F.sort_array(F.collect_set("template")), ",").alias("templates"), F.min("probability").alias("probability"))
    rows = pick(docs, doc_id="long", text="string").select("doc_id", row_key("doc_id", F.coalesce("text", F.lit(""))).alias("k"))
    out = rows.join(small(written(per, "per-document")), "k", "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_paragraphs"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("templates", F.lit("")).alias("templates"), "probability")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_with_licenses(table(spark, sf_dir, "documents"))
