"""Full-text search by prefix terms, and medical evidence search with term expansion.

Score of a text: the sum over query terms that prefix one of its words of ln(1 + count) * ln(1 + N / df); ties go to the lesser id.
Terms are expressions over the words array, so a search is one scan, one aggregate for df, and a top-k. Tables that are searched often
get a kept index (`textindex`), which searches here take instead of the scan where one is given; the results are the same."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.functions.text import FINALS, PLAIN, normalize

# Vocabulary of the medical search.
NEUROLOGICAL = ("נוירולוג", "נוירולוגי", "נוירוכירורג", "עצב", "עצבי", "עצבים", "רדיקול", "רדיקולופתיה", "נימול", "רדימות", "חוסר תחושה", "שינויי תחושה", "תחושה", "חולשה", "הקרנה", "emg")
SPINE = ("עמוד שדרה", "שדרה", "תעלת השדרה", "גב", "צוואר", "צואר", "מותני", "צווארי", "צוארי", "דיסק", "חוליה", "חוליות", "c5", "c6", "c7", "l4", "l5", "s1")
NEUROLOGICAL_INTENT = re.compile("נוירולוג|עצב|עצבי|תחושה|נימול|רדימות|הקרנה|emg", re.I)
SPINE_INTENT = re.compile("עמוד|שדרה|גב|צוואר|צואר|דיסק|חוליה|מותני|צווארי|צוארי", re.I)
SPECIALS = re.compile(r"[+\-&|!(){}\[\]^\"~*?:\\/]")
#: Default of the chunks that the medical search takes from full text; its parameter None takes all.
CANDIDATES = 500


def query_terms(query: str) -> list[str]:
    """Lower-case words without special characters; the query itself if none is left."""
    terms = [t for w in query.lower().split() if (t := SPECIALS.sub("", w).strip())]
    return list(dict.fromkeys(terms)) or [query.lower()]


def fold_term(term: str) -> str:
    """A Python term as functions.text.normalize would give it."""
    bare = re.sub("[֑-ׇ־׳״\"']", "", term).translate(str.maketrans(FINALS, PLAIN))
    return re.sub(r"\s+", " ", bare.strip().lower())


def words_of(text: Column) -> Column:
    """The words of a text, as the scan and the index see them."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w@.-]+")


def fulltext(rows: DataFrame, query: str, key: str, text: str = "text", limit: int | None = 10, index=None) -> DataFrame:
    """rows that hold a word with one of the query's terms as prefix, with score, best first; without limit all. With an index of (at least)
    these rows' texts no text is read: counts come from the index, and how common a term is from the rows given."""
    terms = query_terms(query)
    if index is None:
        count = lambda t: F.size(F.filter("_words", lambda w: w.startswith(t)))
        counted = rows.withColumn("_words", words_of(F.col(text))).select("*", *(count(t).alias(f"_c{i}") for i, t in enumerate(terms))).drop("_words")
    else:
        counted = rows.select(key).join(index.counts(query).withColumnRenamed("key", key), key, "left").fillna(0, [f"_c{i}" for i in range(len(terms))])
    stats = counted.agg(F.count("*").alias("_n"), *(F.count_if(F.col(f"_c{i}") > 0).alias(f"_d{i}") for i in range(len(terms)))).withColumn("_one", F.lit(1))
    hit = F.lit(False)
    for i in range(len(terms)):
        hit = hit | (F.col(f"_c{i}") > 0)
    found = counted.where(hit).withColumn("_one", F.lit(1)).join(F.broadcast(stats), "_one")
    score = F.lit(0.0)
    for i in range(len(terms)):
        score = score + F.when(F.col(f"_c{i}") > 0, F.log1p(f"_c{i}") * F.log1p(F.col("_n") / F.col(f"_d{i}"))).otherwise(0.0)
    order = (F.desc(F.round("score", 9)), key)
    best = found.select(*(rows.columns if index is None else [key]), score.alias("score")).orderBy(*order)
    best = best if limit is None else best.limit(limit)
    return best if index is None else rows.join(best, key).orderBy(*order)


def search_evidence(chunks: DataFrame, facts: DataFrame, cases: DataFrame, query: str, limit: int = 10, kinds: tuple[str, ...] = (), index=None, **equal: str) -> DataFrame:
    """Chunks and facts that match a query, under filters on case columns and fact kinds, by score and case name; chunks by an index of them if there is one."""
    c = cases
    for column, value in equal.items():
        c = c.where(F.col(column) == value)
    near = c.select("case_id", "case_name")
    first = facts.where(F.col("kind").isin(*kinds)) if kinds else facts
    first = first.groupBy("chunk_id").agg(F.min("fact_id").alias("fact_id"))
    limit = min(max(limit, 1), 30)
    wide = chunks.join(near, "case_id").join(first, "chunk_id", "inner" if kinds else "left")
    a = fulltext(wide.select("chunk_id", "case_id", "case_name", "fact_id", "text"), query, "chunk_id", limit=limit, index=index).select(F.lit("chunk").alias("hit"), F.col("chunk_id").alias("id"), "case_id", "case_name", F.left("text", F.lit(700)).alias("snippet"), "score")
    told = facts.where(F.col("kind").isin(*kinds)) if kinds else facts
    said = told.join(near, "case_id").withColumn("text", F.concat_ws(" ", "kind", "subtype", "value", "quote"))
    b = fulltext(said.select("fact_id", "case_id", "case_name", "text"), query, "fact_id", limit=limit).select(F.lit("fact").alias("hit"), F.col("fact_id").alias("id"), "case_id", "case_name", F.left("text", F.lit(700)).alias("snippet"), "score")
    return a.unionByName(b).orderBy(F.desc(F.round("score", 9)), "case_name", "id").limit(limit)


def expand_terms(query: str, neurological: bool = False, spine: bool = False) -> tuple[str, ...]:
    """The query's own words of two or more letters, and the vocabularies that it, or a requirement, calls for; raw and normalised."""
    terms = [t for t in fold_term(query).split() if len(t) >= 2]
    if neurological or NEUROLOGICAL_INTENT.search(query):
        terms += NEUROLOGICAL
    if spine or SPINE_INTENT.search(query):
        terms += SPINE
    return tuple(dict.fromkeys(x for t in terms for x in (t.strip().lower(), fold_term(t)) if x))


def _any(hay: Column, terms: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | hay.contains(t)
    return out


def medical_evidence(cases: DataFrame, injuries: DataFrame, body_parts: DataFrame, chunks: DataFrame, query: str, require_neurological: bool = False, require_spine: bool = False,
                     neurological: tuple[str, ...] = NEUROLOGICAL, spine: tuple[str, ...] = SPINE, limit: int = 20, candidates: int | None = CANDIDATES, index=None) -> DataFrame:
    """Cases with medical evidence for a query, scored by injuries, body parts and chunk hits; up to five snippets each.

    Cases come from the main injury, injuries, body parts, and the best `candidates` chunks by full text (None: all that match), by an index of the chunks if there is one."""
    terms = expand_terms(query, require_neurological, require_spine)
    both = lambda ts: tuple(dict.fromkeys(x for t in ts for x in (t.lower(), fold_term(t)) if x))
    neuro, back = both(neurological), both(spine)
    said = " ".join(terms) if terms else query
    if index is not None and candidates is not None:
        best = chunks.join(F.broadcast(index.top(said, candidates).rows.select(F.col("key").alias("chunk_id"))), "chunk_id", "left_semi")
    else:
        best = fulltext(chunks, said, "chunk_id", limit=candidates, index=index)
    match = lambda df: df.where(_any(normalize("name"), terms)).select("case_id")
    pool = cases.where(_any(normalize(F.coalesce("main_injury", F.lit(""))), terms)).select("case_id").union(match(injuries)).union(match(body_parts)).union(best.select("case_id")).distinct()
    hay = F.lower("text")
    hits = chunks.join(pool, "case_id", "left_semi").withColumn("n", _any(hay, neuro)).withColumn("s", _any(hay, back)).withColumn("q", _any(hay, terms))
    tell = hits.groupBy("case_id").agg(F.count_if(F.col("n") & F.col("s")).alias("combined"), F.count_if("n").alias("neuro"), F.count_if("s").alias("spine"))
    order = F.when(F.col("n") & F.col("s"), 0).when(F.col("n"), 1).when(F.col("s"), 2).otherwise(3)
    snippet = F.row_number().over(W.partitionBy("case_id").orderBy(order, F.desc("char_count"), "chunk_id"))
    tops = hits.where("n or s or q").withColumn("_r", snippet).where("_r <= 5").groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "chunk_id"))), lambda x: x["chunk_id"]).alias("snippets"))
    inj = injuries.groupBy("case_id").agg(F.bool_or(_any(normalize("name"), neuro)).alias("inj_n"), F.bool_or(_any(normalize("name"), back)).alias("inj_s"))
    body = body_parts.groupBy("case_id").agg(F.bool_or(_any(normalize("name"), back)).alias("body_s"))
    out = cases.join(pool, "case_id", "left_semi")
    for df in (tell, inj, body, tops):
        out = out.join(df, "case_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    num = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = F.when(yes("inj_n"), 8).otherwise(0) + F.when(yes("inj_s"), 8).otherwise(0) + F.when(yes("body_s"), 4).otherwise(0) + 3 * F.least(num("combined"), F.lit(5)) + F.least(num("neuro"), F.lit(5)) + F.least(num("spine"), F.lit(5))
    out = out.withColumn("score", score.cast("long"))
    if require_neurological:
        out = out.where(yes("inj_n") | (num("neuro") > 0))
    if require_spine:
        out = out.where(yes("inj_s") | yes("body_s") | (num("spine") > 0))
    return out.select("case_id", "case_name", "score", num("combined").alias("combined"), num("neuro").alias("neuro"), num("spine").alias("spine"), "snippets").orderBy(F.desc("score"), "case_name", "case_id").limit(min(max(limit, 1), 50))
