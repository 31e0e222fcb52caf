"""Personal data, and terms that reveal it, in DataFrame functions only.

Base kinds (leftmost, non-overlapping per kind): email, ip (parts at most 255), card (12 to 19
digits that pass Luhn), phone (9 to 15 digits). Offsets are code points, ends exclusive.

Terms: a word of three or more letters reveals the share PMI(term; entity) / IC(entity) of a protected entity's information (an
entity is one base value), with PMI = log2(N joint / (df(term) df(entity))), IC = log2(N / df(entity)), and all counts over whole
documents of the corpus. Candidates are the words that stand within CONTEXT_CHARS code points of mentions of the entity in SUPPORT or
more different contexts. Where the share reaches DISCLOSURE, the term is reported as kind "term" wherever it stands in any
document, and generalised by sanitise(): a name that gives an address away does so anywhere.

The patterns are written so that they cannot backtrack over long runs, but find the same leftmost matches: possessive
runs, and an email starts only after the end of the last match or a character that can't be in one.

Defined cases: null and empty texts have no spans; very long texts are searched whole; equal rows repeat their result, and count once; extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fits, join_sized, let, pick, row_key, small, table, written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
_LOCAL = "[A-Za-z0-9._%+-]"
#: Pattern and cheap test of the whole text, by kind.
PATTERNS = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[ -]?[0-9])++", r"[0-9][ -]?[0-9]"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
}
CONTEXT_CHARS = 80
SUPPORT = 2
DISCLOSURE = 0.8
LETTERS = r"[\p{L}]{3,}+"
NOT_LETTERS = r"[^\p{L}]+"


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    turned = F.reverse(digits)
    d = lambda i: F.substring(turned, i, F.lit(1)).cast("int")
    doubled = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i % 2 == 1, d(i)).otherwise(2 * d(i) - F.when(d(i) > 4, 9).otherwise(0)))
    luhn = F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return (
        F.when(kind == "ip", value.rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
        .when(kind == "card", n.between(12, 19) & F.when(n.between(12, 19), luhn).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def _keyed(docs: DataFrame) -> DataFrame:
    return pick(docs, doc_id="long", text="string").withColumn("k", row_key("doc_id", "text"))


def base_spans(docs: DataFrame) -> DataFrame:
    """(k, kind, start, end, value, before, after) of all base spans, with the text near each."""
    keyed = docs.where("text is not null").select("k", "text").where(F.col("text").rlike("[0-9@]"))
    per = []
    for kind, (pattern, test) in PATTERNS.items():
        hit = F.col("text").rlike(test)
        gaps, values = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        # The last gap has no match after it.
        per.append(F.when(hit, F.struct(F.lit(kind).alias("kind"), gaps.alias("gaps"), values.alias("found"))))
    one = keyed.select("k", F.explode(F.array(*per)).alias("p")).where("p is not null and size(p.found) > 0").select("k", "p.*")
    row = F.transform(
        F.sequence(F.lit(1), F.size("found")),
        lambda i: F.struct(
            i.alias("i"),
            F.length(F.element_at("gaps", i)).alias("gap"),
            F.element_at("found", i).alias("value"),
            # A match that lies nearer belongs to the context.
            F.right(F.concat(F.when(i > 1, F.concat(F.right(F.element_at("gaps", F.greatest(i - 1, F.lit(1))), F.lit(CONTEXT_CHARS)), F.element_at("found", F.greatest(i - 1, F.lit(1))))).otherwise(""), F.element_at("gaps", i)), F.lit(CONTEXT_CHARS)).alias("before"),
            F.left(F.concat(F.element_at("gaps", i + 1), F.coalesce(F.try_element_at("found", i + 1), F.lit("")), F.coalesce(F.left(F.try_element_at("gaps", i + 2), F.lit(CONTEXT_CHARS)), F.lit(""))), F.lit(CONTEXT_CHARS)).alias("after"),
        ),
    )
    cells = one.select("k", "kind", F.explode(row).alias("c")).select("k", "kind", "c.*").repartition("k", "kind").dropDuplicates(["k", "kind", "i"])
    upto = W.partitionBy("k", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("gap") + F.length("value")).over(upto)
    cells = cells.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    return cells.where(_valid(F.col("kind"), F.col("value"))).select("k", "kind", "start", "end", "value", "before", "after")


def _words_near(side: Column, origin: Column, cut_left: bool) -> Column:
    """Whole words of a context as (term, start, end); one that the context's limit may have cut is left out."""
    kind = "array<struct<term:string,start:bigint,end:bigint,cut:boolean>>"

    def words(gaps, found):
        steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda a, b: F.length(a) + F.length(b))

        def word(steps, i):
            end = F.aggregate(F.slice(steps, 1, i), F.lit(0), lambda a, x: a + x)
            size = F.length(F.element_at(found, i))
            edge = (end - size == 0) if cut_left else (end == F.length(side))
            return F.struct(F.lower(F.element_at(found, i)).alias("term"), (origin + end - size).alias("start"), (origin + end).alias("end"), (edge & (F.length(side) == CONTEXT_CHARS)).alias("cut"))

        made = let(steps, lambda s: F.transform(F.sequence(F.lit(1), F.size(found)), lambda i: word(s, i))).cast(kind)
        return F.when(F.size(found) > 0, F.filter(made, lambda x: ~x["cut"])).otherwise(F.array().cast(kind))

    return let(F.split(side, LETTERS, -1), lambda g: let(F.regexp_extract_all(side, F.lit(LETTERS), F.lit(0)), lambda f: words(g, f)))


def revealing_terms(docs: DataFrame, base: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(k, term): documents with terms that reveal a protected entity, by co-occurrence in documents."""
    entity = F.concat_ws(":", "kind", F.when(F.col("kind").isin("card", "phone"), F.regexp_replace("value", "[^0-9]", "")).otherwise(F.lower("value")))
    near = F.concat(_words_near(F.col("before"), F.col("start") - F.length("before"), True), _words_near(F.col("after"), F.col("end"), False))
    mentions = written(base.select("k", entity.alias("entity")).distinct(), "mentions")
    near = base.select("k", entity.alias("entity"), F.xxhash64("before", "after").alias("context"), F.explode(near).alias("w")).select("k", "entity", "context", "w.term")
    near = written(near, "contexts")
    pairs = near.groupBy("term", "entity").agg(F.countDistinct("context").alias("contexts")).where(F.col("contexts") >= support)
    copies = docs.groupBy("k").agg(F.count("*").alias("n")).agg(F.count("*").alias("rows"), F.coalesce(F.max("n"), F.lit(1)).alias("most")).first()
    total, most = float(copies["rows"]), copies["most"]
    of = mentions.groupBy("entity").agg(F.count("*").alias("de")).where(F.col("de") < total)
    # A term is in at least as many documents as it is near entities of, and with an entity in at most all of the
    # entity's: pairs whose share stays below the threshold even so need no count over the corpus.
    seen = near.select("term", "k").distinct().groupBy("term").agg(F.count("*").alias("seen"))
    share = lambda joint, df: F.log2(F.lit(total) * joint / (F.col(df) * F.col("de"))) / F.log2(F.lit(total) / F.col("de"))
    pairs = written(pairs.join(of, "entity").join(seen, "term").where(share(F.col("de"), "seen") >= disclosure).select("term", "entity", "de"), "pairs")
    words = docs.where("text is not null").select("k", F.explode(F.array_distinct(F.split(F.lower("text"), NOT_LETTERS, -1))).alias("term"))
    # No document repeats more than `most` times, so a term is in at least its rows over that many documents. The rows are
    # summed before they are shuffled; pairs that this rules out, those of all common words, need no list of documents.
    terms = written(pairs.select("term").distinct(), "near-terms")
    some = words.join(F.broadcast(terms), "term") if fits(terms) else words
    rows = some.groupBy("term").agg((F.count("*") / F.lit(most)).alias("least"))
    pairs = written(pairs.join(rows, "term").where(share(F.col("de"), "least") >= disclosure).select("term", "entity", "de"), "rare-pairs")
    hits = written(join_sized(words, pairs.select("term").distinct(), "term", "k").distinct(), "term-hits")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    joint = join_sized(hits.join(mentions, "k"), pairs, ["term", "entity"], "k").groupBy("term", "entity", "de").agg(F.count("*").alias("joint"))
    revealing = joint.join(df, "term").where(share(F.col("joint"), "df") >= disclosure).select("term").distinct()
    return hits.join(small(written(revealing, "revealing")), "term").select("k", "term")


def term_spans(docs: DataFrame, terms: DataFrame, base: DataFrame) -> DataFrame:
    """(k, start, end) of all places of a document's terms, but those that overlap a base span."""
    of = terms.groupBy("k").agg(F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.array_sort(F.collect_set("term")), "|"), F.lit(r")(?!\p{L})")).alias("pattern"))
    one = docs.where("text is not null").select("k", "text").join(small(written(of, "patterns")), "k")
    one = one.select("k", F.split("text", F.col("pattern"), -1).alias("gaps"), F.regexp_extract_all("text", F.col("pattern"), F.lit(0)).alias("found")).where(F.size("found") > 0)
    row = F.transform(F.col("found"), lambda x, i: F.struct(i.alias("i"), F.length(F.element_at("gaps", i + 1)).alias("gap"), F.length(x).alias("size")))
    cells = one.select("k", F.explode(row).alias("c")).select("k", "c.*").dropDuplicates(["k", "i"])
    end = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("k").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow))
    spans = cells.withColumn("end", end).select("k", (F.col("end") - F.col("size")).alias("start"), "end", F.lit(True).alias("term"))
    both = spans.union(base.join(spans.select("k").distinct(), "k", "left_semi").select("k", "start", "end", F.lit(False)))
    other = lambda c: F.when(~F.col("term"), F.col(c))
    by = W.partitionBy("k").orderBy("start", "term")
    both = both.withColumn("before", F.max(other("end")).over(by.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("next", F.min(other("start")).over(by.rowsBetween(W.currentRow, W.unboundedFollowing)))
    return both.where(F.col("term") & (F.coalesce("before", F.lit(-1)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))).select("k", "start", "end")


def all_spans(docs: DataFrame) -> DataFrame:
    """(k, kind, start, end) of base spans and terms; docs has k, doc_id, text."""
    base = written(base_spans(docs), "spans")
    terms = written(revealing_terms(docs, base), "terms")
    spans = term_spans(docs, terms, base).select("k", F.lit(TERM).alias("kind"), "start", "end")
    return written(base.select("k", "kind", "start", "end").union(spans), "all-spans")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term; one row per document row."""
    keyed = _keyed(docs)
    spans = all_spans(keyed)
    rank = F.array_position(F.array(*map(F.lit, (*KINDS, TERM))), F.col("kind"))
    each = F.struct("start", rank.alias("r"), "end", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("s"))
    per = spans.groupBy("k").agg(F.sort_array(F.collect_list(each)).alias("all"), *(F.count_if(F.col("kind") == x).alias(f"n_{x}") for x in (*KINDS, TERM)))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["s"]), ",")
    per = per.select("k", joined(F.filter("all", lambda x: x["r"] <= len(KINDS))).alias("base"), joined("all").alias("spans"), *(f"n_{x}" for x in (*KINDS, TERM)))
    out = keyed.select("doc_id", "k").join(per, "k", "left")
    return out.select(
        "doc_id", *(F.coalesce(f"n_{x}", F.lit(0)).cast("long").alias(f"n_{x}") for x in KINDS),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce(f"n_{TERM}", F.lit(0)).cast("long").alias(f"n_{TERM}"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with each span of its text generalised to its kind in brackets; n_chars, if present, is set anew."""
    names = docs.columns
    plain = docs.toDF(*(f"_p{i}" for i in range(len(names))))
    at = f"_p{names.index('text')}"
    plain = plain.withColumn("_k", row_key(F.col(f"_p{names.index('doc_id')}").cast("long"), F.col(at).cast("string")))
    spans = all_spans(_keyed(docs))
    upto = F.max("end").over(W.partitionBy("k").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    new = F.when(F.col("start") < F.coalesce("upto", F.lit(-1)), 0).otherwise(1)
    runs = spans.withColumn("upto", upto).withColumn("run", F.sum(new).over(W.partitionBy("k").orderBy("start", "end")))
    merged = runs.groupBy("k", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", F.array_position(F.array(*map(F.lit, (*KINDS, TERM))), F.col("kind")))).alias("kind"))
    per = written(merged.groupBy(F.col("k").alias("_k")).agg(F.sort_array(F.collect_list(F.struct("start", "end", F.concat(F.lit("["), F.upper("kind"), F.lit("]")).alias("label")))).alias("_spans")), "replace")
    text = F.col(at)
    n = F.size("_spans")

    def piece(i):
        a = F.when(i > 1, F.element_at("_spans", F.greatest(i - 1, F.lit(1)))["end"]).otherwise(F.lit(0)).cast("int")
        here = F.element_at("_spans", i)
        return F.concat(F.substring(text, a + 1, here["start"].cast("int") - a), here["label"])

    rest = F.substring(text, F.element_at("_spans", n)["end"].cast("int") + 1, F.length(text))
    rebuilt = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), n), piece), ""), rest)
    out = plain.join(small(per), "_k", "left").withColumn(at, F.when(F.col("_spans").isNull(), text).otherwise(rebuilt))
    if "n_chars" in names:
        out = out.withColumn(f"_p{names.index('n_chars')}", F.length(at).cast(docs.schema[names.index("n_chars")].dataType))
    return out.drop("_k", "_spans").select(*(f"_p{i}" for i in range(len(names)))).toDF(*names)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
