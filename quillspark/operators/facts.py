"""Evidence facts from text by rule packs: rules are data, and one plan runs any pack.

A rule finds its pattern in a text; around each match a quote of RADIUS characters is the context, and the sentence is
the span between the nearest full stops or newlines. Context and subtype patterns decide whether and as what a
match counts. Results carry dates of the sentence or the context, a value, a number and a confidence."""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.functions.dates import dates_in
from quillspark.functions.text import WHITE, normalize, strip_white
from quillspark.sources.scratch import materialize

RADIUS = 190
QUOTE = 700
KEY_CHARS = 120
#: Of the rules; a cache of facts is keyed by it.
VERSION = "1"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    subtype: str = ""
    context: str = ""
    radius: int = RADIUS
    #: (pattern, subtype) tried in order on the scope (sentence or context) before the rule's own subtype.
    subtypes: tuple[tuple[str, str], ...] = ()
    scope: str = "context"
    #: Subtype and value are the context's first match of this pattern.
    capture: str = ""
    value: str = ""
    number: float | None = None
    #: The pattern's first group is the number, at most this.
    number_most: float | None = None
    unit: str = ""
    dates: int = 0
    confidence: float = 0.8
    #: Confidence where the rule's own subtype is left.
    fallback: float | None = None


# Wordings of Hebrew case files that mark a fact, with its subtype and confidence.
_NII = r"ביטוח\s+לאומי|המוסד\s+לביטוח\s+לאומי|נפגעי\s+עבודה|גמלה|ועדה"
_APPEAL = r"ערעור|ערר|תובענה|בית\s+הדין|לחדש|מסמכים\s+חסרים|זכאות"
_NEED = r"צריך|נדרש|חסר|חסרים|להביא|לשלוח|להעביר|לא\s+קיבלנו|אנא|מסמכים"
_SLIPS, _LETTER = r"תלושי\s+שכר|תלוש(?:י)?\s+משכורת", r"מכתב\s+מהמעסיק|אישור\s+מעסיק"
HEBREW_PACK: tuple[Rule, ...] = (
    Rule("disability_period", r"(\d{1,3})(?:\s*%|\s+אחוז(?:י(?:ם)?)?)", "mentioned", "נכות|נכויות|ועדה רפואית|אחוזי", 230, (("קבוע|קבועה|צמית|צמיתה|יציב|יציבה", "permanent"), ("זמני|זמנית|זמניות|לתקופה", "temporary")), "sentence", value="%", number_most=100, unit="percent", dates=2, confidence=0.86, fallback=0.72),
    Rule("regulation_15", r"תקנה\s*15", "mentioned", subtypes=((r"לא\s+הופעלה|לא\s+חל|לא\s+הוחלה|אין\s+מקום", "not_applied"), ("הופעלה|הוחלה|תחול|הגדלה", "applied")), confidence=0.9, fallback=0.7),
    Rule("nii_decision", r"דחיית|דוחה|דחינו|נדח(?:ה|תה)|נאלצים\s+לדחות", "rejected", _NII, dates=1, confidence=0.86),
    Rule("nii_decision", r"אושרה|אושר|הוכרה|הכיר(?:ה)?\s+ב", "accepted", _NII, dates=1, confidence=0.82),
    Rule("nii_decision", r"החלטת\s+הוועדה|הוועדה\s+הרפואית\s+המסכמת|פרוטוקול\s+הוועדה", "committee_decision", _NII, dates=1, confidence=0.84),
    Rule("nii_decision", r"ערעור|ערר|תובענה|בית\s+הדין\s+לעבודה", "appeal_notice", _NII, dates=1, confidence=0.78),
    Rule("appeal_deadline", r"60\s+יום", "days", _APPEAL, value="60 days", number=60, unit="days", confidence=0.84),
    Rule("appeal_deadline", r"שישים\s+יום", "days", _APPEAL, value="60 days", number=60, unit="days", confidence=0.84),
    Rule("appeal_deadline", r"12\s+חודשים", "months", _APPEAL, value="12 months", number=12, unit="months", confidence=0.84),
    Rule("appeal_deadline", r"שנים\s+עשר\s+חודשים", "months", _APPEAL, value="12 months", number=12, unit="months", confidence=0.84),
    Rule("required_document", _SLIPS, "salary_slips", _NEED, confidence=0.78),
    Rule("required_document", _LETTER, "employer_letter", _NEED, confidence=0.78),
    Rule("required_document", r"רופא\s+תעסוקתי|אישור\s+רופא\s+תעסוקתי", "occupational_doctor", _NEED, confidence=0.78),
    Rule("required_document", r"מסמכים\s+רפואיים|תיעוד\s+רפואי|חומר\s+רפואי", "medical_records", _NEED, confidence=0.78),
    Rule("required_document", r"דיסק(?:ים)?\s+של\s+בדיקות|בדיקות\s+הדמיה|CT|MRI", "imaging_discs", _NEED, confidence=0.78),
    Rule("required_document", r"טופס\s+בל\/?250|בל\s*250", "btl_250_form", _NEED, confidence=0.78),
    Rule("required_document", r"אישור\s+משטרה|דוח\s+משטרה", "police_report", _NEED, confidence=0.78),
    Rule("income_evidence", r"ירידה\s+בהכנסה|ירידה\s+משמעותית\s+.*הכנסה|הכנסותיו", "income_reduction", dates=2, confidence=0.82),
    Rule("income_evidence", r"חצי\s+משרה|4\s+שעות|ארבע\s+שעות", "reduced_work_capacity", dates=2, confidence=0.82),
    Rule("income_evidence", _SLIPS, "salary_slips", dates=2, confidence=0.78),
    Rule("income_evidence", r"חזר\s+לעבודה|חזרה\s+לעבודה|שב\s+לעבודה", "returned_to_work", dates=2, confidence=0.78),
    Rule("income_evidence", _LETTER, "employer_letter", dates=2, confidence=0.78),
    Rule("medical_committee", r"ועדה\s+רפואית|הוועדה\s+הרפואית|פרוטוקול\s+הוועדה", "committee", capture=r"כירורגיה\s+אורטופדית|אורטופד(?:י|ית)|נוירולוג(?:י|ית)|פסיכיאטר(?:י|ית)", dates=1, confidence=0.82),
    Rule("work_accident", r"נפגעי\s+עבודה", "work_injury_claim", dates=1, confidence=0.82),
    Rule("work_accident", r"תאונת\s+עבודה|פגיעה\s+בעבודה", "work_accident", dates=1, confidence=0.82),
    Rule("work_accident", r"דמי\s+פגיעה", "injury_allowance", dates=1, confidence=0.82),
    Rule("work_accident", r"תאריך\s+פגיעה", "injury_date", dates=1, confidence=0.82),
)
#: A pack for texts in any language.
GENERIC_PACK: tuple[Rule, ...] = (
    Rule("email", r"[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]{1,63}\.[A-Za-z]{2,10}", "address", confidence=0.95),
    Rule("network", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "ip", confidence=0.9),
    Rule("licence", r"(?i)licensed under|released under", "notice", subtypes=(("(?i)apache", "apache"), ("(?i)\\bmit\\b", "mit"), ("(?i)gnu", "gpl"), ("(?i)\\bcc\\b", "cc")), confidence=0.9, fallback=0.6),
)


def literals(pattern: str) -> tuple[frozenset[str], bool] | None:
    """Strings of which any match of the pattern holds one, and whether to look for them in the lower-cased text; None if there are none.

    Of parts in sequence the one whose strings are longest is taken; alternatives add up; optional parts and classes of several characters end a string."""

    def worth(found):
        return 0 if found is None else min(map(len, found))

    def of(items) -> frozenset[str] | None:
        best, run = None, ""

        def better(found):
            nonlocal best
            if worth(found) > worth(best):
                best = found

        for op, arg in items:
            if op is sre.LITERAL:
                run += chr(arg)
                continue
            better(frozenset({run}) if run else None)
            run = ""
            if op is sre.SUBPATTERN:
                better(of(arg[-1]))
            elif op is sre.BRANCH:
                parts = [of(x) for x in arg[1]]
                better(None if any(x is None for x in parts) else frozenset().union(*parts))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                better(of(arg[2]))
        better(frozenset({run}) if run else None)
        return best

    parsed = sre_parser.parse(pattern)
    found, folded = of(parsed), bool(parsed.state.flags & re.IGNORECASE)
    return None if found is None else (frozenset(x.lower() for x in found) if folded else found, folded)


def _may_match(rules: tuple[Rule, ...]) -> Column:
    """A cheap condition that a text meets if any of the rules matches in it."""
    found = [literals(r.pattern) for r in rules]
    if None in found:
        return F.lit(True)
    out = F.lit(False)
    for folded in (False, True):
        strings = sorted({x for some, f in found if f is folded for x in some})
        if strings:
            out = out | (F.exists(F.lit(strings), lambda x: F.contains(F.lower("text"), x)) if folded else F.exists(F.lit(strings), lambda x: F.contains("text", x)))
    return out


def _matches(pattern: str) -> Column:
    """(at, matched) of all matches in a text: positions follow from the lengths of gaps and matches. Chunks are short, so the sums are cheap."""
    gaps, found = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))
    upto = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))
    return F.transform(found, lambda m, i: F.struct((upto(gaps, i + 1) + upto(found, i)).alias("at"), m.alias("matched")))


def _key() -> list[Column]:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return [text("kind"), text("subtype"), text("value"), text("numeric_value"), text("from_date"), text("to_date"), F.left("quote", F.lit(KEY_CHARS))]


def _rule_rows(spark: SparkSession, pack: tuple[Rule, ...]) -> DataFrame:
    """The pack as a table: one row for each rule."""
    rows = [(i, r.kind, r.pattern, r.subtype, r.context, r.radius, [*r.subtypes], r.scope == "sentence", r.capture, r.value, None if r.number is None else float(r.number), None if r.number_most is None else float(r.number_most), r.unit or None, r.dates, r.confidence, r.fallback) for i, r in enumerate(pack)]
    return spark.createDataFrame(rows, "rule int, kind string, pattern string, own string, needs string, radius int, subtypes array<struct<pattern:string,name:string>>, in_sentence boolean, capture string, said string, number double, number_most double, unit string, dates int, sure double, fallback double")


def extract_facts(chunks: DataFrame, pack: tuple[Rule, ...] = HEBREW_PACK, source: str = "regex", version: str = VERSION) -> DataFrame:
    """Facts of chunks (chunk_id, text, and other columns to carry), numbered in order of rule and position; equal ones once.

    One scan finds the matches of all rules; what a match counts as follows from its rule. metadata tells extractor, version and chunk hash."""
    chunks = chunks.withColumn("text", strip_white("text"))
    carried = [c for c in chunks.columns if c != "text"]

    def found(number: int, r: Rule) -> Column:
        all_of = F.transform(_matches(r.pattern), lambda m: F.struct(F.lit(number).alias("rule"), m["at"].alias("at"), m["matched"].alias("matched")))
        return F.when(_may_match((r,)) & F.col("text").rlike(r.pattern), all_of)

    # Texts without any of the pack's literals are done with before a pattern runs.
    chunks = chunks.where(_may_match(pack))
    per = F.array(*(found(i, r) for i, r in enumerate(pack)))
    rows = chunks.select("*", F.explode(F.flatten(F.filter(per, lambda x: x.isNotNull()))).alias("m")).select(*chunks.columns, "m.*")
    rows = rows.join(F.broadcast(_rule_rows(chunks.sparkSession, pack)), "rule")
    lo = F.greatest(F.lit(0), F.col("at") - F.col("radius"))
    around = strip_white(F.regexp_replace(F.substring(F.col("text"), lo + 1, F.col("at") + F.col("radius") - lo), WHITE, " "))
    before, after = F.substring(F.col("text"), F.lit(1), F.col("at")), F.substring(F.col("text"), F.col("at") + 1, F.length("text"))
    sentence = F.concat(F.regexp_extract(before, r"([^.\n]*)$", 1), F.regexp_extract(after, r"^([^.\n]*)", 1))
    rows = rows.withColumn("context", around).withColumn("scope", F.when(F.col("in_sentence"), sentence).otherwise(F.col("context"))).drop("text")
    rows = rows.where(F.regexp_like("context", F.col("needs")))
    named = F.try_element_at(F.filter("subtypes", lambda x: F.regexp_like(F.col("scope"), x["pattern"])), F.lit(1))["name"]
    captured = F.when(F.col("capture") != "", F.nullif(F.regexp_substr("context", F.col("capture")), F.lit("")))
    rows = rows.withColumn("subtype", F.coalesce(captured, named, "own"))
    rows = rows.withColumn("numeric_value", F.when(F.col("number_most").isNotNull(), F.expr("try_cast(regexp_extract(matched, pattern, 1) as double)")).otherwise(F.col("number")))
    rows = rows.where("number_most is null or numeric_value <= number_most")
    value = (
        F.when(F.col("number_most").isNotNull(), F.concat(F.col("numeric_value").cast("int").cast("string"), "said")).when(F.col("said") != "", F.col("said"))
        .when(F.col("capture") != "", F.when(F.col("subtype") != F.col("own"), F.col("subtype"))).otherwise(F.col("subtype"))
    )
    rows = rows.withColumn("found_dates", F.when(F.col("dates") > 0, dates_in("scope")))
    nth = lambda n: F.when(F.col("dates") >= n, F.try_element_at("found_dates", F.lit(n)))
    conf = F.when(F.col("subtype") == F.col("own"), F.coalesce("fallback", "sure")).otherwise(F.col("sure"))
    digest = F.col("chunk_hash") if "chunk_hash" in carried else F.lit(None).cast("string")
    out = rows.select(
        *carried, "rule", "at", "kind", "subtype", value.alias("value"), "numeric_value", "unit",
        nth(1).alias("from_date"), nth(2).alias("to_date"), conf.alias("confidence"), F.left("context", F.lit(QUOTE)).alias("quote"),
        F.to_json(F.struct(F.lit(source).alias("extractor"), F.lit(version).alias("version"), digest.alias("chunk_hash"), F.col("at").alias("at"))).alias("metadata"),
    )
    first = F.row_number().over(W.partitionBy("chunk_id", *_key()).orderBy("rule", "at"))
    out = out.withColumn("_f", first).where("_f = 1").drop("_f")
    n = F.row_number().over(W.partitionBy("chunk_id").orderBy("rule", "at"))
    return out.withColumn("fact_id", F.concat_ws(":", "chunk_id", F.lit("fact"), n.cast("string"))).withColumn("source", F.lit(source)).drop("rule", "at")


def validate_drafts(drafts: DataFrame, chunks: DataFrame, kinds: tuple[str, ...] = tuple(dict.fromkeys(r.kind for r in HEBREW_PACK))) -> DataFrame:
    """Facts of an outside provider that hold: a known kind, and a quote of six or more characters that the chunk contains."""
    j = drafts.join(chunks.select("chunk_id", F.col("text").alias("_text")), "chunk_id")
    quote = strip_white("quote")
    ok = F.col("kind").isin(*kinds) & (F.length(quote) >= 6) & F.contains(normalize("_text"), normalize("quote"))
    conf = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))), F.lit(0.7))
    return j.where(ok).withColumn("confidence", conf).withColumn("quote", F.left(quote, F.lit(QUOTE))).drop("_text")


def merge_facts(regex: DataFrame, other: DataFrame) -> DataFrame:
    """All facts of both; of equal ones the regex's."""
    both = regex.withColumn("_p", F.lit(0)).unionByName(other.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(W.partitionBy("chunk_id", *_key()).orderBy("_p", "fact_id"))
    return both.withColumn("_r", rank).where("_r = 1").drop("_r", "_p")


def _in_batches(provider, size: int):
    """The provider, called with at most `size` chunks at once. Each call's drafts are followed by a row without kind that tells what the call took."""

    def run(frames):
        for f in frames:
            for at in range(0, len(f), size):
                asked = f.iloc[at : at + size]
                made = [d for d in provider(iter([asked])) if len(d)]
                yield from made
                took = {c: sum(float(d[c].fillna(0).sum()) for d in made if c in d.columns) for c in ("tokens_in", "tokens_out")}
                yield pd.DataFrame([{"calls": 1, "chunks": len(asked), "drafts": sum(map(len, made))} | took])

    return run


def _metered(frames_of, columns: list[str]):
    """frames_of's frames with all of the columns, in order."""

    def run(frames):
        for d in frames_of(frames):
            wide = d.reindex(columns=columns).astype(object)
            yield wide.where(wide.notna(), None)

    return run


METER = "calls long, chunks long, drafts long, tokens_in double, tokens_out double"


def asked(chunks: DataFrame, provider, batch: int = 5, calls: int = 8, price_in: float = 0.0, price_out: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Drafts of a provider, and one row of progress: calls, chunks, drafts, tokens_in, tokens_out, cost by prices a token.

    A provider may give tokens_in and tokens_out with its drafts. What calls took is written with their drafts, by the same tasks, and summed from the
    table: a task that fails or runs twice leaves one output, so it counts once, which accumulators don't promise."""
    schema = f"{DRAFTS}, {METER}"
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    rows = chunks.select("chunk_id", "text").repartition(calls, "chunk_id").mapInPandas(_metered(_in_batches(provider, batch), names), schema)
    rows = materialize(rows, "drafts")
    drafts = rows.where("calls is null").select(*(c.strip().split(" ")[0] for c in DRAFTS.split(",")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    meter = rows.where("calls is not null").agg(*(total(c.strip().split(" ")[0]) for c in METER.split(",")))
    return drafts, meter.withColumn("cost", F.col("tokens_in") * price_in + F.col("tokens_out") * price_out)


def with_provider(chunks: DataFrame, provider, cache: DataFrame | None = None, version: str = VERSION, batch: int = 5, calls: int = 8, told=None) -> DataFrame:
    """Drafts of a provider (a mapInPandas function from chunk_id, text to DRAFTS) for chunks that the cache (chunk_hash, version
    and draft columns) doesn't hold, and the cache's for the others, under the ids of these chunks.

    The provider gets `batch` chunks in a call, and at most `calls` calls run at once; told is called with the row of progress (see asked). Where
    chunks have an observed_date, drafts get it."""
    keyed = chunks.withColumn("version", F.lit(version))
    fresh = keyed if cache is None else keyed.join(cache.select("chunk_hash", "version").distinct(), ["chunk_hash", "version"], "left_anti")
    made, meter = asked(fresh, provider, batch, calls)
    if told is not None:
        told(meter)
    if cache is not None:
        old = keyed.select("chunk_id", "chunk_hash", "version").join(cache.drop("chunk_id"), ["chunk_hash", "version"]).select(*made.columns)
        made = made.unionByName(old)
    return made.join(chunks.select("chunk_id", "observed_date"), "chunk_id", "left") if "observed_date" in chunks.columns else made


def numbered(facts: DataFrame, name: str = "fact") -> DataFrame:
    """facts with ids anew, in order of kind, subtype and quote within a chunk."""
    n = F.row_number().over(W.partitionBy("chunk_id").orderBy("kind", "subtype", "quote"))
    return facts.withColumn("fact_id", F.concat_ws(":", "chunk_id", F.lit(name), n.cast("string")))


DRAFTS = "chunk_id string, kind string, subtype string, value string, numeric_value double, unit string, from_date string, to_date string, confidence double, quote string"
