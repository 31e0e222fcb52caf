"""Text normalisation as column expressions: marks, final letters, synonyms, insurer names, contact points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide which spellings count as one term.
MARKS = "[֑-ׇ־׳״\"']"
WHITE = "(?U)[\\s﻿]+"
FINALS, PLAIN = "םןץףך", "מנצפכ"
INJURY_SYNONYMS = {
    "כאבי גב": "כאב גב",
    "כאב גב תחתון": "כאב גב",
    "כאבי גב תחתון": "כאב גב",
    "כאבי צואר": "כאב צואר",
    "כאבי ראש": "כאב ראש",
    "מיגרנה": "כאב ראש",
    "פריצת דיסק": "דיסק",
    "בלט דיסק": "דיסק",
    "שבר מרוסק": "שבר",
    "שבר סגור": "שבר",
    "חבלה": "חבלות",
}
BODY_PART_SYNONYMS = {
    "גב תחתון": "גב",
    "גב עליון": "גב",
    "עמוד שדרה": "גב",
    "צוואר": "צואר",
    "כתף ימין": "כתף",
    "כתף שמאל": "כתף",
    "ברך ימין": "ברך",
    "ברך שמאל": "ברך",
}
INSURER_OVERRIDES = {
    "ביטוח ישיר": "ביטוח ישיר",
    "המוסד לביטוח לאומי": "ביטוח לאומי",
    "ביטוח לאומי": "ביטוח לאומי",
    "נימרוד חברה לביטוח": "נימרוד",
}
INSURER_SUFFIXES = ("חברה", "לביטוח", "ביטוח", "בעמ", "מבטחים", "ישראלי", "הישראלי")


def fold(text: str) -> str:
    """Final letters of a Python string as plain ones."""
    return text.translate(str.maketrans(FINALS, PLAIN))


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_white(c: str | Column) -> Column:
    return F.regexp_replace(_column(c), "(?U)^[\\s﻿]+|[\\s﻿]+$", "")


def normalize(c: str | Column) -> Column:
    """Without marks and quotes, final letters folded, trimmed, lower case, white space as single spaces."""
    bare = F.translate(F.regexp_replace(_column(c), MARKS, ""), FINALS, PLAIN)
    return F.regexp_replace(F.lower(strip_white(bare)), WHITE, " ")


def _lookup(term: Column, pairs: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(fold(x)) for kv in pairs.items() for x in kv))
    return F.coalesce(F.try_element_at(table, term), term)


def canonical_insurer(term: str | Column) -> Column:
    """The last part of a normalised name after commas and semicolons, by the override table, else without legal suffixes."""
    term = _column(term)
    parts = F.filter(F.transform(F.split(term, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    part = F.coalesce(F.try_element_at(parts, F.lit(-1)), term)
    suffix = "|".join(map(fold, INSURER_SUFFIXES))
    known = F.try_element_at(F.create_map(*(F.lit(fold(x)) for kv in INSURER_OVERRIDES.items() for x in kv)), part)
    return F.coalesce(known, F.regexp_replace(part, rf"^(\S+(?: \S+)*?)(?: (?:{suffix}))+$", "$1"))


def term(domain: str, c: str | Column) -> Column:
    """A term of domain injury, bodyPart or insurer in its canonical form."""
    n = normalize(c)
    if domain == "injury":
        return _lookup(n, INJURY_SYNONYMS)
    if domain == "bodyPart":
        return _lookup(n, BODY_PART_SYNONYMS)
    if domain == "insurer":
        return canonical_insurer(n)
    raise ValueError(f"unknown domain {domain}")


def contact_point(email: str | Column, phone: str | Column) -> Column:
    """e:<email>, else p:<digits of the phone>, else an empty string."""
    mail = F.lower(F.trim(F.coalesce(_column(email), F.lit(""))))
    digits = F.regexp_replace(F.coalesce(_column(phone), F.lit("")), "\\D", "")
    return F.when(mail != "", F.concat(F.lit("e:"), mail)).when(digits != "", F.concat(F.lit("p:"), digits)).otherwise("")


def blank_to_null(c: str | Column) -> Column:
    t = strip_white(c)
    return F.when(t != "", t)


def content_hash(c: str | Column) -> Column:
    """sha256 of the trimmed text with white space collapsed."""
    return F.sha2(F.regexp_replace(strip_white(c), WHITE, " "), 256)
