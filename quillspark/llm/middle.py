"""Fill-in-the-middle documents by injected markers, in DataFrame functions only.

A text's units are runs of white space with the word after them (and white space at the end). ESCAPE and DELIMITER are escaped in the text,
so that DELIMITER cannot occur in it; one is then put behind each unit, which cuts no unit differently, since neither it nor the escapes are white space. The
markers are counted by the bytes they add, and prefix, middle and suffix are what stands before, between and behind the markers of two
ranks drawn by the document's id; markers are taken out of them and escapes undone. Nothing is shuffled, and a document's work is linear in its length.

Defined cases: a null text is an empty one, and empty texts stay plain; a null id draws as an empty one; texts that hold one of
the three sentinels stay plain, so that every output can be taken apart again; ranks that are equal give an empty middle; repeated rows give equal
rows; very long texts are cut at one place like others; an empty table gives no rows; extra columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Seed of the draws; documents of 100 that are rearranged, and of those the ones with the suffix first.
SEED, RATE, SUFFIX_FIRST = 42, 50, 80
DELIMITER, ESCAPE = "\x01", "\x02"
ESCAPES = ((ESCAPE, ESCAPE + "a"), (DELIMITER, ESCAPE + "b"))


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def draws(doc_id: Column, seed: int) -> Column:
    """Four unsigned 32-bit numbers from a document's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))


def rearrange(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, text (never null), n (units), form (plain, psm or spm), output, prefix_chars and middle_chars (null if plain)."""
    d = pick(docs, doc_id="long", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), draws(F.col("doc_id"), seed).alias("h"))
    d = d.withColumn("escaped", escape(F.col("text")))
    d = d.withColumn("marked", F.regexp_replace("escaped", UNIT, "$0" + DELIMITER))
    d = d.withColumn("n", (F.octet_length("marked") - F.octet_length("escaped")).cast("long")).drop("escaped")
    cuts = [F.col("h")[i] % (F.col("n") + 1) for i in range(2)]
    d = d.withColumns({"lo": F.least(*cuts).cast("int"), "hi": F.greatest(*cuts).cast("int")})
    held = F.lit(False)
    for s in SENTINELS:
        held = held | F.col("text").contains(s)
    plain = (F.col("n") == 0) | (F.col("h")[2] % 100 >= rate) | held
    d = d.withColumn("form", F.when(plain, "plain").when(F.col("h")[3] % 100 < suffix_first, "spm").otherwise("psm"))
    # Ranks count from either end: n - hi units stand behind the marker of rank hi, and the last marker ends the text.
    cut = lambda text, rank: F.call_function("substring_index", text, F.lit(DELIMITER), rank)
    whole = lambda part: unescape(F.replace(part, F.lit(DELIMITER), F.lit("")))
    parts = {
        "prefix": whole(cut(F.col("marked"), F.col("lo"))),
        "middle": whole(cut(cut(F.col("marked"), F.col("hi")), F.col("lo") - F.col("hi"))),
        "suffix": whole(cut(F.col("marked"), F.col("hi") - F.col("n").cast("int") - 1)),
    }
    d = d.withColumns({k: F.when(F.col("form") != "plain", v) for k, v in parts.items()})
    p, m, s = (F.lit(x) for x in (PREFIX, MIDDLE, SUFFIX))
    output = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle")).otherwise(F.col("text"))
    return d.select("doc_id", "text", "n", "form", output.alias("output"), F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"))


def restored(output: Column, form: Column) -> Column:
    """The text that output was made of."""
    cut = F.substring_index
    first, last = cut(output, MIDDLE, 1), cut(output, MIDDLE, -1)
    psm = F.concat(F.substr(cut(first, SUFFIX, 1), F.lit(len(PREFIX) + 1)), last, cut(first, SUFFIX, -1))
    spm = F.concat(cut(first, PREFIX, -1), last, F.substr(cut(first, PREFIX, 1), F.lit(len(SUFFIX) + 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rearrange(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    out = out.withColumns({"output_sha256": digest(F.col("output")), "restored_sha256": digest(restored(F.col("output"), F.col("form")))})
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


OP13_SQL = r"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
b AS (SELECT *, len(u)::BIGINT AS n, [('0x' || substr(d, 1, 8))::BIGINT, ('0x' || substr(d, 9, 8))::BIGINT, ('0x' || substr(d, 17, 8))::BIGINT, ('0x' || substr(d, 25, 8))::BIGINT] AS h FROM a),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM b),
e AS (SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM e"""
