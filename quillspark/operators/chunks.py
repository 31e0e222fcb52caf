"""Texts to chunks: compaction, paragraphs, slices, greedy packing with overlap. Higher-order functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.functions.text import content_hash

TARGET, MOST, OVERLAP, PREVIEW = 2200, 2600, 180, 700
PAGE_MARK = r"(?=\n\s*(?:---\s*)?(?:Page|עמוד)\s+\d+)"


def compact(c: str | Column) -> Column:
    """Without carriage returns and blanks at line ends, four or more newlines as two, trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(F.regexp_replace(c, "\r", ""), "[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(c, "\n{4,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def page_range(text: Column, start: Column, end: Column) -> Column:
    """A range as text, else start-end, one number if equal."""
    return F.coalesce(text, F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string"))))


def pieces(text: Column) -> Column:
    """Paragraphs, with those over MOST cut into slices of TARGET characters."""
    paragraphs = F.filter(F.transform(F.split(text, rf"\n\s*\n|{PAGE_MARK}"), lambda x: F.trim(x)), lambda x: x != "")
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.length(p) - 1, F.lit(TARGET)), lambda i: F.substring(p, i + 1, F.lit(TARGET)))
    return F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) > MOST, cut(p)).otherwise(F.array(p))))


def pack(parts: Column) -> Column:
    """Pieces joined by blank lines while they fit; a new chunk begins with the last OVERLAP characters of the one before."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc, piece):
        joined = F.when(acc["open"] == "", piece).otherwise(F.concat(acc["open"], F.lit("\n\n"), piece))
        fits = F.length(joined) <= MOST
        tail = F.trim(F.right(acc["open"], F.lit(OVERLAP)))
        fresh = F.when(tail == "", piece).otherwise(F.concat(tail, F.lit("\n\n"), piece))
        full = (acc["open"] != "") & ~fits
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), F.when(full, fresh).otherwise(joined).alias("open"))

    return F.aggregate(parts, start, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def source_texts(files: DataFrame) -> DataFrame:
    """document_id, source, pos, text, summary, page_range of a file: its own chunks in order, else its combined, extracted or summary text."""
    d = F.col("processedData")
    row = "array<struct<source:string,pos:double,text:string,summary:string,page_range:string>>"
    usable = F.filter(F.coalesce(d["chunks"], F.array().cast("array<struct<chunk_number:double,extracted_text:string,summary:string,gcs_uri:string,page_range:string>>")), lambda c: F.trim(F.coalesce(c["extracted_text"], F.lit(""))) != "")
    own = F.transform(usable, lambda c: F.struct(F.lit("chunk").alias("source"), c["chunk_number"].alias("pos"), c["extracted_text"].alias("text"), c["summary"].alias("summary"), c["page_range"].alias("page_range"))).cast(row)
    single = lambda name, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.array(F.struct(F.lit(name).alias("source"), F.lit(0.0).alias("pos"), c.alias("text"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("page_range"))).cast(row))
    chosen = F.when(F.size(own) > 0, own).otherwise(F.coalesce(single("combined_text", d["combined_text"]), single("extracted_text", d["extractedText"]), single("summary", d["summary"])))
    return files.select(F.col("_id").alias("document_id"), F.explode(chosen).alias("s")).select("document_id", "s.*")


def chunk_rows(texts: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """chunk_id, chunk_number, text, preview, char_count, chunk_hash of texts, one text for each key."""
    cut = texts.select(key, F.posexplode(pack(pieces(compact(F.coalesce(text, F.lit("")))))).alias("i", "chunk"))
    number = F.col("i") + 1
    return cut.select(F.concat_ws(":", F.col(key).cast("string"), F.lit("chunk"), number.cast("string")).alias("chunk_id"), key, number.alias("chunk_number"), F.col("chunk").alias("text"), F.left("chunk", F.lit(PREVIEW)).alias("preview"), F.length("chunk").alias("char_count"), content_hash("chunk").alias("chunk_hash"))


def file_chunks(files: DataFrame) -> DataFrame:
    """Chunks of files, numbered through all texts of a file in their order, with the page range of the text they come from."""
    cut = source_texts(files).select("document_id", "source", "pos", "page_range", F.posexplode(pack(pieces(compact("text")))).alias("i", "chunk"))
    number = F.row_number().over(W.partitionBy("document_id").orderBy("pos", "i"))
    rows = cut.withColumn("chunk_number", number)
    return rows.select(F.concat_ws(":", "document_id", F.lit("chunk"), F.col("chunk_number").cast("string")).alias("chunk_id"), "document_id", "chunk_number", "source", "page_range", F.col("chunk").alias("text"), F.left("chunk", F.lit(PREVIEW)).alias("preview"), F.length("chunk").alias("char_count"), content_hash("chunk").alias("chunk_hash"))
