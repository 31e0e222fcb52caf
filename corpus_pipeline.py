"""The corpus pipeline: five stages over documents, each on all that its predecessor kept.

1. quality: documents that the quality trees reject go.
2. near_duplicates: one document of each near-duplicate class stays, the one with the least doc_id.
3. decontamination: documents that hold a benchmark window go.
4. pii: personal data and terms that reveal it are generalised in the text.
5. mixing: the mix over what is left; documents it takes nothing of go, and size, source_size,
   target and taken say how many words it takes of each of the others, repeats counted.

Defined cases: a null text is an empty one at every stage: it is scored as such, is no near duplicate of anything, holds no window and no personal data, and
has size 0, so that the mix takes nothing of it; rows with a null doc_id are kept like others; equal rows are one class, of which one stays; very
long texts are worked on whole; an empty table, at the start or after any stage, gives no rows; extra columns go through all stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontaminate, minhash, mixing, pii, quality
from quillspark.llm.common import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.good_rows(docs, model)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def generalise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each_class),
    ("decontamination", keep_uncontaminated),
    ("pii", generalise_personal_data),
    ("mixing", mix_sources),
]

#: The quality trees are trained on the data, which SQL can't express; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
