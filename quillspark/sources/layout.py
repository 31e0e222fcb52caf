"""Tables laid out for seeks: sorted by key, in small row groups, with Bloom filters, so that a lookup opens few of them.

The rows of one key lie together, so the least and greatest key of a row group (and of its pages) rule out nearly all groups. Other keys, by
which the rows are not sorted, get Bloom filters: a group is read only if it may hold the value. Both are Parquet's, and Spark's filters
reach them by themselves; lookups are written as on any other table."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession

from . import sinks

#: Bytes of a row group: what a lookup of one key reads at least.
GROUP_BYTES = 1 << 20


def write_sorted(df: DataFrame, path: str, key: str, others: tuple[str, ...] = (), group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Writes df sorted by key, with Bloom filters on others, and returns it read again."""
    spark = df.sparkSession
    out = df.repartitionByRange(key).sortWithinPartitions(key, *others).write.option("parquet.block.size", group_bytes)
    for c in others:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables of a portfolio that are looked up by case, and the other keys of each.
SOUGHT = {"cases": ("case_number",), "documents": ("document_id",), "communications": ("comm_id",), "facts": ("document_id", "fact_id"), "injuries": ("normalized",), "body_parts": ("normalized",), "insurers": ("normalized",), "experts": ("key",), "case_contacts": ("contact_id",), "valuations": ()}


def laid_out(p, path: str, group_bytes: int = GROUP_BYTES):
    """The portfolio with its tables sorted by case at path; they are written by the first call and read by later ones."""
    spark: SparkSession = p.cases.sparkSession
    done = sinks.read_table(spark, f"{path}/written")
    known = set() if done is None else {r[0] for r in done.collect()}  # at most one row a table
    tables = {}
    for name, others in SOUGHT.items():
        df = getattr(p, name)
        if name in known:
            tables[name] = spark.read.schema(df.schema).parquet(f"{path}/{name}")
            continue
        sinks.clear(spark, f"{path}/{name}")  # what a writer that died has left
        tables[name] = write_sorted(df, f"{path}/{name}", "case_id", others, group_bytes)
        sinks.upsert_rows(spark.createDataFrame([(name,)], "name string"), f"{path}/written", ["name"], parts=1)
    return dataclasses.replace(p, **tables)


def scanned(df: DataFrame) -> dict[str, int]:
    """Runs df and returns what its scans read: files, and rows that came out of the row groups that were opened."""
    df.collect()
    files = rows = 0
    plans = [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            plans.append(plan.executedPlan())
            continue
        if "QueryStage" in name:
            plans.append(plan.plan())
            continue
        if name.startswith("Scan"):
            metrics = plan.metrics()
            files += metrics.apply("numFiles").value() if metrics.contains("numFiles") else 0
            rows += metrics.apply("numOutputRows").value() if metrics.contains("numOutputRows") else 0
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    return {"files": files, "rows": rows}
