"""A few registered queries against their oracle SQL on the smallest tables; all names must be unique and well-formed."""

from pathlib import Path

import duckdb
import pytest

from quillspark.plans import catalog

SF = Path("/root/testdata/sf0.001")
SOME = ["cohort_common_signals", "case_signal_rollup", "similar_top_k_either_side", "portfolio_insurer", "search_cases_filtered", "stage_timeline", "compare_case_to_pattern", "contact_dedup", "valuation_components_unpivot"]


def test_oracles_have_queries():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = catalog.QUERIES[name](spark, str(SF))
    want = con.execute(catalog.ORACLE_SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(cols)
    tidy = lambda row: tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in row)
    assert sorted(tidy(r) for r in got.select(*cols).collect()) == sorted(tidy(r) for r in want.fetchall())


def test_entry_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
