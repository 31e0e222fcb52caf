import corpus_pipeline as cp
from quillspark.llm.common import table


def test_stages_keep_the_columns(spark, awkward, tmp_path, labels, items):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = awkward
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).columns[: len(docs.columns)] == docs.columns


def test_pipeline_decides(spark):
    sf = "/root/testdata/sf0.001"
    out = cp.run(spark, sf)
    rows = out.collect()
    n = table(spark, sf, "documents").count()
    assert 0 < len(rows) < n and all(r.taken > 0 for r in rows) and len({r.doc_id for r in rows}) == len(rows)
