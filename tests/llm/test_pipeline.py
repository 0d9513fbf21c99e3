"""The pipeline over small tables, stage by stage and as a whole, and the registered queries."""

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tallyward.llm import queries  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != names[-1]:
            assert out.columns == docs.columns
            assert 0 < out.count() <= seen
            seen, docs = out.count(), out
    assert out.select("doc_id").distinct().count() == seen


def test_run_packs_what_the_stages_keep(spark):
    got = corpus_pipeline.run(spark, DATA).toPandas()
    lengths = got.groupby("sequence_id")["length"].sum().to_numpy()
    assert (np.sort(lengths)[1:] == 2048).all()
    assert (got.groupby("doc_id")["length"].sum() == got.groupby("doc_id")["doc_tokens"].first()).all()


def test_extra_columns_and_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "12 34", "en", None, 5), (None, "plain words of no one at all", "en", "s", 1)], docs.schema)
    wide = docs.union(odd).union(docs.limit(3)).selectExpr("*", "'x' AS lang_pred", "1 AS toxicity", "'k' AS _key", "'t' AS text_key", "2 AS passages", "3 AS node")
    at = f"file://{tmp_path}"
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    for table in (wide, wide.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, at)
            assert now.schema.names == wide.schema.names, name
        ids = [r.doc_id for r in now.collect()]
        assert len(ids) == len(set(ids)) and not {-1, -2, -3} & set(ids)
        assert corpus_pipeline.STAGES[-1][1](spark, now, at).select("doc_id").distinct().count() == len(ids)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
