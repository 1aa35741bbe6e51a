"""Registered queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as contract
from tests.check_oracles import connect, differences
from tidewatch.llm.oracles import oracle_sql
from tidewatch.llm.queries import queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


def test_all_are_registered():
    assert set(queries()) | {"pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    frame = queries()[name](spark, SF_DIR).toPandas()
    assert differences(frame, connect(SF_DIR).sql(oracle_sql()[name]).df()) == []


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, ids = docs.columns, [{r["doc_id"] for r in docs.collect()}]
    for number, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert ids[-1] <= ids[-2] and ids[-1]
        if number < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert ids[1] == ids[2] and len(ids[1]) < len(ids[0])
    assert {"sequence_id", "offset", "ids"} <= set(docs.columns)
