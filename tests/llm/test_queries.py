"""Registered queries against DuckDB, the pipeline's stages, and independence from the subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from photonlake.llm import registry
from tests.test_registry import rows

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0])))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    table = "pages" if name.startswith("op8_") else "documents"
    if not name.startswith("op6_"):
        assert len(got) == spark.read.parquet(f"{DATA}/{table}.parquet").count()
    if name in registry.SQL:
        c = duckdb.connect()
        for file in Path(DATA).glob("*.parquet"):
            c.sql(f"create view {file.stem} as select * from '{file}'")
        assert rows(got) == rows(c.sql(registry.SQL[name]).df())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} <= ids, name
    last = corpus_pipeline.run(spark, DATA).collect()
    assert last and {r["doc_id"] for r in last} <= ids and {r["shard"] for r in last} <= set(range(16))
    assert "pipeline" in __spark_entry__.queries()


def test_the_rest_does_not_import_the_subpackage():
    code = "import sys; from photonlake.plans import registry, pipeline; from photonlake.streaming import incremental; assert not [m for m in sys.modules if m.startswith('photonlake.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__spark_entry__.__file__).parent)
