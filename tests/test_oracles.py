"""Every query against its DuckDB SQL on the smallest tables."""

import datetime
import decimal
import os
import re

import pytest

duckdb = pytest.importorskip("duckdb")
from pagemill.plans import registry  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    return str(v) if isinstance(v, (datetime.datetime, list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows(spark, con, name):
    got = registry.QUERIES[name](spark, DATA)
    rows = sorted(tuple(str(plain(r[c])) for c in sorted(got.columns)) for r in got.collect())
    if name not in registry.ORACLES:
        assert rows
        return
    want = con.sql(registry.ORACLES[name])
    cols = want.columns
    assert sorted(cols) == sorted(got.columns)
    assert rows == sorted(tuple(str(plain(r[cols.index(c)])) for c in sorted(cols)) for r in want.fetchall())


@pytest.mark.parametrize("policy", ["digital", "mixed", "unknown"])
def test_reason_codes_of_blank_pages(spark, tmp_path, policy):
    texts = ["", "  ", "\n \r\n", "\t", "short prose", "x = y = z " * 30, "word " * 100]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    own = duckdb.connect()
    own.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    name = f"page_reason_codes_{policy}"
    got = registry.QUERIES[name](spark, str(tmp_path)).select("source_id", "page", "reason_codes").collect()
    assert sorted(map(tuple, got)) == sorted(own.sql(f"SELECT source_id, page, reason_codes FROM ({registry.ORACLES[name]})").fetchall())


def test_unused_columns_are_not_read(spark):
    plan = registry.QUERIES["representative_pages"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"ReadSchema: struct<[^>]*text", plan)


def test_filters_reach_the_scan(spark):
    plan = registry.QUERIES["ledger_new_batches"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan


def test_entry_works_without_the_llm_folder():
    import subprocess
    import sys

    code = "import sys; sys.modules['pagemill.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'batch_plan' in q and not any(k.startswith('op') and k[2].isdigit() for k in q), q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
