"""Every registered query against its DuckDB oracle (driver contract) on sf0.001."""
import pytest

import __spark_entry__ as E
from postsift.plans.oracle import oracle_sql
from postsift.plans.queries import QUERIES
from postsift.plans.verify import compare, duck

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_is_registered_with_oracle_or_rows_only():
    assert set(SQL) <= set(QUERIES) and set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())
    assert set(QUERIES) - set(SQL) == {"lr_predict"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    rep = compare(QUERIES[name](spark, SF), con, SQL[name])
    assert rep["ok"], rep
    assert not rep.get("type_mismatch"), rep


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "segment" in df.columns


def test_lr_predict_rows(spark):
    df = QUERIES["lr_predict"](spark, SF)
    n_docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = df.collect()
    assert len(rows) == n_docs
    assert {r.prediction for r in rows} <= {"__label__q0", "__label__q1", "unmeasurable"}
    assert all(0.5 <= r.probability <= 1 for r in rows)
