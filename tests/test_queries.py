import compare
import pytest

from quarrymill import queries

SF = "/root/testdata/sf0.001"
#: Inference needs more than a handful of rows to tell keys from chance.
LARGER = {"infer_keys": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    sf = LARGER.get(name, SF)
    assert compare.of_spark(queries.QUERIES[name](spark, sf)) == compare.of_duck(queries.SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_inference_covers_all_tables(spark):
    found = {(r["table"], r["column"]) for r in queries.QUERIES["infer_columns"](spark, SF).collect()}
    assert found == {(t, c) for t in compare.TABLES for c in spark.read.parquet(f"{SF}/{t}.parquet").columns}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
