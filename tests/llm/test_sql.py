import pytest
from compare import connected, differences

from tracespark.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    assert not differences(queries.QUERIES[name](spark, FOLDER), connected(FOLDER), queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_one_row_per_document(spark, name):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert queries.QUERIES[name](spark, FOLDER).count() == n
