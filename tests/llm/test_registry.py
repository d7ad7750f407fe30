import pytest
from conftest import same_rows

from sparkquarry.llm import registry


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_runs(name, spark, data):
    df = registry.queries()[name](spark, data)
    rows = df.toPandas()
    assert len(rows) > 0 and len(set(df.columns)) == len(df.columns)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(name, spark, data, duck):
    same_rows(registry.queries()[name](spark, data), duck.execute(registry.oracle_sql()[name]).df())


def test_columns(spark, data):
    columns = {"p1_found": ["chunk_id"], "p2_found": ["chunk_id"], "p3_found": ["response_id", "defect"], "p4_found": ["chunk_id"], "p5_found": ["chunk_id_a", "chunk_id_b"], "p6_found": ["chunk_id_a", "chunk_id_b"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id_a", "doc_id_b"]}
    for name, want in columns.items():
        assert registry.queries()[name](spark, data).columns == want
