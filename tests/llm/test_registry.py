"""Every query of the subpackage over the smallest tables; those with SQL give its rows."""

import duckdb
import pytest

from tempora.llm import registry


#: Queries whose rows aren't documents.
OTHER_ROWS = {"op11_suffix_sigma_collocations", "op12_hamerly_codes"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - OTHER_ROWS))
def test_one_row_for_each_document_at_least(spark, sf, documents, name):
    rows = registry.QUERIES[name](spark, sf).select("doc_id").distinct().count()
    assert rows == documents.count()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    want = con.execute(registry.ORACLE_SQL[name]).fetchdf()
    columns = sorted(want.columns)
    got = registry.QUERIES[name](spark, sf).select(*columns).toPandas()
    assert sorted(map(tuple, got[columns].to_numpy().tolist())) == sorted(map(tuple, want[columns].to_numpy().tolist()))
