"""The registered queries against SQL on the small tables, and the pipeline against its stages one by one."""

from __future__ import annotations

import pytest
from oracle_check import compare, duckdb_views

import corpus_pipeline
from shelfcast.llm import oracle, queries
from shelfcast.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duckdb_views(SF)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    columns = [d[0] for d in con.execute(f"SELECT * FROM ({oracle.oracle_sql()[name]}) LIMIT 0").description]
    result = compare(con, queries.queries()[name](spark, SF).select(columns), oracle.oracle_sql()[name])
    assert result["columns"] and result["types"] and result["values"], result


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_stages_keep_columns_and_the_last_packs_what_is_left(spark):
    docs = before = table(spark, SF, "documents")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == before.columns and docs.dtypes == before.dtypes
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] / 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(whole.select("doc_id", "piece", "length", "ids_crc32").collect()) == sorted(packed.select("doc_id", "piece", "length", "ids_crc32").collect())
