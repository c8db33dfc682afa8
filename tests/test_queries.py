"""Every registered query of the core against its SQL on the smallest tables, or at least that it runs."""

import pytest
from oracle import compare

from mnemora import plans

SF = "/root/testdata/sf0.001"
SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, name):
    query = plans.queries()[name]
    if name in SQL:
        compare(spark, SF, query, SQL[name])
    else:
        query(spark, SF).collect()


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(plans.queries())


def test_searches_over_empty_tables(spark, tmp_path):
    import os

    from mnemora.plans import event_queries, search_queries

    for f in os.listdir(SF):
        spark.read.parquet(f"{SF}/{f}").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{f}")
    for name, query in (search_queries.QUERIES | {"ann_recall": event_queries.ann_recall}).items():
        assert query(spark, str(tmp_path)).count() <= 1, name
