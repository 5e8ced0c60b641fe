"""Every query of the engine against its SQL, and the entry points."""

import compare
import pytest

from quillstream import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, sf, name):
    sf = sf if name != "redact_secrets" else "/root/testdata/sf0.01"  # the smallest tables hold no secret
    assert compare.differences(spark, sf, catalogue.queries()[name], catalogue.oracle_sql()[name]) == []


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_no_cartesian_product_on_tables(spark, sf):
    for name in ("contamination_probe", "range_backfill_join", "fts_idf_topk"):
        plan = catalogue.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
