"""What no plan may hold, and what some must."""

import pytest

from lorekeep.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - {"k9_self_model_items"}))  # that one joins a few literal rows
def test_no_product_of_tables(spark, name):
    text = plan(registry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_text_is_not_read_where_it_is_not_needed(spark):
    for name in ("a1_system_stats", "a6_daily_context", "q7_core_listing", "k10_degree_recompute", "e_quality_audit"):
        assert "text" not in plan(registry.queries()[name](spark, SF)).split("ReadSchema")[-1] and "documents.parquet" not in plan(registry.queries()[name](spark, SF))


def test_filters_reach_the_scan(spark):
    assert "GreaterThanOrEqual(ts" in plan(registry.queries()["f5_day_filter"](spark, SF))
    assert "GreaterThan(event_id" in plan(registry.queries()["h13_since_watermark"](spark, SF))
