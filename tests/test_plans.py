"""What the plans of some queries must and mustn't hold."""

import re

import pytest

from baglight.operators.rows import latest
from baglight.plans import registry
from baglight.sources.tables import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, columns", [("split_eda", {"uid", "split", "n_labels", "indexed_at"}), ("hue_histogram", {"l_quantity", "l_discount", "l_tax"}), ("split_report", {"uid", "labels", "part", "run_at"}), ("seed_summary", {"c_nationkey", "c_acctbal"})])
def test_only_the_columns_asked_for_are_read(spark, small, name, columns):
    text = plan(registry.QUERIES[name](spark, small))
    read = re.findall(r"ReadSchema: struct<([^\n]*)>", text)
    assert read and all({c.split(":")[0] for c in re.split(r",(?![^<]*>)", r)} <= columns for r in read)


def test_filters_reach_the_scan(spark, small):
    df = table(spark, small, "lineitem", "l_orderkey", "l_quantity").filter("l_quantity > 40")
    assert "GreaterThan(l_quantity,40.0)" in plan(df)


def test_the_current_row_is_cut_before_the_shuffle(spark, small):
    text = plan(latest(table(spark, small, "scan_split", "uid", "run_at", "part"), "uid", "run_at"))
    assert text.count("WindowGroupLimit") == 2 and text.index("Final") < text.index("Exchange") < text.index("Partial")


@pytest.mark.parametrize("name", ["box_ap50", "near_dup_pairs", "leakage_audit", "stem_lookup", "split_class_report", "donors"])
def test_no_product_of_two_tables(spark, small, name):
    text = plan(registry.QUERIES[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["near_dup_pairs", "leakage_audit"])
def test_exploded_signatures_are_never_broadcast(spark, small, name):
    df = registry.QUERIES[name](spark, small)
    df.collect()
    text = plan(df)
    assert "isFinalPlan=true" in text or "AdaptiveSparkPlan" in text
    for side in re.findall(r"BroadcastHashJoin[^\n]*", text):
        assert "key" not in side


def test_signatures_are_spread_before_they_become_keys(spark, small):
    rows = spark.range(1, 2000).selectExpr("id * 7919 as d", "id * 104729 as a").distinct()
    from baglight.operators.splits import near_signatures

    df = near_signatures(rows, rows, 12)
    df.collect()
    assert plan(df).count("REPARTITION_BY_NUM") >= 2
