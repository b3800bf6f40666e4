"""What the physical plans must not contain."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ARROW = {"match_fuzzy", "match_best", "match_similar", "match_misspelt"}
EAGER = {"stream_ingest_acks", "stream_ingest_forecasts", "forecast_read_files", "forecast_read_quotes", "export_csv"}


@pytest.mark.parametrize("name", sorted({name for group in entry.LIBRARY for name in group.QUERIES} - EAGER))
def test_plan(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    if name not in ARROW:
        assert "ArrowEvalPython" not in plan and "MapInPandas" not in plan
    if "Exchange SinglePartition" in plan:  # only ordered results, whole-table totals and their few rows
        assert "Aggregate" in plan


def test_filters_and_columns_reach_the_scan(spark):
    from catalog.views import table
    from fillwise.operators.monthly import forecast_summary
    from pyspark.sql import functions as F

    f = table(spark, SF, "lineitem").select(F.col("l_shipdate").cast("date").alias("forecast_month"), F.col("l_quantity").alias("forecast_qty"),
                                            F.col("l_partkey").alias("vendor_sku"), F.col("l_suppkey"))
    plan = forecast_summary(f.filter("l_suppkey = 3"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_suppkey,3)" in plan and "l_partkey" not in plan


def test_ranking_limits_rows_before_the_shuffle(spark):
    plan = entry.queries()["latest_ack_lines"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


#: Most hash exchanges and scans in the final plan, with no side small enough to broadcast. Tables that a query stores on the way
#: (session.held) have plans of their own.
SHAPES = {"filter_options": (9, 4), "search_po_expand": (12, 6), "abc_class": (11, 2), "rca_report": (9, 4), "rca_by_po": (16, 20),
          "dashboard_kpis": (6, 3), "report_summary": (5, 3), "four_panels": (7, 3), "match_misspelt": (24, 18)}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_shape_of_a_large_plan(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = entry.queries()[name](spark, SF)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    exchanges, scans = SHAPES[name]
    assert sum("Exchange hashpartitioning" in line and "ReusedExchange" not in line for line in plan.splitlines()) <= exchanges
    assert plan.count("FileScan parquet") <= scans


def test_streamed_documents_are_packed(spark, tmp_path, monkeypatch):
    from catalog import loading

    monkeypatch.setattr(loading, "scratch", lambda spark, name: str(tmp_path / name))
    assert loading._streamed(spark, SF).count() > 0
    assert {p.suffix for p in (tmp_path / "acks" / "in").glob("part-*")} == {".gz"}


def test_wide_rows_are_made_where_their_products_are(spark):
    plan = entry.queries()["forecast_unpivot"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(vendor_sku") == 1


def test_sheet_lines_are_built_once(spark):
    """Readers go over the lines several times; each would build them anew from the lines of orders."""
    from catalog import loading

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        loading.scratch(spark, "any")
    assert "lineitem" not in loading._sheet_lines(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_rows_found_by_many_texts_are_not_shuffled(spark):
    from catalog import selection
    from fillwise.operators import postings

    f, _ = postings.search_texts(selection._fcst(spark, SF), selection._lines(spark, SF), selection._texts(spark, SF))
    assert "HashAggregate(keys=[query#" not in "".join(
        line for line in f._jdf.queryExecution().executedPlan().toString().splitlines(True) if "forecast_month" in line)
