"""Small cases worked out by hand from the rules."""

import datetime as dt
import math
import json

import pytest
from pyspark.sql import functions as F

from fillwise.functions.stats import slope_p_value
from fillwise.operators import display, filters, matching, monthly, questions, ranking, search
from fillwise.operators.root_cause import conclusions_table, rca_by_po, rca_by_sku, root_cause
from fillwise.plans import dashboards
from fillwise.plans.workspace import Workspace
from fillwise.sources.acks import flatten_documents, read_ack_lines

D = dt.date


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def column(df, name):
    return [r[name] for r in df.collect()]


def test_documents_in_both_layouts(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    flat = {"header": {"vendor": "Harbour Mills", "po_number": "00081"}, "lines": [
        {"vendor_sku": "T-40", "upc": "0007", "ordered_quantity": 36, "confirmed_quantity": 30, "price": "1.25", "status_code": "P", "delivery_date": "2025-11-03"},
        {"vendorSku": "T-41", "gtin": "0008", "orderedQty": 6, "confirmedQty": 0, "price": "cheap"}]}
    nested = {"Header": {"OrderHeader": {"Vendor": "12", "PurchaseOrderNumber": "0099"}}, "LineItem": [
        {"OrderLine": {"LineSequenceNumber": "3", "VendorPartNumber": "Q-7", "OrderQty": 5.0, "GTIN": ""},
         "LineItemAcknowledgement": [{"ItemScheduleQty": 4.0, "ItemScheduleDate": "2025-12-24"}, {"ItemScheduleQty": 1.0}],
         "PhysicalDetails": [{"PackValue": 0}], "Dates": [{"DateTimeQualifier": "002", "Date": "2025-12-20"}]}]}
    for name, text in (("flat.json", json.dumps(flat)), ("deep/er/nested.json", json.dumps(nested)), ("cut.json", '{"lines": [')):
        (tmp_path / name).write_text(text)
    lines = {r["vendor_sku"]: r for r in read_ack_lines(spark, str(tmp_path)).collect()}
    assert sorted(lines) == ["Q-7", "T-40", "T-41"]
    assert (lines["T-40"]["po_number"], lines["T-40"]["upc"], lines["T-40"]["confirmed_qty"]) == ("00081", "0007", 30.0)
    assert lines["T-41"]["upc"] == "0008" and lines["T-41"]["price"] is None
    deep = lines["Q-7"]
    assert (deep["ordered_qty"], deep["confirmed_qty"], deep["line_no"]) == (5.0, 4.0, 3)  # a pack of 0 counts as 1
    assert deep["requested_dt"] == D(2025, 12, 20)
    whole = read_ack_lines(spark, str(tmp_path), sum_schedules=True).filter("vendor_sku = 'Q-7'").first()
    assert whole["confirmed_qty"] == 5.0


def test_monthly_totals(spark):
    f = frame(spark, "forecast_month date, forecast_qty double", (D(2025, 9, 1), 7.5), (D(2025, 8, 1), 4.0), (D(2025, 9, 1), 0.5), (None, 1.0))
    a = frame(spark, "delivery_date string, confirmed_qty double", ("2025-09-30", 2.0), ("2025-10-01", 9.0), ("unknown", 5.0), ("2025", 5.0))
    assert [tuple(r) for r in monthly.forecast_summary(f).collect()] == [(D(2025, 8, 1), 4.0), (D(2025, 9, 1), 8.0)]
    assert [tuple(r) for r in monthly.forecast_vs_actual(f, a).collect()] == [(D(2025, 8, 1), 4.0, None, None), (D(2025, 9, 1), 8.0, 2.0, 0.25)]


def test_calendar_columns_sort_by_time(spark):
    df = frame(spark, "ship_date string, n long", ("2025-10-02", 3), ("2025-02-11", 1), ("2025-02-12", 2))
    assert column(display.prepare_calendar(df, "ship_date"), "n") == [1, 2, 3]


def test_identifiers_decide_before_descriptions(spark):
    schema = "vendor_sku string, buyer_part_number string, upc string, description string"
    c = frame(spark, "candidate_id long, " + schema, (1, " K1 ", "B7", None, "oak chair"), (2, None, "B7", "U1", "oak chair"), (3, "", None, None, "oak chair tall"))
    t = frame(spark, "target_id long, " + schema, (10, "K1", None, None, "lamp"), (11, "K2", "B7", None, "desk"), (12, "K3", None, "U1", "rug"), (13, "K4", None, None, "oak chair"))
    got = {r["candidate_id"]: (r["target_id"], r["score"], r["tier"]) for r in matching.match_best(c, t).collect()}
    assert got == {1: (10, 100.0, "vendor_sku"), 2: (12, 99.0, "upc"), 3: (13, 100.0, "description")}


@pytest.fixture
def shop(spark):
    """Two orders of mugs and trays; a third product is only planned."""
    f = frame(spark, "vendor_sku string, forecast_month date, forecast_qty double",
              ("MUG", D(2025, 3, 1), 40.0), ("MUG", D(2025, 4, 1), 44.0), ("TRAY", D(2025, 4, 1), 6.0), ("VASE", D(2025, 4, 1), 15.0))
    a = frame(spark, "po_number string, vendor_sku string, ordered_qty double, confirmed_qty double, delivery_date string, vendor string",
              ("77", "MUG", 50.0, 35.0, "2025-04-03", "Kiln"), ("77", "TRAY", 5.0, 5.0, "2025-04-09", "Kiln"), ("78", "VASE", 12.0, 3.0, "2025-04-20", "Glass"))
    return f, a


def test_a_po_finds_the_forecasts_of_its_products(shop):
    f, a = search.search_records(*shop, "77")
    assert sorted(column(a, "vendor_sku")) == ["MUG", "TRAY"] and sorted(column(f, "forecast_qty")) == [6.0, 40.0, 44.0]
    f, a = search.search_records(*shop, "vase")
    assert column(f, "vendor_sku") == column(a, "vendor_sku") == ["VASE"]


def test_report_of_a_po(shop):
    f, a = shop
    report = rca_by_po(f, a, as_of="2025-05-01").filter("entity = '77'").first()
    assert (report["total_forecast"], report["total_confirmed"], report["po_shortfall_qty"]) == (90.0, 40.0, 15.0)
    assert [(c["cause"], c["confidence"]) for c in report["conclusions"]] == [("unknown", "low")] and report["confidence"] == 0.2
    single = Workspace(f, a).root_cause("77", as_of="2025-05-01").first()
    assert (single["total_forecast"], single["total_confirmed"]) == (90.0, 40.0) and single["conclusions"] == report["conclusions"]
    assert [s["vendor_sku"] for s in single["supporting_ack_samples"]] == ["TRAY", "MUG"]


def test_a_collapse_of_orders_is_a_cut(spark):
    """Six steady months, then a tenth of the volume against an unchanged plan."""
    months = [D(2025, m, 1) for m in range(1, 8)]
    f = frame(spark, "vendor_sku string, forecast_month date, forecast_qty double", *[("BOX", m, 60.0) for m in months])
    a = frame(spark, "vendor_sku string, po_number string, delivery_date string, ordered_qty double, confirmed_qty double",
              *[("BOX", f"N{i}", str(m), 60.0, 6.0 if i == 6 else 60.0) for i, m in enumerate(months)])
    found = {r["cause"]: r for r in conclusions_table(root_cause(f, a, as_of="2025-07-20")).collect()}
    assert set(found) == {"product_cut", "vendor_under_supply"}
    assert found["product_cut"]["detail"] == "orders_drop" and found["product_cut"]["evidence"] == {"drop_pct": 0.9}
    assert found["vendor_under_supply"]["confidence"] == "high"  # the fill falls by more than 0.05 a month


def test_more_orders_than_planned(spark):
    f = frame(spark, "vendor_sku string, forecast_month date, forecast_qty double", ("P", D(2025, 1, 1), 10.0), ("Q", D(2025, 1, 1), 10.0))
    a = frame(spark, "vendor_sku string, delivery_date string, ordered_qty double, confirmed_qty double",
              ("P", "2025-01-05", 13.0, 13.0), ("Q", "2025-01-05", 11.0, 11.0), ("R", "2025-01-05", 2.0, 2.0))
    got = {(r["entity"], r["cause"], r["confidence"]) for r in conclusions_table(rca_by_sku(f, a, as_of="2025-02-01")).collect()}
    assert got == {("P", "demand_exceeded_forecast", "high"), ("Q", "demand_exceeded_forecast", "medium"),
                   ("R", "demand_exceeded_forecast", "high"), ("R", "forecast_missing", "high")}


def test_an_unknown_entity_has_no_data(spark, shop):
    row = root_cause(*shop, entities=frame(spark, "entity string", ("SPOON",)), as_of="2025-05-01").first()
    assert [(c["cause"], c["confidence"]) for c in row["conclusions"]] == [("no_data", "high")] and row["confidence"] == 1.0


def test_reports_of_one_vendor(shop):
    rows = {r["entity"]: r["total_confirmed"] for r in root_cause(*shop, vendor="Glass", as_of="2025-05-01").collect()}
    assert rows == {"MUG": 0.0, "TRAY": 0.0, "VASE": 3.0}


def test_stock_reached_through_another_identifier(spark):
    """The PO's line names P1, its UPC leads to the plan of P2, and only P2 is in stock."""
    f = frame(spark, "vendor_sku string, upc string, forecast_month date, forecast_qty double", ("P2", "555", D(2025, 4, 1), 9.0))
    a = frame(spark, "po_number string, vendor_sku string, upc string, delivery_date string, ordered_qty double, confirmed_qty double",
              ("PO9", "P1", "555", "2025-04-02", 10.0, 2.0))
    stock = frame(spark, "vendor_sku string, qty_available double, supplier_po_qty double, inventory_snapshot_date date", ("P2", 6.0, 0.0, D(2025, 4, 1)))
    ws = Workspace(f, a, stock)
    fields = ("total_forecast", "qty_available", "po_shortfall_qty", "uncovered_shortfall_qty")
    reports = [ws.root_cause("PO9", as_of="2025-05-01").first(), rca_by_po(f, a, stock, as_of="2025-05-01").filter("entity = 'PO9'").first(),
               ws.root_causes(as_of="2025-05-01").filter("entity = 'PO9'").first()]
    for r in reports:
        assert tuple(r[x] for x in fields) == (9.0, 6.0, 8.0, 2.0)
        assert [c["cause"] for c in r["conclusions"]] == ["inventory_insufficient_for_po_shortfall"]


def test_equal_lines_count_once_for_a_po_only(spark):
    f = frame(spark, "vendor_sku string, forecast_month date, forecast_qty double", ("P1", D(2025, 4, 1), 9.0))
    line = ("PO9", "P1", "2025-04-02", 5.0, 3.0)
    a = frame(spark, "po_number string, vendor_sku string, delivery_date string, ordered_qty double, confirmed_qty double", line, line)
    ws = Workspace(f, a)
    total = lambda r: r.first()["total_confirmed"]
    assert total(rca_by_sku(f, a, as_of="2025-05-01")) == total(ws.root_cause("P1", as_of="2025-05-01")) == 6.0
    assert total(ws.root_causes(as_of="2025-05-01").filter("entity = 'P1'")) == 6.0
    assert total(rca_by_po(f, a, as_of="2025-05-01")) == total(ws.root_cause("PO9", as_of="2025-05-01")) == 3.0
    assert total(ws.root_causes(as_of="2025-05-01").filter("entity = 'PO9'")) == 3.0


def test_rows_that_differ_in_a_map_are_no_copies(spark):
    schema = "vendor_sku string, forecast_qty double, attributes map<string,string>"
    f = frame(spark, schema, ("P1", 1.0, {"a": "x", "b": "y"}), ("P1", 1.0, {"b": "y", "a": "x"}), ("P1", 1.0, {"a": "z"}), ("P3", 1.0, None), ("P3", 1.0, None))
    a = frame(spark, "po_number string, vendor_sku string", ("PO9", "P1"))
    found, _ = search.search_records(f, a, "PO9")
    assert sorted(column(found, "attributes"), key=str) == [{"a": "x", "b": "y"}, {"a": "z"}]
    direct, _ = search.search_records(f, a, "P3")  # nothing is reached through a line: equal rows all count
    assert direct.count() == 2


def test_significance_for_any_number_of_points(spark):
    """The series against the closed forms of 3 to 6 points, and against the density summed up by Simpson's rule beyond."""
    def outside(r, n):
        v = n - 2
        steps = 20_000
        h = math.asin(r) / steps  # t = sqrt(v) tan(x) turns the density into a power of the cosine
        f = lambda x: math.cos(x) ** (v - 1)
        area = h / 3 * sum((1 if i in (0, steps) else 4 if i % 2 else 2) * f(i * h) for i in range(steps + 1))
        return 1 - 2 * area * math.gamma((v + 1) / 2) / math.gamma(v / 2) / math.sqrt(math.pi)

    closed = {3: lambda r: 1 - 2 * math.asin(r) / math.pi, 4: lambda r: 1 - r, 5: lambda r: 1 - 2 / math.pi * (math.asin(r) + r * math.sqrt(1 - r * r)),
              6: lambda r: 1 - r * (1 + (1 - r * r) / 2)}
    rows = spark.range(1, 25).crossJoin(spark.createDataFrame([(0.0,), (0.3,), (-0.7,), (0.99,), (1.0,)], "r double"))
    for n, r, p in rows.select("id", "r", slope_p_value(F.col("r"), F.col("id")).alias("p")).collect():
        if n < 3:
            assert p is None
        else:
            assert abs(p - outside(abs(r), n)) < 1e-9 and (n not in closed or abs(p - closed[n](abs(r))) < 1e-12)


def test_filters(spark):
    df = frame(spark, "vendor string, brand string, ack_date date", ("N", "x", D(2025, 1, 1)), ("S", "x", None), ("S", "y", None), (None, "x", None))
    got = lambda **kw: filters.apply_filters(df, kw).count()
    assert got(vendor=["S", "N"], brand=["x"]) == 2 and got(vendor=[None, " "], brand=[], ack_date=["never"], colour=["red"]) == 4


def test_one_text_column_and_no_unnamed_ones(spark):
    df = frame(spark, "`unnamed: 3` string, vendor_sku string, brand string, description string, product_description string", ("z", "P1", "b", "long text", "  "))
    tidy = display.tidy_columns(df)
    assert tidy.columns == ["vendor_sku", "Product Description", "brand"] and tidy.first()[1] == "long text"


def test_exactly_eighty_percent_is_no_cut(spark):
    from fillwise.operators.signals import product_cuts, with_fill

    m = frame(spark, "vendor_sku string, month date, forecast_qty double, confirmed_qty double",
              ("at", D(2025, 1, 1), 50.0, 0.0), ("at", D(2025, 2, 1), 10.0, 0.0),
              ("below", D(2025, 1, 1), 50.0, 0.0), ("below", D(2025, 3, 1), 9.5, 0.0), ("below", D(2025, 4, 1), 0.0, 0.0))
    assert column(product_cuts(with_fill(m)), "vendor_sku") == ["below"]


def test_questions(spark, shop):
    f, a = shop
    many = a.unionByName(frame(spark, a.schema, ("79", "MUG", 1.0, 12.345, "2025-04-21", "Over")))
    asked = frame(spark, "question string", ("Is this PO short: 77",), ("how good is vendor kiln",), ("how good is vendor over",), ("how good is vendor zzz",), ("hello",))
    answers = {r["question"]: r["answer"] for r in Workspace(f, many).answer(asked, as_of="2025-05-01").collect()}
    assert answers["Is this PO short: 77"] == "Confidence: 20%.\nPossible cause: unknown (low)."
    assert answers["how good is vendor kiln"] == "Vendor kiln has an average fill rate of 72.7%."
    assert answers["how good is vendor over"] == "Vendor over has an average fill rate of 1234.5%."
    assert answers["how good is vendor zzz"] == answers["hello"] == questions.FALLBACK


def test_every_page_has_data(shop):
    f, a = shop
    a = a.withColumns({"customer": F.lit("C"), "line_no": F.lit(1)})
    ws = Workspace(f, a)
    for page in (dashboards.overview, dashboards.four_panels, dashboards.forecast_page, dashboards.acknowledgement_page,
                 dashboards.accuracy_page, dashboards.exception_page, dashboards.vendor_page):
        for name, df in page(ws).items():
            assert df.count() > 0, name
    cut = dashboards.cut_page(ws, "77", as_of="2025-05-01")
    assert sorted(column(cut["coverage"], "vendor_sku")) == ["MUG", "TRAY"]
    assert ranking.top_risk_products(a, 1).first()["vendor_sku"] == "VASE"


def test_workers_need_no_package(tmp_path):
    """Queries with code in tasks run from another folder, without PYTHONPATH."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = (f"import sys; sys.path.insert(0, {str(root)!r})\n"
            "import __spark_entry__ as e\nfrom pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "print('rows', len(e.queries()['match_best'](s, '/root/testdata/sf0.001').collect()))")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]


def test_a_po_gets_lists_of_months_and_no_sku_that_its_line_covers(spark):
    """P1 is planned under one UPC only, P2 under two: the UPC of the line covers P1, not P2."""
    from fillwise.operators.reach import reached

    f = frame(spark, "vendor_sku string, upc string, forecast_month date, forecast_qty double",
              *[("P1", "555", D(2024, m, 1), 1.0) for m in range(1, 13)], ("P2", "555", D(2024, 1, 1), 10.0), ("P2", "556", D(2024, 1, 1), 100.0))
    a = frame(spark, "po_number string, vendor_sku string, upc string, delivery_date string, ordered_qty double, confirmed_qty double",
              ("PO1", "P1", "555", "2024-02-02", 1.0, 1.0), ("PO2", "P2", "555", "2024-02-02", 1.0, 1.0), ("PO3", "P2", None, "2024-02-02", 1.0, 1.0))
    rows = reached(f, a, None, (), None).groupBy("entity").count().collect()
    assert dict(map(tuple, rows)) == {"PO1": 1, "PO2": 3, "PO3": 1}  # lists, however many months
    report = rca_by_po(f, a, as_of="2024-12-31", lookback_months=24)
    assert {r["entity"]: r["total_forecast"] for r in report.collect()} == {"PO1": 22.0, "PO2": 122.0, "PO3": 110.0}


@pytest.mark.parametrize("entries", [0, 14, 1000])
def test_lists_that_many_pos_share_are_not_dealt_to_them(spark, monkeypatch, entries):
    """Two UPCs with a year of plans each, on every PO; the lists go to all tasks, as many as are allowed."""
    from fillwise.operators import reach

    monkeypatch.setattr(reach, "HOT_ENTRIES", entries)
    f = frame(spark, "vendor_sku string, upc string, forecast_month date, forecast_qty double",
              *[(f"P{u}", u, D(2024, m, 1), float(u)) for u in ("555", "556") for m in range(1, 13)])
    a = frame(spark, "po_number string, vendor_sku string, upc string, delivery_date string, ordered_qty double, confirmed_qty double",
              *[(f"PO{i}", None, u, "2024-02-02", 2.0, 1.0) for i in range(20) for u in ("555", "556")])
    found, hot = reach.reached_terms(f, a, None, (), None)
    assert found.filter("rows is not null").count() == {0: 40, 14: 20, 1000: 0}[entries] and hot.count() == {0: 0, 14: 1, 1000: 2}[entries]
    report = rca_by_po(f, a, as_of="2024-12-31", lookback_months=24).collect()
    assert {r["entity"]: r["total_forecast"] for r in report} == {f"PO{i}": 12.0 * (555 + 556) for i in range(20)}


def test_flat_lines_are_not_one_generated_method(spark):
    """All fields of a line in one generated method are too much for the JVM to compile."""
    texts = ['{"lines": [{"buyer_part_number": "", "buyerPartNumber": " B2 "}, {"buyer_part_number": "B1", "buyerPartNumber": "B2"}, {"upc": "U"}]}',
             '{"LineItem": [{"OrderLine": {"BuyerPartNumber": "N1"}}, {"OrderLine": {"BuyerPartNumber": "", "buyerPartNumber": " "}}]}']
    documents = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source_file string, document string")
    lines = flatten_documents(documents).select("source_file", "line_no", "buyer_part_number", "vendor_sku", "upc", "price", "delivery_dt")
    assert sorted(tuple(r)[:3] for r in lines.collect()) == [
        ("0", 1, "B2"), ("0", 2, "B1"), ("0", 3, None), ("1", 1, "N1"), ("1", 2, None)]
    plan = lines._jdf.queryExecution().executedPlan().toString().split("Generate")[0]
    assert any(step.lstrip(" +-:").startswith("Project") for step in plan.splitlines())  # steps of one method have a star
