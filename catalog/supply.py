"""Fill rates, shortages, coverage, and product classes."""

from pyspark.sql import functions as F

from fillwise.operators import coverage, ranking, risk, supply

from .views import AS_OF, acks, forecasts, inventory, rounded, sql

_RECENT = ["po_number", "vendor_sku", "vendor", "line_no", "ordered_qty", "confirmed_qty", "delivery_date"]

_BY_SKU = dict(by_sku="""select trim(vendor_sku) as vendor_sku, sum(ordered_qty) as o, sum(confirmed_qty) as c,
    sum(cast(ordered_cases * price as decimal(38,4))) as v from v_acks where trim(vendor_sku) <> '' group by 1""")
_BY_VENDOR = dict(by_vendor="""select vendor, sum(ordered_qty) as o, sum(confirmed_qty) as c, count(*) as n,
    case when sum(ordered_qty) > 0 then sum(confirmed_qty) / sum(ordered_qty) else 0 end as fill,
    coalesce(avg(cast(delivery_dt > cast(requested_date as date) as int)), 0) as late,
    avg(cast(confirmed_qty > 0 and confirmed_qty < ordered_qty as int)) as partial,
    count(delivery_dt) as dated, count(*) filter (delivery_dt > cast(requested_date as date)) as late_n
    from v_acks where vendor is not null group by vendor""")
_COVER = dict(_BY_SKU, cover0="""select s.vendor_sku, o, c, greatest(o - c, 0) as short_qty,
        coalesce(qty_available, 0) as qty_available, coalesce(supplier_po_qty, 0) as supplier_po_qty,
        inventory_description, greatest(coalesce(qty_available, 0), 0) as supply
        from by_sku s left join v_inventory i on s.vendor_sku = i.vendor_sku""",
    cover=f"""select *, greatest(short_qty - supply, 0) as uncovered, case
        when short_qty > 0 and supply <= 0 then '{coverage.NO_SUPPLY}'
        when short_qty > supply then '{coverage.NOT_ENOUGH}' else '{coverage.COVERED}' end as cut_reason from cover0""")
_COVER_COLUMNS = """vendor_sku, o as ordered_qty, c as confirmed_qty, qty_available, supplier_po_qty, inventory_description,
    short_qty, supply as supply_available, uncovered as uncovered_short_qty, cut_reason"""
_CV = dict(
    sm="""select trim(vendor_sku) as vendor_sku, date_trunc('month', delivery_dt) as month, sum(ordered_qty) as q,
        sum(confirmed_qty) as cq from v_acks where trim(vendor_sku) <> '' and delivery_dt is not null group by 1, 2""",
    cv="select vendor_sku, stddev_pop(q) as std, stddev_pop(q) / avg(q) as cv from sm group by 1")


def _approximate(spark, d):
    """Counts from sketches of each month, next to whether each is within 2 % of the exact one."""
    lines = acks(spark, d, with_order=True)
    rough = supply.approximate_summary(forecasts(spark, d), supply.party_sketches(lines))
    exact = supply.report_summary(forecasts(spark, d), lines)
    parties = supply.PARTIES.values()
    both = supply.one_row(rough.withColumnsRenamed({n: f"{n}_rough" for n in parties}), exact.select(*parties))
    near = lambda n: (F.abs(F.col(f"{n}_rough") - F.col(n)) <= 0.02 * F.col(n)).alias(f"{n}_near")
    return both.select("forecast_records", "ack_records", *map(near, parties))


QUERIES = {
    "vendor_fill_pct": lambda s, d: rounded(supply.vendor_fill_pct(acks(s, d)), fill_rate=8),
    "vendor_performance": lambda s, d: rounded(
        supply.vendor_performance(acks(s, d)), fill_rate=8, partial_acceptance=8, reliability_score=8),
    "fill_rate_histogram": lambda s, d: supply.fill_rate_histogram(acks(s, d)),
    "customer_behavior": lambda s, d: rounded(supply.customer_behavior(acks(s, d, with_order=True)), avg_order=8),
    "short_sku_count": lambda s, d: supply.short_sku_count(acks(s, d)),
    "po_summary": lambda s, d: supply.po_summary(acks(s, d)),
    "dataset_status": lambda s, d: supply.dataset_status(forecasts(s, d), acks(s, d)),
    "report_summary": lambda s, d: supply.report_summary(forecasts(s, d), acks(s, d, with_order=True)),
    "report_summary_approx": _approximate,
    "four_panels": lambda s, d: rounded(supply.panel_data(forecasts(s, d), acks(s, d)), value=4),
    "dashboard_kpis": lambda s, d: rounded(
        supply.dashboard_kpis(forecasts(s, d), acks(s, d)),
        forecast_value=3, fill_rate=8, vendor_reliability=8, mape=8, wmape=8),
    "top_risk_products": lambda s, d: rounded(
        ranking.top_risk_products(acks(s, d)), fill_rate=8, risk_score=8),
    "vendor_fill_top": lambda s, d: rounded(ranking.top_vendors(acks(s, d)), fill_rate=8),
    "recent_acks": lambda s, d: ranking.recent_acks(acks(s, d).select(_RECENT)),
    "cut_supply": lambda s, d: coverage.cut_supply(acks(s, d), inventory(s, d)),
    "cut_supply_search": lambda s, d: coverage.cut_supply(acks(s, d), inventory(s, d), "Gear"),
    "inventory_risk": lambda s, d: coverage.inventory_risk(acks(s, d), inventory(s, d)),
    "exceptions_top": lambda s, d: coverage.largest_line_shortages(acks(s, d).select(_RECENT), inventory(s, d)),
    "late_confirmations": lambda s, d: rounded(risk.late_confirmations(acks(s, d)), late_share=8),
    "repeated_partials": lambda s, d: risk.repeated_partials(acks(s, d)),
    "vendor_reliability": lambda s, d: rounded(
        risk.vendor_reliability(acks(s, d)), fill_rate=8, late_share=8, partial_share=8, reliability=6),
    "shortage_counts": lambda s, d: risk.shortage_counts(acks(s, d), as_of=AS_OF),
    "repeated_shortage": lambda s, d: risk.repeated_shortage(acks(s, d)),
    "abc_class": lambda s, d: rounded(risk.abc_class(acks(s, d)), value=2, cumulative_share=8),
    "xyz_class": lambda s, d: rounded(risk.xyz_class(acks(s, d)), cv=6),
    "supply_risk": lambda s, d: rounded(risk.supply_risk(acks(s, d)), vendor_fill=6, cv=6, supply_risk=6),
    "reorder_suggestion": lambda s, d: rounded(
        risk.reorder_suggestion(acks(s, d), inventory(s, d)), safety_stock=6, reorder_qty=6),
}

ORACLE = {
    "vendor_fill_pct": sql("select vendor, round(fill * 100, 8) as fill_rate, n as orders from by_vendor", **_BY_VENDOR),
    "vendor_performance": sql("""select vendor, o as ordered_qty, c as confirmed_qty, round(fill, 8) as fill_rate,
        0 as late_confirmations, round(fill, 8) as partial_acceptance, round(fill, 8) as reliability_score from by_vendor""", **_BY_VENDOR),
    "fill_rate_histogram": sql("""select cast(least(floor(case when o > 0 then c / o * 100 else 0 end / 5) * 5, 100) as int) as bin_start,
        count(*) as products from by_sku group by 1""", **_BY_SKU),
    "customer_behavior": sql("""select customer, round(avg(ordered_qty), 8) as avg_order, count(*) as order_count
        from v_acks where customer is not null group by customer"""),
    "short_sku_count": sql("select count(*) as short_skus from by_sku where o > c", **_BY_SKU),
    "po_summary": sql("""select count(distinct po_number) as total_pos, sum(ordered_qty) as ordered_qty,
        sum(confirmed_qty) as confirmed_qty, sum(greatest(ordered_qty - confirmed_qty, 0)) as backordered_qty from v_acks"""),
    "dataset_status": sql("select (select count(*) from v_forecasts) as forecasts, (select count(*) from v_acks) as acks"),
    "report_summary": sql("""select (select count(*) from v_forecasts) as forecast_records, count(*) as ack_records,
        count(distinct vendor) as vendors, count(distinct customer) as customers, count(distinct vendor_sku) as products from v_acks"""),
    "report_summary_approx": sql("""select (select count(*) from v_forecasts) as forecast_records, count(*) as ack_records,
        true as vendors_near, true as customers_near, true as products_near from v_acks"""),
    "four_panels": sql("""select 'forecast' as panel, cast(forecast_month as varchar) as key, round(sum(forecast_qty), 4) as value from v_forecasts group by 2
        union all select 'actual', cast(m as varchar), sum(c) from am where m is not null group by 2
        union all select 'demand', cast(m as varchar), sum(o) from am where m is not null group by 2
        union all select * from (select 'vendor_fill', vendor, round(fill * 100, 4) from by_vendor order by fill desc, vendor limit 10) v
        union all select 'fill_rate_histogram', cast(cast(least(floor(case when o > 0 then c / o * 100 else 0 end / 5) * 5, 100) as int) as varchar), count(*)
        from by_sku group by 2""", **_BY_SKU, **_BY_VENDOR,
        am="select cast(date_trunc('month', delivery_dt) as date) as m, ordered_qty as o, confirmed_qty as c from v_acks"),
    "dashboard_kpis": sql("""select (select round(sum(forecast_qty), 3) from v_forecasts) as forecast_value,
        sum(ordered_qty) as ordered_quantity, sum(confirmed_qty) as confirmed_quantity,
        round(sum(confirmed_qty) / sum(ordered_qty), 8) as fill_rate,
        count(*) filter (confirmed_qty > ordered_qty) as products_over_supplied, 0 as high_risk_products,
        (select count(*) from by_sku where o > c) as products_short,
        (select round(avg(fill), 8) from by_vendor) as vendor_reliability,
        (select count(*) from by_vendor where fill < 0.8) as high_risk_vendors,
        (select round(avg(abs(f - a) / f) filter (f > 0), 8) from fa) as mape,
        (select round(sum(abs(f - a)) / sum(f), 8) from fa) as wmape from v_acks""", **_BY_SKU, **_BY_VENDOR,
        mf="select forecast_month as month, sum(forecast_qty) as f from v_forecasts group by 1",
        ma="select cast(date_trunc('month', delivery_dt) as date) as month, sum(confirmed_qty) as a from v_acks group by 1",
        fa="select f, a from mf left join ma on mf.month = ma.month"),
    "top_risk_products": sql("""select vendor_sku, o as ordered_qty, c as confirmed_qty, o - c as backorder_qty,
        round(case when o > 0 then c / o else 0 end, 8) as fill_rate,
        round(greatest(1 - case when o > 0 then c / o else 0 end, 0), 8) as risk_score
        from by_sku order by greatest(1 - case when o > 0 then c / o else 0 end, 0) desc, o - c desc, vendor_sku limit 10""", **_BY_SKU),
    "vendor_fill_top": sql("""select vendor, o as ordered_qty, c as confirmed_qty, round(fill, 8) as fill_rate
        from by_vendor order by fill desc, vendor limit 15""", **_BY_VENDOR),
    "recent_acks": sql(f"""select {', '.join(_RECENT)} from v_acks order by delivery_date desc nulls last,
        {', '.join(c + ' nulls first' for c in _RECENT if c != 'delivery_date')} limit 30"""),
    "cut_supply": sql(f"select {_COVER_COLUMNS} from cover", **_COVER),
    "cut_supply_search": sql(f"select {_COVER_COLUMNS} from cover where vendor_sku ilike '%gear%' or inventory_description ilike '%gear%'", **_COVER),
    "inventory_risk": sql(f"""select {_COVER_COLUMNS} from cover where short_qty > 0
        order by uncovered desc, short_qty desc, vendor_sku limit 25""", **_COVER),
    "exceptions_top": sql(f"""select po_number, nullif(trim(a.vendor_sku), '') as vendor_sku, vendor, line_no, ordered_qty, confirmed_qty,
        delivery_date, ordered_qty - confirmed_qty as short_qty, qty_available, supplier_po_qty, uncovered as uncovered_short_qty, cut_reason
        from v_acks a left join cover on trim(a.vendor_sku) = cover.vendor_sku
        order by ordered_qty - confirmed_qty desc, po_number nulls first, nullif(trim(a.vendor_sku), '') nulls first, line_no, ordered_qty,
        confirmed_qty, vendor, delivery_date limit 25""", **_COVER),
    "late_confirmations": sql("""select vendor, dated as dated_lines, late_n as late_lines,
        round(late_n / dated, 8) as late_share from by_vendor""", **_BY_VENDOR),
    "repeated_partials": sql("""select vendor, trim(vendor_sku) as vendor_sku, count(*) as partial_lines from v_acks
        where trim(vendor_sku) <> '' and confirmed_qty > 0 and confirmed_qty < ordered_qty group by 1, 2 having count(*) >= 3"""),
    "vendor_reliability": sql("""select vendor, round(fill, 8) as fill_rate, round(late, 8) as late_share, round(partial, 8) as partial_share,
        round(100 * (0.7 * least(fill, 1) + 0.2 * (1 - late) + 0.1 * (1 - partial)), 6) as reliability from by_vendor""", **_BY_VENDOR),
    "shortage_counts": sql(f"""select trim(vendor_sku) as vendor_sku, count(*) filter (confirmed_qty < ordered_qty) as shortages,
        count(*) filter (confirmed_qty > ordered_qty) as oversupplies from v_acks
        where trim(vendor_sku) <> '' and delivery_dt >= date '{AS_OF}' - interval 12 month group by 1"""),
    "repeated_shortage": sql("""select vendor_sku, count(*) as short_months from sm where q > cq
        group by 1 having count(*) >= 3""", sm=_CV["sm"]),
    "abc_class": sql("""select vendor_sku, round(cast(v as double), 2) as value, round(share, 8) as cumulative_share,
        case when share <= 0.8 then 'A' when share <= 0.95 then 'B' else 'C' end as abc_class from (
        select *, cast(sum(v) over (order by v desc) as double) / cast(sum(v) over () as double) as share from by_sku) x""", **_BY_SKU),
    "xyz_class": sql("""select vendor_sku, round(cv, 6) as cv,
        case when cv <= 0.5 then 'X' when cv <= 1.0 then 'Y' else 'Z' end as xyz_class from cv""", **_CV),
    "supply_risk": sql("""select r.vendor_sku, round(r.fill, 6) as vendor_fill, round(cv, 6) as cv,
        round(0.5 * (1 - r.fill) + 0.5 * least(coalesce(cv, 0), 1), 6) as supply_risk
        from (select trim(vendor_sku) as vendor_sku, sum(ordered_qty * least(fill, 1)) / sum(ordered_qty) as fill
              from v_acks join by_vendor using (vendor) where trim(vendor_sku) <> '' group by 1) r
        left join cv on r.vendor_sku = cv.vendor_sku""", **_BY_VENDOR, **_CV),
    "reorder_suggestion": sql("""select cover.vendor_sku, uncovered as uncovered_short_qty, supply as supply_available,
        round(1.65 * coalesce(std, 0), 6) as safety_stock,
        round(greatest(uncovered + 1.65 * coalesce(std, 0) - greatest(supply - short_qty, 0), 0), 6) as reorder_qty
        from cover left join cv on cover.vendor_sku = cv.vendor_sku""", **_COVER, **_CV),
}
