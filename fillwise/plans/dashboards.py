"""The data behind each dashboard page, as lazy DataFrames by panel."""

from pyspark.sql import DataFrame

from ..operators import accuracy, coverage, monthly, ranking, supply
from .workspace import Workspace


def overview(ws: Workspace) -> dict[str, DataFrame]:
    return {"kpis": ws.kpis(), "forecast_vs_actual": ws.forecast_vs_actual(), "top_risk_products": ws.top_risk_products(10)}


def four_panels(ws: Workspace) -> dict[str, DataFrame]:
    return {
        "forecast": ws.forecast_summary(),
        "actual": monthly.ack_by_month(ws.acks, "confirmed_qty", "actual_qty").orderBy("month"),
        "vendor_fill": supply.vendor_fill_pct(ws.acks).limit(10),
        "demand": monthly.demand_by_month(ws.acks),
        "fill_rate_histogram": supply.fill_rate_histogram(ws.acks)}


def forecast_page(ws: Workspace) -> dict[str, DataFrame]:
    panels = {"trend": ws.forecast_summary(), "top_products": ranking.top_forecast_products(ws.forecasts)}
    if "brand" in ws.forecasts.columns:
        panels["brands"] = monthly.brand_forecast(ws.forecasts).limit(12)
    return panels


def acknowledgement_page(ws: Workspace) -> dict[str, DataFrame]:
    return {"summary": supply.po_summary(ws.acks), "vendor_fill": ranking.top_vendors(ws.acks),
            "recent": ranking.recent_acks(ws.acks)}


def accuracy_page(ws: Workspace) -> dict[str, DataFrame]:
    return {"errors": ws.forecast_errors(), "gauge": accuracy.accuracy_gauge(ws.forecasts, ws.acks)}


def inventory_risk_page(ws: Workspace) -> dict[str, DataFrame]:
    return {"uncovered": coverage.inventory_risk(ws.acks, ws.inventory)}


def exception_page(ws: Workspace) -> dict[str, DataFrame]:
    return {"largest_shortages": coverage.largest_line_shortages(ws.acks, ws.inventory)}


def vendor_page(ws: Workspace) -> dict[str, DataFrame]:
    return {"vendors": ws.vendor_performance(), "customers": supply.customer_behavior(ws.acks)}


def cut_page(ws: Workspace, query: str, **options) -> dict[str, DataFrame]:
    found = ws.investigate(query, **options)
    return {**found, "inventory": ws.search_inventory(query), "coverage": ws.cut_supply_of_search(query)}
