"""PO shortages against the newest inventory snapshot."""

from pyspark.sql import DataFrame, functions as F

from ..functions.clean import blank_to_null, contains_text
from .supply import totals_by

# Reason texts of a shortage.
COVERED = "PO shortfall covered by available supply"
NO_SUPPLY = "No available supply"
NOT_ENOUGH = "Available supply does not cover the PO shortfall"


def shortage_coverage(acks: DataFrame, inventory: DataFrame, query: str | None = None) -> DataFrame:
    """Per SKU: the shortage of its totals, the supply that could cover it, and what stays open.

    The available quantity already contains what the supplier still has to deliver, so the latter is
    shown but not added. The aggregate and the join share one partitioning by SKU.
    """
    short, supply, uncovered = F.col("short_qty"), F.col("supply_available"), F.col("uncovered_short_qty")
    result = (
        totals_by(acks, "vendor_sku").join(inventory, "vendor_sku", "left")
        .withColumns({
            "short_qty": F.greatest(F.col("ordered_qty") - F.col("confirmed_qty"), F.lit(0.0)),
            "qty_available": F.coalesce("qty_available", F.lit(0.0)),
            "supplier_po_qty": F.coalesce("supplier_po_qty", F.lit(0.0))})
        .withColumn("supply_available", F.greatest("qty_available", F.lit(0.0)))
        .withColumn("uncovered_short_qty", F.greatest(short - supply, F.lit(0.0)))
        .withColumn("cut_reason", F.when((short > 0) & (supply <= 0), NO_SUPPLY)
                    .when((short > 0) & (uncovered > 0), NOT_ENOUGH).otherwise(COVERED))
    )
    if query and query.strip():
        fields = [c for c in ("vendor_sku", "inventory_description") if c in result.columns]
        found = [contains_text(F.col(c), query.strip()) for c in fields]
        result = result.filter(found[0] if len(found) == 1 else found[0] | found[1])
    return result


def cut_supply(acks: DataFrame, inventory: DataFrame, query: str | None = None) -> DataFrame:
    """`shortage_coverage`, the largest open shortage first."""
    return shortage_coverage(acks, inventory, query).orderBy(
        F.desc("uncovered_short_qty"), F.desc("short_qty"), "vendor_sku")


def inventory_risk(acks: DataFrame, inventory: DataFrame, top_n: int = 25) -> DataFrame:
    """SKUs with a shortage, the largest open one first."""
    return cut_supply(acks, inventory).filter(F.col("short_qty") > 0).limit(top_n)


def largest_line_shortages(acks: DataFrame, inventory: DataFrame, top_n: int = 25) -> DataFrame:
    """The lines with the largest shortage, with the coverage of their SKU.

    Coverage adds columns but never rows, so the top lines are taken first and only their SKUs (at most
    `top_n`) are covered.
    """
    tie_break = [c for c in ("po_number", "vendor_sku", "line_no", "ordered_qty", "confirmed_qty", "vendor", "price",
                             "delivery_date") if c in acks.columns]
    order = [F.desc("short_qty"), *tie_break]
    top = (
        acks.withColumns({
            "vendor_sku": blank_to_null(F.col("vendor_sku")),
            "short_qty": F.coalesce("ordered_qty", F.lit(0.0)) - F.coalesce("confirmed_qty", F.lit(0.0))})
        .orderBy(*order).limit(top_n)
    )
    wanted = F.broadcast(top.select("vendor_sku").distinct())
    lines = acks.select(blank_to_null(F.col("vendor_sku")).alias("vendor_sku"), "ordered_qty", "confirmed_qty")
    covered = shortage_coverage(lines.join(wanted, "vendor_sku", "left_semi"),
                                inventory.join(wanted, "vendor_sku", "left_semi"))
    columns = ["vendor_sku", "qty_available", "supplier_po_qty", "uncovered_short_qty", "cut_reason"]
    return top.join(F.broadcast(covered.select(columns)), "vendor_sku", "left").orderBy(*order)
