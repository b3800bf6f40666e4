"""Search over the three tables, with expansion of a PO to the forecasts of its products."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.clean import any_of, blank_to_null, contains_text
from ..session import held

# Searched columns per table, and the identifiers both tables share.
FORECAST_FIELDS = ["vendor_sku", "buyer_part_number", "upc", "description", "brand", "department"]
ACK_FIELDS = ["vendor_sku", "buyer_part_number", "upc", "po_number", "vendor", "customer"]
PRODUCT_IDS = ["vendor_sku", "buyer_part_number", "upc"]
EXACT_FIELDS = ["vendor_sku", "upc", "buyer_part_number", "product_id"]


def row_digest(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Two hashes of a row's values, maps included; equal for equal rows only, as far as 96 bits tell."""
    comparable = lambda f: F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f.name)
    values = [comparable(f) for f in df.schema if columns is None or f.name in columns]
    flags = [v.isNull() for v in values]  # hashes skip nulls
    return F.struct(F.xxhash64(*values, *flags).alias("a"), F.hash(*values[::-1], *flags).alias("b"))


def _mentions(df: DataFrame, fields: list[str], query: str) -> Column:
    return any_of([contains_text(F.col(c), query) for c in fields if c in df.columns])


def once_if(df: DataFrame, some: DataFrame) -> DataFrame:
    """One of each set of equal rows if `some` has any row, else all rows."""
    digest, any_row = row_digest(df), some.limit(1).agg((F.count("*") > 0).alias("any"))
    # By numbers, not by a struct: the sort then compares eight bytes at a time.
    copy = F.row_number().over(Window.partitionBy("_row_a", "_row_b").orderBy("_row_a"))
    numbered = df.withColumns({"_row_a": digest["a"], "_row_b": digest["b"]}).withColumn("_copy", copy)
    return numbered.filter((F.col("_copy") == 1) | ~any_row.scalar()).select(df.columns)


def identifiers(df: DataFrame, names: list[str]) -> DataFrame:
    """The distinct identifiers of the rows, as name and value; blank ones are none."""
    pair = lambda n: F.struct(F.lit(n).alias("name"), blank_to_null(F.col(n)).alias("value"))
    return df.select(F.inline(F.array(*map(pair, names)))).filter(F.col("value").isNotNull()).distinct()


def related_forecasts(forecasts: DataFrame, lines: DataFrame, direct: Column) -> DataFrame:
    """Forecast rows that satisfy `direct` or share an identifier with one of `lines`.

    The identifiers of the lines are gathered in one pass and one shuffle. If any forecast is reached
    through a line, one of each set of equal rows stays.
    """
    names = [n for n in PRODUCT_IDS if n in lines.columns and n in forecasts.columns]
    return forecasts_of_ids(forecasts, identifiers(lines, names), names, direct) if names else forecasts.filter(direct)


def forecasts_of_ids(forecasts: DataFrame, ids: DataFrame, names: list[str], direct: Column) -> DataFrame:
    """Forecast rows that satisfy `direct` or have one of the identifiers `ids` (name, value) in the columns `names`.

    The identifiers are joined to the distinct identifier sets of the forecasts; forecasts are never
    multiplied, and shuffled once: equal rows have equal identifiers, so copies meet where the sets are joined.
    Rows without identifiers are dealt by their digest. What is reached is stored and looked at before the rest
    is planned: if nothing is, copies stay and nothing is shuffled.
    """
    keys = [f"_{n}" for n in names]
    sets = [F.coalesce(F.trim(F.col(n).cast("string")), F.lit("")).alias(k) for n, k in zip(names, keys)]
    own = F.array(*[F.struct(F.lit(n).alias("name"), F.col(k).alias("value")) for n, k in zip(names, keys)])
    reached = (forecasts.select(*sets).distinct().withColumn("pair", F.explode(own)).select(*keys, "pair.*")
               .join(ids, ["name", "value"], "left_semi").select(*keys).distinct())
    reached = held(reached, "reached-sets")
    if reached.isEmpty():
        return forecasts.filter(direct)
    digest, columns = row_digest(forecasts), forecasts.columns
    rows = forecasts.select("*", *sets, F.coalesce(direct, F.lit(False)).alias("_direct"))
    named = reduce(lambda a, b: a | b, [F.col(k) != "" for k in keys])
    rows = rows.withColumn("_deal", F.when(named, F.lit(0).cast("long")).otherwise(digest["a"]))
    reached = reached.withColumns({"_deal": F.lit(0).cast("long"), "_reached": F.lit(True)})
    found = rows.join(reached.hint("shuffle_hash"), [*keys, "_deal"], "left").filter(F.col("_direct") | F.col("_reached")).drop("_direct", "_reached")
    if any(isinstance(f.dataType, T.MapType) for f in forecasts.schema):  # maps are no keys of groups
        return once_if(found.select(columns), reached)
    return found.dropDuplicates().select(columns)


def search_records(forecasts: DataFrame, acks: DataFrame, query: str | None, expand: bool = True) -> tuple[DataFrame, DataFrame]:
    """Records that mention `query` (a case-insensitive pattern) in any searched column.

    Forecasts of every product on a matching acknowledgement line belong to the result, all months of
    them; this is how a PO number finds forecasts.
    """
    text = (query or "").strip()
    if not text:
        return forecasts, acks
    ack_matches = acks.filter(_mentions(acks, ACK_FIELDS, text))
    direct = _mentions(forecasts, FORECAST_FIELDS, text)
    if not expand:
        return forecasts.filter(direct), ack_matches
    return related_forecasts(forecasts, ack_matches, direct), ack_matches


def search_inventory_snapshot(inventory: DataFrame, query: str | None) -> DataFrame:
    text = (query or "").strip()
    return inventory.filter(_mentions(inventory, ["vendor_sku", "inventory_description"], text)) if text else inventory


def product_records(forecasts: DataFrame, acks: DataFrame, *, product: str | None = None,
                    po_number: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Records of exactly one product identifier, of a PO with the forecasts of its products, or of both together.

    Equal lines all count, unless the PO has lines: then one of each set stays.
    """
    def named(df: DataFrame) -> Column:
        return F.lit(False) if product is None else any_of([F.col(c).cast("string") == str(product) for c in EXACT_FIELDS if c in df.columns])

    po = "" if po_number is None or "po_number" not in acks.columns else str(po_number).strip()
    if not po:
        return forecasts.filter(named(forecasts)), acks.filter(named(acks))
    on_po = F.trim(F.col("po_number").cast("string")) == po
    of_po = acks.filter(on_po)
    return related_forecasts(forecasts, of_po, named(forecasts)), once_if(acks.filter(named(acks) | on_po), of_po)
