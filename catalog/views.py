"""Supply-chain tables derived from the test tables.

Column expressions are written once, in SQL both engines understand: Spark evaluates them with
`selectExpr`, DuckDB as common table expressions in front of each check query.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from fillwise.functions.clean import day

AS_OF = "2001-11-01"

_ACK = {
    "po_number": "cast(l_orderkey as string)",
    "vendor_sku": "case when l_partkey % 97 = 5 then ' ' when l_partkey % 97 = 6 then null else cast(l_partkey as string) end",
    "buyer_part_number": "concat('B', cast(l_partkey % 500 as string))",
    "upc": "case when l_partkey % 3 = 0 then concat('U', cast(l_partkey % 800 as string)) end",
    "vendor": "cast(l_suppkey as string)",
    "line_no": "l_linenumber",
    "ordered_cases": "l_quantity",
    "confirmed_cases": """case when l_suppkey % 10 = 3 then cast(floor(l_quantity * cast(0.6 as double)) as double)
        when l_returnflag = 'R' then cast(floor(l_quantity * (1 - l_discount * 5)) as double)
        when l_returnflag = 'N' and l_linenumber = 1 then l_quantity + 1
        when l_returnflag = 'A' and l_partkey % 20 = 7 then l_quantity * 8
        else l_quantity end""",
    "pack_value": "cast(1 + l_partkey % 4 as double)",
    "price": "l_extendedprice",
    "delivery_date": """case when l_linenumber = 7 and l_linestatus = 'F' then 'n/a'
        else cast(cast(l_shipdate as date) as string) end""",
    "requested_date": "cast(cast(l_shipdate as date) + cast(l_linenumber % 3 - 1 as int) as string)",
}
_ACK_ORDER = {"customer": "cast(o_custkey as string)", "po_date": "cast(cast(o_orderdate as date) as string)"}
_UNITS = {"ordered_qty": "ordered_cases * pack_value", "confirmed_qty": "confirmed_cases * pack_value"}

_SNAPSHOT_QTY = """sum(l_quantity) * (1 + l_partkey % 4)
    * cast(case when l_partkey % 20 = 7 then 0.5 when snap = 1 then 0.9 else 1.1 end as double)"""
_INVENTORY = {
    "vendor_sku": "cast(p_partkey as string)", "qty_available": "cast(p_size * 10 - 100 as double)",
    "supplier_po_qty": "cast(p_size as double)", "inventory_description": "p_name",
}
_PRODUCTS = {
    "vendor_sku": "cast(p_partkey as string)", "buyer_part_number": "concat('B', cast(p_partkey % 500 as string))",
    "upc": "case when p_partkey % 3 = 0 then concat('U', cast(p_partkey % 800 as string)) end",
    "description": "p_name", "brand": "p_brand", "department": "p_type",
}


def _list(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} as {name}" for name, sql in columns.items())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def acks(spark: SparkSession, sf_dir: str, with_order: bool = False) -> DataFrame:
    """Acknowledgement lines; `with_order` adds customer and PO date at the price of a join."""
    lines, columns = table(spark, sf_dir, "lineitem"), dict(_ACK)
    if with_order:
        orders = table(spark, sf_dir, "orders")
        lines = lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left")
        columns |= _ACK_ORDER
    return (
        lines.selectExpr(*[f"{sql} as {name}" for name, sql in columns.items()])
        .selectExpr("*", *[f"{sql} as {name}" for name, sql in _UNITS.items()])
        .withColumn("delivery_dt", day(F.col("delivery_date")))
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of two snapshots; the later one covers a third of the products."""
    per_month = (
        table(spark, sf_dir, "lineitem").filter("l_partkey % 5 <> 0")
        .groupBy("l_partkey", F.trunc("l_shipdate", "MM").alias("forecast_month"))
        .agg(F.sum("l_quantity").alias("quantity"))
    )
    factor = F.when(F.col("l_partkey") % 20 == 7, 0.5).when(F.col("snapshot_no") == 1, 0.9).otherwise(1.1)
    numbers = F.when(F.col("l_partkey") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return per_month.withColumn("snapshot_no", F.explode(numbers)).select(
        F.col("l_partkey").cast("string").alias("vendor_sku"), "forecast_month", "snapshot_no",
        F.when(F.col("snapshot_no") == 1, F.lit("2001-06-01")).otherwise("2001-09-01").cast("date").alias("snapshot_at"),
        (F.col("quantity") * (1 + F.col("l_partkey") % 4) * factor).alias("forecast_qty"))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).groupBy("vendor_sku", "forecast_month").agg(
        F.max_by("forecast_qty", "snapshot_at").alias("forecast_qty"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter("p_partkey % 11 <> 4").selectExpr(
        *[f"{sql} as {name}" for name, sql in _INVENTORY.items()])


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[f"{sql} as {name}" for name, sql in _PRODUCTS.items()])


def described_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts with the product's other identifiers and attributes."""
    return forecasts(spark, sf_dir).join(products(spark, sf_dir), "vendor_sku", "left")


VIEWS = {
    "v_acks": f"""select *, {_list(_UNITS)}, try_cast(delivery_date as date) as delivery_dt
        from (select {_list(_ACK | _ACK_ORDER)} from lineitem left join orders on l_orderkey = o_orderkey) x""",
    "v_forecast_snapshots": f"""select cast(l_partkey as string) as vendor_sku,
        cast(date_trunc('month', l_shipdate) as date) as forecast_month, snap as snapshot_no,
        case when snap = 1 then date '2001-06-01' else date '2001-09-01' end as snapshot_at,
        {_SNAPSHOT_QTY} as forecast_qty
        from lineitem cross join (values (1), (2)) as s(snap)
        where l_partkey % 5 <> 0 and (snap = 1 or l_partkey % 3 = 0)
        group by l_partkey, cast(date_trunc('month', l_shipdate) as date), snap""",
    "v_forecasts": """select vendor_sku, forecast_month, max_by(forecast_qty, snapshot_at) as forecast_qty
        from v_forecast_snapshots group by vendor_sku, forecast_month""",
    "v_inventory": f"select {_list(_INVENTORY)} from part where p_partkey % 11 <> 4",
    "v_products": f"select {_list(_PRODUCTS)} from part",
    "v_described": """select f.*, buyer_part_number, upc, description, brand, department
        from v_forecasts f left join v_products p on f.vendor_sku = p.vendor_sku""",
}
_NEEDS = {"v_forecasts": ["v_forecast_snapshots"], "v_described": ["v_forecasts", "v_products"]}


def sql(body: str, **ctes: str) -> str:
    """`body` (and further named CTEs) behind the views it mentions."""
    text = " ".join([*ctes.values(), body])
    wanted: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in wanted:
            wanted.append(name)

    for name in VIEWS:
        if name in text:
            need(name)
    parts = [f"{name} as ({VIEWS[name]})" for name in wanted] + [f"{name} as ({query})" for name, query in ctes.items()]
    return f"with {', '.join(parts)} {body}" if parts else body


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round columns so that a different order of additions does not show."""
    return df.withColumns({name: F.round(name, n) for name, n in digits.items()})
