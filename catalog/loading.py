"""Readers: documents and sheets are written from the test tables and read back."""

import tempfile
import uuid

from pyspark.sql import functions as F

from fillwise.functions.months import fiscal_month, month_label
from fillwise.session import held, shared_folder
from fillwise.sources import acks as ack_source, forecasts as sheets, inventory as stock, sinks
from fillwise.streaming import ingest
from fillwise.streaming.forecast_table import ForecastTable

from .views import forecasts, rounded, snapshots, sql, table

_ACK = ["source_file", "line_no", "po_number", "vendor", "vendor_sku", "buyer_part_number", "upc", "ordered_cases",
        "confirmed_cases", "pack_value", "ordered_qty", "confirmed_qty", "price", "status_code", "delivery_dt",
        "po_date", "requested_dt"]

#: A packed file is read by one task.
DOCUMENTS_A_FILE = 100_000


def scratch(spark, name: str) -> str:
    """A new folder below the shared folder, which all tasks can reach; a session without one gets its own."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-shared-"))
    return f"{shared_folder(spark, 'runs')}/{name}-{uuid.uuid4().hex}"


# --- documents -----------------------------------------------------------------

def _documents(spark, d):
    """One nested document per line item, with one to three lines of increasing quantity.

    Numbers come as numbers and as text; packs are sometimes missing or useless; some documents lack a
    PO number, some are cut off.
    """
    li = table(spark, d, "lineitem")
    key, part = F.col("l_orderkey"), F.col("l_partkey")
    pack = F.when(part % 7 == 0, "-1").when(part % 7 == 1, F.lit(None)).when(part % 7 == 2, "x").otherwise(
        (1 + part % 4).cast("string"))

    def line(i):
        quantity = F.col("l_quantity") + i
        return F.struct(
            F.struct(F.when(part % 97 == 5, " ").otherwise(part.cast("string")).alias("VendorPartNumber"),
                     F.concat(F.lit("000"), part.cast("string")).alias("BuyerPartNumber"),
                     quantity.alias("OrderQty"), F.col("l_extendedprice").cast("string").alias("PurchasePrice"),
                     F.lit(None).cast("string").alias("GTIN")).alias("OrderLine"),
            F.array(F.struct(F.when(F.col("l_returnflag") == "R", "IR").otherwise("IA").alias("ItemStatusCode"),
                             F.floor(quantity * 0.5).cast("string").alias("ItemScheduleQty"),
                             F.col("l_shipdate").cast("date").cast("string").alias("ItemScheduleDate"))
                    ).alias("LineItemAcknowledgement"),
            F.when(pack.isNotNull(), F.array(F.struct(pack.alias("PackValue")))).alias("PhysicalDetails"),
            F.array(*[F.struct(F.lit(q).alias("DateTimeQualifier"), F.date_add(F.col("l_shipdate").cast("date"), n)
                               .cast("string").alias("Date")) for q, n in (("017", 3), ("002", 2))]).alias("Dates"))

    document = F.to_json(F.struct(
        F.struct(F.struct(
            F.col("l_suppkey").cast("string").alias("Vendor"),
            F.when(key % 11 != 0, key.cast("string")).alias("PurchaseOrderNumber"),
            F.lit("2026-05-11").alias("PurchaseOrderDate")).alias("OrderHeader")).alias("Header"),
        F.transform(F.sequence(F.lit(0), F.col("l_linenumber") % 3), line).alias("LineItem")))
    cut_off = (key % 13 == 0) & (F.col("l_linenumber") == 7)
    return li.select(
        F.concat_ws("-", key, "l_linenumber", part).alias("source_file"),
        F.when(cut_off, F.substring(document, 1, 40)).otherwise(document).alias("document"))


def _flat_documents(spark, d):
    """The same line items in the flat layout, with field names that vary from document to document."""
    li = table(spark, d, "lineitem")
    part = F.col("l_partkey")
    named = lambda *options: F.element_at(F.array(*map(F.lit, options)), ((part % len(options)) + 1).cast("int"))
    line = F.map_from_arrays(
        F.array(named("vendor_sku", "vendorSku", "seller_item_id"), named("buyer_part_number", "buyerPartNumber"),
                named("upc", "gtin"), named("ordered_quantity", "orderedQty", "ordered"),
                named("confirmed_quantity", "confirmedQty", "confirmed"), F.lit("price"), named("status_code", "status"),
                F.lit("delivery_date")),
        F.array(part.cast("string"), F.concat(F.lit("B"), part.cast("string")), F.concat(F.lit("U"), part.cast("string")),
                F.col("l_quantity").cast("string"), F.floor(F.col("l_quantity") / 2).cast("string"),
                F.when(part % 10 == 0, "on request").otherwise(F.col("l_extendedprice").cast("string")),
                F.col("l_returnflag"), F.col("l_shipdate").cast("date").cast("string")))
    document = F.struct(
        F.struct(F.col("l_suppkey").cast("string").alias("vendor"), F.col("l_orderkey").cast("string").alias("po_number"),
                 F.lit("2026-07-01").alias("po_date")).alias("header"),
        F.array(line).alias("lines"))
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", part).alias("source_file"),
                     F.to_json(document).alias("document"))


def _flatten(spark, d):
    return ack_source.valid_lines(ack_source.flatten_documents(_documents(spark, d))).select(_ACK)


def _rejects(spark, d):
    return ack_source.rejected_lines(ack_source.flatten_documents(_documents(spark, d))).select(
        "source_file", "line_no", "vendor", "vendor_sku", "reject_reason")


def _flat(spark, d):
    flat = [c for c in _ACK if c not in ("requested_dt", "pack_value", "ordered_cases", "confirmed_cases")]
    return ack_source.valid_lines(ack_source.flatten_documents(_flat_documents(spark, d))).select(flat)


def _streamed(spark, d):
    """Documents written to packed files of DOCUMENTS_A_FILE, read by the stream into a table, and read again (nothing is added)."""
    root = scratch(spark, "acks")
    _documents(spark, d).select("document").write.option("maxRecordsPerFile", DOCUMENTS_A_FILE).text(f"{root}/in", compression="gzip")
    for _ in range(2):
        ingest.ingest_acks(spark, f"{root}/in", f"{root}/table", f"{root}/checkpoint", json_lines=True, pattern="*.txt.gz").awaitTermination()
    return spark.read.parquet(f"{root}/table").groupBy("po_number", "vendor").agg(
        F.count("*").alias("lines"), F.sum("ordered_qty").alias("ordered_qty"), F.sum("confirmed_qty").alias("confirmed_qty"))


# --- sheets --------------------------------------------------------------------

def _months(spark, d):
    bounds = snapshots(spark, d).agg(F.min("forecast_month").alias("lo"), F.max("forecast_month").alias("hi"))
    return bounds.select(F.sequence("lo", "hi", F.expr("interval 1 month")).alias("months"))


def _sheet_lines(spark, d):
    """Lines of CSV sheets, one sheet per snapshot and price group: titles, fiscal periods, header, products, total.

    Every product row has one cell per month of the whole range, empty where there is no forecast.
    """
    months = _months(spark, d)
    group = F.col("vendor_sku").cast("bigint") % 6
    file = F.concat(F.lit("plans/group "), group.cast("string"), F.lit(" "), F.col("snapshot_at").cast("string"), F.lit(".csv"))
    per_product = (
        snapshots(spark, d).groupBy("vendor_sku", "snapshot_at")
        .agg(F.map_from_entries(F.collect_list(F.struct("forecast_month", "forecast_qty"))).alias("qty"))  # months of one product
        .withColumns({"source_file": file, "months": months.scalar()})
    )
    cells = F.array_join(F.transform("months", lambda m: F.coalesce(F.try_element_at("qty", m).cast("string"), F.lit(""))), ",")
    body = per_product.select(
        "source_file", (F.col("vendor_sku").cast("bigint") + 100).alias("seq"),
        F.concat(F.col("vendor_sku"), F.lit(',"Item ""'), F.col("vendor_sku"), F.lit('"", boxed",'), cells).alias("line"))
    files = per_product.select("source_file", group.alias("g"), "months").distinct()
    fiscal = lambda m: F.concat(
        (F.year(m) - F.when(F.month(m) == 1, 1).otherwise(0)).cast("string"), F.lit(" P"),
        F.lpad(((F.month(m) + 10) % 12 + 1).cast("string"), 2, "0"))
    head = F.concat(
        F.transform(F.sequence(F.lit(1), F.col("g").cast("int") + 1), lambda i: F.struct(
            i.cast("bigint").alias("seq"), F.when(i % 2 == 0, "  ").otherwise("Plan of the season").alias("line"))),
        F.array(
            F.struct(F.lit(20).cast("bigint").alias("seq"), F.concat(F.lit(",,"), F.array_join(F.transform("months", fiscal), ",")).alias("line")),
            F.struct(F.lit(21).cast("bigint").alias("seq"), F.concat(
                F.lit("Brand Partner SKU#,Ulta Item Description,"),
                F.array_join(F.transform("months", lambda m: F.date_format(m, "MMMM")), ",")).alias("line")),
            F.struct(F.lit(1 << 40).alias("seq"), F.concat(F.lit(",Overall Result,"), F.array_join(
                F.transform("months", lambda m: F.lit("999")), ",")).alias("line"))))
    heads = files.select("source_file", F.explode(head).alias("h")).select("source_file", "h.*")
    lines = body.unionByName(heads).select(
        "source_file", F.lit(0).cast("bigint").alias("block"), "seq", F.current_timestamp().alias("modified_at"), "line")
    return held(lines, "sheet-lines")  # they are read several times


def _sheet_facts(spark, d):
    return rounded(sheets.parse_sheets(_sheet_lines(spark, d)).select(
        "source_file", F.col("snapshot_at").cast("date").alias("snapshot_at"), "vendor_sku", "description",
        "forecast_month", "month_label", "forecast_qty"), forecast_qty=4)


def _write_sheets(lines, folder):
    """One file per sheet, in a folder named after it."""
    file = F.regexp_extract("source_file", r"^plans/(.*)\.csv$", 1)
    # A value with a line break would be quoted, so each line of a cell is a row of its own; sorted rows are streamed to their file.
    rows = lines.select(file.alias("sheet"), "seq", F.posexplode(F.split("line", "\n")).alias("part", "text")).repartition("sheet")
    rows.sortWithinPartitions("sheet", "seq", "part").select("sheet", "text").write.partitionBy("sheet").format("csv").option("quote", "").option(
        "sep", "\x01").option("lineSep", "\n").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).save(folder)


def _read_sheets(spark, d):
    """The sheets written to files, every seventh description with a line break, and read by the file reader."""
    folder = scratch(spark, "sheets")
    _write_sheets(_sheet_lines(spark, d).withColumn("line", F.when(
        (F.col("seq") > 100) & (F.col("seq") % 7 == 0), F.replace("line", F.lit(", boxed"), F.lit(",\n boxed"))).otherwise(F.col("line"))), folder)
    read = sheets.parse_sheets(sheets.read_sheet_lines(spark, folder))
    sheet = F.regexp_extract("source_file", r"sheet=([^/]*)/", 1)
    return rounded(read.select(sheet.alias("sheet"), "vendor_sku", "description", "forecast_month", "forecast_qty"), forecast_qty=4)


#: Descriptions with quotes of all kinds, by product: as written in a sheet, and as text.
_QUOTED = (
    ("'Item ' || vendor_sku || '\" steel'", "'Item ' || vendor_sku || '\" steel'"),
    ("'\"Item \"\"' || vendor_sku || '\"\", boxed\"'", "'Item \"' || vendor_sku || '\", boxed'"),
    ("'\"Item' || chr(10) || vendor_sku || ',' || chr(10) || '\"\"x\"\"\"'", "'Item' || chr(10) || vendor_sku || ',' || chr(10) || '\"x\"'"),
    ("'pipe ' || vendor_sku || '\"\" wide \"'", "'pipe ' || vendor_sku || '\"\" wide \"'"),
    ("'\"Item\" no \"' || vendor_sku", "'Item no \"' || vendor_sku"),
)


def _read_quoted(spark, d):
    """Sheets whose descriptions hold inch marks, quoted commas and line breaks, read by the file reader at two split sizes."""
    lines = _sheet_lines(spark, d).withColumn("vendor_sku", F.regexp_extract("line", r"^(\d+),", 1))
    kind = F.col("vendor_sku").cast("bigint") % len(_QUOTED)
    written = F.coalesce(*[F.when(kind == i, F.expr(cell)) for i, (cell, _) in enumerate(_QUOTED)])
    months = F.regexp_extract("line", r'^\d+,"(?:[^"]|"")*"(.*)$', 1)
    lines = lines.withColumn("line", F.when(F.col("seq").between(100, 1 << 39), F.concat("vendor_sku", F.lit(","), written, months)).otherwise(F.col("line")))
    folder = scratch(spark, "quoted")
    _write_sheets(lines.drop("vendor_sku"), folder)
    before, results = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for split in ("100k", "64m"):  # planned and stored here, as the setting holds while files are cut
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            read = sheets.parse_sheets(sheets.read_sheet_lines(spark, folder))
            sheet = F.regexp_extract("source_file", r"sheet=([^/]*)/", 1)
            target = scratch(spark, "quoted-rows")
            rounded(read.select(F.lit(split).alias("split"), sheet.alias("sheet"), "vendor_sku", "description", "forecast_month", "forecast_qty"),
                    forecast_qty=4).write.parquet(target)
            results.append(target)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return spark.read.parquet(*results)


def _place_sheets(spark, lines, folder):
    """The sheets as files of their own names, in one folder; a file that is there is replaced."""
    written = scratch(spark, "written")
    _write_sheets(lines, written)
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(written)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(hadoop.Path(folder))
    for sheet in store.listStatus(root):  # one folder a sheet
        name = sheet.getPath().getName()
        if name.startswith("sheet="):
            target = hadoop.Path(f"{folder}/{name[len('sheet='):]}.csv")
            store.delete(target, False)
            (part,) = [f.getPath() for f in store.listStatus(sheet.getPath()) if f.getPath().getName().startswith("part-")]
            store.rename(part, target)


def _streamed_forecasts(spark, d):
    """Later sheets streamed first, older ones after them, then one sheet rewritten without every second of its products."""
    root, lines = scratch(spark, "plans"), _sheet_lines(spark, d)
    later = F.col("source_file").endswith(" 2001-09-01.csv")
    run = lambda: ingest.ingest_forecasts(spark, f"{root}/in", f"{root}/table", f"{root}/checkpoint").awaitTermination()
    for some in (later, ~later):
        _place_sheets(spark, lines.filter(some), f"{root}/in")
        run()
    rewritten = lines.filter(F.col("source_file") == "plans/group 0 2001-09-01.csv")
    product = F.regexp_extract("line", r"^(\d+),", 1).try_cast("bigint")
    _place_sheets(spark, rewritten.filter(F.coalesce(F.floor(product / 6) % 2 == 0, F.lit(True))), f"{root}/in")
    forecasts_table = ForecastTable(spark, f"{root}/table")
    forecasts_table.load(f"{root}/in")
    return rounded(forecasts_table.current().select(
        "vendor_sku", "forecast_month", F.col("snapshot_at").cast("date").alias("snapshot_at"), "forecast_qty"), forecast_qty=4)


def _exported(spark, d):
    """A result written as CSV with a header, and read back."""
    folder = scratch(spark, "export")
    sinks.write_csv(forecasts(spark, d).withColumn("note", F.concat(F.lit('a, "'), F.col("vendor_sku"), F.lit('"'))), folder)
    schema = "vendor_sku string, forecast_month date, forecast_qty double, note string"
    return rounded(spark.read.schema(schema).option("header", True).option("escape", "\\").csv(folder), forecast_qty=4)


def _header_rows(spark, d):
    return sheets.sheet_layouts(_sheet_lines(spark, d)).select(
        "source_file", "header_row", F.size("months").alias("month_columns"), "has_totals",
        F.get("months.month", F.lit(0)).alias("first_month"))


def _sheet_totals(spark, d):
    return rounded(sheets.parse_sheets(_sheet_lines(spark, d)).groupBy("source_file").agg(
        F.count("*").alias("cells"), F.sum("forecast_qty").alias("forecast_qty")), forecast_qty=3)


def _labels(spark, d):
    """Every forecast month written in one of fourteen ways, and read again."""
    f = forecasts(spark, d)
    m, way = F.col("forecast_month"), F.col("vendor_sku").cast("bigint") % 14
    label = (
        F.when(way == 0, F.date_format(m, "MMM yyyy")).when(way == 1, F.date_format(m, "MMMM-yyyy"))
        .when(way == 2, F.concat(F.lit("Forecast "), F.date_format(m, "MMM yyyy"))).when(way == 3, F.date_format(m, "yyyy-MM"))
        .when(way == 4, F.date_format(m, "yyyy/MM")).when(way == 5, F.date_format(m, "MM/yyyy"))
        .when(way == 6, F.concat(F.lit("total "), F.year(m).cast("string"))).when(way == 7, F.date_format(m, "yyyy-MM-dd"))
        .when(way == 8, F.date_format(m, "d-MMM-yyyy")).when(way == 9, F.concat(F.lit("15-"), F.date_format(m, "MMM-yyyy")))
        .when(way == 10, F.date_format(m, "M/d/yyyy")).when(way == 11, F.date_format(m, "MMMM d, yyyy"))
        .when(way == 12, F.date_format(m, "yyyy MMMM")).otherwise(F.concat(F.date_format(m, "MMM yyyy"), F.lit(" forecast"))))
    return f.select("vendor_sku", "forecast_month", month_label(label).alias("parsed_month"))


def _fiscal(spark, d):
    m = F.col("forecast_month")
    period = F.concat((F.year(m) - F.when(F.month(m) == 1, 1).otherwise(0)).cast("string"), F.lit(" P"),
                      ((F.month(m) + 10) % 12 + 1).cast("string"))
    return forecasts(spark, d).select("vendor_sku", "forecast_month", fiscal_month(F.date_format(m, "MMMM"), period).alias("parsed_month"))


def _melted(spark, d):
    """A frame with one named column per calendar month, melted back."""
    months = [r["m"] for r in _months(spark, d).select(F.explode("months").alias("m")).collect()]
    labels = [m.strftime("%b %Y") for m in months]
    wide = (
        snapshots(spark, d).filter("snapshot_no = 1").repartition("vendor_sku")  # a task has the wide rows of its products only
        .groupBy("vendor_sku").pivot("forecast_month", months).agg(F.max("forecast_qty")).toDF("vendor_sku", *labels)
        .withColumn("note", F.lit("x"))
    )
    return rounded(sheets.melt_months(wide, ["vendor_sku", "note"]).drop("note"), forecast_qty=4)


def _aligned(spark, d):
    """Three frames with different columns and types for the same column."""
    part = table(spark, d, "part")
    return sheets.union_align(
        part.select(F.col("p_partkey").alias("item"), F.col("p_size").alias("quantity"), F.col("p_name").alias("description")),
        part.select(F.col("p_partkey").cast("string").alias("item"), F.col("p_retailprice").alias("quantity"), F.lit(True).alias("listed")),
        part.select(F.concat(F.lit("X"), F.col("p_partkey").cast("string")).alias("item"), F.col("p_size").alias("rank")))


def _latest(spark, d):
    """Snapshots together with rows that have no SKU, which must all stay."""
    rows = snapshots(spark, d).drop("snapshot_no")
    blank = table(spark, d, "lineitem").filter("l_partkey % 5 = 0").select(
        F.when(F.col("l_partkey") % 2 == 0, " ").alias("vendor_sku"), F.trunc("l_shipdate", "MM").alias("forecast_month"),
        F.lit("2001-06-01").cast("date").alias("snapshot_at"), F.col("l_quantity").alias("forecast_qty"))
    return rounded(sheets.newest_per_month(rows.unionByName(blank)), forecast_qty=4)


def _named_snapshots(spark, d):
    o = table(spark, d, "orders")
    day = F.col("o_orderdate").cast("date").cast("string")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("plan v2 "), day, F.lit(".xlsx"))).when(
        F.col("o_orderkey") % 3 == 1, F.concat(F.lit("plan "), day, F.lit(" final.csv"))).otherwise(F.concat(day, F.lit(".csv")))
    return o.select("o_orderkey", sheets.snapshot_time(name, F.lit("2026-01-02 03:04:05").cast("timestamp"))
                    .cast("date").alias("snapshot_at"))


# --- inventory -----------------------------------------------------------------

def _export(spark, d):
    """Three inventory exports: an old one, the newest one, and one without a date in its name."""
    p = table(spark, d, "part")
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    return p.select(
        F.explode(F.array(*map(F.lit, ["Stock 14July2026.csv", "Stock 15Jul2026.csv", "stock.csv"]))).alias("file_name"),
        F.lit("2026-07-01 10:00:00").cast("timestamp").alias("modified_at"),
        F.when(key % 50 == 0, " ").otherwise(F.concat(F.lit(" "), (key % 1500).cast("string"))).alias(stock.SKU),
        F.when(key % 5 == 0, F.concat(F.lit("1,"), F.lpad(size, 3, "0"), F.lit(" EA"))).when(key % 5 == 1, F.concat(F.lit("-"), size))
        .when(key % 5 == 2, F.concat(F.lit("("), size, F.lit(")"))).when(key % 5 == 3, "n/a").otherwise(size).alias(stock.AVAILABLE),
        size.alias(stock.SUPPLIER_PO), F.col("p_name").alias(stock.DESCRIPTION), "p_partkey")


def _inventory_clean(spark, d):
    raw = _export(spark, d)
    return stock.clean_rows(raw).select(
        "vendor_sku", "qty_available", "supplier_po_qty", "inventory_snapshot_date", "inventory_source_file")


QUERIES = {
    "ack_flatten": _flatten,
    "ack_rejects": _rejects,
    "ack_flat_variants": _flat,
    "forecast_sheet_long": _sheet_facts,
    "forecast_read_files": _read_sheets,
    "forecast_read_quotes": _read_quoted,
    "forecast_header_row": _header_rows,
    "forecast_drop_totals": _sheet_totals,
    "fiscal_month": _fiscal,
    "month_label_parse": _labels,
    "forecast_unpivot": _melted,
    "union_align": _aligned,
    "forecast_latest_snapshot": _latest,
    "snapshot_from_name": _named_snapshots,
    "inventory_clean": _inventory_clean,
    "inventory_latest": lambda s, d: stock.latest_snapshot(stock.clean_rows(_export(s, d))),
    "stream_ingest_acks": _streamed,
    "stream_ingest_forecasts": _streamed_forecasts,
    "export_csv": _exported,
}

# --- the same in SQL -------------------------------------------------------------

_DOC = dict(
    li="select *, l_orderkey || '-' || l_linenumber || '-' || l_partkey as source_file, l_orderkey % 13 = 0 and l_linenumber = 7 as cut_off from lineitem",
    doc_lines="""select source_file, cast(i + 1 as int) as line_no, case when l_orderkey % 11 <> 0 then cast(l_orderkey as varchar) end as po_number,
        cast(l_suppkey as varchar) as vendor, case when l_partkey % 97 <> 5 then cast(l_partkey as varchar) end as vendor_sku,
        '000' || l_partkey as buyer_part_number, cast(null as varchar) as upc, l_quantity + i as ordered_cases,
        floor((l_quantity + i) * 0.5::double) as confirmed_cases,
        cast(case when l_partkey % 7 < 3 then 1 else 1 + l_partkey % 4 end as double) as pack_value,
        l_extendedprice as price, case when l_returnflag = 'R' then 'IR' else 'IA' end as status_code,
        cast(l_shipdate as date) as delivery_dt, date '2026-05-11' as po_date, cast(l_shipdate as date) + 2 as requested_dt,
        from li, unnest(range(l_linenumber % 3 + 1)) as t(i) where not cut_off""")
_DOC_COLUMNS = ", ".join("ordered_cases * pack_value as ordered_qty" if c == "ordered_qty" else
                         "confirmed_cases * pack_value as confirmed_qty" if c == "confirmed_qty" else c for c in _ACK)
_SHEET = dict(
    grid="""select s.vendor_sku, s.snapshot_at, 'plans/group ' || (cast(s.vendor_sku as bigint) % 6) || ' ' || s.snapshot_at || '.csv' as source_file,
        cast(m as date) as forecast_month from (select distinct vendor_sku, snapshot_at from v_forecast_snapshots) s,
        (select unnest(generate_series(min(forecast_month), max(forecast_month), interval 1 month)) as m from v_forecast_snapshots) x""",
    facts="""select g.*, 'Item "' || g.vendor_sku || '", boxed' as description,
        lower(strftime(g.forecast_month, '%B %Y')) as month_label, coalesce(forecast_qty, 0) as q
        from grid g left join v_forecast_snapshots s on g.vendor_sku = s.vendor_sku and g.snapshot_at = s.snapshot_at
        and g.forecast_month = s.forecast_month""")
_NUM = "coalesce(try_cast(regexp_replace({}, '[^0-9.\\-]', '', 'g') as double), 0)"
_EXPORT = dict(
    raw="""select p_partkey, file_name, case when p_partkey % 50 <> 0 then cast(p_partkey % 1500 as varchar) end as vendor_sku,
        case p_partkey % 5 when 0 then '1,' || lpad(cast(p_size as varchar), 3, '0') || ' EA' when 1 then '-' || p_size
          when 2 then '(' || p_size || ')' when 3 then 'n/a' else cast(p_size as varchar) end as a, p_size, p_name
        from part, (values ('Stock 14July2026.csv'), ('Stock 15Jul2026.csv'), ('stock.csv')) f(file_name)""",
    rows=f"""select vendor_sku, {_NUM.format('a')} as qty_available, cast(p_size as double) as supplier_po_qty,
        case file_name when 'Stock 14July2026.csv' then date '2026-07-14' when 'Stock 15Jul2026.csv' then date '2026-07-15'
        else date '2026-07-01' end as inventory_snapshot_date, file_name as inventory_source_file, p_name from raw""")

ORACLE = {
    "ack_flatten": sql(f"select {_DOC_COLUMNS} from doc_lines where po_number is not null", **_DOC),
    "ack_rejects": sql("""select source_file, line_no, vendor, vendor_sku, 'no po number' as reject_reason from doc_lines where po_number is null
        union all select source_file, null, null, null, 'unreadable document' from li where cut_off""", **_DOC),
    "ack_flat_variants": sql("""select l_orderkey || '-' || l_linenumber || '-' || l_partkey as source_file, 1 as line_no,
        cast(l_orderkey as varchar) as po_number, cast(l_suppkey as varchar) as vendor, cast(l_partkey as varchar) as vendor_sku,
        'B' || l_partkey as buyer_part_number, 'U' || l_partkey as upc, l_quantity as ordered_qty, floor(l_quantity / 2) as confirmed_qty,
        case when l_partkey % 10 <> 0 then l_extendedprice end as price, l_returnflag as status_code, cast(l_shipdate as date) as delivery_dt,
        date '2026-07-01' as po_date from lineitem"""),
    "forecast_sheet_long": sql("""select source_file, snapshot_at, vendor_sku, description, forecast_month, month_label,
        round(q, 4) as forecast_qty from facts""", **_SHEET),
    "forecast_read_files": sql("""select source_file[7:-5] as sheet, vendor_sku, case when (cast(vendor_sku as bigint) + 100) % 7 = 0
        then replace(description, ', boxed', ',' || chr(10) || ' boxed') else description end as description, forecast_month, round(q, 4) as forecast_qty
        from facts""", **_SHEET),
    "forecast_read_quotes": sql(f"""select split, source_file[7:-5] as sheet, vendor_sku,
        case cast(vendor_sku as bigint) % {len(_QUOTED)} {' '.join(f'when {i} then {text}' for i, (_, text) in enumerate(_QUOTED))} end as description,
        forecast_month, round(q, 4) as forecast_qty from facts, (values ('100k'), ('64m')) x(split)""", **_SHEET),
    "forecast_header_row": sql("""select source_file, cast(cast(source_file[13:13] as int) // 2 + 2 as int) as header_row,
        cast(count(distinct forecast_month) as int) as month_columns, true as has_totals, min(forecast_month) as first_month
        from grid group by source_file""", **_SHEET),
    "forecast_drop_totals": sql("""select source_file, count(*) as cells, round(sum(q), 3) as forecast_qty from facts group by 1""", **_SHEET),
    "fiscal_month": sql("select vendor_sku, forecast_month, forecast_month as parsed_month from v_forecasts"),
    "month_label_parse": sql("""select vendor_sku, forecast_month,
        case when cast(vendor_sku as bigint) % 14 <> 6 then forecast_month end as parsed_month from v_forecasts"""),
    "forecast_unpivot": sql("""select g.vendor_sku, strftime(g.forecast_month, '%b %Y') as month_label, g.forecast_month, round(q, 4) as forecast_qty
        from facts g where snapshot_at = date '2001-06-01'""", **_SHEET),
    "union_align": """select cast(p_partkey as varchar) as item, cast(p_size as double) as quantity, p_name as description,
          cast(null as boolean) as listed, cast(null as bigint) as rank from part
        union all select cast(p_partkey as varchar), p_retailprice, null, true, null from part
        union all select 'X' || p_partkey, null, null, null, p_size from part""",
    "forecast_latest_snapshot": sql("""
        select vendor_sku, forecast_month, max(snapshot_at) as snapshot_at, round(max_by(forecast_qty, snapshot_at), 4) as forecast_qty
        from v_forecast_snapshots group by 1, 2
        union all select case when l_partkey % 2 = 0 then ' ' end, cast(date_trunc('month', l_shipdate) as date), date '2001-06-01', l_quantity
        from lineitem where l_partkey % 5 = 0"""),
    "snapshot_from_name": """select o_orderkey, case when o_orderkey % 3 = 1 then date '2026-01-02' else cast(o_orderdate as date) end as snapshot_at
        from orders""",
    "inventory_clean": sql("select * exclude (p_name) from rows", **_EXPORT),
    "inventory_latest": sql("""select vendor_sku, sum(qty_available) as qty_available, sum(supplier_po_qty) as supplier_po_qty,
        max(inventory_snapshot_date) as inventory_snapshot_date, min(inventory_source_file) as inventory_source_file,
        min(p_name) as inventory_description from rows where inventory_snapshot_date = date '2026-07-15' and vendor_sku is not null group by 1""", **_EXPORT),
    "stream_ingest_forecasts": sql("""select vendor_sku, forecast_month, max(snapshot_at) as snapshot_at, round(max_by(q, snapshot_at), 4) as forecast_qty
        from facts where snapshot_at <> date '2001-09-01' or cast(vendor_sku as bigint) % 6 <> 0 or cast(vendor_sku as bigint) // 6 % 2 = 0 group by 1, 2""", **_SHEET),
    "export_csv": sql("""select vendor_sku, forecast_month, round(forecast_qty, 4) as forecast_qty, 'a, "' || vendor_sku || '"' as note from v_forecasts"""),
    "stream_ingest_acks": sql("""select po_number, vendor, count(*) as lines, sum(ordered_cases * pack_value) as ordered_qty,
        sum(confirmed_cases * pack_value) as confirmed_qty from doc_lines where po_number is not null group by 1, 2""", **_DOC),
}
