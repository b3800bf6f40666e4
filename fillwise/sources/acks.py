"""Purchase-order acknowledgement documents to acknowledgement lines."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.clean import blank_to_null, day, first_number, first_text, number
from ..schemas import ACK_DOCUMENT, ACK_DOCUMENT_NAMED, ACK_LINES


def read_documents(spark: SparkSession, *paths: str, streaming: bool = False, json_lines: bool = False,
                   pattern: str = "*.json*") -> DataFrame:
    """One row per document: `document` text and `source_file`.

    One document per file by default; `json_lines=True` reads one document per line, which lets Spark
    split large files.
    """
    reader = spark.readStream if streaming else spark.read
    reader = reader.format("text").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    if not json_lines:
        reader = reader.option("wholetext", True)
    df = reader.load(paths[0]) if streaming else reader.load(list(paths))
    return df.select(F.col("value").alias("document"), F.url_decode("_metadata.file_path").alias("source_file"))


def _first_of(*columns: Column) -> Column:
    """`first_text` as a filter. Spark evaluates a projection with one in many small methods.

    Without any, all fields of a line are one generated method, which is too long for the JVM to compile.
    """
    return F.get(F.filter(F.array(*columns), lambda c: c != ""), F.lit(0))


def _fields(parent: str, *names: str) -> list[Column]:
    return [F.col(f"{parent}.{n}") for n in names]


def _pack(text: Column) -> Column:
    """Units per case; absent, unparsable or non-positive values mean 1."""
    value = number(text)
    return F.when(value > 0, value).otherwise(F.lit(1.0))


def _dated(dates: Column, qualifier: str) -> Column:
    return day(F.get(F.filter(dates, lambda d: d["DateTimeQualifier"] == qualifier), F.lit(0))["Date"])


def _line_fields(sum_schedules: bool) -> dict[str, Column]:
    """Fields of one exploded line: `nested` is set in the EDI layout, `flat` in the flat one."""
    schedules = F.col("nested.LineItemAcknowledgement")
    schedule = F.get(schedules, F.lit(0))
    confirmed = first_number(schedule["ItemScheduleQty"], schedule["confirmedQty"],
                             *_fields("flat", "confirmed_quantity", "confirmedQty", "confirmed"))
    if sum_schedules:
        total = F.aggregate(schedules, F.lit(0.0), lambda acc, s: acc + first_number(s["ItemScheduleQty"], s["confirmedQty"]))
        confirmed = F.coalesce(F.when(F.size(schedules) > 1, total), confirmed)
    order, flat = "nested.OrderLine", "flat"
    return {
        "line_no": F.coalesce(F.col(f"{order}.LineSequenceNumber").try_cast("int"), F.col("pos") + 1),
        "vendor_sku": blank_to_null(first_text(*_fields(order, "VendorPartNumber", "vendorSku", "seller_item_id"),
                                               *_fields(flat, "vendor_sku", "vendorSku", "seller_item_id"))),
        "buyer_part_number": blank_to_null(_first_of(*_fields(order, "BuyerPartNumber", "buyer_part_variant"),
                                                     *_fields(flat, "buyer_part_number", "buyerPartNumber"))),
        "upc": blank_to_null(first_text(*_fields(order, "GTIN"), *_fields(flat, "upc", "gtin"))),
        "description": first_text(F.get("nested.ProductOrItemDescription", F.lit(0))["ProductDescription"],
                                  F.col("flat.description")),
        "ordered_cases": first_number(*_fields(order, "OrderQty", "orderedQty", "ordered"),
                                      *_fields(flat, "ordered_quantity", "orderedQty", "ordered")),
        "confirmed_cases": confirmed,
        "pack_value": _pack(F.coalesce(F.get("nested.PhysicalDetails", F.lit(0))["PackValue"], F.col("flat.pack_value"))),
        "price": number(F.coalesce(F.col(f"{order}.PurchasePrice"), F.col("flat.price"))),
        "status_code": first_text(schedule["ItemStatusCode"], *_fields(flat, "status_code", "status")),
        "delivery_date": first_text(schedule["ItemScheduleDate"], F.col("flat.delivery_date")),
        "requested_dt": _dated(F.col("nested.Dates"), "002"),
        "estimated_dt": _dated(F.col("nested.Dates"), "017"),
    }


def flatten_documents(documents: DataFrame, sum_schedules: bool = False) -> DataFrame:
    """Every line of every document, lines without a PO number included (see `rejected_lines`).

    Both the nested EDI layout and the flat `header` / `lines` layout are understood. Only the first
    schedule of a line counts unless `sum_schedules`. A document without lines gives one row without a
    line number, so that it can be reported.
    """
    parsed = documents.select(
        "source_file", F.from_json("document", ACK_DOCUMENT).cast(ACK_DOCUMENT_NAMED).alias("d")
    ).select("source_file", "d.*")
    nested = F.coalesce(F.when(F.size("LineItem") > 0, F.col("LineItem")), F.col("line_items"))
    empty = lambda column: F.array().cast(parsed.schema[column].dataType)
    items = F.arrays_zip(F.coalesce(nested, empty("LineItem")).alias("nested"),
                         F.coalesce(F.col("lines"), empty("lines")).alias("flat"))
    head, flat = "Header.OrderHeader", "flat_header"
    exploded = parsed.select(
        "source_file", F.col("damaged").isNull().alias("readable"),
        first_text(*_fields(head, "PurchaseOrderNumber"), *_fields(flat, "po_number"), F.col("poNumber"), F.col("po")).alias("po_number"),
        first_text(*_fields(head, "Vendor"), *_fields(flat, "vendor"), F.col("vendor")).alias("vendor"),
        first_text(*_fields(head, "Customer"), *_fields(flat, "customer"), F.col("customer")).alias("customer"),
        day(first_text(*_fields(head, "PurchaseOrderDate"), *_fields(flat, "po_date"))).alias("po_date"),
        day(first_text(*_fields(head, "AcknowledgementDate"), *_fields(flat, "ack_date"))).alias("ack_date"),
        F.posexplode_outer(items).alias("pos", "item"),
    )
    names = exploded.schema["item"].dataType.fieldNames()
    lines = exploded.withColumns({"nested": F.col("item")[names[0]], "flat": F.col("item")[names[1]]})
    return lines.withColumns(_line_fields(sum_schedules)).withColumns({
        "ordered_qty": F.col("ordered_cases") * F.col("pack_value"),
        "confirmed_qty": F.col("confirmed_cases") * F.col("pack_value"),
        "delivery_dt": day(F.col("delivery_date")),
    }).select("readable", *ACK_LINES.fieldNames())


def valid_lines(lines: DataFrame) -> DataFrame:
    """Lines that carry a PO number.

    One condition over document and line together: a test of the PO number alone would be pushed below
    the explode, and the documents would be parsed a second time for it.
    """
    return lines.filter(F.when(F.col("line_no").isNotNull(), F.col("po_number")).isNotNull()).select(ACK_LINES.fieldNames())


def rejected_lines(lines: DataFrame) -> DataFrame:
    """What `valid_lines` leaves out, with the reason."""
    reason = (F.when(~F.col("readable"), "unreadable document").when(F.col("line_no").isNull(), "no lines")
              .when(F.col("po_number").isNull(), "no po number"))
    return lines.withColumn("reject_reason", reason).filter(reason.isNotNull()).select(
        *ACK_LINES.fieldNames(), "reject_reason")


def read_ack_lines(spark: SparkSession, *paths: str, json_lines: bool = False, sum_schedules: bool = False) -> DataFrame:
    """All valid acknowledgement lines below the given folders."""
    return valid_lines(flatten_documents(read_documents(spark, *paths, json_lines=json_lines), sum_schedules))
