"""Schemas of the three analytic tables and of the documents they come from.

Identifiers stay text everywhere: leading zeros are significant.
"""

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


ACK_LINES = T.StructType(
    _strings("po_number", "vendor", "customer", "vendor_sku", "buyer_part_number", "upc", "description")
    + [T.StructField(n, T.DoubleType()) for n in
       ("ordered_cases", "confirmed_cases", "pack_value", "ordered_qty", "confirmed_qty", "price")]
    + _strings("status_code", "delivery_date")
    + [T.StructField(n, T.DateType()) for n in
       ("delivery_dt", "po_date", "ack_date", "requested_dt", "estimated_dt")]
    + [T.StructField("line_no", T.IntegerType())]
    + _strings("source_file")
)

FORECASTS = T.StructType(
    _strings("vendor_sku", "buyer_part_number", "upc", "description", "brand", "department")
    + [
        T.StructField("forecast_month", T.DateType()),
        T.StructField("month_label", T.StringType()),
        T.StructField("forecast_qty", T.DoubleType()),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
        T.StructField("source_file", T.StringType()),
        T.StructField("snapshot_at", T.TimestampType()),
    ]
)

INVENTORY = T.StructType(
    _strings("vendor_sku")
    + [T.StructField("qty_available", T.DoubleType()), T.StructField("supplier_po_qty", T.DoubleType()),
       T.StructField("inventory_snapshot_date", T.DateType())]
    + _strings("inventory_source_file", "inventory_description")
)

# --- acknowledgement documents -------------------------------------------------
# Every scalar is read as text, so numbers and numeric text are both accepted and identifiers keep their
# spelling. JSON keys differ by case only in two places ("Header" and "header", "BuyerPartNumber" and
# "buyerPartNumber"), which column names must not: a document is parsed by `ACK_DOCUMENT` and then cast,
# by position, to `ACK_DOCUMENT_NAMED`.

_ORDER_HEADER = T.StructType(_strings(
    "Vendor", "Customer", "PurchaseOrderNumber", "PurchaseOrderDate", "AcknowledgementDate"))
_SCHEDULES = T.ArrayType(T.StructType(_strings("ItemStatusCode", "ItemScheduleQty", "confirmedQty", "ItemScheduleDate")))
_FLAT_LINES = T.ArrayType(T.StructType(_strings(
    "vendor_sku", "vendorSku", "seller_item_id", "buyer_part_number", "buyerPartNumber", "upc", "gtin", "description",
    "ordered_quantity", "orderedQty", "ordered", "confirmed_quantity", "confirmedQty", "confirmed", "pack_value",
    "price", "status_code", "status", "delivery_date")))


def _line_items(buyer_variant: str) -> T.ArrayType:
    order_line = T.StructType(_strings(
        "LineSequenceNumber", "VendorPartNumber", "vendorSku", "seller_item_id", "BuyerPartNumber", buyer_variant,
        "GTIN", "OrderQty", "orderedQty", "ordered", "PurchasePrice"))
    return T.ArrayType(T.StructType([
        T.StructField("OrderLine", order_line),
        T.StructField("LineItemAcknowledgement", _SCHEDULES),
        T.StructField("ProductOrItemDescription", T.ArrayType(T.StructType(_strings("ProductDescription")))),
        T.StructField("PhysicalDetails", T.ArrayType(T.StructType(_strings("PackValue")))),
        T.StructField("Dates", T.ArrayType(T.StructType(_strings("DateTimeQualifier", "Date")))),
    ]))


def _document(flat_header: str, buyer_variant: str, damaged: str) -> T.StructType:
    return T.StructType([
        T.StructField("Header", T.StructType([T.StructField("OrderHeader", _ORDER_HEADER)])),
        T.StructField("LineItem", _line_items(buyer_variant)),
        T.StructField("line_items", _line_items(buyer_variant)),
        T.StructField(flat_header, T.StructType(_strings("vendor", "customer", "po_number", "po_date", "ack_date"))),
        T.StructField("lines", _FLAT_LINES),
        *_strings("vendor", "customer", "poNumber", "po", damaged),
    ])


ACK_DOCUMENT = _document("header", "buyerPartNumber", "_corrupt_record")
ACK_DOCUMENT_NAMED = _document("flat_header", "buyer_part_variant", "damaged")
