"""Monthly forecast sheets (CSV exports) to one long forecast table.

A sheet has no fixed schema: title rows, then a header row (possibly under a row of fiscal periods),
then products with one column per month. Sheets are read line by line, so Spark splits large files;
only the first rows of each file are looked at to learn its layout, which is then joined back.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.clean import number, squeeze
from ..functions.months import fiscal_month, month_label
from ..schemas import FORECASTS
from ..session import held

# Words that mark a header row; two of them in one row are enough.
HEADER_WORDS = ["upc", "vendor", "vendor sku", "sku", "retail", "retail item", "description", "brand",
                "department", "forecast", "qty", "quantity", "month", "forecast month", "report date"]
HEADER_SEARCH_ROWS = 20
#: Text that a task reads, if the files are cut into smaller blocks.
TASK_BYTES = 32 << 20
#: Groups that the records of a file are dealt to where its layout is joined.
SPREAD = 32

# Header names (after `squeeze`) of the known product columns, first match wins.
PRODUCT_COLUMNS = {
    "vendor_sku": ["brand partner sku#", "vendor sku", "vendor_sku", "sku"],
    "buyer_part_number": ["buyer part number", "buyer_part_number", "retail item number"],
    "upc": ["upc", "gtin"],
    "description": ["ulta item description", "product description", "product_description", "description"],
    "brand": ["brand"],
    "department": ["department"],
}
# A sheet with this column ends in total rows, which have no SKU.
TOTALS_LAYOUT_COLUMN = "ulta item description"
# Columns of the layout with one row per product and month.
LONG_MONTH_COLUMNS, LONG_QTY_COLUMNS = ["forecast month", "month"], ["forecast qty", "forecast quantity", "qty", "quantity"]


def _text_source(reader, *paths: str, only: list[str] | None = None) -> DataFrame:
    reader = reader.format("text").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    lines = reader.load(paths[0]) if len(paths) == 1 else reader.load(list(paths))
    if only is not None:  # files are chosen before any is opened
        lines = lines.filter(F.col("_metadata.file_path").isin(only))
    return lines.select(
        F.url_decode("_metadata.file_path").alias("source_file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"))


def with_place(lines: DataFrame) -> DataFrame:
    """Adds `seq`: lines of one file block are read in order by one task, hence the increasing number;
    blocks of a file are ordered by their offset."""
    return lines.withColumn("seq", F.monotonically_increasing_id())


def _size(spark: SparkSession, *paths: str) -> int:
    """Bytes of the files below the paths, as the file system counts them."""
    hadoop, total = spark._jvm.org.apache.hadoop.fs, 0
    for path in map(hadoop.Path, paths):
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        total += sum(store.getContentSummary(found.getPath()).getLength() for found in store.globStatus(path) or [])
    return total


def read_sheet_lines(spark: SparkSession, *paths: str, only: list[str] | None = None) -> DataFrame:
    """Lines of all CSV sheets with their place: `(block, seq)` orders the lines of one file. `only` names files (encoded paths).

    A task reads several blocks if they are small, so that small splits or files cost no task each.
    """
    tasks = max(2 * spark.sparkContext.defaultParallelism, _size(spark, *paths) // TASK_BYTES + 1)
    return with_place(_text_source(spark.read, *paths, only=only).coalesce(tasks)).drop("size")


def stream_sheet_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same lines as a stream, without `seq`, which only a micro-batch can number."""
    return _text_source(spark.readStream, path)


def snapshot_time(file_name: Column, modified_at: Column) -> Column:
    """Report date at the end of a file name (``plan 2026-07-14.csv``), else the file's own time."""
    stamp = F.regexp_extract(file_name, r"(\d{4}-\d{2}-\d{2})\.[^.]+$", 1)
    return F.coalesce(stamp.try_cast("timestamp"), modified_at.cast("timestamp"))


def split_cells(line: Column) -> Column:
    """Cells of one CSV record. A quote that begins a cell may enclose commas and line breaks, a doubled one inside stands for one;
    any other quote, and one that nothing closes, is a character like others."""
    cells = F.regexp_extract_all(  # possessive, so a line costs linear time
        F.concat(F.lit(","), F.regexp_replace(line, r"[\r\x{FEFF}]", "")),
        F.lit(r',(?:"[^"]*+(?:""[^"]*+)*+"[^,]*|[^,]*)'), F.lit(0))
    return F.transform(cells, _unquote)


def _unquote(cell: Column) -> Column:
    text = F.substring(cell, 2, 1 << 30)
    parts = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*)$'
    inside = F.regexp_extract(text, parts, 1)
    quoted = F.concat(F.replace(inside, F.lit('""'), F.lit('"')), F.regexp_extract(text, parts, 2))
    return F.trim(F.when(text.startswith('"') & text.rlike(parts), quoted).otherwise(text))


# A line of a sheet as a function of states: begun outside (0) or inside (1) a quoted cell, it ends in one or the other.
# OPENS and KEEPS are the two bits of that function: the state after it if begun outside, and if begun inside.
OPENS, KEEPS = 1, 2


def quote_map(line: Column) -> Column:
    """OPENS and KEEPS of a line: what it does to the state of the cells around it.

    The line is cut at its quotes, and an automaton steps from quote to quote, from both states at once: 0 in a
    plain cell, 1 at the start of a cell, 2 inside quotes, 3 behind a quote inside quotes, which closes the cell
    unless another quote follows. Only in state 1 does a quote open a cell.
    """
    comma = lambda piece: piece.endswith(",").cast("int")

    def step(state: Column, piece: Column) -> Column:
        return (F.when(state == 0, comma(piece)).when((state == 1) | (state == 3), 2)
                .when(piece == "", 3).otherwise(comma(piece)))

    pieces = F.split(F.replace(line, F.lit("\ufeff"), F.lit("")), '"')
    first = F.get(pieces, F.lit(0))
    start = F.struct(F.when((first == "") | first.endswith(","), 1).otherwise(0).alias("out"), F.lit(2).alias("ins"))
    ends = F.aggregate(F.slice(pieces, 2, F.size(pieces)), start, lambda s, p: F.struct(step(s["out"], p).alias("out"), step(s["ins"], p).alias("ins")))
    both = F.element_at(F.transform(F.array(ends), lambda e: (e["out"] == 2).cast("int") * OPENS + (e["ins"] == 2).cast("int") * KEEPS), 1)
    return F.when(F.contains(line, F.lit('"')), both).otherwise(KEEPS)


def _composed(rows: DataFrame, place: Window, opens: Column, keeps: Column) -> DataFrame:
    """Adds `key` and `flips` of all functions up to each row: the state after it is `key`, or the state before the first row
    where that is null, turned over if `flips` is odd.

    A function either sets the state (both bits alike), keeps it, or turns it over. So what counts is the last
    one that sets it, and how many turn it over: `key` is the state it sets less the turns before it.
    """
    up_to = place.rowsBetween(Window.unboundedPreceding, 0)
    turns = ((opens == 1) & (keeps == 0)).cast("int")
    rows = rows.withColumn("flips", F.sum(turns).over(up_to) % 2)
    return rows.withColumn("key", F.last(F.when(opens == keeps, opens.bitwiseXOR(F.col("flips"))), ignorenulls=True).over(up_to))


def _with_records(lines: DataFrame) -> DataFrame:
    """Lines (with `quotes`, see quote_map) with the number of their record in the file, and whether they are a whole record.

    Each block of a file yields one function from state to state, composed of its lines'; a scan over the
    blocks of the file gives the state in which each begins, and so that of every line. A quoted cell that the
    file never closes is none: its line and all lines behind it are records of their own.
    """
    block, inside = ["source_file", "block"], Window.partitionBy("source_file", "block").orderBy("seq")
    opens, keeps = F.col("quotes").bitwiseAND(OPENS), F.shiftright("quotes", 1)
    lines = _composed(lines, inside, opens, keeps)
    last = lines.groupBy(*block).agg(F.max_by(F.struct("key", "flips"), "seq").alias("last")).select(*block, "last.*")
    opens, keeps = (F.coalesce("key", F.lit(begun)).bitwiseXOR(F.col("flips")) for begun in (0, 1))
    of_file = Window.partitionBy("source_file").orderBy("block")
    blocks = _composed(last.select(*block, opens.cast("int").alias("o"), keeps.cast("int").alias("k")), of_file, F.col("o"), F.col("k"))
    ends = F.coalesce("key", F.lit(0)).bitwiseXOR(F.col("flips"))
    blocks = blocks.select(*block, ends.alias("ends")).select(
        *block, F.lag("ends", 1, 0).over(of_file).alias("begins"), F.last("ends").over(of_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("unclosed"))
    lines = lines.withColumns({"key_before": F.lag("key").over(inside), "flips_before": F.lag("flips", 1, 0).over(inside)}).join(blocks, block)
    state = lambda key, flips: F.coalesce(key, "begins").bitwiseXOR(F.col(flips))
    lines = lines.withColumns({"before": state("key_before", "flips_before"), "after": state("key", "flips")})
    # The number of a record: how many lines up to here begin one, in the block and in those before.
    lines = lines.withColumn("first", (F.col("before") == 0).cast("long"))
    totals = lines.groupBy(*block).agg(F.sum("first").alias("total")).withColumns({
        "earlier": F.coalesce(F.sum("total").over(of_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "records": F.sum("total").over(Window.partitionBy("source_file"))}).drop("total")
    own = F.sum("first").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("own", own).join(totals, block).withColumn("record", F.col("own") + F.col("earlier"))
    stray = (F.col("unclosed") == 1) & (F.col("record") == F.col("records"))
    return lines.withColumns({"stray": stray, "single": stray | ((F.col("before") == 0) & (F.col("after") == 0))})


def _marked(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with their quote maps, and those on which a quoted cell goes over the end of the line."""
    marked = lines.withColumn("quotes", quote_map(F.col("line")))
    return marked, marked.filter(F.col("quotes").bitwiseAND(OPENS) == OPENS)


def sheet_records(lines: DataFrame) -> DataFrame:
    """Lines joined to records, so that a quoted cell may hold line breaks; columns as before.

    Where no line leaves a quoted cell open, lines are records: one look at the lines decides that now. Else only
    the files that have such lines are numbered (see _with_records), and only the lines of records of several
    lines are brought together; a record has the place of its first line.
    """
    marked, opening = _marked(lines)
    if opening.isEmpty():
        return lines
    files = opening.select("source_file").distinct()
    plain = lines.join(files, "source_file", "left_anti")
    rows = held(_with_records(marked.join(files, "source_file", "left_semi")).select(*lines.columns, "record", "single"), "sheet-records")
    several = rows.filter(~F.col("single")).groupBy("source_file", "modified_at", "record").agg(
        F.sort_array(F.collect_list(F.struct("block", "seq", "line"))).alias("rows"))  # one record's lines
    several = several.select("source_file", "modified_at", F.col("rows")[0]["block"].alias("block"), F.col("rows")[0]["seq"].alias("seq"),
                             F.array_join("rows.line", "\n").alias("line"))
    return plain.unionByName(rows.filter("single").select(lines.columns)).unionByName(several.select(lines.columns))


def header_word_hits(cells: Column) -> Column:
    """How many known header words occur in a row."""
    row = F.concat_ws(" ", F.transform(cells, squeeze))
    return reduce(lambda a, b: a + b, [F.contains(row, F.lit(w)).cast("int") for w in HEADER_WORDS])


def _described(header: Column, periods: Column) -> Column:
    """Position, normalised name and month of every header cell; a fiscal month names its column."""
    def describe(cell: Column, i: Column) -> Column:
        return F.struct(
            i.alias("pos"), squeeze(cell).alias("text"), month_label(cell).alias("labelled"),
            fiscal_month(cell, F.coalesce(F.get(periods, i), F.lit(""))).alias("fiscal"))
    return F.transform(header, describe)


def _named(described: Column) -> Column:
    def name(c: Column) -> Column:
        plain = F.when(c["text"].isin("", "nan"), F.concat(F.lit("unnamed_"), c["pos"].cast("string"))).otherwise(c["text"])
        month = F.coalesce(c["fiscal"], F.when(~c["text"].startswith("unnamed"), c["labelled"]))
        return F.struct(
            c["pos"].alias("pos"), month.alias("month"),
            F.coalesce(F.lower(F.date_format(c["fiscal"], "MMMM yyyy")), plain).alias("name"))
    return F.transform(described, name)


def _unique_names(columns: Column) -> Column:
    """Repeated names get a running number, so that they can be map keys."""
    def number_repeats(c: Column, i: Column) -> Column:
        nth = F.size(F.filter(F.slice(columns, F.lit(1), i + 1), lambda x: x["name"] == c["name"]))
        suffix = F.when(nth > 1, F.concat(F.lit(" ("), nth.cast("string"), F.lit(")"))).otherwise("")
        return F.struct(c["pos"].alias("pos"), c["month"].alias("month"), F.concat(c["name"], suffix).alias("name"))
    return F.transform(columns, number_repeats)


def _position(columns: Column, names: list[str]) -> Column:
    """Position of the first of `names` among the columns, or null."""
    place = F.coalesce(*[F.nullif(F.array_position(columns["name"], n), F.lit(0)) for n in names])
    return F.get(columns["pos"], (place - 1).cast("int"))


def header_rows(lines: DataFrame) -> DataFrame:
    """Per file, from its records: number and cells of the header row, the row above it, and the text of all rows so far.

    The header is the first of the top rows with two known words, else the first row. Blank lines do not
    count. A task sends at most `HEADER_SEARCH_ROWS` records per file.
    """
    order = Window.partitionBy("source_file").orderBy("seq")
    top = (
        lines.filter((F.col("block") == 0) & (F.trim("line") != ""))
        .withColumn("row", F.row_number().over(order)).filter(F.col("row") <= HEADER_SEARCH_ROWS)
        .withColumn("cells", split_cells(F.col("line")))
        .withColumn("hit", header_word_hits(F.col("cells")) >= 2)
    )
    per_file = top.groupBy("source_file").agg(
        F.sort_array(F.collect_list(F.struct("row", "cells", "line"))).alias("rows"),  # HEADER_SEARCH_ROWS at most
        F.coalesce(F.min(F.when(F.col("hit"), F.col("row"))) - 1, F.lit(0)).alias("header_row"),
    )
    above = F.get("rows", F.col("header_row") - 1)
    return per_file.select(
        "source_file", "header_row", F.get("rows", F.col("header_row"))["cells"].alias("header"),
        F.coalesce(above["cells"], F.array().cast("array<string>")).alias("periods"),
        F.slice("rows.line", F.lit(1), F.col("header_row") + 1).alias("head_lines"))


def sheet_layouts(lines: DataFrame) -> DataFrame:
    """Per file: where its header is and what each column holds."""
    columns = F.col("columns")
    found = (
        header_rows(lines)
        .withColumn("columns", _described(F.col("header"), F.col("periods")))
        .withColumn("columns", _named(columns))
        .withColumn("columns", _unique_names(columns))
    )
    places = {f"{field}_pos": _position(columns, names) for field, names in PRODUCT_COLUMNS.items()}
    found = found.withColumns(places)
    is_product = lambda c: F.array_contains(F.array_compact(F.array(*places)), c["pos"])
    return found.select(
        "source_file", "header_row", "head_lines", *places,
        F.filter(columns, lambda c: c["month"].isNotNull()).alias("months"),
        F.filter(columns, lambda c: c["month"].isNull() & ~is_product(c)).alias("others"),
        _position(columns, [TOTALS_LAYOUT_COLUMN]).isNotNull().alias("has_totals"),
        _position(columns, LONG_MONTH_COLUMNS).alias("long_month_pos"),
        _position(columns, LONG_QTY_COLUMNS).alias("long_qty_pos"),
    )


def parse_sheets(lines: DataFrame) -> DataFrame:
    """Every (product row, month) cell of every sheet as one forecast row.

    Layouts are one row a file, repeated for SPREAD groups of its records: a few large files are parsed by more
    tasks than there are files, and what follows is not dealt by file. Besides the forecast columns the result has `row_order`, the place of the cell
    in its file.

    A record that equals, as text, the header or a record above it is no data, wherever it stands:
    page breaks repeat headers. So the result does not depend on how Spark splits a file.
    """
    records = sheet_records(lines)
    layouts = sheet_layouts(records).withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    rows = (
        records.filter(F.trim("line") != "").withColumn("_group", F.pmod(F.xxhash64("block", "seq"), F.lit(SPREAD)).cast("int"))
        .join(layouts, ["source_file", "_group"])
        .filter(~F.array_contains("head_lines", F.col("line")))
        .withColumn("cells", split_cells(F.col("line")))
    )
    cell = lambda pos: F.get("cells", F.col(pos))
    blank = lambda c: F.when(~c.isin("", "nan", "None"), c)
    rows = rows.withColumns({field: blank(F.trim(cell(f"{field}_pos"))) for field in PRODUCT_COLUMNS})
    # Total rows get no facts. A filter instead would be pushed below the split and repeat it.
    is_total = F.col("vendor_sku").isNull() & F.col("has_totals") & F.col("vendor_sku_pos").isNotNull()

    wide = F.transform("months", lambda m: F.struct(
        m["pos"].alias("pos"), m["month"].alias("forecast_month"), m["name"].alias("month_label"),
        F.get("cells", m["pos"]).alias("qty")))
    long = F.array(F.struct(
        F.col("long_qty_pos").alias("pos"), month_label(cell("long_month_pos")).alias("forecast_month"),
        cell("long_month_pos").alias("month_label"), cell("long_qty_pos").alias("qty")))
    facts = F.when(~is_total & (F.size("months") > 0), wide).when(
        ~is_total & F.col("long_month_pos").isNotNull() & F.col("long_qty_pos").isNotNull(), long)

    attributes = F.map_filter(
        F.map_from_arrays(F.col("others.name"), F.transform("others.pos", lambda pos: F.get("cells", pos))),
        lambda _, v: v.isNotNull() & (v != ""))
    file_name = F.element_at(F.split("source_file", "/"), -1)

    # What a row has only once is computed before the explode.
    return rows.withColumns({
        "attributes": attributes, "snapshot_at": snapshot_time(file_name, F.col("modified_at")),
    }).select(
        *PRODUCT_COLUMNS, "source_file", "block", "seq", "snapshot_at", "attributes", F.explode(facts).alias("fact"),
    ).select(
        *PRODUCT_COLUMNS, "fact.forecast_month", "fact.month_label",
        # An empty cell is known for one: a failed cast costs more than all the rest of a cell.
        F.coalesce(number(F.nullif(F.col("fact.qty"), F.lit(""))), F.lit(0.0)).alias("forecast_qty"),
        "attributes", "source_file", "snapshot_at",
        F.struct("block", "seq", "fact.pos").alias("row_order"),
    )


def broken_lines(lines: DataFrame) -> DataFrame:
    """Lines on which a quoted cell begins that the rest of the file never closes; `parse_sheets` takes that quote as text."""
    marked, opening = _marked(lines)
    rows = _with_records(marked.join(opening.select("source_file").distinct(), "source_file", "left_semi"))
    return rows.filter("stray and before = 0").select("source_file", "line")


def unread_headers(lines: DataFrame) -> DataFrame:
    """Header cells (source_file, header) that hold a year but name no month, for a person to look at."""
    columns = F.explode("others")
    found = sheet_layouts(sheet_records(lines)).select("source_file", columns.alias("c")).select("source_file", F.col("c.name").alias("header"))
    return found.filter(F.col("header").rlike(r"\b(19|20)\d{2}\b"))


def newest_per_month(
    forecasts: DataFrame,
    keys: tuple[str, ...] = ("vendor_sku", "forecast_month"),
    order: tuple[str, ...] = ("snapshot_at", "source_file", "row_order"),
) -> DataFrame:
    """Later snapshots replace earlier ones per product and month; rows without a SKU stay untouched.

    `max_by` is combined before the shuffle, so a product with very many snapshots costs one row per task.
    """
    order = [c for c in order if c in forecasts.columns]
    rest = [c for c in forecasts.columns if c not in keys]
    known = F.coalesce(F.trim(F.col(keys[0])) != "", F.lit(False))

    def newest(df: DataFrame, *by: str) -> DataFrame:
        return (df.groupBy(*keys, *by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("newest"))
                .select(*keys, "newest.*").select(forecasts.columns))

    if "row_order" in forecasts.columns:  # the place of a row makes its group unique: one pass for both kinds
        place = F.when(~known, F.struct("source_file", "row_order"))
        return newest(forecasts.withColumn("place", place), "place")
    return newest(forecasts.filter(known)).unionByName(forecasts.filter(~known))


def read_forecasts(spark: SparkSession, *paths: str) -> DataFrame:
    """The newest forecast per product and month over all sheets below the given folders."""
    return newest_per_month(parse_sheets(read_sheet_lines(spark, *paths))).select(FORECASTS.fieldNames())


# --- wide frames ----------------------------------------------------------------

def melt_months(df: DataFrame, id_columns: list[str]) -> DataFrame:
    """Wide to long for a frame with named columns: every column whose name is a month becomes rows."""
    others = df.sparkSession.createDataFrame([(c,) for c in df.columns if c not in id_columns], "name string")
    found = others.select("name", month_label(F.col("name")).alias("month")).filter(F.col("month").isNotNull())
    months = {r["name"]: r["month"] for r in found.collect()}  # column names, not data
    names = F.create_map(*[x for c, m in months.items() for x in (F.lit(c), F.lit(m))])
    typed = df.select(*id_columns, *[F.coalesce(number(F.col(f"`{c}`")), F.lit(0.0)).alias(c) for c in months])
    return typed.unpivot(id_columns, list(months), "month_label", "forecast_qty").select(
        *id_columns, "month_label", F.element_at(names, F.col("month_label")).alias("forecast_month"), "forecast_qty")


def _widest(types: set[str]) -> str:
    """Text wins over float, float over integer, integer over boolean, boolean over time."""
    for wanted, result in (("string", "string"), ("double", "double"), ("float", "double"), ("decimal", "double"),
                           ("bigint", "bigint"), ("int", "bigint"), ("boolean", "boolean"),
                           ("timestamp", "timestamp"), ("date", "timestamp")):
        if any(wanted in t for t in types):
            return result
    return "string"


def union_align(*frames: DataFrame) -> DataFrame:
    """Union by name of frames with different columns; a column gets the widest of its types."""
    types: dict[str, set[str]] = {}
    for frame in frames:
        for name, dtype in frame.dtypes:
            types.setdefault(name, set()).add(dtype)
    target = {name: _widest(found) for name, found in types.items()}
    cast = [f.select(*[F.col(f"`{c}`").cast(target[c]).alias(c) for c in f.columns]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast).select(list(target))
