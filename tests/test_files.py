"""Sheets, inventory exports, streams, and exports as files."""

import datetime as dt
import io
import itertools

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fillwise.schemas import FORECASTS
from fillwise.sources import forecasts as sheets, inventory, sinks
from fillwise.streaming import ingest
from fillwise.streaming.forecast_table import ForecastTable

D = dt.date

TWO_ROW_HEADER = '''Report title,,,,
,,2026 P01,2026 P02,2026 P12,
Brand Partner SKU#,Ulta Item Description,February,March,January,Note
S1,"Lip, liner ""x""",1,2,3,hello
S2,Other,4,"5",x,

,Overall Result,5,7,3,
'''
PLAIN_HEADER = '''Vendor SKU,Description,Jul-26,Aug-26,total 2026
S1,aa,10,20,30
,bb,1,2,3
S9,"broken
cell",1,2,3
'''


def facts(df):
    return {(r["vendor_sku"], r["forecast_month"]): r["forecast_qty"] for r in df.collect()}


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / name.replace("__", " ").replace("_csv", ".csv")).write_text(text)


def test_sheets_of_different_layouts(spark, tmp_path):
    write(tmp_path, **{"plan__2026-07-14_csv": TWO_ROW_HEADER, "b_csv": PLAIN_HEADER,
                       "long__2026-07-15_csv": "Vendor SKU,Forecast Month,Forecast Qty\nS1,Feb 2026,10\n"})
    df = sheets.read_forecasts(spark, str(tmp_path))
    assert df.schema.fieldNames() == FORECASTS.fieldNames()
    found = facts(df)
    assert found[("S1", D(2026, 2, 1))] == 10.0  # the later file wins
    assert found[("S1", D(2026, 3, 1))] == 2.0 and found[("S1", D(2027, 1, 1))] == 3.0
    assert found[("S2", D(2027, 1, 1))] == 0.0 and found[("S1", D(2026, 7, 1))] == 10.0
    assert found[(None, D(2026, 8, 1))] == 2.0  # kept: this layout has no totals
    assert not [k for k in found if k[0] is None and k[1] < D(2026, 7, 1)]
    row = df.filter("vendor_sku = 'S1' and forecast_month = '2026-03-01'").first()
    assert row["description"] == 'Lip, liner "x"' and row["attributes"] == {"note": "hello"}
    assert row["snapshot_at"] == dt.datetime(2026, 7, 14)
    assert sheets.broken_lines(sheets.read_sheet_lines(spark, str(tmp_path))).count() == 0


def test_lines_of_a_split_file_keep_their_layout(spark, tmp_path):
    rows = "".join(f"S{i},{i}\n" for i in range(4000))
    write(tmp_path, **{"big_csv": "Vendor SKU,Jul-26\n" + rows})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = sheets.read_sheet_lines(spark, str(tmp_path))
        assert lines.select("block").distinct().count() > 3
        found = facts(sheets.newest_per_month(sheets.parse_sheets(lines)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(found) == 4000 and found[("S3999", D(2026, 7, 1))] == 3999.0


def test_a_large_file_is_parsed_by_many_tasks(spark, tmp_path):
    """The rows of one file, without a layout small enough to be sent, and after the file's rows are made unique."""
    write(tmp_path, **{"big_csv": "Vendor SKU,Jul-26,Aug-26\n" + "".join(f"S{i},{i},\n" for i in range(2000))})
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        parsed = sheets.parse_sheets(sheets.read_sheet_lines(spark, str(tmp_path)))
        unique = sheets.newest_per_month(parsed, keys=("vendor_sku", "forecast_month", "source_file"))
        for rows in (parsed, unique):
            sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect()]
            assert sum(sizes) == 4000 and max(sizes) < 2000
        assert {r["forecast_qty"] for r in parsed.filter("month(forecast_month) = 8").collect()} == {0.0}  # empty cells
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_small_splits_share_tasks(spark, tmp_path):
    write(tmp_path, big_csv="Vendor SKU,Jul-26\n" + "".join(f"S{i},{i}\n" for i in range(20000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = sheets.read_sheet_lines(spark, str(tmp_path))
        assert lines.select("block").distinct().count() > 100
        assert lines.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
        ordered = [r["line"] for r in lines.orderBy("block", "seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert ordered == ["Vendor SKU,Jul-26", *[f"S{i},{i}" for i in range(20000)]]


BREAKS = ('Report of July\n"Vendor SKU","Item\nDescription",Jul-26\nS9,"l1\nmiddle\nl3",7\nVendor SKU,Note,Jul-26\n'
          + "".join(f"S{i},plain {i},{i}\n" for i in range(10, 3000)) + '"Vendor SKU","Item\nDescription",Jul-26\nLAST,"a, ""b""\n",3\n')


@pytest.mark.parametrize("split", ["4096", "134217728"])
def test_quoted_line_breaks_whatever_the_split(spark, tmp_path, split):
    write(tmp_path, **{"breaks_csv": BREAKS, "other_csv": 'Vendor SKU,Description,Jul-26\nT1,5" pipe,2\nT2,plain,4\n'})
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        lines = sheets.read_sheet_lines(spark, str(tmp_path))
        rows = {r["vendor_sku"]: r for r in sheets.parse_sheets(lines).collect()}
        broken = sheets.broken_lines(lines).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows["S9"]["forecast_qty"] == 7.0 and rows["S9"]["attributes"] == {"item description": "l1\nmiddle\nl3"}
    assert rows["LAST"]["attributes"] == {"item description": 'a, "b"\n'} and rows["LAST"]["forecast_qty"] == 3.0
    # The repeated header is no product; another text in its place is one.
    assert len(rows) == 2990 + 3 + 2 and rows["Vendor SKU"]["attributes"] == {"item description": "Note"}
    assert rows["T2"]["forecast_qty"] == 4.0 and rows["T1"]["description"] == '5" pipe' and not broken


# Quotes inside cells, closed and open ones, in one text; what pandas reads from it is the rule.
STRAY = [
    'A,bolt 6" steel,5', 'B,plain,6', 'C,pipe 3" wide,7', 'D,plain,8', 'E,"two\nlines, 5"" each",9', 'F,"a""b",10', 'G,"6"" x 2""",11', 'H,"x"y "z",12',
    'I,"""",13', 'J,"",14', 'K,""x,15', 'L, "lead",16', 'M,"\n""\n,\n",17', 'N,"end\n"" ",18', '"O",tail",19', 'P,"\n",20']


@pytest.mark.parametrize("split", ["64", "134217728"])
@pytest.mark.parametrize("times", [1, 40])
def test_quotes_are_quotes_at_the_start_of_a_cell_only(spark, tmp_path, split, times):
    text = "Vendor SKU,Description,Jul-26\n" + "".join(f"{i}{x}\n" if x[0] != '"' else f'"{i}{x[1:]}\n' for i in range(times) for x in STRAY)
    write(tmp_path, a_csv=text, b_csv="Vendor SKU,Description,Jul-26\nZ,no quote,1\n")
    expected = pd.read_csv(io.StringIO(text), dtype=str, keep_default_na=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        lines = sheets.read_sheet_lines(spark, str(tmp_path))
        rows = {r["vendor_sku"]: (r["description"], r["forecast_qty"]) for r in sheets.parse_sheets(lines).collect()}
        assert sheets.broken_lines(lines).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows.pop("Z") == ("no quote", 1.0) and len(rows) == len(expected) == len(STRAY) * times
    assert rows == {r[0]: (r[1].strip(" ") or None, float(r[2])) for r in expected.itertuples(index=False)}


@pytest.mark.parametrize("split", ["64", "134217728"])
def test_a_quote_that_nothing_closes_is_text(spark, tmp_path, split):
    write(tmp_path, a_csv='Vendor SKU,Description,Jul-26\nA,"two\nlines",1\nB,"6 inch,2\n' + "".join(f'S{i},"" x,{i}\n' for i in range(60)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        lines = sheets.read_sheet_lines(spark, str(tmp_path))
        rows = {r["vendor_sku"]: (r["description"], r["forecast_qty"]) for r in sheets.parse_sheets(lines).collect()}
        broken = [r["line"] for r in sheets.broken_lines(lines).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == {"A": ("two\nlines", 1.0), "B": ('"6 inch', 2.0), **{f"S{i}": ("x", float(i)) for i in range(60)}}
    assert broken == ['B,"6 inch,2']


def test_line_maps_agree_with_a_walk_over_characters(spark):
    texts = ["".join(t) for n in range(6) for t in itertools.product(',"a', repeat=n)] + ['"a"" ""b",""x"', ' "', '\ufeff"x', '"""']
    def walk(line, state):
        for c in line.replace("\ufeff", ""):
            if state in ("start", "plain"):
                state = "in" if c == '"' and state == "start" else "start" if c == "," else "plain"
            elif state == "in":
                state = "quote" if c == '"' else "in"
            else:
                state = "in" if c == '"' else "start" if c == "," else "plain"
        return state == "in"

    df = spark.createDataFrame([(t,) for t in texts], "line string").select("line", sheets.quote_map(F.col("line")).alias("q"))
    for line, q in df.collect():
        assert q == walk(line, "start") * sheets.OPENS + walk(line, "in") * sheets.KEEPS, line


def test_headers_with_a_year_but_no_month_are_reported(spark, tmp_path):
    write(tmp_path, **{"a_csv": "Vendor SKU,Total 2026,Jul-26,Note\nS1,1,2,x\n"})
    assert [r["header"] for r in sheets.unread_headers(sheets.read_sheet_lines(spark, str(tmp_path))).collect()] == ["total 2026"]


def test_last_row_of_a_sheet_wins(spark, tmp_path):
    write(tmp_path, **{"a_csv": "Vendor SKU,Jul-26,2026-07\nS1,1,2\nS1,3,4\n"})
    assert facts(sheets.read_forecasts(spark, str(tmp_path))) == {("S1", D(2026, 7, 1)): 4.0}


def test_header_repeated_by_a_page_break(spark, tmp_path):
    write(tmp_path, **{"a_csv": "Plan\nVendor SKU,Jul-26\nS1,1\nPlan\nVendor SKU,Jul-26\nS2,2\n"})
    assert facts(sheets.read_forecasts(spark, str(tmp_path))) == {("S1", D(2026, 7, 1)): 1.0, ("S2", D(2026, 7, 1)): 2.0}


def test_repeated_header_names(spark, tmp_path):
    write(tmp_path, **{"a_csv": "Vendor SKU,Jul-26,Note,Note,,\nS1,1,x,y,z,\n"})
    row = sheets.read_forecasts(spark, str(tmp_path)).first()
    assert row["attributes"] == {"note": "x", "note (2)": "y", "unnamed_4": "z"}


def test_newest_inventory_file(spark, tmp_path):
    head = "Item__No__,Item__Qty__on_Purch__Order_,QtyAvailable,Item_Item_Description\n"
    write(tmp_path, **{"Stock__14July2026_csv": head + "S1,1,1,old\n",
                       "Stock__15Jul2026_csv": head + ' 001,2,"1,200 EA",Lip\n001,3,-5,\n ,9,9,\nS2,x,(100),Eye\n'})
    rows = {r["vendor_sku"]: r for r in inventory.read_inventory(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["001", "S2"]
    assert (rows["001"]["qty_available"], rows["001"]["supplier_po_qty"]) == (1195.0, 5.0)
    assert rows["S2"]["qty_available"] == 100.0 and rows["S2"]["supplier_po_qty"] == 0.0
    assert rows["001"]["inventory_snapshot_date"] == D(2026, 7, 15) and rows["001"]["inventory_description"] == "Lip"


def test_inventory_without_files_or_columns(spark, tmp_path):
    assert inventory.read_inventory(spark, str(tmp_path)).count() == 0
    write(tmp_path, **{"x_csv": "a,b\n1,2\n"})
    assert inventory.read_inventory(spark, str(tmp_path)).count() == 0


def test_forecast_stream_equals_one_load(spark, tmp_path):
    source, table, mark = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "mark")
    run = lambda: ingest.ingest_forecasts(spark, str(source), table, mark).awaitTermination()
    write(source, **{"plan__2026-07-14_csv": TWO_ROW_HEADER})
    run()
    write(source, **{"plan__2026-07-01_csv": TWO_ROW_HEADER.replace("S1,", "S1,").replace(",1,2,3,hello", ",7,7,7,old")})
    run()
    run()  # nothing new
    late = ingest.current_forecasts(spark, table)
    assert late.schema.fieldNames() == FORECASTS.fieldNames()
    assert facts(late) == facts(sheets.read_forecasts(spark, str(source)))
    assert facts(late)[("S1", D(2026, 2, 1))] == 1.0


def sheet(**months):
    """A sheet of products by SKU, with one quantity a month (None: not in the sheet)."""
    rows = [f"{sku},{','.join('' if q is None else str(q) for q in own)}" for sku, own in months.items()]
    return "Vendor SKU,Jul-26,Aug-26\n" + "\n".join(rows) + "\n"


def test_forecast_table_follows_its_files(spark, tmp_path):
    source, table = tmp_path / "in", ForecastTable(spark, str(tmp_path / "table"), parts=3)
    read = lambda: facts(table.current())
    assert read() == {} and table.ledger().count() == 0
    load = lambda: table.load(str(source))
    write(source, **{"b__2026-07-14_csv": sheet(S1=(1, 2), S2=(3, 4))})
    load()
    write(source, **{"a__2026-07-01_csv": sheet(S1=(10, 20), S3=(30, 40)), "x_[1]%20,__2026-07-02_csv": sheet(S4=(5, 6))})
    load()
    whole = lambda: facts(sheets.read_forecasts(spark, str(source)))
    assert read() == whole() and read()[("S1", D(2026, 7, 1))] == 1.0 and read()[("S3", D(2026, 8, 1))] == 40.0
    versions = table._versions()
    load()
    assert table._versions() == versions  # nothing changed
    # A rewritten file: what it no longer names falls back to the older sheet, or goes.
    write(source, **{"b__2026-07-14_csv": sheet(S2=(33, 44), S5=(7, 8))})
    load()
    assert read() == whole() and read()[("S1", D(2026, 7, 1))] == 10.0 and read()[("S2", D(2026, 7, 1))] == 33.0
    (source / "a 2026-07-01.csv").unlink()
    load()
    assert read() == whole() and ("S1", D(2026, 7, 1)) not in read() and table.ledger().count() == 2
    before = table.current()
    table.drop_old_versions(keep=1)
    assert len(table._versions()) == 1 and facts(before) == read() == whole()
    assert table.current().count() == len(read())  # each row is stored once
    for f in list(source.iterdir()):
        f.unlink()
    load()
    assert read() == {}


def test_a_load_touches_only_the_cuts_of_its_files(spark, tmp_path):
    source, table = tmp_path / "in", ForecastTable(spark, str(tmp_path / "table"), parts=8)
    write(source, **{"a__2026-07-01_csv": sheet(**{f"S{i}": (i, i) for i in range(40)})})
    table.load(str(source))
    first = {(r["part"], r["year"]): r["newest"] for r in table._manifest()}
    write(source, **{"b__2026-07-02_csv": "Vendor SKU,Aug-26\nS1,99\n"})
    table.load(str(source))
    second = {(r["part"], r["year"]): r["newest"] for r in table._manifest()}
    assert first.keys() == second.keys() and sum(first[k] != second[k] for k in first if k[0] is not None) == 1
    assert facts(table.current())[("S1", D(2026, 8, 1))] == 99.0


def test_a_batch_that_is_retried_is_merged_once_and_a_failed_load_is_not_seen(spark, tmp_path):
    source, table = tmp_path / "in", ForecastTable(spark, str(tmp_path / "table"))
    write(source, **{"a__2026-07-01_csv": sheet(S1=(1, 2))})
    rows = sheets.parse_sheets(sheets.read_sheet_lines(spark, str(source)))
    files = rows.select("source_file", F.lit(1).cast("long").alias("size"), F.current_timestamp().alias("modified_at")).distinct()
    for _ in range(2):
        table.merge(rows, files, batch=0)
    assert table._versions() == [1] and table.current().count() == 2
    broken = rows.withColumn("forecast_qty", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception):
        table.merge(broken, files, batch=1)
    assert table._versions() == [1] and table.current().count() == 2


def test_ack_stream_skips_files_already_read(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    doc = '{"po": "%s", "lines": [{"vendor_sku": "S", "ordered_quantity": 2}]}'
    run = lambda: ingest.ingest_acks(spark, str(source), str(tmp_path / "t"), str(tmp_path / "m")).awaitTermination()
    count = lambda: spark.read.parquet(str(tmp_path / "t")).count()
    (source / "a.json").write_text(doc % "1")
    run()
    run()
    assert count() == 1
    (source / "b.json").write_text(doc % "2")
    (source / "c.json").write_text("no json")
    run()
    assert count() == 2
    ingest.ingest_ack_rejects(spark, str(source), str(tmp_path / "r"), str(tmp_path / "rm")).awaitTermination()
    assert [r["reject_reason"] for r in spark.read.parquet(str(tmp_path / "r")).collect()] == ["unreadable document"]


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("007", 1.5), ("x,y", None)], "sku string, qty double")
    sinks.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, schema="sku string, qty double")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    sinks.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_month_labels_with_a_day_or_two_digits(spark):
    from pyspark.sql import functions as F

    from fillwise.functions.months import month_label

    july = ["1-Jul-26", "15-Jul-2026", "7/1/26", "July 1, 2026", "2026 July", "Jul 2026 forecast", "Jul-26", "2026 P06"]
    none = ["total 2026", "q1 2026", "2026 total", "July", "31-Foo-26", "1 2 3"]
    rows = spark.createDataFrame([(x,) for x in july + none], "h string").select("h", month_label(F.col("h")).alias("m")).collect()
    assert {r["h"] for r in rows if r["m"] == D(2026, 7, 1)} == set(july) and {r["h"] for r in rows if r["m"] is None} == set(none)


def test_a_sheet_is_written_as_its_lines(spark, tmp_path):
    """A cell with a line break, a blank line and blanks around a line, in the order of the sheet."""
    from catalog import loading

    text = ["  first ", "  ", '7,"Item,\n boxed",1', "last"]
    lines = spark.createDataFrame([("plans/group 1.csv", i, x) for i, x in enumerate(text)], "source_file string, seq long, line string").repartition(3)
    loading._write_sheets(lines, str(tmp_path / "out"))
    (file,) = (tmp_path / "out" / "sheet=group 1").glob("part-*")
    assert file.read_text() == "\n".join(text) + "\n"
