"""The search index and the search of many texts against plain scans."""

import itertools
import re
import uuid

import pytest
from pyspark.sql import functions as F

from fillwise.functions.clean import contains_text
from fillwise.operators import postings, search
from fillwise.plans.workspace import Workspace

PATTERNS = ["RED lip", "colou?r", "12$", "(red|blue)", "po-7", "zzz", "é"]


@pytest.fixture(scope="module")
def tables(spark):
    forecasts = [("A1", "B1", "U1", "Red Lipstick", "Glow", "Care", 1.0), ("A1", "B1", "U1", "Red Lipstick", "Glow", "Care", 1.0),
                 ("A2", "B2", None, "colour É pen", "GLOW", None, 2.0), (" A3 ", None, "U12", "blue.pen+", "Exx", "Care", 3.0),
                 ("A4", "B9", "U9", "", None, "care", 4.0), (None, None, None, None, None, None, 5.0)]
    acks = [("A1", "B1", "U1", "PO-7", "Vend", "Shop", 1.0), ("A3", "B7", None, "po-71", "vend", "Colored", 2.0),
            ("A9", None, "U12", "PO-8", "RED house", None, 3.0), (None, None, None, "PO-9", None, "lipp", 4.0)]
    f = spark.createDataFrame(forecasts, "vendor_sku string, buyer_part_number string, upc string, description string, brand string, department string, forecast_qty double")
    a = spark.createDataFrame(acks, "vendor_sku string, buyer_part_number string, upc string, po_number string, vendor string, customer string, confirmed_qty double")
    return f.withColumn("forecast_month", F.lit("2026-01-01").cast("date")), a.withColumn("delivery_date", F.lit("2026-02-03"))


def rows(df, *without):
    return sorted(map(repr, df.drop(*without).collect()))


def test_required_pieces():
    want = {"Red": {"red"}, "abcd": {"abc", "bcd"}, "abc?d": set(), "abcd*e": {"abc"}, "abc+de": {"abc"}, "a.bcd$": {"bcd"}, "(abc|def)": set(), r"6\.55": set(), "ab": set(), "ÀBC": {"Àbc"}}
    assert {p: postings.required_pieces(p) for p in want} == want


def test_index_finds_what_a_scan_finds(spark, tables, tmp_path):
    space = Workspace(*tables)
    space.write_index(str(tmp_path / "index"), blocks=3)
    for pattern in PATTERNS:
        for mine, plain in zip(space.search_index(str(tmp_path / "index"), pattern), space.search(pattern)):
            assert rows(mine) == rows(plain.select(mine.columns)), pattern


def test_index_reads_only_blocks_with_a_match(spark, tmp_path):
    lines = spark.range(4000).select(F.format_string("S%05d", "id").alias("vendor_sku"), F.lit("Vend").alias("vendor"), F.rand(3).alias("confirmed_qty"))
    postings.write_index(lines, search.ACK_FIELDS, str(tmp_path / "index"), blocks=16)
    index = postings.SearchIndex(spark, str(tmp_path / "index"), search.ACK_FIELDS)
    assert index.records.select("_block").distinct().count() == 16
    found = index.holding(index.matches("s00777"))
    assert index.search("s00777").count() == 1 and found.count() <= 4000 / 16 * 2
    assert "dynamicpruning" in found._jdf.queryExecution().toString()
    assert index.search("vend").count() == 4000  # a value of all rows is in all blocks


def test_empty_index(spark, tables, tmp_path):
    Workspace(*[t.limit(0) for t in tables]).write_index(str(tmp_path / "index"))
    f, a = Workspace(*tables).search_index(str(tmp_path / "index"), "red")
    assert f.count() == 0 and a.count() == 0


def test_many_texts_are_found_as_one_by_one(spark, tables):
    texts = ["red", " RED lip", "po-7", "a", "É", "blue.pen+", "zzz", "", None, "(red|blue)"]
    f, a = postings.search_texts(*tables, spark.createDataFrame([(t,) for t in texts + texts[:3]], "query string"))
    f, a = f.collect(), a.collect()
    for text in {t.strip() for t in texts if t}:
        plain = search.search_records(*tables, re.escape(text))
        for mine, want in zip((f, a), plain):
            own = sorted(repr(tuple(r)[1:]) for r in mine if r["query"] == text)
            assert own == sorted(repr(tuple(r)) for r in want.collect()), text
    assert not {r["query"] for r in f + a} & {"", None, "zzz", "(red|blue)"}


def test_text_matches_by_brute_force(spark):
    letters = ["a", "B", "c"]
    values = ["".join(p) for n in range(1, 6) for p in itertools.product(letters, repeat=n)]
    texts = ["".join(p) for n in range(1, 5) for p in itertools.product("AbC", repeat=n)] + ["cabac" * 3]
    got = postings.text_matches(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame([(t,) for t in texts], "query string"))
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == {(t, v) for t in texts for v in values if t.lower() in v.lower()}
    none = spark.createDataFrame([], "query string")
    assert postings.text_matches(spark.createDataFrame([("abc",)], "value string"), none).count() == 0


def test_plain_text_is_found_as_the_pattern_finds_it(spark):
    texts = ["x100", "Widget", "wIDGET 1", "Kelvin", "kelvin", "İ", "a\nb", "", None, "STRASSE", "straße", "0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in ["100", "widget", "WIDGET", "kelvin", "KELVIN", "i", "a\nb", " ", "ss", "é", "#", "a&b", "-", "1.0", "k|0"]:
        got = [r[0] for r in df.select(contains_text(F.col("t"), pattern)).collect()]
        want = [r[0] for r in df.select(F.coalesce(F.col("t").rlike("(?i)" + pattern), F.lit(False))).collect()]
        assert got == want, pattern
    plan = df.filter(contains_text(F.col("t"), "100"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan and "RLIKE" not in plan.upper()


@pytest.mark.parametrize("maps", [False, True])
def test_forecasts_of_lines_read_the_lines_once(spark, tmp_path, monkeypatch, maps):
    """Of reached forecasts one of each set of equal rows stays, rows without identifiers included; without any all stay."""
    named = [("A1", "B1", "U1", "red"), ("A1", "B1", "U1", "red"), (" A1", "B1", "U1", "red"), ("A1", "B1", "U1", None), (None, "B1", "", "pen"), ("", "B1", None, "pen")]
    blank = [(None, None, None, "po-7"), (None, None, None, "po-7"), (" ", "", None, "po-7"), (None, None, None, "cap"), ("A2", "B2", None, "cap"), ("A2", "B2", None, "cap")]
    f = spark.createDataFrame(named + blank, "vendor_sku string, buyer_part_number string, upc string, description string")
    if maps:
        f = f.withColumn("more", F.create_map(F.lit("a"), F.col("description")))
    a = spark.createDataFrame([("A9", "B1", None, "PO-7"), (None, None, " ", "PO-7")], "vendor_sku string, buyer_part_number string, upc string, po_number string")

    def held(df, name):
        folder = str(tmp_path / f"{name}-{uuid.uuid4().hex}")
        df.write.parquet(folder)
        return spark.read.schema(df.schema).parquet(folder)

    monkeypatch.setattr(search, "held", held, raising=False)
    got = search.search_records(f, a, "PO-7")[0]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    none, _ = search.search_records(f, a, "cap")
    want = sorted(set(named + blank[:3]), key=repr)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == want
    assert "po_number" not in plan and (maps or "Window" not in plan)
    assert sorted((tuple(r)[:4] for r in none.collect()), key=repr) == sorted(blank[3:], key=repr)


def test_folders_are_written_unsorted_and_settings_come_back(spark, tmp_path):
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    lines = spark.createDataFrame([("S1", "P1", None), ("S1", "P1", None), (None, "P2", "V")], "vendor_sku string, po_number string, vendor string")
    postings.write_index(lines, search.ACK_FIELDS, str(tmp_path / "index"), blocks=2)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    values = spark.read.parquet(str(tmp_path / "index/values"))
    got = sorted(map(tuple, values.select("field", "value").distinct().collect()))
    assert got == [("po_number", "P1"), ("po_number", "P2"), ("vendor", "V"), ("vendor_sku", "S1")]
    assert values.count() == values.distinct().count()
    with postings._unsorted_folders(spark, 3):
        assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "3"
