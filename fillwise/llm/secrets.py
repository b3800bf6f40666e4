"""Finds secrets: fixed patterns, and random-looking strings told from identifiers by two Markov models.

DataFrame functions only. No pattern reaches over white space or a line end.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, functions as F

from fillwise.llm.common import SPACE, let

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run too short to count can't hide a longer match, so the least lengths stand in the patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
SIGNS = string.ascii_letters + string.digits + "+/_=-"
#: Strings that the models judge, and words that the models learn from.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"^[A-Za-z0-9+/_=-]{6,}$"


def _found(text: Column, pattern: str, kind: int, likely: Column, group: int = 0, least: int = 1) -> Column:
    """Spans of all matches, leftmost first: start, kind, end (code points, end exclusive) and text.

    Matches are the pieces that splitting by the pattern takes out, so lengths add up to places.
    """

    def placed(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>").alias("spans"))

        def add(a: Column, m: Column) -> Column:
            begin = a["at"] + m["gap"]
            span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + F.length(m["whole"])).alias("end"), m["value"].alias("value"))
            return F.struct((begin + F.length(m["whole"])).alias("at"), F.concat(a["spans"], F.array(span)).alias("spans"))

        return F.filter(F.aggregate(parts, start, add)["spans"], lambda s: F.length(s["value"]) >= least)

    gaps, whole, value = (F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                          F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    parts = let(F.struct(gaps.alias("gaps"), value.alias("values"), whole.alias("wholes")), lambda x: F.transform(
        x["wholes"], lambda w, i: F.struct(F.length(F.get(x["gaps"], i)).alias("gap"), w.alias("whole"), F.get(x["values"], i).alias("value"))))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return F.when(likely, let(parts, placed)).otherwise(empty)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start and then kind."""
    assign = _found(text, ASSIGN, 0, text.rlike(ASSIGN), 2, 6)
    access = _found(text, ACCESS, 1, text.contains("AKIA"))
    hexes = _found(text, HEX, 2, text.rlike(HEX))
    return F.array_sort(F.concat(assign, access, hexes))


def _text(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def labelled_samples(docs: DataFrame, sample_docs: int = 20_000, text: str = "text") -> DataFrame:
    """Samples to learn from: `sample` and `label`, 1 for a random string, 0 for an ordinary one.

    Random are values that the fixed patterns name as secrets and that hold a digit. Ordinary are all
    other words of signs that identifiers use. About `sample_docs` documents are read (a bounded
    sample, by hash of the text, for this fit only), so that copies of a text come in together.
    """
    every = max(1, round(docs.count() / sample_docs))
    some = docs.select(_text(text).alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    some = some.withColumn("spans", base_spans(F.col("text")))
    random = some.select(F.explode("spans.value").alias("sample")).filter(F.col("sample").rlike("[0-9]")).distinct()
    known = random.select("sample", F.lit(True).alias("known"))
    words = some.select(F.explode(F.split(F.regexp_replace("text", ASSIGN, " "), SPACE)).alias("sample"))
    words = words.select(F.regexp_extract("sample", r"^[\"'(]*(.*?)[\"').,;:!?]*$", 1).alias("sample")).filter(F.col("sample").rlike(IDENTIFIER)).distinct()
    ordinary = words.join(known, "sample", "left_anti").filter(~F.col("sample").rlike(HEX) & ~F.col("sample").rlike(ACCESS))
    return random.withColumn("label", F.lit(1)).unionByName(ordinary.withColumn("label", F.lit(0)))


def log_ratios(samples: DataFrame) -> list[float]:
    """Of each pair of signs (first * len(SIGNS) + second): log2 of its chance after the first in random
    strings over that in ordinary ones. Order-1 Markov models with one added to each count.

    Null, empty and one-sign samples teach nothing; pairs with other signs are left out. Without
    samples all ratios are 0. The models have len(SIGNS) squared numbers, whatever the data.
    """
    pairs = samples.filter(F.length("sample") >= 2).select("label", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("sample") - 1), lambda i: F.col("sample").substr(i, F.lit(2)))).alias("pair"))
    counts = pairs.filter(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).groupBy("label", "pair").count().collect()  # bounded by the signs
    n = len(SIGNS)
    seen = [[[1.0] * n for _ in range(n)] for _ in range(2)]
    for row in counts:
        if row["label"] in (0, 1):
            seen[row["label"]][SIGNS.index(row["pair"][0])][SIGNS.index(row["pair"][1])] += row["count"]
    ratios = []
    for a in range(n):
        totals = [sum(seen[x][a]) for x in (0, 1)]
        ratios += [math.log2(seen[1][a][b] / totals[1]) - math.log2(seen[0][a][b] / totals[0]) for b in range(n)]
    return ratios


def evidence(value: Column, ratios: list[float]) -> Column:
    """Sum of the log ratios of a candidate's sign pairs, in bits."""
    numbers = [0] * 128
    for i, sign in enumerate(SIGNS):
        numbers[ord(sign)] = i
    place = F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    start = F.struct(F.lit(0.0).alias("bits"), F.lit(-1).alias("last"))

    def add(a: Column, sign: Column) -> Column:
        number = F.get(place, F.ascii(sign))
        gain = F.when(a["last"] < 0, F.lit(0.0)).otherwise(F.get(table, a["last"] * len(SIGNS) + number))
        return F.struct((a["bits"] + gain).alias("bits"), number.alias("last"))

    return F.aggregate(F.split(value, ""), start, add)["bits"]


def with_spans(docs: DataFrame, ratios: list[float], *, text: str = "text", least_bits: float = 24.0, bits_a_sign: float = 1.0, name: str = "spans") -> DataFrame:
    """Adds the column `name`, an array of (start, kind, end, value) by start and kind; one of that name is replaced.

    Spans of the fixed patterns always stay. A run of 20 or more SIGNS that touches none of them is
    a span of kind `random` if the models' evidence reaches `least_bits` and `bits_a_sign` a sign.
    Null and empty texts have no spans.
    """
    whole = _text(text)

    def judged(x: Column) -> Column:
        good = F.filter(x["runs"], lambda s: ~F.exists(x["base"], lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        good = F.filter(good, lambda s: let(evidence(s["value"], ratios), lambda e: (e >= least_bits) & (e >= bits_a_sign * F.length(s["value"]))))
        return F.array_sort(F.concat(x["base"], good))

    runs = _found(whole, CANDIDATE, 3, whole.rlike(CANDIDATE))
    return docs.withColumn(name, let(F.struct(base_spans(whole).alias("base"), runs.alias("runs")), judged))


def report(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and the spans as text, of every row."""
    names = F.array(*[F.lit(k) for k in KINDS])
    written = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    rows = with_spans(docs.select("doc_id", "text"), ratios)
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id", *[number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(written(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, ratios: list[float], mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of `text` replaced by `mark` (spans that overlap by one), and n_chars counted anew where it changed.

    Texts without spans, null ones included, stay as they are.
    """
    whole = F.col("text")

    def rebuilt(spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

        def add(a: Column, s: Column) -> Column:
            apart = s["start"] >= a["at"]
            parts = F.when(apart, F.concat(a["parts"], F.array(F.substring(whole, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))).otherwise(a["parts"])
            return F.struct(F.greatest(a["at"], s["end"]).alias("at"), parts.alias("parts"))

        done = F.aggregate(spans, start, add)
        return let(done, lambda d: F.concat(F.array_join(d["parts"], ""), F.substring(whole, d["at"] + 1, F.length(whole))))

    rows = with_spans(docs, ratios, name="__spans")
    found = F.size("__spans") > 0
    rows = rows.withColumn("text", F.when(found, rebuilt(F.col("__spans"))).otherwise(whole))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(found, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.drop("__spans")
