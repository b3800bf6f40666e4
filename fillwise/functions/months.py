"""Month labels of forecast sheets."""

from itertools import chain

from pyspark.sql import Column, functions as F

from .clean import squeeze

# English month names in calendar order.
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august",
               "september", "october", "november", "december"]


def _lookup(entries: dict[str, int], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(entries.items())])
    return F.try_element_at(table, key)


def _name_to_number(name: Column) -> Column:
    """Month number of a full name or of its three-letter form."""
    entries = {n: i for i, n in enumerate(MONTH_NAMES, 1)}
    entries |= {n[:3]: i for n, i in list(entries.items())} | {"sept": 9}
    return _lookup(entries, name)


def _first_of(year: Column, month: Column) -> Column:
    return F.when(month.between(1, 12) & year.between(1900, 9999), F.make_date(year, month, F.lit(1)))


def _number(text: Column) -> Column:
    """Whole number, or null for anything but digits."""
    return F.when(text.rlike(r"^\d+$"), text).try_cast("int")


def fiscal_month(name: Column, period: Column) -> Column:
    """Month of a two-row header: a month name under a fiscal period such as ``2026 P01``.

    The fiscal year runs from February to January, so January belongs to the next calendar year.
    """
    short = F.substring(F.lower(F.trim(name)), 1, 3)
    number = _lookup({n[:3]: i for i, n in enumerate(MONTH_NAMES, 1)}, short)
    year = F.regexp_extract(period, r"(?i)\b(\d{4})\s*P\d{1,2}\b", 1).try_cast("int")
    return _first_of(year + F.when(number == 1, 1).otherwise(0), number)


def month_label(header: Column) -> Column:
    """Month named by a whole header cell, or null.

    Understood: ``Jul 2026``, ``2026 July``, ``July-2026``, ``Jul-26``, ``2026-07``, ``2026/07``,
    ``2026-07-01``, ``07/2026``, ``07/01/2026``, ``7/1/26``, ``1-Jul-26``, ``15-Jul-2026``,
    ``July 1, 2026`` and the fiscal ``2026 P06``, each optionally with "forecast", "qty" or the like
    before or after. Labels that merely contain a year ("total 2026", "q1 2026") are no months.
    """
    text = F.regexp_replace(squeeze(F.translate(header, "_,", "  ")),
                            r"^(?:(?:forecast|qty|quantity|month) )+|(?: (?:forecast|qty|quantity))+$", "")
    text = F.regexp_replace(text, r"^(\d{4})p(\d{1,2})$", "$1 p$2")
    return _bind(_bind(F.split(text, r"[ \-/.]+"), _tokens), _month_of_tokens)


def _bind(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, however often `body` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _tokens(parts: Column) -> Column:
    first, second, third = (F.get(parts, F.lit(i)) for i in range(3))
    return F.struct(
        F.size(parts).alias("n"), _name_to_number(first).alias("name"), _name_to_number(second).alias("second_name"),
        _number(first).alias("a"), _number(second).alias("b"), _number(third).alias("c"),
        F.length(first).alias("len_a"), F.length(second).alias("len_b"), F.length(third).alias("len_c"),
        F.when(second.startswith("p"), _number(F.substring(second, 2, 2))).alias("period"),
        third.rlike(r"^\d{1,2}(?:t.*)?$").alias("is_day"))


def _month_of_tokens(t: Column) -> Column:
    a, b, c, name, period = t["a"], t["b"], t["c"], t["name"], t["period"]
    two = (
        F.when(name.isNotNull() & (t["len_b"] == 4), F.struct(b.alias("year"), name.alias("month")))
        .when(name.isNotNull() & (t["len_b"] == 2), F.struct((b + 2000).alias("year"), name.alias("month")))
        .when((t["len_a"] == 4) & period.between(1, 12),
              F.struct((a + F.when(period == 12, 1).otherwise(0)).alias("year"), (period % 12 + 1).alias("month")))
        .when((t["len_a"] == 4) & t["second_name"].isNotNull(), F.struct(a.alias("year"), t["second_name"].alias("month")))
        .when((t["len_a"] == 4) & (t["len_b"] <= 2), F.struct(a.alias("year"), b.alias("month")))
        .when((t["len_b"] == 4) & (t["len_a"] <= 2), F.struct(b.alias("year"), a.alias("month")))
    )
    year = F.when(t["len_c"] == 4, c).when(t["len_c"] == 2, c + 2000)
    found = (
        F.when(t["n"] == 2, two)
        .when((t["n"] == 3) & t["second_name"].isNotNull() & a.between(1, 31) & (t["len_a"] <= 2), F.struct(year.alias("year"), t["second_name"].alias("month")))
        .when((t["n"] == 3) & name.isNotNull() & b.between(1, 31) & (t["len_b"] <= 2), F.struct(year.alias("year"), name.alias("month")))
        .when((t["n"] == 3) & (t["len_c"] == 2) & (t["len_a"] <= 2) & (t["len_b"] <= 2) & b.between(1, 31), F.struct(year.alias("year"), a.alias("month")))
        .when((t["n"] == 3) & (t["len_c"] == 4) & (t["len_a"] <= 2) & (t["len_b"] <= 2),
              F.struct(c.alias("year"), a.alias("month")))
        .when((t["n"] >= 3) & (t["len_a"] == 4) & (t["len_b"] <= 2) & t["is_day"], F.struct(a.alias("year"), b.alias("month")))
    )
    return _bind(found, lambda m: _first_of(m["year"], m["month"]))
