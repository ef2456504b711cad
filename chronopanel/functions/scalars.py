"""Scalar expressions: calendar periods, text parsing, small numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FREQUENCIES = ("D", "M", "Q", "Y")


def check_frequency(freq: str) -> str:
    if freq not in FREQUENCIES:
        raise ValueError(f"frequency must be one of {FREQUENCIES}, got {freq!r}")
    return freq


def period_index(date: Column, freq: str) -> Column:
    """Consecutive integer number of the period holding ``date``."""
    check_frequency(freq)
    if freq == "D":
        return F.unix_date(date)
    if freq == "M":
        return F.year(date) * 12 + F.month(date) - 1
    if freq == "Q":
        return F.year(date) * 4 + F.quarter(date) - 1
    return F.year(date)


def period_end(index: Column, freq: str) -> Column:
    """Last day of the period with that number."""
    check_frequency(freq)
    if freq == "D":
        return F.date_from_unix_date(index)
    if freq == "M":
        return F.last_day(F.make_date((F.floor(index / 12)).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"), F.lit(1)))
    if freq == "Q":
        return F.last_day(F.make_date((F.floor(index / 4)).cast("int"), (F.pmod(index, F.lit(4)) * 3 + 3).cast("int"), F.lit(1)))
    return F.make_date(index.cast("int"), F.lit(12), F.lit(31))


def year_to_date(year: Column) -> Column:
    return F.make_date(year.cast("int"), F.lit(1), F.lit(1))


def year_end(date: Column) -> Column:
    return F.make_date(F.year(date), F.lit(12), F.lit(31))


def add_years(date: Column, years: int) -> Column:
    """Calendar shift; Feb 29 clamps to Feb 28."""
    return F.add_months(date, 12 * years)


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def normalise_alias(alias: Column) -> Column:
    """Frequency alias of any spelling (MS, ME, QS-OCT, A-DEC, ...) to D, M, Q, Y or Unknown."""
    upper = F.upper(alias)
    return (
        F.when(upper.startswith("D"), "D")
        .when(upper.startswith("M"), "M")
        .when(upper.startswith("Q"), "Q")
        .when(upper.startswith("Y") | upper.startswith("A"), "Y")
        .otherwise("Unknown")
    )


def gap_frequency(gap: Column) -> Column:
    """Frequency label of a typical day gap."""
    return (
        F.when(gap == 1, "D")
        .when(gap.between(28, 31), "M")
        .when(gap.between(89, 92), "Q")
        .when(gap.between(365, 366), "Y")
        .otherwise("Unknown")
    )


def gap_tolerance(gap: Column) -> Column:
    """Day slack allowed around a typical gap when checking that dates are consecutive."""
    return (
        F.when(gap == 1, 1)
        .when(gap.between(28, 31), 3)
        .when(gap.between(89, 92), 3)
        .when(gap.between(365, 366), 1)
        .otherwise(F.greatest(F.lit(1), F.floor(gap / 10).cast("int")))
    )


def finite_or_null(x: Column) -> Column:
    inf = float("inf")
    return F.when(~x.isin(inf, -inf) & ~F.isnan(x), x)


def ratio(num: Column, den: Column) -> Column:
    """Division that yields NULL on a zero denominator."""
    return F.try_divide(num, den)


def split_topics(text: Column) -> Column:
    """Comma list to trimmed, non-empty topics."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.trim(t))
    return F.filter(parts, lambda t: t != "")


def name_before_dash(name: Column) -> Column:
    """Series title up to the first en dash."""
    return F.trim(F.element_at(F.split(name, "–"), 1))


def parse_dimensions(text: Column) -> Column:
    """Dict literal to MAP<STRING,STRING>, strings in either kind of quotes; NULL when it is not one."""
    return F.from_json(text, "map<string,string>", {"allowSingleQuotes": "true"})


def without_key(mapping: Column, key: str) -> Column:
    return F.map_filter(mapping, lambda k, v: k != key)


def dimensions_text(mapping: Column) -> Column:
    """MAP back to a dict literal, keys in their own order; a value with an apostrophe stands in double quotes."""
    quote = lambda v: F.when(v.contains("'"), F.lit('"')).otherwise(F.lit("'"))
    items = F.transform(
        F.map_entries(mapping),
        lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), quote(e["value"]), e["value"], quote(e["value"])),
    )
    return F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}"))


def generic_series_code(code: Column, dimensions: Column) -> Column:
    """SUBJECT.MEASURE.FREQUENCY from the dimensions, else parts 1, 3, 4 of the code, else the code."""
    parts = F.split(code, r"\.")
    from_code = F.when(
        F.size(parts) >= 4,
        F.concat_ws(".", F.element_at(parts, 1), F.try_element_at(parts, F.lit(3)), F.try_element_at(parts, F.lit(4))),
    ).otherwise(code)
    dims = parse_dimensions(dimensions)
    part = lambda k: F.coalesce(F.try_element_at(dims, F.lit(k)), F.lit(""))
    from_dims = F.concat_ws(".", part("SUBJECT"), part("MEASURE"), part("FREQUENCY"))
    return F.when(dims.isNotNull(), from_dims).otherwise(from_code)


def experiment_parts(experiment: Column, method: Column) -> dict[str, Column]:
    """Fields of ``'Train A + Train B, Test'`` and ``'Method [Group]'`` labels."""
    sides = F.split(experiment, ", ")
    train = F.element_at(sides, 1)
    group = F.regexp_extract(method, r"\[([^\]]*)\]", 1)
    has_group = method.contains("[") & method.contains("]")
    return {
        "train_market": F.when(train.contains("+"), "Mixed").when(train.contains("Developed"), "Developed").otherwise("Emerging"),
        "test_market": F.when(F.try_element_at(sides, F.lit(2)) == "Developed", "Developed").otherwise("Emerging"),
        "method_name": F.when(has_group, F.trim(F.element_at(F.split(method, r"\["), 1))).otherwise(method),
        "method_group": F.when(has_group, group).otherwise("ungrouped"),
    }
