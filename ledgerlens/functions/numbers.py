"""Numbers in text: casts, clamps, money, table cells. All Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multipliers of unit words.
UNITS = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mm": 1e6, "million": 1e6, "b": 1e9, "billion": 1e9}
NUMERIC = r"^-?[0-9]+(\.[0-9]+)?\z"


def to_float(text: Column) -> Column:
    """Best-effort number: null where the trimmed text is none."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), t.try_cast("double"))


def clamp(x: Column) -> Column:
    """1..5; null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(5.0), F.greatest(F.lit(1.0), x)))


def score_of(value: Column, value_type: Column) -> Column:
    """Live semantics: true 5, false 1, score_1_5 clamped, number null, other best effort."""
    v = F.lower(F.trim(value))
    boolean = F.when(v.isin("true", "yes", "1"), 5.0).when(v.isin("false", "no", "0"), 1.0)
    return F.when(value_type == "boolean", boolean).when(value_type == "score_1_5", clamp(to_float(value))).when(value_type == "number", F.lit(None).cast("double")).otherwise(to_float(value))


def view_number(value: Column) -> Column:
    """View semantics: strict number, true 1, false 0, else null."""
    return F.when(value.rlike(NUMERIC), value.try_cast("double")).when(value == "true", 1.0).when(value == "false", 0.0)


def value_text(x: Column) -> Column:
    """Whole numbers without '.0'."""
    return F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(x.cast("string"))


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero on the scaled double, as SQL engines have it. F.round goes by
    the shortest decimal text, so 1.60875, in truth a little less, would go up."""
    return F.round(x * float(10**digits), 0) / float(10**digits)


def within(x: Column, low: Column | None, high: Column | None) -> Column:
    """low <= x <= high, either bound may be null (open)."""
    ok = x.isNotNull()
    if low is not None:
        ok = ok & (low.isNull() | (x >= low))
    if high is not None:
        ok = ok & (high.isNull() | (x <= high))
    return ok


def multiplier(unit: Column) -> Column:
    """Of a unit word; 1 for none, null for an unknown one."""
    u = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    out = F.when(u == "", 1.0)
    for name, factor in UNITS.items():
        out = out.when(u == name, factor)
    return out


def money(amount: Column, unit: Column) -> Column:
    return to_float(F.replace(amount, F.lit(","), F.lit(""))) * multiplier(unit)


def _magnitude(cell: Column) -> Column:
    plain = F.regexp_replace(F.trim(cell), r"[,$\s]", "")
    # Null, and no cast of an empty text: that costs an exception a cell.
    found = F.regexp_extract(plain, r"^\(?-?([0-9]+(?:\.[0-9]+)?)(?:%|[a-zA-Z]+)?\)?\z", 1)
    return F.get(F.transform(F.array(found), lambda x: F.when(x != "", x.try_cast("double"))), F.lit(0))


def matrix_value(metric: Column, cell: Column) -> Column:
    """Cell of a flattened matrix: percents keep their sign (parentheses are
    negative), counts are absolute, money is absolute and in millions."""
    size = _magnitude(cell)
    negative = cell.rlike(r"^\s*(\(|-)")
    signed = F.when(negative, -size).otherwise(size)
    return F.when(metric == "gross_margin", signed).when(metric.isin("customer_count", "employee_count"), size).otherwise(size * 1e6)


def table_cell(cell: Column, metric: Column, units: Column) -> Column:
    """Cell of a table grid in the table's units; null for dashes and non-numbers."""
    size = _magnitude(cell)
    signed = F.when(cell.rlike(r"^\s*(\(|-)"), -size).otherwise(size)
    own = F.when(metric.isin("arr", "revenue", "burn_rate"), "usd_millions").when(metric == "gross_margin", "percent").otherwise("count")
    used = F.when(units == "mixed", own).otherwise(units)
    factor = F.when(used == "usd_millions", 1e6).when(used.isin("usd_thousands", "thousands"), 1e3).otherwise(1.0)
    return F.when((metric == "gross_margin") | cell.contains("%"), signed).when(metric.isin("customer_count", "employee_count"), size).otherwise(size * factor)


def table_units(head: Column) -> Column:
    """Units from the text of a table's first three rows; order matters."""
    t = F.lower(head)
    dollar = t.contains("$")
    return (
        F.when(t.contains("%") | t.contains("margin"), "mixed")
        .when(dollar & t.contains("m"), "usd_millions")
        .when(dollar & (t.contains("k") | t.contains("thousand")), "usd_thousands")
        .when(dollar, "usd")
        .when(t.contains("000") | t.contains("thousand"), "thousands")
        .when(t.contains("m)") | t.contains("usd m") | t.contains("millions"), "usd_millions")
        .otherwise("mixed")
    )


def first_int(text: Column) -> Column:
    """First integer of a range like '11-50'; null unless positive."""
    n = F.regexp_extract(text, "([0-9]+)", 1).try_cast("bigint")
    return F.when(n > 0, n)
