"""Period labels: scenario, period end, granularity, labels near a match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month words, label patterns (Java and RE2 both read them).
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_WORD = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
YEAR = r"^(?i:FY-?)?\s?((?:19|20)[0-9]{2})([EPFepf]?)$"
QUARTER = r"^[Qq]([1-4])['\s]*((?:19|20)?[0-9]{2})([EPFepf]?)$"
MONTH = rf"^(?i:({MONTH_WORD}))\.?[\s-]+((?:19|20)[0-9]{{2}})([EPFepf]?)$"
SCAN_MONTH = rf"(?i)\b(?:{MONTH_WORD})\.?[\s-]+(?:19|20)[0-9]{{2}}[EPF]?\b"
SCAN_QUARTER = r"(?i)\bQ[1-4]['\s]*(?:19|20)?[0-9]{2}[EPF]?\b"
SCAN_YEAR = r"(?i)\b(?:FY[\s-]?)?(?:19|20)[0-9]{2}[EPF]?\b"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once, however often f uses it; inside of
    lambdas Spark computes each use again."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def month_number(word: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(word, 1, 3)))
    return F.nullif(at, F.lit(0)).cast("int")


def suffix_scenario(letter: Column) -> Column:
    u = F.upper(letter)
    return F.when(u == "E", "estimate").when(u == "P", "projection").when(u == "F", "forecast").otherwise("actual")


def parse_label(label: Column, as_of: Column) -> Column:
    """struct(scenario, as_of_date): the end of the labelled period; without a
    suffix a period that ends after as_of is a projection. Nulls if unparseable.
    Months end on their true last day."""

    def read(t: Column) -> Column:
        # The three forms begin differently, so at most one matches.
        part = lambda pattern, n: F.regexp_extract(t, pattern, n)
        quarter_year = once(part(QUARTER, 2), lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y))
        made = lambda end, suffix: F.struct(end.alias("end"), suffix.alias("suffix"))
        year = made(F.make_date(part(YEAR, 1).try_cast("int"), F.lit(12), F.lit(31)), part(YEAR, 2))
        quarter = made(F.last_day(F.make_date(quarter_year.try_cast("int"), part(QUARTER, 1).try_cast("int") * 3, F.lit(1))), part(QUARTER, 3))
        month = made(F.last_day(F.make_date(part(MONTH, 2).try_cast("int"), month_number(part(MONTH, 1)), F.lit(1))), part(MONTH, 3))
        return F.when(t.rlike(YEAR), year).when(t.rlike(QUARTER), quarter).when(t.rlike(MONTH), month)

    def result(p: Column) -> Column:
        scenario = F.when(p["suffix"] != "", suffix_scenario(p["suffix"])).when(p["end"] > as_of, "projection").otherwise("actual")
        return F.struct(F.when(p["end"].isNotNull(), scenario).alias("scenario"), p["end"].alias("as_of_date"))

    return once(once(F.trim(label), read), result)


def granularity(label: Column, default: Column) -> Column:
    return F.when(F.coalesce(F.trim(label).rlike(YEAR), F.lit(False)), F.lit("year")).otherwise(default)


def nearby_label(text: Column, start: Column, length: Column, window: int = 60) -> Column:
    """First month-year, else quarter, else year within window characters of a 1-based match."""
    low = F.greatest(F.lit(1), start - window)
    around = F.substring(text, low, F.least(F.length(text) + 1, start + length + window) - low)

    def first(t: Column, patterns: list[str]) -> Column:
        if not patterns:
            return F.lit(None).cast("string")
        return once(F.regexp_extract(t, patterns[0], 0), lambda m: F.when(m != "", m).otherwise(first(t, patterns[1:])))

    return F.when((F.length(text) > 0) & (length > 0), once(around, lambda t: first(t, [SCAN_MONTH, SCAN_QUARTER, SCAN_YEAR])))


def with_period(df: DataFrame, text: Column, start: Column, length: Column, as_of: Column) -> DataFrame:
    """df with period_label, scenario, as_of_date: all null unless the nearby
    label parses. Two steps, so that the label is looked for once a row."""
    found = df.withColumn("_label", nearby_label(text, start, length)).withColumn("_period", parse_label(F.col("_label"), as_of))
    date = F.col("_period.as_of_date")
    return found.withColumns({"period_label": F.when(date.isNotNull(), F.col("_label")), "scenario": F.col("_period.scenario"), "as_of_date": date}).drop("_label", "_period")


def contract_met(requires: Column, as_of_date: Column, scenario: Column, granularity_: Column) -> Column:
    """Every required field is there."""
    have = F.create_map(F.lit("as_of_date"), as_of_date.isNotNull(), F.lit("scenario"), scenario.isNotNull(), F.lit("period_granularity"), granularity_.isNotNull())
    return F.forall(requires, lambda r: F.coalesce(F.element_at(have, r), F.lit(False)))


def month_end(text: Column) -> Column:
    """Last day of the first 'Month YYYY' in text."""
    pattern = rf"(?i)\b({MONTH_WORD})\.?\s+((?:19|20)[0-9]{{2}})\b"
    return F.last_day(F.make_date(_group(text, pattern, 2).try_cast("int"), month_number(_group(text, pattern, 1)), F.lit(1)))


def year_near(text: Column, start: Column, length: Column, window: int = 120) -> Column:
    low = F.greatest(F.lit(1), start - window)
    around = F.substring(text, low, F.least(F.length(text) + 1, start + length + window) - low)
    return F.nullif(F.regexp_extract(around, r"\b(20[0-9]{2})\b", 1), F.lit(""))
