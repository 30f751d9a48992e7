"""Period labels in every way they are written."""

from datetime import date

from pyspark.sql import functions as F

from ledgerlens.functions import temporal

AS_OF = date(2025, 6, 30)


def test_labels(spark):
    want = {
        "2024": ("actual", date(2024, 12, 31)),
        "FY2024": ("actual", date(2024, 12, 31)),
        "FY 2024": ("actual", date(2024, 12, 31)),
        "FY-2024": ("actual", date(2024, 12, 31)),
        "fy-2026e": ("estimate", date(2026, 12, 31)),
        "Dec-2024": ("actual", date(2024, 12, 31)),
        "Feb 2024": ("actual", date(2024, 2, 29)),
        "Sept 2025": ("projection", date(2025, 9, 30)),
        "Dec 2024F": ("forecast", date(2024, 12, 31)),
        "Q2'24": ("actual", date(2024, 6, 30)),
        "Q5 2024": (None, None),
        "20245": (None, None),
        "": (None, None),
        None: (None, None),
    }
    df = spark.createDataFrame([(k,) for k in want], "t string")
    got = {r.t: tuple(r.p) for r in df.select("t", temporal.parse_label(F.col("t"), F.lit(AS_OF)).alias("p")).collect()}
    assert got == want


def test_labels_nearby(spark):
    want = {"ARR $2M in Dec 2024E, 2023": "Dec 2024E", "ARR $2M Dec-2024": "Dec-2024", "ARR $2M, FY 2024": "FY 2024", "ARR $2M by 2026e": "2026e", "ARR $2M, Q3 2024 of 2023": "Q3 2024", "ARR $2M": None}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.label for r in df.select("t", temporal.nearby_label(F.col("t"), F.lit(5), F.lit(3)).alias("label")).collect()} == want
