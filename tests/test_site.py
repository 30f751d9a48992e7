"""Each step of the site ladder."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import ground


@pytest.mark.parametrize(
    ("name", "html", "want"),
    [
        ("Acme Robotics", "<p>welcome to ACME ROBOTICS</p>", 1.0),
        ("Acme Robotics", "<TITLE lang='en'> Acme home </title><p>robots</p>", 0.8),
        ("Acme Robotics", "<title>Home</title><p>acme</p>", 0.7),
        ("Zed Acme Robotics", "<title>Home</title><p>robotics by acme</p>", 0.6),
        ("Zed Acme Robotics", "<p>acme</p>", 0.0),
        ("AI Co", "<p>ai and co</p>", 0.0),
        ("", "<p>acme</p>", 0.0),
        (None, "<p>acme</p>", 0.0),
        ("Acme", None, 0.0),
        ("Acme", "x" * 60_000 + " acme", 1.0),
    ],
)
def test_ladder(spark, name, html, want):
    df = spark.createDataFrame([(name, html)], "n string, h string")
    assert df.select(ground.site_confidence(F.col("n"), F.col("h"))).first()[0] == want
