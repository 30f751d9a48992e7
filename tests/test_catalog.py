"""Statistics without reading data, and each kind of check."""

from pyspark.sql import functions as F

from ledgerlens.sources import catalog as C


def test_statistics_come_from_footers(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "cast(id % 7 as int) as k", "if(id % 10 = 0, null, 'x') as s", "cast(id as double) as `odd name`")
    df.repartition(3).write.parquet(str(tmp_path / "t"))
    got = C.table_statistics(spark, str(tmp_path / "t"), "t")
    assert "PushedAggregation: [COUNT(*)" in got._jdf.queryExecution().toString()
    assert [tuple(r) for r in got.collect()] == [("t", "id", "bigint", 1000, 0, 0, 999), ("t", "k", "int", 1000, 0, 0, 6), ("t", "s", "string", 1000, 100, None, None), ("t", "odd name", "double", 1000, 0, None, None)]
    df.limit(0).write.parquet(str(tmp_path / "empty"))
    assert [tuple(r)[3:] for r in C.table_statistics(spark, str(tmp_path / "empty"), "e").collect()] == [(0, 0, None, None)] * 4
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"  # the caller's session is as before


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "a"), (None, "a"), (None, "a"), (9, None)], "k int, v string")
    other = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id int")
    count = lambda df: df.first().violations
    assert count(C.unique(df, "t", ["k"])) == 2 and count(C.unique(df, "t", ["k", "v"])) == 2
    assert count(C.not_null(df, "t", "k")) == 2 and count(C.among(df, "t", "v", ["a"])) == 1
    assert count(C.references(df, "t", "k", other, "id")) == 1 and count(C.references(df.where("k < 9"), "t", "k", other, "id")) == 0
    assert count(C.unique(df.where(F.lit(False)), "t", ["k"])) == 0
