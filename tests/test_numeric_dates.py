import datetime as dt

from pyspark.sql import functions as F

from orderscope.functions import dates as Dt
from orderscope.functions.numeric import exact_double, round_half_even


def test_round_half_even_matches_numpy(spark):
    # FIXTURES "rounding": 2.675 -> 2.68, 0.125 -> 0.12, 1.005 -> 1.0
    df = spark.createDataFrame([(2.675,), (0.125,), (1.005,)], "x double")
    got = [r[0] for r in df.select(round_half_even("x", 2)).collect()]
    assert got == [2.68, 0.12, 1.0]


def test_exact_double_is_correctly_rounded(spark):
    vals = [0, 1, -5, 2 ** 53 + 1, 2 ** 70 + 12345, -(2 ** 80 + 7), 123456789012345678901234]
    df = spark.createDataFrame([(str(v),) for v in vals], "s string")
    got = [r[0] for r in df.select(exact_double(F.col("s").cast("decimal(38,0)"))).collect()]
    assert got == [float(v) for v in vals]


def test_iso_week_year_end(spark):
    # FIXTURES "iso_year_end": 2024-12-30 is ISO week 1
    df = spark.createDataFrame([(dt.date(2024, 12, 30),)], "d date")
    r = Dt.time_features(df, "d").collect()[0]
    assert r.week == 1 and r.day_of_week == "Monday" and r.quarter == "2024Q4"
    assert r.month_name == "Dec" and r.year_month == dt.date(2024, 12, 1) and r.is_weekend is False


def test_weekend_flag_and_month_diff(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 2), dt.date(2023, 11, 15))], "a date, b date")
    r = df.select(Dt.is_weekend("a").alias("w"), Dt.month_diff("a", "b").alias("m")).collect()[0]
    assert r.w is True and r.m == 4
