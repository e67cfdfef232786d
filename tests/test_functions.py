from pyspark.sql import functions as F

from quayline.functions import blank_to_null, clock_secs, clock_text, gtfs_date, half_up, is_digits, pct


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_clock_parse_keeps_hours_past_midnight(spark):
    assert one(spark, clock_secs(F.lit("24:10:00"))) == 87000
    assert one(spark, clock_secs(F.lit(" 07:05:09 "))) == 7 * 3600 + 5 * 60 + 9
    assert one(spark, clock_secs(F.lit("7:05:09"))) is None
    assert one(spark, clock_secs(F.lit("ab:cd:ef"))) is None


def test_clock_text_round_trip(spark):
    assert one(spark, clock_text(F.lit(87000))) == "24:10:00"
    assert one(spark, clock_secs(clock_text(F.lit(172799)))) == 172799


def test_blank_and_digits(spark):
    assert one(spark, blank_to_null(F.lit("   "))) is None
    assert one(spark, blank_to_null(F.lit(" a "))) == "a"
    assert one(spark, is_digits(F.lit(" 12 "))) == 1
    assert one(spark, is_digits(F.lit("abc"))) == 0
    assert one(spark, is_digits(F.lit(None).cast("string"))) == 0


def test_gtfs_date(spark):
    assert str(one(spark, gtfs_date(F.lit(" 20250106")))) == "2025-01-06"
    assert one(spark, gtfs_date(F.lit("20251345"))) is None
    assert one(spark, gtfs_date(F.lit("2025-01-06"))) is None


def test_half_up_rounding(spark):
    assert one(spark, half_up(F.lit(2.5), 0)) == 3.0
    assert one(spark, half_up(F.lit(-2.5), 0)) == -3.0
    assert one(spark, half_up(F.lit(0.125), 2)) == 0.13
    assert one(spark, pct(F.lit(1), F.lit(3), 2)) == 33.33
    assert one(spark, pct(F.lit(1), F.lit(0), 2)) is None
