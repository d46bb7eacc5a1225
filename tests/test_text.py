from pyspark.sql import functions as F

from docaudit.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_fold(spark):
    assert one(spark, T.fold(F.lit("ХТ01"))) == "XT01"
    assert one(spark, T.fold(F.lit("кл01"))) == "КЛ01"
    assert one(spark, T.fold(F.lit(None).cast("string"))) == ""
    assert one(spark, T.fold(F.lit("8000099046"))) != one(spark, T.fold(F.lit("800099046")))


def test_fold_designator(spark):
    assert one(spark, T.fold_designator(F.lit("XA001"))) == one(spark, T.fold_designator(F.lit("XA1"))) == "XA1"


def test_tokens(spark):
    assert "FU1" in one(spark, T.text_tokens(F.lit("CB-10L, FU1")))
    assert "XA19" in one(spark, T.text_tokens(F.lit("XA019,")))


def test_numbers_and_cleaning(spark):
    assert one(spark, T.to_number(F.lit("1,5"))) == 1.5
    assert one(spark, T.to_number(F.lit("many"))) is None
    assert one(spark, T.clean(F.lit("  a   b "))) == "a b"
    assert one(spark, T.clean(F.lit("  "))) is None
    assert one(spark, T.severity_rank(F.lit("critical"))) == 0 and one(spark, T.severity_rank(F.lit("?"))) == 9
    assert one(spark, T.approx_tokens(F.lit(""))) == 1
    assert one(spark, T.clip_text(F.lit("abcdef"), 3)) == "abc..."
