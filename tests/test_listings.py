import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from matchbook.functions import columns as fx
from matchbook.operators import listings as prep
from matchbook.operators import profile
from matchbook.operators.metrics import error_report, regression_metrics
from matchbook.sources import LISTING_SCHEMA


def values(spark, cells, data_type, make):
    df = spark.createDataFrame([(c,) for c in cells], f"x {data_type}")
    return [r[0] for r in df.select(make("x")).collect()]


def test_price_text(spark):
    cells = ["12", "", "1.2.3", "$1,200.50", "-7", None]
    found = values(spark, cells, "string", fx.amount_from_text)
    assert found == [12.0, None, None, 1200.5, 7.0, None]


def test_price_filter(spark):
    cells = ["12", "", "1.2.3", "$1,200.50", "-7", None, "$10", "1000"]
    df = spark.createDataFrame([(c,) for c in cells], "price string")
    kept = prep.clean_prices(df).filter(fx.within("price", *prep.PRICE_RANGE))
    assert [r[0] for r in kept.collect()] == [12.0, 10.0, 1000.0]


def test_default_stands_for_null_only(spark):
    found = values(
        spark, ["3", None, "n/a", ""], "string", lambda c: fx.default_when_null(c, "int", 0)
    )
    assert found == [3, 0, None, None]


def test_names_and_keys(spark):
    df = spark.createDataFrame([("A", "B"), (None, "B"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(fx.full_name("a", "b")).collect()] == ["A B", "B", ""]
    assert [r[0] for r in df.select(fx.composite_key("a", "b")).collect()] == ["A_B", "B", ""]


def test_ratio_and_flag(spark):
    df = spark.createDataFrame([(6, 3.0), (6, 0.0), (None, 2.0), (6, None)], "n int, d double")
    assert [r[0] for r in df.select(fx.ratio_or_zero("n", "d")).collect()] == [2.0, 0.0, None, 0.0]
    assert values(spark, [2, 0, None], "int", fx.positive_flag) == [1.0, 0.0, 0.0]
    assert values(spark, [-1.0], "double", F.log1p) == [None]


def test_missing_values_of_any_type(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0), (None, "", None), (3, None, 2.0)], "i int, s string, d double"
    )
    assert rows(profile.missing_census(df)) == [
        ("i", "int", 1),
        ("s", "string", 2),
        ("d", "double", 1),
    ]


def test_describe(spark):
    df = spark.createDataFrame([(1, "b"), (3, "a"), (None, None)], "i int, s string")
    number, text = profile.describe(df).collect()
    assert tuple(number) == ("i", 2, 2.0, pytest.approx(math.sqrt(2)), 1.0, 3.0, None, None)
    assert tuple(text) == ("s", 2, None, None, None, None, "a", "b")


def test_shape_and_preview(spark):
    df = spark.range(7).withColumn("x", F.lit(1))
    assert rows(profile.table_shape(df)) == [(7, 2)]
    assert [r["id"] for r in profile.preview(df, ["id"], 3).collect()] == [0, 1, 2]


LISTING = dict(
    id="1",
    host_id="9",
    neighbourhood_group="x",
    neighbourhood="North",
    room_type="Private",
    latitude="1.5",
    longitude=None,
    price="$100",
    minimum_nights=None,
    number_of_reviews="8",
    reviews_per_month=None,
    calculated_host_listings_count=None,
    availability_365="4",
)


def prepared(spark, *changes):
    listings = [tuple({**LISTING, **c}[k] for k in LISTING_SCHEMA) for c in changes]
    ddl = ", ".join(f"{k} string" for k in LISTING_SCHEMA)
    return prep.prepare_listings(spark.createDataFrame(listings, ddl))


def test_prepare_listing(spark):
    row = prepared(spark, {}).first().asDict()
    assert row["id"] == "9_1"
    assert row["label"] == pytest.approx(math.log(100))
    assert (row["latitude"], row["longitude"]) == (1.5, 0.0)
    assert row["minimum_nights"] is None and row["log_minimum_nights"] is None
    assert (row["number_of_reviews"], row["reviews_per_month"]) == (8, 0.0)
    assert row["calculated_host_listings_count"] == 1.0
    assert row["reviews_per_availability"] == 2.0
    assert row["log_availability"] == pytest.approx(math.log(5))
    assert "price" not in row and "host_id" not in row


def test_prepare_drops_unusable_rows(spark):
    kept = prepared(
        spark,
        {},
        {"price": "$9.99"},
        {"price": "1000.01"},
        {"price": "free"},
        {"neighbourhood": None},
        {"neighbourhood": ""},
        {"room_type": ""},
        {"room_type": None},
    )
    assert kept.count() == 1


def test_split_covers_and_does_not_depend_on_partitions(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("id"))
    training, test = prep.split(df)
    assert training.count() + test.count() == 5000
    assert training.join(test, "id").count() == 0
    assert 3800 < training.count() < 4200
    again, _ = prep.split(df.repartition(7))
    assert again.exceptAll(training).count() == 0
    folds = rows(df.groupBy(prep.fold_number()).count())
    assert len(folds) == 5 and all(850 < n < 1150 for _, n in folds)


def test_metrics_match_spark(spark):
    from pyspark.ml.evaluation import RegressionEvaluator

    scored = spark.createDataFrame(
        [(1.0, 1.5), (2.0, 1.75), (4.0, 3.0), (3.0, 3.5)], "label double, prediction double"
    )
    found = regression_metrics(scored).first().asDict()
    for scale, suffix in ((scored, ""), (scored.select(F.exp("label").alias("label"), F.exp("prediction").alias("prediction")), "_original")):
        for metric in ("rmse", "r2", "mae"):
            expected = RegressionEvaluator(labelCol="label", metricName=metric).evaluate(scale)
            assert found[metric + suffix] == pytest.approx(expected)


def test_error_report(spark):
    scored = spark.createDataFrame(
        [(math.log(100.0), math.log(150.0))], "label double, prediction double"
    )
    assert rows(error_report(scored))[0] == pytest.approx((100.0, 150.0, 50.0, 50.0))
