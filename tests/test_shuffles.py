"""What is moved between tasks: narrow rows, put together before they move."""

from pyspark.sql import functions as F

from pricewright.catalog import LINE, Catalog
from pricewright.functions import display, text
from pricewright.operators import history, identity, offers


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_offers_move_only_columns_of_the_line(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    assert c.latest_points().columns == LINE
    assert plan(c.latest_points()).count("Exchange") == 1  # the rows of a product and store are in one task before they are sorted
    assert c.offers.groupBy("product_id", "store_id").count().where("count > 1").count() == 0


def test_two_offers_of_a_product_leave_a_task(spark, sf_dir):
    assert "WindowGroupLimit" in plan(offers.best_offers(Catalog(spark, sf_dir)))


def test_days_are_put_together_before_they_move(spark):
    rows = [("a", "1", 5, "2001-10-01 08:00:00", 1, 1), ("a", "1", 7, "2001-10-01 09:00:00", 1, 2), ("a", "1", 3, "2001-10-03 09:00:00", 2, 1), ("a", "2", 4, "2001-10-02 00:00:00", 3, 1)]
    points = spark.createDataFrame(rows, "product_id string, store_id string, ngn long, recorded_at string, order_no long, line_no int").withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    series = history.price_timeseries(points)
    got = {str(r.day): (r.low_ngn, r.n_stores) for r in series.collect()}
    assert (got["2001-10-01"], got["2001-10-02"], got["2001-10-03"]) == ((7, 1), (4, 2), (3, 2)) and len(got) == 23
    assert "SortAggregate" not in plan(series)


def test_titles_are_dealt_to_all_tasks(spark, sf_dir):
    """The file of products is one split, the work on its titles is not."""
    c = Catalog(spark, sf_dir)
    assert c.products.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism <= identity.spelled(c).rdd.getNumPartitions()
    assert identity.identified(c).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_title_is_worked_on_once(spark):
    title = spark.createDataFrame([("Samsung Galaxy A10 Plus",)], "t string")
    steps = lambda made: title.select(made(F.col("t")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert steps(text.variant_tokens).count("lower(") == 1
    assert steps(display.friendly_chip).count("split(") == 2 and steps(display.friendly_chip).count("rtrim(") + steps(display.friendly_chip).count("trim(trailing") <= 4
