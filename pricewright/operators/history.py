"""Price history: carry-forward series, lows, alerts, snapshots and change capture."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewright.catalog import AS_OF, Catalog, as_of, days_before, sql
from pricewright.session import refresh


def price_timeseries(points: DataFrame, at: str = AS_OF, days_back: int = 90, carry: int = 21) -> DataFrame:
    """Cheapest price by product and day, each observation carried for ``carry`` days.

    Instead of a range join with a day spine, an observation explodes to the
    days it stands for: until the next one of its offer, clipped to the spine.
    So an offer has one row a day at most, and days are put together by
    partial aggregation. Days without a live observation have no row.
    """
    last, first = F.to_date(as_of(at)), F.date_sub(F.to_date(as_of(at)), days_back)
    seen = points.withColumn("obs", F.to_date("recorded_at")).where((F.col("obs") > F.date_sub(first, carry)) & (F.col("obs") <= last))
    by = Window.partitionBy("product_id", "store_id").orderBy("recorded_at", "order_no", "line_no")
    held = seen.select("product_id", "store_id", "ngn", "obs", F.date_sub(F.lead("obs").over(by), 1).alias("until"))
    held = held.withColumns({"from": F.greatest("obs", first), "to": F.least("until", F.date_add("obs", carry - 1), last)}).where(F.col("from") <= F.col("to"))
    daily = held.select("product_id", "store_id", "ngn", F.explode(F.sequence("from", "to")).alias("day"))
    return daily.groupBy("product_id", "day").agg(F.min("ngn").alias("low_ngn"), F.count("store_id").alias("n_stores"))


def pending_alerts(c: Catalog) -> DataFrame:
    """Alerts of customers whose product is now on offer at or below their target, with that offer.

    Only the cheapest offer of a product by country of its store meets the
    alerts: rows are alerts times countries, not times offers.
    """
    alerts = c.table("customer").select(
        F.col("c_custkey").alias("alert_id"),
        F.col("c_custkey").cast("string").alias("product_id"),
        (F.floor(F.abs("c_acctbal")) * 165_000).alias("target_ngn"),
        F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string"))).alias("wanted"),
    )
    named = F.struct("ngn", "offer_id", "store_name").alias("b")
    offers = c.live.join(c.stores, "store_id").groupBy("product_id", F.lower("country").alias("country"), "is_international").agg(F.min(named).alias("b"))
    reach = F.col("wanted").isNull() | F.coalesce(F.col("country") == F.col("wanted"), F.col("is_international"))
    best = (
        alerts.join(offers, "product_id")
        .where(reach)
        .groupBy("alert_id", "product_id", "target_ngn")
        .agg(F.min("b").alias("b"))
    )
    return best.select("alert_id", "product_id", "target_ngn", "b.ngn", "b.offer_id", "b.store_name").where("ngn <= target_ngn")


def capture_changes(points: DataFrame) -> DataFrame:
    """Points where price or currency differ from the one before at the store; the first counts."""
    by = Window.partitionBy("product_id", "store_id").orderBy("recorded_at", "order_no", "line_no")
    now, old = F.struct("cents", "currency"), F.lag(F.struct("cents", "currency")).over(by)
    return points.withColumn("before", old).where(F.col("before").isNull() | ~now.eqNullSafe(F.col("before"))).drop("before")


def q_price_timeseries(spark, sf_dir):
    return price_timeseries(Catalog(spark, sf_dir).points).withColumn("day", F.col("day").cast("string"))


def q_price_history_by_store(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    early = F.struct("cents", "recorded_at", "order_no", "line_no")
    late = F.struct("recorded_at", "order_no", "line_no")
    return c.points.groupBy("product_id", "store_id", "currency").agg(
        F.min("cents").alias("low"), F.min_by("recorded_at", early).alias("low_at"), F.max_by("cents", late).alias("latest"), F.max("recorded_at").alias("latest_at")
    )


def q_offers_at_30d_low(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    low = c.points.where(F.col("recorded_at") > days_before(30)).groupBy("product_id").agg(F.min("ngn").alias("low"), F.countDistinct("store_id").alias("n_stores"))
    return c.live.join(low.where("n_stores >= 2"), "product_id").where("ngn * 100 <= low * 101").select("offer_id", "ngn", "low", "n_stores")


def q_pending_alerts(spark, sf_dir):
    return pending_alerts(Catalog(spark, sf_dir))


def q_snapshot_prices(spark, sf_dir):
    """Live offers without a point of their store in the last six days."""
    c = Catalog(spark, sf_dir)
    recent = c.points.where(F.col("recorded_at") > days_before(6)).select("product_id", "store_id")
    return c.live.join(recent, ["product_id", "store_id"], "left_anti").select("offer_id", "cents", "currency")


def q_seed_missing_history(spark, sf_dir):
    """Offers that have no change of price on record, once seeded with their first."""
    c = Catalog(spark, sf_dir)
    n = c.points.groupBy("offer_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("offer_id")
    return c.offers.join(n, "offer_id", "left_anti").select("offer_id", "cents", "recorded_at")


def q_cdc_price(spark, sf_dir):
    return capture_changes(Catalog(spark, sf_dir).points).select("offer_id", "cents", "currency", "recorded_at", "order_no", "line_no")


def q_cdc_stock(spark, sf_dir):
    """Flips between in and out of stock; the first state is none."""
    by = Window.partitionBy("product_id", "store_id").orderBy("recorded_at", "order_no", "line_no")
    rows = Catalog(spark, sf_dir).points.withColumn("from_state", F.lag("in_stock").over(by))
    return rows.where("from_state <> in_stock").select("offer_id", "from_state", F.col("in_stock").alias("to_state"), "recorded_at", "order_no", "line_no")


def q_purge_corrupt_history(spark, sf_dir):
    """Points of at least a tenth of the current price stay."""
    c = Catalog(spark, sf_dir)
    now = c.offers.select("offer_id", F.col("ngn").alias("now_ngn"))
    return c.points.join(now, "offer_id").where("ngn * 10 >= now_ngn").groupBy("product_id").agg(F.count(F.lit(1)).alias("n_kept"))


def q_retention_prune(spark, sf_dir):
    """What the stored history holds by store after rows of more than 90 days are deleted."""
    kept = refresh(f"{sf_dir}/history", Catalog(spark, sf_dir).points.where(F.col("recorded_at") > days_before(90)))
    return kept.groupBy("store_id").agg(F.count(F.lit(1)).alias("n_kept"))


def q_coverage_bands(spark, sf_dir):
    days = Catalog(spark, sf_dir).points.groupBy("product_id").agg(F.countDistinct(F.to_date("recorded_at")).alias("days"))
    return days.agg(*(F.count_if(F.col("days") >= n).alias(f"at_least_{n}") for n in (2, 7, 30, 90)))


def q_lowest_in_window(spark, sf_dir):
    """Lowest, highest and when, of products that two stores sold in the window."""
    rows = Catalog(spark, sf_dir).points.where(F.col("recorded_at") > days_before(90))
    return (
        rows.groupBy("product_id")
        .agg(F.min("ngn").alias("low"), F.max("ngn").alias("high"), F.min_by("recorded_at", F.struct("ngn", "recorded_at")).alias("low_at"), F.countDistinct("store_id").alias("n_stores"))
        .where("n_stores >= 2")
    )


def q_sweep_ttl(spark, sf_dir):
    """Offers not seen for 14 days go out of stock, at stores seen since."""
    c = Catalog(spark, sf_dir)
    touched = c.points.where(F.col("recorded_at") > days_before(14)).select("store_id").distinct()
    stale = F.col("recorded_at") <= days_before(14)
    return c.live.join(touched, "store_id", "left_semi").groupBy("store_id").agg(F.count_if(stale).alias("n_swept"), F.count_if(~stale).alias("n_left"))


def q_sweep_full(spark, sf_dir):
    """Offers that the newest batch of a store left out, where the batch is large enough to trust."""
    c = Catalog(spark, sf_dir)
    batch = F.count_if(F.col("recorded_at") > days_before(180))
    n = c.live.groupBy("store_id").agg(batch.alias("n_batch"), F.count(F.lit(1)).alias("n_current"))
    return n.withColumn("swept", F.when((F.col("n_batch") >= 10) & (F.col("n_batch") * 10 >= F.col("n_current") * 4), F.col("n_current") - F.col("n_batch")).otherwise(0))


def q_freshness_tier(spark, sf_dir):
    age = F.datediff(F.to_date(as_of()), F.to_date("recorded_at"))
    tier = F.when(age < 3, "fresh").when(age < 7, "recent").when(age < 30, "month").otherwise("old")
    return Catalog(spark, sf_dir).offers.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.min(age).alias("youngest"), F.max(age).alias("oldest"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
NOW = "TIMESTAMP '2001-11-05'"
SEQ = "recorded_at, order_no, line_no"
ORACLES = {
    "price_timeseries": sql(
        """SELECT product_id, day::VARCHAR AS day, min(ngn) AS low_ngn, count(DISTINCT store_id) AS n_stores FROM (
        SELECT day, product_id, store_id, ngn, row_number() OVER (PARTITION BY day, product_id, store_id ORDER BY recorded_at DESC, order_no DESC, line_no DESC) AS rn
        FROM spine JOIN points ON recorded_at::DATE <= day AND recorded_at::DATE > day - 21) WHERE rn = 1 GROUP BY 1, 2""",
        "spine AS (SELECT unnest(generate_series(DATE '2001-11-05' - 90, DATE '2001-11-05', INTERVAL 1 DAY))::DATE AS day)",
    ),
    "price_history_by_store": sql(
        f"""SELECT product_id, store_id, currency, min(cents) AS low, first(recorded_at ORDER BY cents, {SEQ}) AS low_at,
        last(cents ORDER BY {SEQ}) AS latest, max(recorded_at) AS latest_at FROM points GROUP BY 1, 2, 3"""
    ),
    "offers_at_30d_low": sql(
        f"""SELECT offer_id, ngn, low, n_stores FROM live JOIN (SELECT product_id, min(ngn) AS low, count(DISTINCT store_id) AS n_stores FROM points
        WHERE recorded_at > {NOW} - INTERVAL 30 DAY GROUP BY 1) USING (product_id) WHERE n_stores >= 2 AND ngn * 100 <= low * 101"""
    ),
    "pending_alerts": sql(
        """SELECT alert_id, product_id, target_ngn, ngn, offer_id, store_name FROM (
        SELECT a.*, o.ngn, o.offer_id, store_name, row_number() OVER (PARTITION BY alert_id ORDER BY o.ngn, o.offer_id) AS rn FROM alerts a JOIN live o USING (product_id) JOIN stores USING (store_id)
        WHERE wanted IS NULL OR coalesce(lower(country) = wanted, is_international)) WHERE rn = 1 AND ngn <= target_ngn""",
        """alerts AS (SELECT c_custkey AS alert_id, c_custkey::VARCHAR AS product_id, floor(abs(c_acctbal))::BIGINT * 165000 AS target_ngn, CASE WHEN c_nationkey % 2 = 0 THEN 'nation_' || c_nationkey END AS wanted FROM customer)""",
    ),
    "snapshot_prices": sql(
        f"SELECT offer_id, cents, currency FROM live l WHERE NOT EXISTS (SELECT 1 FROM points p WHERE p.product_id = l.product_id AND p.store_id = l.store_id AND p.recorded_at > {NOW} - INTERVAL 6 DAY)"
    ),
    "seed_missing_history": sql("SELECT offer_id, cents, recorded_at FROM offers WHERE offer_id NOT IN (SELECT offer_id FROM points GROUP BY 1 HAVING count(*) > 1)"),
    "cdc_price": sql(
        f"""SELECT offer_id, cents, currency, recorded_at, order_no, line_no FROM (SELECT *, row_number() OVER w AS rn, lag(cents) OVER w AS pc, lag(currency) OVER w AS pk FROM points
        WINDOW w AS (PARTITION BY product_id, store_id ORDER BY {SEQ})) WHERE rn = 1 OR cents IS DISTINCT FROM pc OR currency IS DISTINCT FROM pk"""
    ),
    "cdc_stock": sql(
        f"SELECT offer_id, from_state, in_stock AS to_state, {SEQ} FROM (SELECT *, lag(in_stock) OVER (PARTITION BY product_id, store_id ORDER BY {SEQ}) AS from_state FROM points) WHERE from_state <> in_stock"
    ),
    "purge_corrupt_history": sql("SELECT p.product_id, count(*) AS n_kept FROM points p JOIN offers o USING (offer_id) WHERE p.ngn * 10 >= o.ngn GROUP BY 1"),
    "retention_prune": sql(f"SELECT store_id, count(*) AS n_kept FROM points WHERE recorded_at > {NOW} - INTERVAL 90 DAY GROUP BY 1"),
    "coverage_bands": sql(
        "SELECT " + ", ".join(f"count(*) FILTER (WHERE days >= {n}) AS at_least_{n}" for n in (2, 7, 30, 90)) + " FROM (SELECT product_id, count(DISTINCT recorded_at::DATE) AS days FROM points GROUP BY 1)"
    ),
    "lowest_in_window": sql(
        f"""SELECT product_id, min(ngn) AS low, max(ngn) AS high, first(recorded_at ORDER BY ngn, recorded_at) AS low_at, count(DISTINCT store_id) AS n_stores FROM points
        WHERE recorded_at > {NOW} - INTERVAL 90 DAY GROUP BY 1 HAVING count(DISTINCT store_id) >= 2"""
    ),
    "sweep_ttl": sql(
        f"""SELECT store_id, count(*) FILTER (WHERE recorded_at <= {NOW} - INTERVAL 14 DAY) AS n_swept, count(*) FILTER (WHERE recorded_at > {NOW} - INTERVAL 14 DAY) AS n_left FROM live
        WHERE store_id IN (SELECT store_id FROM points WHERE recorded_at > {NOW} - INTERVAL 14 DAY) GROUP BY 1"""
    ),
    "sweep_full": sql(
        f"""SELECT *, CASE WHEN n_batch >= 10 AND n_batch * 10 >= n_current * 4 THEN n_current - n_batch ELSE 0 END AS swept FROM (
        SELECT store_id, count(*) FILTER (WHERE recorded_at > {NOW} - INTERVAL 180 DAY) AS n_batch, count(*) AS n_current FROM live GROUP BY 1)"""
    ),
    "freshness_tier": sql(
        """SELECT CASE WHEN age < 3 THEN 'fresh' WHEN age < 7 THEN 'recent' WHEN age < 30 THEN 'month' ELSE 'old' END AS tier, count(*) AS n, min(age)::INT AS youngest, max(age)::INT AS oldest
        FROM (SELECT DATE '2001-11-05' - recorded_at::DATE AS age FROM offers) GROUP BY 1"""
    ),
}
