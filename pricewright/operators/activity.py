"""Clicks, searches and operational counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewright.catalog import EVENTS_AS_OF, Catalog, as_of, days_before, sql


def popular_products(c: Catalog, days: int = 14) -> DataFrame:
    """Clicks by product; a click names an offer or a product and counts if either exists."""
    offers = c.offers.select(F.col("offer_id").alias("deal_id"), F.col("product_id").alias("by_offer"))
    products = c.products.select(F.col("product_id").alias("deal_id"), F.col("product_id").alias("by_product"))
    clicks = c.clicks.where(F.col("clicked_at") > days_before(days, EVENTS_AS_OF))
    found = clicks.join(offers, "deal_id", "left").join(products, "deal_id", "left")
    return found.withColumn("product_id", F.coalesce("by_offer", "by_product")).where("product_id is not null").groupBy("product_id").agg(F.count(F.lit(1)).alias("n_clicks"))


def _number_windows(seconds: int):
    """Rows sorted by user and time get the number of their window; what a user's last window holds is carried on."""
    wide = seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, start, no = None, 0, 0
        for batch in batches:
            users = batch.column("user_id").to_numpy(zero_copy_only=False)
            times = batch.column("t").to_numpy(zero_copy_only=False)
            out = np.zeros(len(users), np.int32)
            cuts = np.append(np.flatnonzero(np.append(True, users[1:] != users[:-1])), len(users)) if len(users) else []
            for at, end in zip(cuts[:-1], cuts[1:]):
                if users[at] != user:
                    user, start, no = users[at], times[at], 1
                while at < end:  # a step for each window
                    if times[at] >= start + wide:
                        start, no = times[at], no + 1
                    to = at + int(np.searchsorted(times[at:end], start + wide))
                    out[at:to] = no
                    at = to
            yield pa.RecordBatch.from_arrays([batch.column("user_id"), batch.column("event_id"), pa.array(out)], names=["user_id", "event_id", "window_no"])

    return run


def fixed_windows(events: DataFrame, seconds: int) -> DataFrame:
    """Number each user's events by windows that begin with the first event outside the one before.

    Such windows depend on all before them, so a user's rows stream through in
    the order of their times; none are held. Rows without user or time have none.
    """
    rows = events.where("user_id is not null and ts is not null").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    types = dict(rows.dtypes)
    sorted_ = rows.repartition("user_id").sortWithinPartitions("user_id", "t", "event_id")
    return sorted_.mapInArrow(_number_windows(seconds), f"user_id {types['user_id']}, event_id {types['event_id']}, window_no int")


def q_popular_products(spark, sf_dir):
    return popular_products(Catalog(spark, sf_dir))


def q_popularity_rerank(spark, sf_dir):
    """Products by discount, moved up by their clicks."""
    c = Catalog(spark, sf_dir)
    best = c.live.groupBy("product_id").agg(F.max("discount").alias("discount"))
    top = best.orderBy(F.desc("discount"), "product_id").limit(200).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("discount"), "product_id")) - 1)
    n = F.coalesce("n_clicks", F.lit(0))
    score = (1 / (1 + F.col("pos"))) * (1 + F.log1p(n) / 5)
    return top.join(popular_products(c, 30), "product_id", "left").select("product_id", "pos", F.round(score, 6).alias("score"))


def q_popular_searches(spark, sf_dir):
    rows = Catalog(spark, sf_dir).searches.where((F.lower("country") == "ng") & (F.col("result_count") > 0) & (F.col("created_at") > days_before(20, EVENTS_AS_OF)))
    key = F.lower(F.trim("query"))
    return rows.where(F.length(key) >= 3).groupBy(key.alias("q")).agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("latest")).orderBy(F.desc("n"), F.desc("latest"), "q").limit(10)


def q_zero_result_queries(spark, sf_dir):
    key = F.lower(F.trim("query"))
    rows = Catalog(spark, sf_dir).searches.where((F.col("result_count") == 0) & F.length(F.trim("query")).between(3, 80))
    found = rows.groupBy(F.lower(F.coalesce("country", F.lit("ng"))).alias("market"), key.alias("q")).agg(F.count(F.lit(1)).alias("n"))
    return found.where("n >= 3").orderBy(F.desc("n"), "market", "q").limit(50)


def q_resolution_dashboard(spark, sf_dir):
    """Events of a week by user group and kind, one pass."""
    rows = Catalog(spark, sf_dir).table("events").where(F.col("ts") > days_before(7, EVENTS_AS_OF))
    kinds = ("click", "view", "purchase", "signup", "error")
    return rows.groupBy((F.col("user_id") % 10).alias("grp")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds))


def q_cashback_balance(spark, sf_dir):
    """Order totals by customer and status, in cents."""
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5)
    rows = Catalog(spark, sf_dir).table("orders")
    return rows.groupBy(F.col("o_custkey").alias("user_id")).agg(*(F.coalesce(F.sum(F.when(F.col("o_orderstatus") == s, cents)), F.lit(0)).alias(f"cents_{s}") for s in ("F", "O", "P")))


def q_fixed_window_limit(spark, sf_dir):
    """Requests over 3 in a day that begins with a user's first."""
    rows = fixed_windows(Catalog(spark, sf_dir).table("events"), 86_400)
    return rows.groupBy("user_id", "window_no").agg(F.count(F.lit(1)).alias("n")).where("n > 3")


def q_rotation_bucket(spark, sf_dir):
    bucket = F.floor(F.unix_timestamp("ts") / 21600)
    return Catalog(spark, sf_dir).table("events").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"))


def q_session_windows(spark, sf_dir):
    """Sessions of a user's events no more than 30 minutes apart."""
    rows = Catalog(spark, sf_dir).table("events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("s.start").alias("started"), "n")


def q_trailing_windows(spark, sf_dir):
    ts = F.col("ts")
    rows = Catalog(spark, sf_dir).table("events")
    return rows.groupBy("event_type").agg(*(F.count_if(ts > days_before(n, EVENTS_AS_OF)).alias(f"last_{n}d") for n in (7, 14, 30)))


def q_inflight_dedupe(spark, sf_dir):
    """The first of equal events of a user within an hour bucket."""
    bucket = F.floor(F.unix_timestamp("ts") / 3600)
    rows = Catalog(spark, sf_dir).table("events")
    return rows.groupBy("user_id", "event_type", bucket.alias("bucket")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count(F.lit(1)).alias("n"))


def q_vote_counts(spark, sf_dir):
    return Catalog(spark, sf_dir).events("signup").groupBy(F.col("k").alias("feature")).agg(F.countDistinct("user_id").alias("n_votes"))


def q_age_text(spark, sf_dir):
    """How long ago each user was last seen, in words."""
    last = Catalog(spark, sf_dir).table("events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    minutes = F.floor((F.unix_timestamp(as_of(EVENTS_AS_OF)) - F.unix_timestamp("ts")) / 60)
    text = (
        F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))
    )
    return last.select("user_id", text.alias("seen"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
NOW = "TIMESTAMP '2024-01-31'"
POPULAR = """SELECT coalesce(o.product_id, p.product_id) AS product_id, count(*) AS n_clicks FROM clicks c LEFT JOIN offers o ON o.offer_id = c.deal_id LEFT JOIN products p ON p.product_id = c.deal_id
WHERE clicked_at > TIMESTAMP '2024-01-31' - INTERVAL {} DAY AND coalesce(o.product_id, p.product_id) IS NOT NULL GROUP BY 1"""
ORACLES = {
    "popular_products": sql(POPULAR.format(14)),
    "popularity_rerank": sql(
        "SELECT product_id, pos, round((1 / (1 + pos)) * (1 + ln(1 + coalesce(n_clicks, 0)) / 5), 6) AS score FROM (SELECT product_id, (row_number() OVER (ORDER BY discount DESC, product_id) - 1)::INT AS pos FROM (SELECT product_id, max(discount) AS discount FROM live GROUP BY 1) QUALIFY pos < 200) LEFT JOIN pop USING (product_id)",
        f"pop AS ({POPULAR.format(30)})",
    ),
    "popular_searches": sql(
        f"""SELECT lower(trim(query)) AS q, count(*) AS n, max(created_at) AS latest FROM searches WHERE lower(country) = 'ng' AND result_count > 0 AND created_at > {NOW} - INTERVAL 20 DAY AND length(trim(query)) >= 3
        GROUP BY 1 ORDER BY n DESC, latest DESC, q LIMIT 10"""
    ),
    "zero_result_queries": sql(
        """SELECT lower(coalesce(country, 'ng')) AS market, lower(trim(query)) AS q, count(*) AS n FROM searches WHERE result_count = 0 AND length(trim(query)) BETWEEN 3 AND 80
        GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY n DESC, market, q LIMIT 50"""
    ),
    "resolution_dashboard": f"""SELECT user_id % 10 AS grp, count(*) AS n, {', '.join(f"count(*) FILTER (WHERE event_type = '{k}') AS n_{k}" for k in ('click', 'view', 'purchase', 'signup', 'error'))}
        FROM events WHERE ts > {NOW} - INTERVAL 7 DAY GROUP BY 1""",
    "cashback_balance": f"""SELECT o_custkey AS user_id, {', '.join(f"coalesce(sum(floor(o_totalprice * 100 + 0.5)::BIGINT) FILTER (WHERE o_orderstatus = '{s}'), 0)::BIGINT AS cents_{s}" for s in 'FOP')} FROM orders GROUP BY 1""",
    "fixed_window_limit": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
        w AS (SELECT user_id, rn, t AS start, 1 AS window_no FROM e WHERE rn = 1
          UNION ALL SELECT e.user_id, e.rn, CASE WHEN e.t >= w.start + 86400000000 THEN e.t ELSE w.start END, CASE WHEN e.t >= w.start + 86400000000 THEN w.window_no + 1 ELSE w.window_no END
          FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
        SELECT user_id, window_no, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) > 3""",
    "rotation_bucket": "SELECT floor(epoch(ts) / 21600)::BIGINT AS bucket, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1",
    "session_windows": """SELECT user_id, min(ts) AS started, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
        SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
    "trailing_windows": f"SELECT event_type, {', '.join(f'count(*) FILTER (WHERE ts > {NOW} - INTERVAL {n} DAY) AS last_{n}d' for n in (7, 14, 30))} FROM events GROUP BY 1",
    "inflight_dedupe": "SELECT user_id, event_type, floor(epoch(ts) / 3600)::BIGINT AS bucket, first(event_id ORDER BY ts, event_id) AS event_id, count(*) AS n FROM events GROUP BY 1, 2, 3",
    "vote_counts": sql("SELECT k AS feature, count(DISTINCT user_id) AS n_votes FROM ev WHERE event_type = 'signup' GROUP BY 1"),
    "age_text": f"""SELECT user_id, CASE WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END AS seen
        FROM (SELECT user_id, floor((epoch({NOW}) - floor(epoch(max(ts)))) / 60)::BIGINT AS m FROM events GROUP BY 1)""",
}
