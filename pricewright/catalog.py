"""The price model over the warehouse tables, as DataFrames and as SQL.

stores are suppliers, products are parts, price points are order lines, and an
offer is the latest price point of a product at a store. Prices are whole
cents in the currency of the store; ``ngn`` are cents in the comparison unit.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.session import stored

AS_OF = "2001-11-05 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"

# The seed exchange rates, from USD.
FX_RATES = [("USD", "NGN", 1650.0), ("USD", "GBP", 0.79), ("USD", "EUR", 0.92), ("USD", "AED", 3.6725), ("USD", "INR", 83.0), ("USD", "ZAR", 18.0)]
USD_NGN = 1650


def as_of(text: str = AS_OF) -> Column:
    return F.lit(text).cast("timestamp")


def days_before(n: int, at: str = AS_OF) -> Column:
    return as_of(at) - F.expr(f"INTERVAL {n} DAYS")


def ngn(cents: Column, currency: Column) -> Column:
    return F.when(F.coalesce(currency, F.lit("USD")) == "USD", cents * USD_NGN).otherwise(cents)


#: Columns of a price point's line that its offer is made of, and those of an offer.
LINE = ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_shipdate", "l_linestatus"]
OFFER = ["product_id", "store_id", "offer_id", "cents", "currency", "ngn", "discount", "recorded_at", "in_stock"]
#: Tasks among which the stores of a product are dealt.
SHARES = 4


def priced(lines: DataFrame) -> DataFrame:
    """``lines`` with the columns of an offer."""
    cents = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity") + 0.5)
    currency = F.when(F.col("l_suppkey") % 3 == 0, "NGN").otherwise("USD")
    return lines.select(
        "*",
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_suppkey").cast("string").alias("store_id"),
        F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("offer_id"),
        cents.alias("cents"),
        currency.alias("currency"),
        ngn(cents, currency).alias("ngn"),
        F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("discount"),
        F.col("l_shipdate").alias("recorded_at"),
        (F.col("l_linestatus") == "O").alias("in_stock"),
    )


class Catalog:
    """Lazily bound tables of one data folder; only columns in use are read."""

    #: The stored offers have one row for each product and store.
    one_offer_by_store = True

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @cached_property
    def stores(self) -> DataFrame:
        nation = F.broadcast(self.table("nation"))  # at most one row for each country
        joined = self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        return joined.select(
            F.col("s_suppkey").cast("string").alias("store_id"),
            F.col("s_name").alias("store_name"),
            F.when(F.col("n_regionkey") != 4, F.col("n_name")).alias("country"),
            F.col("n_regionkey").isin(2, 4).alias("is_international"),
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").cast("string").alias("product_id"),
            F.col("p_name").alias("title"),
            F.col("p_brand").alias("brand"),
            F.col("p_type").alias("category"),
            F.col("p_size").alias("size"),
            (F.lit("1995-01-01").cast("timestamp") + F.make_dt_interval(days=(F.col("p_partkey") % 2000).cast("int"))).alias("created_at"),
        )

    @cached_property
    def points(self) -> DataFrame:
        return priced(self.table("lineitem")).select(*OFFER[:7], "recorded_at", F.col("l_orderkey").alias("order_no"), F.col("l_linenumber").alias("line_no"), "in_stock")

    @cached_property
    def offers(self) -> DataFrame:
        """The stored table of offers: the latest price point by product and store."""
        return priced(stored(self.spark, f"{self.sf_dir}/offers", self.latest_points, [self.path("lineitem")])).select(*OFFER)

    def latest_points(self) -> DataFrame:
        """The latest line of each product and store, which ``priced`` makes an offer.

        Only the narrow columns of the table are moved and stored. The rows of a
        product are dealt to a few tasks, so what is worked out by product later
        is first put together there; a product of very many stores is in several.
        """
        keys = ["l_partkey", "l_suppkey", "share"]
        rows = self.table("lineitem").select(*LINE, "l_orderkey", "l_linenumber", F.pmod(F.xxhash64("l_suppkey"), F.lit(SHARES)).cast("int").alias("share"))
        rows = rows.repartition("l_partkey", "share")
        newest = F.max_by(F.struct(*LINE[2:]), F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("o")
        return rows.groupBy(*keys).agg(newest).select(*LINE[:2], "o.*")

    @cached_property
    def live(self) -> DataFrame:
        return self.offers.where("in_stock")

    def events(self, *kinds: str) -> DataFrame:
        rows = self.table("events").where(F.col("event_type").isin(*kinds))
        return rows.withColumn("k", F.get_json_object("props", "$.k").cast("int"))

    @cached_property
    def clicks(self) -> DataFrame:
        """An even key is a product, an odd one the offer of a product at its first store."""
        deal = F.when(F.col("k") % 2 == 0, F.col("k").cast("string")).otherwise(F.concat(F.col("k").cast("string"), F.lit("-"), (F.col("user_id") % 10).cast("string")))
        return self.events("click").select("event_id", deal.alias("deal_id"), F.col("ts").alias("clicked_at"), "user_id")

    @cached_property
    def searches(self) -> DataFrame:
        query = F.concat(F.when(F.col("event_id") % 2 == 0, " Query ").otherwise("query "), (F.col("k") % 12).cast("string"))
        return self.events("purchase", "signup").select(
            "event_id",
            query.alias("query"),
            F.when(F.col("k") % 11 != 0, F.col("k") % 4).alias("result_count"),
            F.when(F.col("user_id") % 4 != 0, F.when(F.col("user_id") % 4 == 1, "NG").otherwise("gb")).alias("country"),
            F.col("ts").alias("created_at"),
        )


#: The same bindings as common table expressions.
SQL = f"""
stores AS (
  SELECT s_suppkey::VARCHAR AS store_id, s_name AS store_name, CASE WHEN n_regionkey <> 4 THEN n_name END AS country, n_regionkey IN (2, 4) AS is_international
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
), products AS (
  SELECT p_partkey::VARCHAR AS product_id, p_name AS title, p_brand AS brand, p_type AS category, p_size AS size,
         TIMESTAMP '1995-01-01' + to_days((p_partkey % 2000)::INT) AS created_at FROM part
), points AS (
  SELECT *, CASE WHEN currency = 'USD' THEN cents * {USD_NGN} ELSE cents END AS ngn FROM (
    SELECT l_partkey::VARCHAR AS product_id, l_suppkey::VARCHAR AS store_id, l_partkey || '-' || l_suppkey AS offer_id,
           floor(l_extendedprice * 100 / l_quantity + 0.5)::BIGINT AS cents, CASE WHEN l_suppkey % 3 = 0 THEN 'NGN' ELSE 'USD' END AS currency,
           floor(l_discount * 100 + 0.5)::INT AS discount, l_shipdate AS recorded_at, l_orderkey AS order_no, l_linenumber AS line_no, l_linestatus = 'O' AS in_stock
    FROM lineitem)
), offers AS (
  SELECT product_id, store_id, offer_id, cents, currency, ngn, discount, recorded_at, in_stock FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id, store_id ORDER BY recorded_at DESC, order_no DESC, line_no DESC) AS rn FROM points) WHERE rn = 1
), live AS (SELECT * FROM offers WHERE in_stock),
ev AS (SELECT *, (props::JSON->>'k')::INT AS k FROM events),
clicks AS (
  SELECT event_id, CASE WHEN k % 2 = 0 THEN k::VARCHAR ELSE k || '-' || (user_id % 10) END AS deal_id, ts AS clicked_at, user_id FROM ev WHERE event_type = 'click'
), searches AS (
  SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ' Query ' ELSE 'query ' END || (k % 12) AS query, CASE WHEN k % 11 <> 0 THEN k % 4 END AS result_count,
         CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'NG' ELSE 'gb' END AS country, ts AS created_at
  FROM ev WHERE event_type IN ('purchase', 'signup')
)"""


def sql(body: str, *ctes: str) -> str:
    """A query over the bindings; ``ctes`` are further ones."""
    return "WITH " + ",\n".join([SQL.strip(), *ctes]) + "\n" + body
