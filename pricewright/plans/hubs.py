"""Pages of brands, categories and stores: what reaches a buyer, in any order, page by page for all of them at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.catalog import FX_RATES, USD_NGN, Catalog, sql
from pricewright.functions import text as T
from pricewright.operators.offers import DEALS, deals
from pricewright.session import materialize

PAGE = 20


def reaches(country: str) -> Column:
    """A store of the country, or a global one of none."""
    return F.coalesce((F.col("country") == country) | (F.col("country").isNull() & F.col("is_international")), F.lit(False))


#: Orders of deals by name; each ends with the id.
ORDERS = {
    "relevance": [F.desc_nulls_last, "score"], "discount": [F.desc_nulls_last, "discount"], "price": [F.asc_nulls_last, "ngn"], "newest": [F.desc_nulls_last, "recorded_at"],
    "popular": [F.desc_nulls_last, "clicks", F.desc_nulls_last, "discount"],
}


def ordering(mode: str) -> list[Column]:
    """The order of a mode: relevance, discount, price, newest or popular (clicks, then discount)."""
    steps = ORDERS[mode]
    return [by(column) for by, column in zip(steps[::2], steps[1::2])] + [F.asc("offer_id")]


def hub_pages(rows: DataFrame, hub: str, country: str, mode: str, page: int, size: int = PAGE) -> DataFrame:
    """A page of every ``hub`` (a column of ``rows``): offers that reach ``country``, one for each product, places numbered from 1.

    Rows without a hub are left out. Pages are cut in a window by hub, which
    keeps only the first places of each task before it shuffles.
    """
    own = rows.where(reaches(country) & F.col(hub).isNotNull())
    one = Window.partitionBy(hub, "product_id").orderBy(*ordering(mode))
    first = own.withColumn("_rn", F.row_number().over(one)).where("_rn = 1").drop("_rn")
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(hub).orderBy(*ordering(mode)))).where(F.col("place") <= (page + 1) * size)
    return placed.where(F.col("place") > page * size)


def scored_deals(c: Catalog) -> DataFrame:
    """Deals with clicks and the score of relevance: discount, and half of what a click adds."""
    clicks = c.clicks.groupBy(F.col("deal_id").alias("product_id")).agg(F.count(F.lit(1)).alias("clicks"))
    rows = deals(c).join(clicks, "product_id", "left").withColumn("clicks", F.coalesce("clicks", F.lit(0)))
    return rows.withColumn("score", F.col("discount") + F.col("clicks") / 2)


def fx_rate(df: DataFrame, rates: DataFrame, base: str = "base", quote: str = "quote") -> DataFrame:
    """``df`` with ``rate``, the units of ``quote`` for one of ``base``: the table's (a row for each pair), else the fixed one from dollars, else 1."""
    table = F.broadcast(rates.select(F.col("base").alias("_b"), F.col("quote").alias("_q"), F.col("rate").alias("_r")))  # one row for each pair of currencies
    fixed = F.when((F.col(base) == "USD") & (F.col(quote) == "NGN"), F.lit(float(USD_NGN))).otherwise(1.0)
    joined = df.join(table, (F.col(base) == F.col("_b")) & (F.col(quote) == F.col("_q")), "left")
    return joined.withColumn("rate", F.coalesce("_r", fixed)).drop("_b", "_q", "_r")


def jittered(df: DataFrame, rank: str, key: str, seed: str, reach: int) -> DataFrame:
    """``df`` with ``nudged``: its rank, moved up to ``reach`` places back by a hash of seed and key, so an order is fixed by its seed."""
    part = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col(key))), 1, 6), 16, 10).cast("double") / (16**6)
    return df.withColumn("nudged", F.round(F.col(rank) + part * reach, 6))


def q_brand_pages(spark, sf_dir):
    """The second page of every brand by discount, for a buyer of one country."""
    rows = scored_deals(Catalog(spark, sf_dir)).withColumn("slug", T.slug(F.col("brand")))
    return hub_pages(rows, "slug", "NATION_6", "discount", 1).select("slug", "product_id", "offer_id", "place")


def q_category_pages(spark, sf_dir):
    """The first page of every category by clicks."""
    return hub_pages(scored_deals(Catalog(spark, sf_dir)), "category", "NATION_6", "popular", 0).select("category", "product_id", "clicks", "place")


def q_store_pages(spark, sf_dir):
    """The first page of every store by price."""
    return hub_pages(scored_deals(Catalog(spark, sf_dir)), "store_id", "NATION_6", "price", 0).select("store_id", "product_id", "ngn", "place")


def q_deal_orders(spark, sf_dir):
    """The first fifty deals in each order."""
    rows = scored_deals(Catalog(spark, sf_dir)).select("offer_id", "score", "discount", "ngn", "recorded_at", "clicks")
    rows = materialize(rows, "scored-deals")  # every order reads it
    out = None
    for mode in ORDERS:
        top = rows.orderBy(*ordering(mode)).limit(50).select(F.lit(mode).alias("mode"), "offer_id")
        out = top if out is None else out.unionByName(top)
    return out


def q_fx_rate(spark, sf_dir):
    """Live prices in three currencies, by a table that lacks some rates."""
    c = Catalog(spark, sf_dir)
    rates = spark.createDataFrame(FX_RATES[1:] + [("NGN", "USD", 0.0006)], "base string, quote string, rate double")
    rows = c.live.select("offer_id", "cents", F.col("currency").alias("base"), F.explode(F.array(F.lit("USD"), F.lit("NGN"), F.lit("GBP"))).alias("quote"))
    return fx_rate(rows, rates).select("offer_id", "quote", F.round(F.col("cents") * F.col("rate"), 4).alias("amount"))


def q_jitter_rank(spark, sf_dir):
    """Deals by discount, nudged by up to ten places."""
    by = Window.partitionBy("category").orderBy(F.desc("discount"), "offer_id")
    rows = deals(Catalog(spark, sf_dir)).withColumn("rank", F.row_number().over(by))
    return jittered(rows, "rank", "offer_id", "seven", 10).select("category", "offer_id", "nudged")


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
SCORED = """scored AS (SELECT *, discount + clicks / 2 AS score, country = 'NATION_6' OR (country IS NULL AND is_international) AS reach,
  trim(regexp_replace(replace(lower(brand), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-') AS slug
  FROM (SELECT deals.*, coalesce(n, 0) AS clicks FROM deals LEFT JOIN (SELECT deal_id, count(*) AS n FROM clicks GROUP BY 1) k ON k.deal_id = deals.product_id))"""
_BY = {"relevance": "score DESC NULLS LAST", "discount": "discount DESC NULLS LAST", "price": "ngn NULLS LAST", "newest": "recorded_at DESC NULLS LAST", "popular": "clicks DESC, discount DESC NULLS LAST"}


def _pages(hub: str, mode: str, page: int, shown: str) -> str:
    by = f"{_BY[mode]}, offer_id"
    return sql(
        f"""SELECT {shown}, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY {hub} ORDER BY {by}) AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY {hub}, product_id ORDER BY {by}) AS rn FROM scored WHERE reach AND {hub} IS NOT NULL) WHERE rn = 1) WHERE place > {page * PAGE} AND place <= {(page + 1) * PAGE}""",
        DEALS,
        SCORED,
    )


_RATES = " ".join(f"WHEN base = '{b}' AND quote = '{q}' THEN {r}" for b, q, r in FX_RATES[1:] + [("NGN", "USD", 0.0006), ("USD", "NGN", float(USD_NGN))])
ORACLES = {
    "brand_pages": _pages("slug", "discount", 1, "slug, product_id, offer_id"),
    "category_pages": _pages("category", "popular", 0, "category, product_id, clicks"),
    "store_pages": _pages("store_id", "price", 0, "store_id, product_id, ngn"),
    "deal_orders": sql(" UNION ALL ".join(f"(SELECT '{mode}' AS mode, offer_id FROM scored ORDER BY {by}, offer_id LIMIT 50)" for mode, by in _BY.items()), DEALS, SCORED),
    "fx_rate": sql(f"SELECT offer_id, quote, round(cents * (CASE {_RATES} ELSE 1 END)::DOUBLE, 4) AS amount FROM (SELECT offer_id, cents, currency AS base, unnest(['USD', 'NGN', 'GBP']) AS quote FROM live)"),
    "jitter_rank": sql(
        """SELECT category, offer_id, round(rank + ('0x' || substr(md5('seven/' || offer_id), 1, 6))::BIGINT / 16777216.0 * 10, 6)::DOUBLE AS nudged
        FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY discount DESC, offer_id) AS rank FROM deals)""",
        DEALS,
    ),
}
