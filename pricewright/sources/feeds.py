"""Offer feeds: JSON catalogues and search results, static lists, fan-out and exchange rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.catalog import FX_RATES
from pricewright.functions import text as T

OFFER = "title string, url string, store string, price decimal(12,2), currency string, old_price decimal(12,2)"
SEARCH = "shopping_results array<struct<title:string,link:string,source:string,extracted_price:double,extracted_old_price:double>>"
SHOPIFY = "vendor string, products array<struct<title:string,handle:string,variants:array<struct<sku:string,price:string,compare_at_price:string,available:boolean>>>>"
WOO = "name string, permalink string, on_sale boolean, prices struct<price:string,regular_price:string,currency_code:string,currency_minor_unit:int>"

# Plausible bands of quotes for a US dollar.
FX_BANDS = {"NGN": (500, 5000), "GBP": (0.5, 1.2), "EUR": (0.6, 1.3), "AED": (3, 4.5), "INR": (50, 150), "ZAR": (8, 40)}


def search_results(spark: SparkSession, path: str, currency: str, floor: float = 1.0) -> DataFrame:
    """Results of a shopping search: rows without title, link, store or price go, and prices below ``floor``."""
    rows = spark.read.schema(SEARCH).json(path, multiLine=True).select(F.explode("shopping_results").alias("r")).select("r.*")
    price = F.col("extracted_price").cast("decimal(12,2)")
    out = rows.select(
        T.clean_title(F.col("title")).alias("title"), F.col("link").alias("url"), F.col("source").alias("store"), price.alias("price"),
        F.lit(currency).alias("currency"), F.col("extracted_old_price").cast("decimal(12,2)").alias("old_price"),
    )
    return out.where("title <> '' and url <> '' and store <> ''").where(F.col("price") >= floor)


def shopify_catalog(spark: SparkSession, path: str, site: str, currency: str) -> DataFrame:
    """Products and their available variants, one row each."""
    rows = spark.read.schema(SHOPIFY).json(path, multiLine=True).select("vendor", F.explode("products").alias("p"))
    rows = rows.select("vendor", "p.title", "p.handle", F.explode("p.variants").alias("v")).where("v.available")
    return rows.select(
        T.clean_title(F.col("title")).alias("title"), F.concat(F.lit(f"{site}/products/"), "handle", F.lit("?variant="), "v.sku").alias("url"),
        F.col("vendor").alias("store"), F.expr("try_cast(v.price AS decimal(12,2))").alias("price"), F.lit(currency).alias("currency"),
        F.expr("try_cast(v.compare_at_price AS decimal(12,2))").alias("old_price"),
    ).where("price > 0")


def woo_catalog(spark: SparkSession, path: str, store: str) -> DataFrame:
    """Store API products; prices come in minor units."""
    rows = spark.read.schema(WOO).json(path, multiLine=True)
    unit = F.pow(F.lit(10.0), F.col("prices.currency_minor_unit"))
    value = lambda f: (F.expr(f"try_cast(prices.{f} AS double)") / unit).cast("decimal(12,2)")
    return rows.select(
        T.clean_title(F.col("name")).alias("title"), F.col("permalink").alias("url"), F.lit(store).alias("store"), value("price").alias("price"),
        F.col("prices.currency_code").alias("currency"), value("regular_price").alias("old_price"),
    ).where("price > 0")


def local_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows scraped before, one JSON object a line."""
    return spark.read.schema(OFFER).json(path)


def curated(products: DataFrame, marketplaces: Sequence[tuple[str, str]]) -> DataFrame:
    """A static list of products at each of a few marketplaces (name, URL prefix)."""
    places = F.array(*(F.struct(F.lit(n).alias("store"), F.lit(p).alias("prefix")) for n, p in marketplaces))
    rows = products.withColumn("m", F.explode(places))
    return rows.withColumn("store", F.col("m.store")).withColumn("url", F.concat("m.prefix", "sku")).drop("m")


def static_fallback(live: DataFrame, fallback: DataFrame) -> DataFrame:
    """``live``, or ``fallback`` where it is empty."""
    return fallback if live.isEmpty() else live


def fx_rates(spark: SparkSession, quotes: DataFrame | None = None) -> DataFrame:
    """Seed rates from the dollar, replaced by quotes that lie in the band of their currency."""
    seed = spark.createDataFrame(FX_RATES, "base string, quote string, rate double")
    if quotes is None:
        return seed
    bands = spark.createDataFrame([(c, float(a), float(b)) for c, (a, b) in FX_BANDS.items()], "quote string, low double, high double")
    good = quotes.where("base = 'USD'").join(F.broadcast(bands), "quote").where("rate between low and high")
    good = good.groupBy("base", "quote").agg(F.max("rate").alias("rate"))
    return seed.join(good.select("base", "quote"), ["base", "quote"], "left_anti").unionByName(good)


def fanout_union(feeds: Sequence[DataFrame], query: str, least_shared: float = 0.5) -> DataFrame:
    """All feeds, one row for each canonical URL (the first feed's), titles with enough of the query's words."""
    words = [w for w in query.lower().split() if len(w) > 1]
    both = None
    for number, feed in enumerate(feeds):
        part = feed.withColumn("feed", F.lit(number)).withColumn("site", T.url_canonical(F.col("url")))
        both = part if both is None else both.unionByName(part)
    names = [c for c in both.columns if c not in ("feed", "site")]
    first = both.groupBy("site").agg(F.min_by(F.struct(*names), F.struct("feed", "price", "title")).alias("r")).select("r.*")
    padded = F.concat(F.lit(" "), T.strip_punct(F.col("title")), F.lit(" "))
    hits = sum((F.contains(padded, F.lit(f" {w} ")).cast("int") for w in words), F.lit(0))
    return first.where(hits >= least_shared * len(words))


def usable_url(url: Column) -> Column:
    """False for direct search-engine hosts; what is no URL passes."""
    host = F.try_parse_url(url, F.lit("HOST"))
    return ~F.coalesce(host.rlike(r"(?i)(^|\.)google\.[a-z.]+$"), F.lit(False))
