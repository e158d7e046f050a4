"""Money, rates and freshness as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.catalog import USD_NGN


def with_rate(df: DataFrame, rates: DataFrame, currency: str = "currency") -> DataFrame:
    """``df`` with the units of its currency for a dollar; a missing rate is 1, and USD for null."""
    table = F.broadcast(rates.where("base = 'USD'").select(F.col("quote").alias("_quote"), "rate"))  # a row for each currency
    key = F.coalesce(currency, F.lit("USD"))
    fallback = F.when(key == "NGN", F.lit(float(USD_NGN))).otherwise(1.0)
    return df.withColumn("_key", key).join(table, F.col("_key") == F.col("_quote"), "left").withColumn("rate", F.coalesce("rate", fallback)).drop("_key", "_quote")


def usd_price(price: Column, rate: Column) -> Column:
    return F.try_divide(price, rate)


def discount_percent(old: Column, now: Column) -> Column:
    """Rounded markdown; 0 where the old price isn't higher."""
    return F.when(old > now, F.round((old - now) * 100 / old)).otherwise(0).cast("int")


def shown_savings(percent: Column) -> Column:
    """Savings as shown: from 85 on they are not believed, and none is above 99."""
    return F.when(percent >= 85, 0).otherwise(F.least(percent, F.lit(99)))


def cross_border(store_country: Column, buyer: Column, store_currency: Column, buyer_currency: Column, international: Column) -> Column:
    """A store's known country decides; a global store ships across borders if its currency is another or none is known."""
    return F.when(store_country.isNotNull(), store_country != buyer).otherwise(F.coalesce((store_currency != buyer_currency) & international, F.lit(True)))


def landed(price: Column, crosses: Column) -> Column:
    return F.when(crosses, price * 1.3).otherwise(price)


def freshness_tier(days: Column) -> Column:
    return F.when(days < 3, "fresh").when(days < 7, "recent").when(days < 30, "month").otherwise("old")


def cashback_rate(store: Column, rates: dict[str, float]) -> Column:
    """The rate of a store's trimmed lower-case name, else 0."""
    table = F.create_map(*(F.lit(x) for pair in rates.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(store))), F.lit(0.0))
