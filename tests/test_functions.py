from pyspark.sql import functions as F

from pricewright.functions import gates as G
from pricewright.functions import money as M
from pricewright.sources.feeds import fx_rates


def value(spark, column, a=None, b=None):
    return spark.createDataFrame([(a, b)], "a string, b string").select(column.alias("r")).first().r


def test_gates(spark):
    a, b = F.col("a"), F.col("b")
    assert value(spark, G.is_accessory(a), "Leather case for phone") and not value(spark, G.is_accessory(a), "Phone with charger")
    assert value(spark, G.is_used(a), "Renewed phone") and value(spark, G.is_counterfeit(a), "replica watch")
    assert not value(spark, G.is_quality(a, b), "Gift Card", "x") and not value(spark, G.is_quality(a, b), "Phone", None)
    assert value(spark, G.is_blocked(a, b), "ok", "[BLOCKED: id]") and not value(spark, G.is_blocked(a, b), None, "ok")
    assert value(spark, G.significant_overlap(a, b), "red", "red ring") and not value(spark, G.significant_overlap(a, b), "red rod", "red ring")
    assert value(spark, G.distinctive_overlap(a, b, ["red"]), "red", "red ring") == 0
    assert value(spark, G.distinctive_overlap(a, b, ["red"]), "red ring", "ring gold") == 0.5
    assert value(spark, G.numbers_fit(a, b), "phone 15 2024", "Phone 15 pro") and not value(spark, G.numbers_fit(a, b), "phone 15", "Phone 14")
    assert value(spark, G.models_fit(a, b), "WH1000xm5", "WH-1000XM5 black") and not value(spark, G.models_fit(a, b), "s24", "s23")
    assert not value(spark, G.families_clash(a, b), None, "x") and value(spark, G.families_clash(a, b), "y", "x")
    assert value(spark, G.tight_signature(a, ["tv"]), "acme|x1") and not value(spark, G.tight_signature(a, ["tv"]), "acme|tv") and not value(spark, G.tight_signature(a, []), "acme")


def test_listing_classifiers(spark):
    a, b = F.col("a"), F.col("b")
    accessory = {"Replacement Earpads for Bose": True, "Hülle case für Sony": True, "Battery for Astro A50": True, "Anker PowerCore Battery": False, "iPhone 15 with charging case": False, "Water bottle pouch": True, None: False}
    assert {t: value(spark, G.is_accessory(a), t) for t in accessory} == accessory
    noise = {"New battery For Apple macbook air": True, "Grip for AirPods Max": True, "iPhone 15 Pro Max Mainboard 256GB": True, "ASUS ROG Z790 Motherboard": False, "Motherboard for iPhone 15": True, "suitcase": False, None: False}
    assert {t: value(spark, G.is_noise(a), t) for t in noise} == noise
    assert value(spark, G.is_suspicious(a), "Apple MacBook Neo A18 Pro") and value(spark, G.is_suspicious(a), "iPhone 15 clone Android") and not value(spark, G.is_suspicious(a), "MacBook Pro M4")
    assert value(spark, G.is_used(a, b), "Phone", "Back Market DE") and value(spark, G.is_used(a, b), "Open-box TV", None) and not value(spark, G.is_used(a, b), "unused Grade A++ fridge", "Shop")
    assert value(spark, G.is_quality(a, b), "TV with 2 year warranty", "x") and not value(spark, G.is_quality(a, b), "Extended warranty", "x")


def test_price_floors(spark):
    from pricewright.operators import quality as Q

    lines = spark.createDataFrame([("phone 15 pro", 0, 900), ("phone 15", 1, 600)], "name string, rank int, floor long")
    kinds = spark.createDataFrame([("audio", 5)], "category string, floor long")
    rows = [("The PHONE 15 Pro", "audio", 899.0), ("phone 15", None, 600.0), ("ear", "audio", 5.0), ("thing", "x", 999.0), (None, "audio", 4.0), ("ear", "audio", None)]
    got = Q.plausible(spark.createDataFrame(rows, "title string, category string, price double"), lines, kinds)
    assert sorted((r.title or "", r.price or 0, r.floor, r.plausible) for r in got.collect()) == sorted(
        [("The PHONE 15 Pro", 899.0, 900, False), ("phone 15", 600.0, 600, True), ("ear", 5.0, 5, True), ("thing", 999.0, 1000, False), ("", 4.0, 5, False), ("ear", 0, 5, False)]
    )


def test_money(spark):
    rows = spark.createDataFrame([("NGN", 3300.0), ("GBP", 7.9), (None, 5.0), ("XXX", 2.0)], "currency string, price double")
    got = M.with_rate(rows, fx_rates(spark)).select(F.round(M.usd_price(F.col("price"), F.col("rate")), 6).alias("usd")).collect()
    assert sorted(r.usd for r in got) == [2.0, 2.0, 5.0, 10.0]
    assert value(spark, M.discount_percent(F.lit(200), F.lit(150))) == 25 and value(spark, M.discount_percent(F.lit(1), F.lit(2))) == 0
    assert value(spark, M.shown_savings(F.lit(90))) == 0 and value(spark, M.shown_savings(F.lit(40))) == 40
    assert value(spark, M.cross_border(F.lit(None).cast("string"), F.lit("NG"), F.lit("NGN"), F.lit("NGN"), F.lit(True))) is False
    assert value(spark, M.landed(F.lit(10.0), F.lit(True))) == 13
    assert value(spark, M.cashback_rate(F.col("a"), {"shop": 2.5}), " Shop ") == 2.5 and value(spark, M.cashback_rate(F.col("a"), {"shop": 2.5}), "x") == 0
    assert value(spark, M.freshness_tier(F.lit(5))) == "recent"
