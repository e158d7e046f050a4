"""Which listings may be compared: classifiers of titles and stores, and price floors of a table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.catalog import Catalog, sql
from pricewright.functions import gates as G
from pricewright.operators.fulltext import containing
from pricewright.operators.identity import SPELLED

# The least believable prices of product lines, more specific names first, and of categories, in whole units.
LINE_FLOORS = [
    ("iphone 17 pro max", 1_500_000), ("iphone 17 pro", 1_300_000), ("iphone 17", 900_000), ("iphone 16 pro max", 1_200_000), ("iphone 16 pro", 1_000_000), ("iphone 16", 750_000),
    ("iphone 15 pro max", 900_000), ("iphone 15 pro", 750_000), ("iphone 15", 600_000), ("airpods max", 300_000), ("airpods pro 2", 150_000), ("airpods pro", 120_000), ("airpods 4", 100_000),
    ("airpods 3", 80_000), ("macbook pro m4", 1_500_000), ("macbook pro m3", 1_200_000), ("macbook air m3", 900_000), ("macbook air m2", 700_000), ("ipad pro m4", 1_000_000),
    ("ipad air m2", 600_000), ("apple watch ultra", 300_000), ("apple watch series", 150_000), ("apple watch se", 80_000), ("galaxy z fold 7", 1_500_000), ("galaxy z fold 6", 1_300_000),
    ("galaxy z flip 7", 900_000), ("galaxy z flip 6", 800_000), ("galaxy s26 ultra", 900_000), ("galaxy s26", 600_000), ("galaxy s25 ultra", 700_000), ("galaxy s24 ultra", 600_000),
    ("pixel 10 pro", 700_000), ("pixel 10", 500_000), ("pixel 9 pro", 500_000), ("wh-1000xm6", 180_000), ("wh-1000xm5", 150_000), ("wh-1000xm4", 100_000),
    ("bose quietcomfort ultra", 150_000), ("bose quietcomfort 45", 120_000), ("playstation 5 slim", 400_000), ("playstation 5", 350_000), ("xbox series x", 400_000), ("xbox series s", 200_000),
    ("nintendo switch 2", 250_000), ("nintendo switch oled", 250_000), ("dyson v15", 200_000), ("dyson v12", 150_000), ("dyson v11", 130_000), ("dyson v8", 100_000), ("dyson airwrap", 200_000),
    ("dyson supersonic", 150_000), ("air jordan 1", 80_000), ("nike dunk low", 70_000), ("air force 1", 45_000), ("adidas samba", 80_000), ("yeezy", 100_000),
]
CATEGORY_FLOORS = {
    "phones": 40_000, "computing": 80_000, "electronics": 15_000, "appliances": 15_000, "audio": 5_000, "gaming": 15_000, "fashion": 3_000, "beauty": 1_500, "home": 3_000, "sports": 2_500,
    "supermarket": 300,
}
LEAST = 1_000


def price_floors(titles: DataFrame, lines: DataFrame) -> DataFrame:
    """(title, floor) of the distinct ``titles`` that hold a name of ``lines`` (name, rank, floor): that of the least rank.

    Names are found by an index of substrings, so each title is read once for any number of lines.
    """
    low = titles.where("title is not null").select("title", F.lower("title").alias("text")).distinct()
    held = containing(low.select("text"), lines.select(F.col("name").alias("needle"))).join(lines, F.col("needle") == F.col("name"))
    least = held.groupBy("text").agg(F.min_by("floor", "rank").alias("floor"))
    return low.join(least, "text").select("title", "floor")


def plausible(offers: DataFrame, lines: DataFrame, categories: DataFrame) -> DataFrame:
    """``offers`` (title, category, price in whole units, ...) with ``floor`` and ``plausible``: at least the floor of the line, else of the category, else ``LEAST``."""
    floors = price_floors(offers.select("title"), lines).withColumnRenamed("floor", "line_floor")
    rows = offers.join(floors, "title", "left").join(categories.withColumnRenamed("floor", "category_floor"), "category", "left")
    floor = F.coalesce("line_floor", "category_floor", F.lit(LEAST))
    return rows.withColumn("floor", floor).withColumn("plausible", F.coalesce(F.col("price") >= floor, F.lit(False))).drop("line_floor", "category_floor")


def tables(c: Catalog) -> tuple[DataFrame, DataFrame]:
    lines = c.spark.createDataFrame([(n, i, f) for i, (n, f) in enumerate(LINE_FLOORS)], "name string, rank int, floor long")
    return lines, c.spark.createDataFrame(list(CATEGORY_FLOORS.items()), "category string, floor long")


#: Conditions and parts that marketplaces put behind a title, in the SQL that both engines read.
MARKED = f"({SPELLED}) || CASE size % 7 WHEN 0 THEN ' refurbished' WHEN 1 THEN ' Ear Pads' WHEN 2 THEN ' gift card' WHEN 3 THEN ' battery für alle' WHEN 4 THEN ' Snapdragon m2 helio' ELSE '' END"


def q_listing_flags(spark, sf_dir):
    """What each listing is: accessory, noise for a search, suspicious, used, or none of the feed's products."""
    c = Catalog(spark, sf_dir)
    rows = c.products.select("product_id", F.expr(MARKED).alias("t"), F.when(F.col("size") % 4 == 0, "Refurbed Store").otherwise("Store").alias("store"), F.when(F.col("size") % 3 > 0, "image").alias("image"))
    t = F.col("t")
    return rows.select("product_id", G.is_accessory(t).alias("accessory"), G.is_noise(t).alias("noise"), G.is_suspicious(t).alias("suspicious"), G.is_used(t, F.col("store")).alias("used"), G.is_quality(t, F.col("image")).alias("quality"))


def q_plausible_offers(spark, sf_dir):
    """Live offers of each listing, and how many cost at least what its line or category has to."""
    c = Catalog(spark, sf_dir)
    rows = c.live.join(c.products, "product_id").select("product_id", F.expr(SPELLED).alias("title"), F.lower("category").alias("category"), (F.col("ngn") / 100).alias("price"))
    return plausible(rows, *tables(c)).groupBy("product_id", "floor").agg(F.count(F.lit(1)).alias("n"), F.count_if("plausible").alias("n_plausible"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}


def _has(pattern: str, text: str = "lower(t)") -> str:
    return f"regexp_matches({text}, '{pattern}')"


ORACLES = {
    "listing_flags": sql(
        f"""SELECT product_id, {_has(G.ACCESSORY_PATTERN)} OR ({_has(G.FITTED_PATTERN)} AND {_has(G.FOR_PATTERN)}) AS accessory,
        {_has(G.HOST_PATTERN)} OR ({_has(G.PHONE_PART_PATTERN)} AND {_has(G.PHONE_PATTERN)}) OR {_has(G.NOISE_PATTERN)} AS noise, {_has(G.IMPOSSIBLE_PATTERN)} AS suspicious,
        {_has(G.USED_PATTERN)} OR size % 4 = 0 AS used, size % 3 > 0 AND NOT {_has(G.NO_PRODUCT_PATTERN)} AS quality FROM (SELECT product_id, size, {MARKED} AS t FROM products)"""
    ),
    "plausible_offers": sql(
        f"""SELECT product_id, floor, count(*) AS n, count(*) FILTER (WHERE price >= floor) AS n_plausible FROM (SELECT product_id, price,
        (CASE {' '.join(f"WHEN contains(lower(title), '{n}') THEN {f}" for n, f in LINE_FLOORS)} ELSE CASE category {' '.join(f"WHEN '{n}' THEN {f}" for n, f in CATEGORY_FLOORS.items())} ELSE {LEAST} END END)::BIGINT AS floor
        FROM (SELECT product_id, {SPELLED} AS title, lower(category) AS category, ngn / 100 AS price FROM live JOIN products USING (product_id))) GROUP BY 1, 2"""
    ),
}
