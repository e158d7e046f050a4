"""Comparison pages and digests, composed of the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewright.catalog import Catalog, days_before, sql
from pricewright.functions import text as T
from pricewright.operators.matching import LISTINGS, listings
from pricewright.operators.offers import DEALS, deals
from pricewright.operators.search import _scored, scored

# Age limit of the out-of-stock lane, outlier factor, price floors by keyword.
LANE_DAYS, OUTLIER = 90, 3
FLOORS = [("anvil", 9_000_000), ("gizmo", 4_500_000), ("ring", 3_300_000)]
FLOOR = 100_000


def anchor_stats(c: Catalog) -> DataFrame:
    """By product: what its live offers say, and the cheapest recent one of each store that sold out.

    Offers of a store whose price rounds alike count once; prices above three
    times the median are outliers and left out of the range.
    """
    rounded = F.round(F.col("ngn") / 10_000).cast("long")
    live = c.live.groupBy("product_id", "store_id", rounded.alias("step")).agg(F.min(F.struct("ngn", "offer_id")).alias("o")).select("product_id", "store_id", "o.ngn", "o.offer_id")
    mid = live.groupBy("product_id").agg(F.median("ngn").alias("mid"))
    kept = live.join(mid, "product_id").where(F.col("ngn") <= F.col("mid") * OUTLIER)
    stats = kept.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_live"), F.countDistinct("store_id").alias("n_stores"), F.min("ngn").alias("low"), F.max("ngn").alias("high"))
    gone = c.offers.where(~F.col("in_stock") & (F.col("recorded_at") > days_before(LANE_DAYS)))
    lane = gone.join(c.live.select("product_id", "store_id"), ["product_id", "store_id"], "left_anti").groupBy("product_id", "store_id").agg(F.min("ngn").alias("ngn"))
    lane = lane.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_gone"), F.min("ngn").alias("gone_low"))
    return stats.join(lane, "product_id", "left").withColumn("n_gone", F.coalesce("n_gone", F.lit(0)))


def find_similar(c: Catalog, query: str, limit: int = 20) -> DataFrame:
    """Other products like the best validated hit of a query, by blended rank.

    The anchor is the best hit that at least three stores sell. Candidates of
    its title are cut to twice the limit before their savings blend in.
    """
    best = c.live.groupBy("product_id").agg(F.countDistinct("store_id").alias("n_stores"), F.min("ngn").alias("low"), F.max("ngn").alias("high"))
    hits = scored(c.products, query).where("matched").join(best.where("n_stores >= 3"), "product_id")
    anchor = hits.orderBy(F.desc("score"), "product_id").limit(1).select(F.col("product_id").alias("anchor_id"), F.col("title").alias("anchor_title"), F.col("brand").alias("anchor_brand"))
    pool = c.products.crossJoin(F.broadcast(anchor)).where("product_id <> anchor_id")  # one row
    pool = pool.withColumn("similar", T.similarity(T.trigrams(F.col("title")), T.trigrams(F.col("anchor_title")))).where("similar > 0.35")
    top = pool.orderBy(F.desc("similar"), "product_id").limit(2 * limit).join(best, "product_id")
    savings = F.floor((F.col("high") - F.col("low")) * 100 / F.col("high"))
    rank = 0.55 * F.col("similar") * 100 + 0.45 * F.least(F.when(savings >= 85, 0).otherwise(savings), F.lit(80))
    return top.select("product_id", "title", (F.col("brand") == F.col("anchor_brand")).alias("same_brand"), F.round(rank, 4).alias("rank")).orderBy(F.desc("rank"), "product_id").limit(limit)


def variant_partition(c: Catalog) -> DataFrame:
    """Listings of a block beside its first one: the same, a variant of it, a sibling in another size, or other."""
    rows = listings(c).withColumn("v", T.variant_tokens(F.col("listing"))).withColumn("gb", T.storage_gb(F.col("listing")))
    first = rows.groupBy("block").agg(F.min(F.struct("id", "brand", "v", "gb")).alias("a"))
    differs = ~F.coalesce(F.col("brand") == F.col("a.brand"), F.lit(True))
    kind = F.when(F.col("id") == F.col("a.id"), "anchor").when(differs, "other").when(F.col("v") != F.col("a.v"), "variant").when(F.col("gb") != F.col("a.gb"), "sibling").otherwise("same")
    return rows.join(first, "block").select("id", F.col("a.id").alias("anchor"), kind.alias("kind"))


def q_anchor_stats(spark, sf_dir):
    return anchor_stats(Catalog(spark, sf_dir))


def q_find_similar(spark, sf_dir):
    return find_similar(Catalog(spark, sf_dir), "red widget")


def q_variant_partition(spark, sf_dir):
    return variant_partition(Catalog(spark, sf_dir))


def q_trending_multi_store(spark, sf_dir):
    """Titles that most stores of a country sell, twelve for each category by turns."""
    c = Catalog(spark, sf_dir)
    sold = c.live.join(c.stores.where("country = 'NATION_6' or is_international"), "store_id", "left_semi").join(c.products, "product_id")
    n = sold.groupBy(F.lower("title").alias("title"), "category").agg(F.countDistinct("store_id").alias("n_stores"), F.min("product_id").alias("product_id")).where("n_stores >= 2")
    one = n.withColumn("rn", F.row_number().over(Window.partitionBy("title").orderBy(F.desc("n_stores"), "category"))).where("rn = 1")
    turn = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n_stores"), "title"))
    return one.withColumn("turn", turn).where("turn <= 12").select("turn", "category", "title", "n_stores", "product_id")


def q_local_alternative(spark, sf_dir):
    """For best offers a country can't buy: the cheapest offer of the product that it can."""
    c = Catalog(spark, sf_dir)
    shop = F.coalesce(F.col("country") == "NATION_6", F.col("is_international"))
    anchor = deals(c).where(~shop).select("product_id", F.col("offer_id").alias("anchor_offer"))
    local = c.live.join(c.stores, "store_id").where(shop).groupBy("product_id").agg(F.min(F.struct("ngn", "offer_id")).alias("o"))
    return anchor.join(local, "product_id").select("product_id", "anchor_offer", "o.offer_id", "o.ngn")


def q_suggest_store_badge(spark, sf_dir):
    """Best titles of a query with how many stores sell any product of that brand and title."""
    c = Catalog(spark, sf_dir)
    top = scored(c.products, "blue gear").where("matched").orderBy(F.desc("score"), "product_id").limit(30).select("product_id", "brand", "title", "score")
    pool = c.live.join(c.products.select("product_id", "brand", "title"), "product_id").groupBy("brand", "title").agg(F.countDistinct("store_id").alias("n_stores"))
    return top.join(pool, ["brand", "title"], "left").select("product_id", "title", "score", F.coalesce("n_stores", F.lit(0)).alias("n_stores"))


def q_price_plausible(spark, sf_dir):
    """Offers at or above the floor of the first keyword their title has."""
    c = Catalog(spark, sf_dir)
    floor = None
    for word, least in FLOORS:
        hit = F.contains(F.lower("title"), F.lit(word))
        floor = F.when(hit, least) if floor is None else floor.when(hit, least)
    rows = c.live.join(c.products.select("product_id", "title", "category"), "product_id").withColumn("floor", floor.otherwise(FLOOR))
    return rows.groupBy("category").agg(F.count_if(F.col("ngn") >= F.col("floor")).alias("n_plausible"), F.count(F.lit(1)).alias("n"))


def q_landing_split(spark, sf_dir):
    """Live offers by what kind of page they lead to."""
    c = Catalog(spark, sf_dir)
    kind = F.when(F.col("country").isNull(), "global").when(F.col("is_international"), "abroad").when(F.col("discount") == 0, "plain").when(F.col("discount") >= 8, "top deal").otherwise("deal")
    return c.live.join(c.stores, "store_id").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("store_id").alias("n_stores"))


def q_sitemap_rows(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    last = c.offers.groupBy("product_id").agg(F.max("recorded_at").alias("last_seen"))
    return last.orderBy(F.desc("last_seen"), "product_id").limit(1000)


def q_fresh_first(spark, sf_dir):
    """Popular products a user hasn't clicked come first, else in order."""
    c = Catalog(spark, sf_dir)
    seen = c.clicks.where("user_id < 40").select(F.col("deal_id").alias("product_id")).distinct().withColumn("seen", F.lit(1))
    n = c.live.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_offers")).orderBy(F.desc("n_offers"), "product_id").limit(300)
    return n.join(seen, "product_id", "left").select("product_id", "n_offers", F.coalesce("seen", F.lit(0)).alias("seen")).orderBy("seen", F.desc("n_offers"), "product_id")


def q_newsletter_quota(spark, sf_dir):
    """Two picks a store; of 20 places 14 go to local deals, the rest to others."""
    df = deals(Catalog(spark, sf_dir)).where("is_real_deal").withColumn("local", F.coalesce(F.col("country") == "NATION_6", F.lit(False)))
    per_store = Window.partitionBy("store_id").orderBy(F.desc("discount"), "offer_id")
    capped = df.withColumn("rn", F.row_number().over(per_store)).where("rn <= 2")
    parts = [capped.where(w).orderBy(F.desc("discount"), "offer_id").limit(n) for w, n in (("local", 14), ("not local", 6))]
    return parts[0].unionByName(parts[1]).select("offer_id", "store_id", "discount", "local")


def q_redirect_resolution(spark, sf_dir):
    """Where a click leads: its offer if live, else the product's best offer, else nowhere."""
    c = Catalog(spark, sf_dir)
    direct = c.live.select(F.col("offer_id").alias("deal_id"), F.col("offer_id").alias("direct"))
    best = c.live.groupBy("product_id").agg(F.min(F.struct("ngn", "offer_id")).alias("b")).select(F.col("product_id").alias("p"), F.col("b.offer_id").alias("fallback"))
    found = c.clicks.withColumn("p", F.split("deal_id", "-")[0]).join(direct, "deal_id", "left").join(best, "p", "left")
    step = F.when(F.col("direct").isNotNull(), "offer").when(F.col("fallback").isNotNull(), "product").otherwise("none")
    return found.select("event_id", step.alias("step"), F.coalesce("direct", "fallback").alias("target"))


def q_line_configs(spark, sf_dir):
    """Listings of one title line and brand in other configurations."""
    rows = listings(Catalog(spark, sf_dir)).withColumn("config", F.concat_ws("/", T.storage_gb(F.col("listing")).cast("string"), F.array_join(T.variant_tokens(F.col("listing")), "+")))
    return rows.where("brand is not null").groupBy("block", "brand").agg(F.countDistinct("config").alias("n_configs"), F.count(F.lit(1)).alias("n")).where("n_configs > 1")


def q_shoppable_store_count(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    shop = F.coalesce(F.col("country") == "NATION_6", F.col("is_international"))
    return c.live.join(c.stores, "store_id").where(shop).agg(F.countDistinct(F.lower("store_name")).alias("n_stores"), F.count(F.lit(1)).alias("n_offers"))


def q_shadow_match(spark, sf_dir):
    """Best listing for each of three wanted attribute sets, by added points."""
    c = Catalog(spark, sf_dir)
    wanted = spark.createDataFrame([(1, "Brand#2", "ring", 64), (2, "Brand#17", "widget", 128), (3, "Brand#4", "bolt", 256)], "w int, w_brand string, w_word string, w_gb int")
    rows = listings(c).withColumn("gb", T.storage_gb(F.col("listing")))
    pairs = rows.crossJoin(F.broadcast(wanted))  # three rows
    points = F.when(F.col("brand") == F.col("w_brand"), 30).otherwise(0) + F.when(F.contains(F.lower("listing"), F.col("w_word")), 20).otherwise(0) + F.when(F.col("gb") == F.col("w_gb"), 15).otherwise(0)
    best = pairs.withColumn("points", points).where("points > 5").groupBy("w").agg(F.min(F.struct(-F.col("points"), F.col("id"))).alias("b"))
    return best.select("w", F.col("b.id").alias("id"), (-F.col("b.col1")).alias("points"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
SHOP = "coalesce(country = 'NATION_6', is_international)"
ORACLES = {
    "anchor_stats": sql(
        """SELECT s.product_id, n_live, n_stores, low, high, coalesce(n_gone, 0) AS n_gone, gone_low FROM (
        SELECT product_id, count(*) AS n_live, count(DISTINCT store_id) AS n_stores, min(ngn) AS low, max(ngn) AS high FROM o JOIN (SELECT product_id, median(ngn) AS mid FROM o GROUP BY 1) USING (product_id) WHERE ngn <= mid * 3 GROUP BY 1) s
        LEFT JOIN (SELECT product_id, count(DISTINCT store_id) AS n_gone, min(ngn) AS gone_low FROM offers g WHERE NOT in_stock AND recorded_at > TIMESTAMP '2001-11-05' - INTERVAL 90 DAY
        AND NOT EXISTS (SELECT 1 FROM live l WHERE l.product_id = g.product_id AND l.store_id = g.store_id) GROUP BY 1) USING (product_id)""",
        "o AS (SELECT product_id, store_id, round(ngn / 10000)::BIGINT AS step, min(ngn) AS ngn FROM live GROUP BY 1, 2, 3)",
    ),
    "find_similar": sql(
        """SELECT product_id, title, brand = anchor_brand AS same_brand, round(0.55 * sim * 100 + 0.45 * least(CASE WHEN savings >= 85 THEN 0 ELSE savings END, 80), 4) AS rank
        FROM (SELECT *, floor((high - low) * 100 / high) AS savings FROM (SELECT * FROM pool WHERE sim > 0.35 ORDER BY sim DESC, product_id LIMIT 40) JOIN best USING (product_id)) ORDER BY rank DESC, product_id LIMIT 20""",
        f"""best AS (SELECT product_id, count(DISTINCT store_id) AS n_stores, min(ngn) AS low, max(ngn) AS high FROM live GROUP BY 1),
        anchor AS (SELECT product_id AS anchor_id, title AS anchor_title, brand AS anchor_brand FROM ({_scored('products', 'red widget')}) JOIN best USING (product_id) WHERE hits > 0 AND n_stores >= 3 ORDER BY score DESC, product_id LIMIT 1),
        tri AS (SELECT product_id, list_distinct(flatten(list_transform(string_split(lower(title), ' '), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3))))) AS t FROM products),
        pool AS (SELECT p.*, anchor_brand, len(list_intersect(a.t, x.t)) / len(list_distinct(list_concat(a.t, x.t))) AS sim FROM products p JOIN tri x USING (product_id), anchor JOIN tri a ON a.product_id = anchor_id WHERE p.product_id <> anchor_id)""",
    ),
    "variant_partition": sql(
        """SELECT l.id, a.id AS anchor, CASE WHEN l.id = a.id THEN 'anchor' WHEN l.brand <> a.brand THEN 'other' WHEN l.variant <> a.variant THEN 'variant' WHEN l.gb <> a.gb THEN 'sibling' ELSE 'same' END AS kind
        FROM listings l JOIN (SELECT * FROM listings QUALIFY row_number() OVER (PARTITION BY block ORDER BY id) = 1) a USING (block)""",
        LISTINGS,
    ),
    "trending_multi_store": sql(
        f"""SELECT row_number() OVER (PARTITION BY category ORDER BY n_stores DESC, title) AS turn, category, title, n_stores, product_id FROM (
        SELECT lower(title) AS title, category, count(DISTINCT store_id) AS n_stores, min(product_id) AS product_id FROM live JOIN products USING (product_id)
        WHERE store_id IN (SELECT store_id FROM stores WHERE country = 'NATION_6' OR is_international) GROUP BY 1, 2 HAVING count(DISTINCT store_id) >= 2
        QUALIFY row_number() OVER (PARTITION BY lower(title) ORDER BY count(DISTINCT store_id) DESC, category) = 1) QUALIFY turn <= 12"""
    ),
    "local_alternative": sql(
        f"SELECT d.product_id, d.offer_id AS anchor_offer, l.offer_id, l.ngn FROM deals d JOIN (SELECT product_id, first(offer_id ORDER BY ngn, offer_id) AS offer_id, min(ngn) AS ngn FROM live JOIN stores USING (store_id) WHERE {SHOP} GROUP BY 1) l ON l.product_id = d.product_id WHERE NOT {SHOP}",
        DEALS,
    ),
    "suggest_store_badge": sql(
        f"""SELECT product_id, title, score, coalesce(n_stores, 0) AS n_stores FROM (SELECT product_id, brand, title, score FROM ({_scored('products', 'blue gear')}) WHERE hits > 0 ORDER BY score DESC, product_id LIMIT 30)
        LEFT JOIN (SELECT brand, title, count(DISTINCT store_id) AS n_stores FROM live JOIN products USING (product_id) GROUP BY 1, 2) USING (brand, title)"""
    ),
    "price_plausible": sql(
        f"""SELECT category, count(*) FILTER (WHERE ngn >= CASE {' '.join(f"WHEN contains(lower(title), '{w}') THEN {n}" for w, n in FLOORS)} ELSE {FLOOR} END) AS n_plausible, count(*) AS n FROM live JOIN products USING (product_id) GROUP BY 1"""
    ),
    "landing_split": sql(
        """SELECT CASE WHEN country IS NULL THEN 'global' WHEN is_international THEN 'abroad' WHEN discount = 0 THEN 'plain' WHEN discount >= 8 THEN 'top deal' ELSE 'deal' END AS kind, count(*) AS n, count(DISTINCT store_id) AS n_stores
        FROM live JOIN stores USING (store_id) GROUP BY 1"""
    ),
    "sitemap_rows": sql("SELECT product_id, max(recorded_at) AS last_seen FROM offers GROUP BY 1 ORDER BY last_seen DESC, product_id LIMIT 1000"),
    "fresh_first": sql(
        """SELECT product_id, n_offers, (product_id IN (SELECT deal_id FROM clicks WHERE user_id < 40))::INT AS seen FROM (SELECT product_id, count(*) AS n_offers FROM live GROUP BY 1 ORDER BY n_offers DESC, product_id LIMIT 300)"""
    ),
    "newsletter_quota": sql(
        """(SELECT offer_id, store_id, discount, local FROM c WHERE local ORDER BY discount DESC, offer_id LIMIT 14) UNION ALL (SELECT offer_id, store_id, discount, local FROM c WHERE NOT local ORDER BY discount DESC, offer_id LIMIT 6)""",
        DEALS + ", c AS (SELECT *, coalesce(country = 'NATION_6', false) AS local FROM deals WHERE is_real_deal QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY discount DESC, offer_id) <= 2)",
    ),
    "redirect_resolution": sql(
        """SELECT event_id, CASE WHEN l.offer_id IS NOT NULL THEN 'offer' WHEN b.offer_id IS NOT NULL THEN 'product' ELSE 'none' END AS step, coalesce(l.offer_id, b.offer_id) AS target
        FROM clicks LEFT JOIN live l ON l.offer_id = deal_id LEFT JOIN (SELECT product_id, first(offer_id ORDER BY ngn, offer_id) AS offer_id FROM live GROUP BY 1) b ON b.product_id = split_part(deal_id, '-', 1)"""
    ),
    "line_configs": sql("SELECT block, brand, count(DISTINCT gb * 10 + variant) AS n_configs, count(*) AS n FROM listings WHERE brand IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT gb * 10 + variant) > 1", LISTINGS),
    "shoppable_store_count": sql(f"SELECT count(DISTINCT lower(store_name)) AS n_stores, count(*) AS n_offers FROM live JOIN stores USING (store_id) WHERE {SHOP}"),
    "shadow_match": sql(
        """SELECT w, id, points FROM (SELECT w, id, CASE WHEN brand = w_brand THEN 30 ELSE 0 END + CASE WHEN contains(lower(listing), w_word) THEN 20 ELSE 0 END + CASE WHEN (gb + 1) * 64 = w_gb THEN 15 ELSE 0 END AS points
        FROM listings, (VALUES (1, 'Brand#2', 'ring', 64), (2, 'Brand#17', 'widget', 128), (3, 'Brand#4', 'bolt', 256)) t(w, w_brand, w_word, w_gb)) WHERE points > 5 QUALIFY row_number() OVER (PARTITION BY w ORDER BY points DESC, id) = 1""",
        LISTINGS,
    ),
}
