"""Best offers, browsing, facets and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.catalog import AS_OF, Catalog, days_before, sql
from pricewright.session import refresh, stored


def best_offers(c: Catalog, at: str = AS_OF) -> DataFrame:
    """Cheapest live offer of each product, and whether it is a real deal.

    It must beat 99 % of the cheapest offer of another store, or of the highest
    price of the last 30 days (with two prices at least), or carry a discount.
    Flags are null where there is nothing to compare.
    """
    rest = ["cents", "currency", "discount", "recorded_at", "in_stock"]
    by_store = c.live.select("product_id", "store_id", "ngn", "offer_id", *rest)
    if not getattr(c, "one_offer_by_store", False):
        by_store = by_store.groupBy("product_id", "store_id").agg(F.min(F.struct("ngn", "offer_id", *rest)).alias("o")).select("product_id", "store_id", "o.*")
    by = Window.partitionBy("product_id").orderBy("ngn", "offer_id")
    # the next row of a product is the cheapest of another store; tasks keep two rows of a product before they move them
    two = by_store.withColumn("rn", F.row_number().over(by)).where("rn <= 2")
    ranked = two.withColumn("runner_ngn", F.lead("ngn").over(by))
    anchor = ranked.where("rn = 1").drop("rn")
    hist = (
        c.points.where(F.col("recorded_at") > days_before(30, at))
        .groupBy("product_id")
        .agg(F.max("ngn").alias("high_ngn"), F.countDistinct("recorded_at").alias("n_points"))
    )
    cheapest = F.col("ngn") * 100 < F.col("runner_ngn") * 99
    below = (F.col("n_points") >= 2) & (F.col("ngn") * 100 < F.col("high_ngn") * 99)
    return (
        anchor.join(hist, "product_id", "left")
        .withColumn("cross_store_cheapest", cheapest)
        .withColumn("below_30d_high", below)
        .withColumn("is_real_deal", (F.col("discount") > 0) | F.col("cross_store_cheapest") | F.col("below_30d_high"))
    )


BEST_OFFERS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY ngn, offer_id) AS rn FROM live),
anchor AS (SELECT * EXCLUDE rn FROM ranked WHERE rn = 1),
runner AS (SELECT a.product_id, min(r.ngn) AS runner_ngn FROM anchor a JOIN live r ON r.product_id = a.product_id AND r.store_id <> a.store_id GROUP BY 1),
hist AS (SELECT product_id, max(ngn) AS high_ngn, count(DISTINCT recorded_at) AS n_points FROM points WHERE recorded_at > TIMESTAMP '2001-11-05' - INTERVAL 30 DAY GROUP BY 1),
flags AS (
  SELECT a.*, runner_ngn, high_ngn, n_points, a.ngn * 100 < runner_ngn * 99 AS cross_store_cheapest, n_points >= 2 AND a.ngn * 100 < high_ngn * 99 AS below_30d_high
  FROM anchor a LEFT JOIN runner USING (product_id) LEFT JOIN hist USING (product_id)
), best_offers AS (SELECT *, discount > 0 OR cross_store_cheapest OR below_30d_high AS is_real_deal FROM flags)"""


def deals(c: Catalog) -> DataFrame:
    """Best offers with product and store, the stored view that browsing reads."""
    return stored(c.spark, f"{c.sf_dir}/deals", lambda: compute_deals(c), deal_inputs(c))


def deal_inputs(c: Catalog) -> list[str]:
    return [c.path(name) for name in ("lineitem", "part", "supplier", "nation")]


def compute_deals(c: Catalog) -> DataFrame:
    return best_offers(c).join(c.products, "product_id").join(c.stores, "store_id")


DEALS = BEST_OFFERS + ", deals AS (SELECT * FROM best_offers JOIN products USING (product_id) JOIN stores USING (store_id))"


def reachable(country: str | None, store_country: Column, international: Column) -> Column:
    """A buyer's country, or a global store that ships abroad; no country reaches all."""
    if country is None:
        return F.lit(True)
    return F.coalesce(store_country == country, international)


#: Sort names to (column, descending).
SORTS = {"discount": ("discount", True), "newest": ("recorded_at", True), "price_asc": ("ngn", False), "price_desc": ("ngn", True)}


def browse(
    c: Catalog,
    category: str | None = None,
    min_discount: int | None = None,
    zero_only: bool = False,
    real_deals: bool = False,
    text: str | None = None,
    origin: str | None = None,
    stores: list[str] | None = None,
    country: str | None = None,
    sort: str = "discount",
    limit: int = 500,
) -> DataFrame:
    """Filtered and sorted deals; a filter left out (None, "all", an empty list) adds no predicate."""
    df = deals(c)
    if category not in (None, "all"):
        df = df.where(F.col("category") == category)
    if zero_only:
        df = df.where(F.coalesce("discount", F.lit(0)) == 0)
    elif min_discount is not None:
        df = df.where(F.coalesce("discount", F.lit(0)) >= min_discount)
    if real_deals:
        df = df.where("is_real_deal")
    if text:
        df = df.where(F.col("title").ilike(f"%{text}%"))
    if origin == "local":
        df = df.where(F.col("country") == country if country else ~F.col("is_international"))
    elif origin == "intl":
        df = df.where("is_international")
    if stores:
        df = df.where(F.col("store_id").isin(stores))
    if country:
        df = df.where(reachable(country, F.col("country"), F.col("is_international")))
    local_first = [F.desc(F.coalesce(F.col("country") == country, F.lit(False)))] if country else []
    fresh = [F.desc_nulls_last("recorded_at")] if zero_only else []
    column, descending = SORTS[sort]
    chosen = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    order = [*local_first, *fresh, chosen, F.desc_nulls_last("discount"), F.asc("offer_id")]
    return df.orderBy(*order).limit(limit)


SHOWN = ["product_id", "offer_id", "store_id", "title", "category", "ngn", "discount", "country", "is_real_deal"]


def q_best_offers(spark, sf_dir):
    return best_offers(Catalog(spark, sf_dir)).drop("recorded_at", "in_stock")


def refresh_views(c: Catalog) -> None:
    """Recompute the stored offers, then the deals that are made of them."""
    refresh(f"{c.sf_dir}/offers", c.latest_points(), [c.path("lineitem")])
    fresh = Catalog(c.spark, c.sf_dir)
    refresh(f"{c.sf_dir}/deals", compute_deals(fresh), deal_inputs(c))


def q_matview_refresh(spark, sf_dir):
    """The stored deals after a refresh."""
    c = Catalog(spark, sf_dir)
    refresh_views(c)
    return deals(c).select(*SHOWN)


def q_browse_deals(spark, sf_dir):
    return browse(Catalog(spark, sf_dir), min_discount=3, country="NATION_6", sort="discount").select(*SHOWN)


def q_browse_local_newest(spark, sf_dir):
    return browse(Catalog(spark, sf_dir), origin="local", country="NATION_6", sort="newest", real_deals=True).select(*SHOWN)


def q_browse_zero_text(spark, sf_dir):
    return browse(Catalog(spark, sf_dir), zero_only=True, text="b_l", category="ECONOMY", sort="price_asc", limit=100).select(*SHOWN)


def q_browse_stores(spark, sf_dir):
    return browse(Catalog(spark, sf_dir), stores=[str(i) for i in range(40)], origin="intl", sort="price_desc").select(*SHOWN)


def q_store_facets(spark, sf_dir):
    """One pass: a filtered count, stores without hits stay. Offers are counted by store before they meet it."""
    c = Catalog(spark, sf_dir)
    hit = (F.col("discount") >= 5) & F.col("in_stock")
    counted = c.offers.groupBy("store_id").agg(F.count_if(hit).alias("n_deals"), F.count_if("in_stock").alias("n_live"), F.max("discount").alias("top_discount"))
    return counted.join(c.stores.select("store_id", "store_name"), "store_id")


def q_origin_counts(spark, sf_dir):
    local = F.coalesce(F.col("country") == "NATION_6", F.lit(False))
    deal = F.coalesce("is_real_deal", F.lit(False))
    return deals(Catalog(spark, sf_dir)).agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(local).alias("n_local"),
        F.count_if("is_international").alias("n_intl"),
        F.count_if(deal).alias("n_deals"),
        F.count_if(deal & local).alias("n_deals_local"),
        F.count_if(deal & F.col("is_international")).alias("n_deals_intl"),
    )


def q_rollup_category(spark, sf_dir):
    """Counts by country and category, with the category "all"."""
    c = Catalog(spark, sf_dir)
    rows = c.live.join(c.products.select("product_id", "category"), "product_id").join(c.stores, "store_id")
    return (
        rows.where("country is not null")
        .rollup("country", "category")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_international")).alias("n_local"), F.count_if(F.col("discount") > 0).alias("n_deals"))
        .where("country is not null")
        .select("country", F.coalesce("category", F.lit("all")).alias("category"), "n", "n_local", "n_deals")
    )


def q_rollup_store(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    rows = c.live.join(c.products.select("product_id", "category"), "product_id")
    counted = rows.groupBy("store_id", "category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("discount") > 0).alias("n_deals"))
    named = counted.join(c.stores, "store_id")
    return named.groupBy(F.coalesce("country", F.lit("global")).alias("country"), "category", F.lower("store_name").alias("store")).agg(F.sum("n").alias("n"), F.sum("n_deals").alias("n_deals"))


def q_brand_rollup(spark, sf_dir):
    """Brands by slug with their most frequent spelling; small ones left out."""
    c = Catalog(spark, sf_dir)
    slug = F.trim(F.regexp_replace(F.regexp_replace(F.lower("brand"), "&", " and "), "[^a-z0-9]+", "-"), F.lit("-"))
    spelled = c.products.groupBy(slug.alias("slug"), "brand").agg(F.count(F.lit(1)).alias("n"))
    label = F.min_by("brand", F.struct(-F.col("n"), F.col("brand")))
    return spelled.groupBy("slug").agg(label.alias("label"), F.sum("n").alias("n_products")).where("n_products >= 3").orderBy(F.desc("n_products"), "label").limit(60)


def q_reach_fold(spark, sf_dir):
    """Products by market that sells them, and in all."""
    c = Catalog(spark, sf_dir)
    sold = c.live.join(c.stores, "store_id").select("product_id", F.coalesce("country", F.lit("global")).alias("market"))
    return sold.rollup("market").agg(F.countDistinct("product_id").alias("n_products")).select(F.coalesce("market", F.lit("total")).alias("market"), "n_products")


def q_diversity_prune(spark, sf_dir):
    """Categories with three products or a tenth of a store's pool, once the pool has 15."""
    c = Catalog(spark, sf_dir)
    pool = c.live.join(c.products.select("product_id", "category"), "product_id")
    n = pool.groupBy("store_id", "category").agg(F.count(F.lit(1)).alias("n")).withColumn("pool", F.sum("n").over(Window.partitionBy("store_id")))
    return n.where((F.col("pool") < 15) | (F.col("n") >= 3) | (F.col("n") * 10 >= F.col("pool")))


def q_suggest_multistore(spark, sf_dir):
    """Products with a local store and one elsewhere, with how many stores have them."""
    c = Catalog(spark, sf_dir)
    sold = c.live.join(c.stores, "store_id").withColumn("local", F.coalesce(F.lower("country") == "nation_6", F.lit(False)))
    found = sold.groupBy("product_id").agg(
        F.countDistinct("store_id").alias("n_stores"), F.count(F.lit(1)).alias("n_offers"), F.max("local").alias("here"), F.max(~F.col("local")).alias("there")
    )
    return found.where("here and there").join(c.products, "product_id").where(F.length("title").between(6, 80)).select("product_id", "title", "category", "n_stores", "n_offers")


def q_suggest_diverse(spark, sf_dir):
    """The best-stocked of them for each category."""
    by = Window.partitionBy("category").orderBy(F.desc("n_stores"), F.desc("n_offers"), "product_id")
    return q_suggest_multistore(spark, sf_dir).withColumn("rn", F.row_number().over(by)).where("rn = 1").drop("rn")


def q_top_stores_audit(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    n = c.live.groupBy("store_id").agg(F.count(F.lit(1)).alias("n_live"))
    return n.join(c.stores, "store_id").orderBy(F.desc("n_live"), "store_id").limit(20).select("store_id", "n_live", F.coalesce("country", F.lit("global")).alias("market"))


def q_category_hub(spark, sf_dir):
    """A page of one category: one row for each title, best discount first."""
    df = deals(Catalog(spark, sf_dir)).where("category = 'PROMO' and discount >= 2")
    by = Window.partitionBy(F.lower("title")).orderBy(F.desc("discount"), F.desc("recorded_at"), "offer_id")
    return df.withColumn("rn", F.row_number().over(by)).where("rn = 1").select("product_id", "offer_id", "title", "discount", "ngn")


def q_three_pass_pool(spark, sf_dir):
    """Local deals and undiscounted local offers by turns, then cross-border deals; first place wins."""
    df = deals(Catalog(spark, sf_dir)).select("product_id", "offer_id", "discount", "country", "is_international", "recorded_at")
    local = F.coalesce(F.col("country") == "NATION_6", F.lit(False))
    passes = [
        ("A", df.where(local & (F.col("discount") > 0)), [F.desc("discount"), F.asc("offer_id")], 500),
        ("B", df.where(F.col("is_international") & (F.col("discount") > 0)), [F.desc("discount"), F.asc("offer_id")], 1000),
        ("C", df.where(local & (F.col("discount") == 0)), [F.desc("recorded_at"), F.asc("offer_id")], 1500),
    ]
    pool = None
    for name, rows, order, limit in passes:
        top = rows.orderBy(*order).limit(limit).withColumn("pos", F.row_number().over(Window.orderBy(*order)))  # at most `limit` rows
        top = top.select("product_id", "offer_id", F.lit(name).alias("pass"), "pos")
        pool = top if pool is None else pool.unionByName(top)
    rank = F.struct(F.col("pass") == "B", F.col("pos"), F.col("pass"))
    first = pool.groupBy("product_id", "offer_id").agg(F.min(rank).alias("rank"))
    return first.select("product_id", "offer_id", F.col("rank.pass").alias("pass"), F.col("rank.pos").alias("pos"))


def q_deals_page(spark, sf_dir):
    """The second page of real deals that a country reaches, with the total."""
    df = deals(Catalog(spark, sf_dir)).where("is_real_deal").where(reachable("NATION_6", F.col("country"), F.col("is_international")))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    page = df.orderBy(F.desc("discount"), "offer_id").offset(24).limit(24)
    return page.crossJoin(F.broadcast(total)).select("offer_id", "discount", "total", (F.col("total") > 48).alias("has_more"))  # one row


def q_store_spacing_quota(spark, sf_dir):
    """At most two picks of a store in rank order."""
    df = deals(Catalog(spark, sf_dir)).where("discount > 0")
    by = Window.partitionBy("store_id").orderBy(F.desc("discount"), "offer_id")
    return df.withColumn("rank_in_store", F.row_number().over(by)).where("rank_in_store <= 2").select("offer_id", "store_id", "discount", "rank_in_store")


def q_round_robin_category(spark, sf_dir):
    """Categories by turns, twelve products each."""
    df = deals(Catalog(spark, sf_dir)).where("is_real_deal")
    by = Window.partitionBy("category").orderBy(F.desc("discount"), "offer_id")
    return df.withColumn("turn", F.row_number().over(by)).where("turn <= 12").select("turn", "category", "offer_id", "discount").orderBy("turn", "category")


def q_price_gap_report(spark, sf_dir):
    """Products whose dearest store could drop its price by 10 to 94 percent to match the cheapest."""
    c = Catalog(spark, sf_dir)
    by_store = c.live.groupBy("product_id", "store_id").agg(F.min("ngn").alias("ngn"))
    gap = by_store.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_stores"), F.min("ngn").alias("low"), F.max("ngn").alias("high"))
    percent = F.floor((F.col("high") - F.col("low")) * 100 / F.col("high"))
    return gap.where("n_stores >= 2").withColumn("percent", percent).where("percent >= 10 and percent < 95").select("product_id", "n_stores", "low", "high", "percent")


def q_group_stats(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    key = F.struct("ngn", "offer_id")
    return c.live.groupBy("product_id").agg(
        F.countDistinct("store_id").alias("n_stores"),
        F.min_by("offer_id", key).alias("best_offer"),
        F.max_by("offer_id", key).alias("worst_offer"),
        (F.max("ngn") - F.min("ngn")).alias("max_savings"),
    )


def q_group_by_signature(spark, sf_dir):
    """Cheapest offer by store of all products with one signature, and the group's title."""
    c = Catalog(spark, sf_dir)
    rows = c.live.join(c.products.select("product_id", "title", "brand"), "product_id").withColumn("signature", F.concat_ws("|", "brand", "title"))
    by = Window.partitionBy("signature", "store_id").orderBy("ngn", "offer_id")
    one = rows.withColumn("rn", F.row_number().over(by)).where("rn = 1")
    return one.groupBy("signature").agg(
        F.max_by("title", F.length("title")).alias("title"), F.count(F.lit(1)).alias("n_stores"), F.min("ngn").alias("low"), F.countDistinct("product_id").alias("n_products")
    )


def q_landed_price(spark, sf_dir):
    """Cross-border offers cost 30 percent more on arrival."""
    c = Catalog(spark, sf_dir)
    crosses = F.coalesce(F.col("country") != "NATION_6", F.lit(True))
    return c.live.join(c.stores, "store_id").select(
        "offer_id", crosses.alias("cross_border"), F.when(crosses, F.floor((F.col("ngn") * 130 + 50) / 100)).otherwise(F.col("ngn")).alias("landed_ngn")
    )


def q_price_alternatives(spark, sf_dir):
    """Other products of the title's first word within 0.15 to 5 times the anchor's best price."""
    c = Catalog(spark, sf_dir)
    best = c.live.groupBy("product_id").agg(F.min("ngn").alias("ngn")).join(c.products.select("product_id", "title", "brand"), "product_id")
    anchor = best.where("product_id = '7'").select(F.col("product_id").alias("a"), F.col("ngn").alias("a_ngn"), F.col("brand").alias("brand"))
    pairs = best.join(F.broadcast(anchor), "brand").where("product_id <> a").where(F.col("ngn").between(F.col("a_ngn") * 0.15, F.col("a_ngn") * 5))
    return pairs.select("product_id", "title", "ngn")


def q_true_and_upper_median(spark, sf_dir):
    """Exact median of a product's prices, and the element at half its length."""
    c = Catalog(spark, sf_dir)
    prices = c.live.groupBy("product_id").agg(F.sort_array(F.collect_list("ngn")).alias("s"))
    at = lambda i: F.get("s", F.floor(i / 2).cast("int"))
    return prices.select("product_id", ((at(F.size("s") - 1) + at(F.size("s"))) / 2).alias("true_median"), at(F.size("s")).alias("upper_median"))


def q_clone_band(spark, sf_dir):
    """Global-store offers below 0.35 of the median of the product's country stores."""
    c = Catalog(spark, sf_dir)
    rows = c.live.join(c.stores, "store_id")
    band = rows.where("country is not null").groupBy("product_id").agg(F.median("ngn").alias("band"))
    return rows.where("country is null").join(band, "product_id").where("ngn < 0.35 * band").select("offer_id", "ngn", "band")


S = ", ".join(SHOWN)
REACH = "coalesce(country = 'NATION_6', is_international)"
LOCAL = "coalesce(country = 'NATION_6', false)"

QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
ORACLES = {
    "matview_refresh": sql(f"SELECT {', '.join(SHOWN)} FROM deals", DEALS),
    "best_offers": sql("SELECT * EXCLUDE (recorded_at, in_stock) FROM best_offers", BEST_OFFERS),
    "browse_deals": sql(f"SELECT {S} FROM deals WHERE coalesce(discount, 0) >= 3 AND {REACH} ORDER BY {LOCAL} DESC, discount DESC NULLS LAST, offer_id LIMIT 500", DEALS),
    "browse_local_newest": sql(
        f"SELECT {S} FROM deals WHERE is_real_deal AND country = 'NATION_6' ORDER BY recorded_at DESC NULLS LAST, discount DESC NULLS LAST, offer_id LIMIT 500", DEALS
    ),
    "browse_zero_text": sql(
        f"SELECT {S} FROM deals WHERE category = 'ECONOMY' AND coalesce(discount, 0) = 0 AND title ILIKE '%b_l%' ORDER BY recorded_at DESC NULLS LAST, ngn NULLS LAST, discount DESC, offer_id LIMIT 100",
        DEALS,
    ),
    "browse_stores": sql(f"SELECT {S} FROM deals WHERE is_international AND store_id::INT < 40 ORDER BY ngn DESC NULLS LAST, discount DESC, offer_id LIMIT 500", DEALS),
    "store_facets": sql(
        "SELECT store_id, store_name, count(*) FILTER (WHERE discount >= 5 AND in_stock) AS n_deals, count(*) FILTER (WHERE in_stock) AS n_live, max(discount) AS top_discount FROM offers JOIN stores USING (store_id) GROUP BY 1, 2"
    ),
    "origin_counts": sql(
        f"""SELECT count(*) AS n_all, count(*) FILTER (WHERE country = 'NATION_6') AS n_local, count(*) FILTER (WHERE is_international) AS n_intl, count(*) FILTER (WHERE is_real_deal) AS n_deals,
        count(*) FILTER (WHERE is_real_deal AND country = 'NATION_6') AS n_deals_local, count(*) FILTER (WHERE is_real_deal AND is_international) AS n_deals_intl FROM deals""",
        DEALS,
    ),
    "rollup_category": sql(
        """SELECT country, category, count(*) AS n, count(*) FILTER (WHERE NOT is_international) AS n_local, count(*) FILTER (WHERE discount > 0) AS n_deals
        FROM (SELECT country, unnest([category, 'all']) AS category, is_international, discount FROM live JOIN products USING (product_id) JOIN stores USING (store_id) WHERE country IS NOT NULL) GROUP BY 1, 2"""
    ),
    "rollup_store": sql(
        """SELECT coalesce(country, 'global') AS country, category, lower(store_name) AS store, count(*) AS n, count(*) FILTER (WHERE discount > 0) AS n_deals
        FROM live JOIN products USING (product_id) JOIN stores USING (store_id) GROUP BY 1, 2, 3"""
    ),
    "brand_rollup": sql(
        """SELECT slug, label, n_products FROM (SELECT slug, arg_min(brand, {'a': -n, 'b': brand}) AS label, sum(n)::BIGINT AS n_products FROM (
        SELECT trim(regexp_replace(replace(lower(brand), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-') AS slug, brand, count(*) AS n FROM products GROUP BY 1, 2) GROUP BY 1)
        WHERE n_products >= 3 ORDER BY n_products DESC, label LIMIT 60"""
    ),
    "reach_fold": sql(
        """SELECT market, count(DISTINCT product_id) AS n_products FROM (SELECT product_id, unnest([coalesce(country, 'global'), 'total']) AS market FROM live JOIN stores USING (store_id)) GROUP BY 1"""
    ),
    "diversity_prune": sql(
        "SELECT * FROM (SELECT store_id, category, n, (sum(n) OVER (PARTITION BY store_id))::BIGINT AS pool FROM (SELECT store_id, category, count(*) AS n FROM live JOIN products USING (product_id) GROUP BY 1, 2)) WHERE pool < 15 OR n >= 3 OR n * 10 >= pool"
    ),
    "suggest_multistore": sql(
        """SELECT product_id, title, category, count(DISTINCT store_id) AS n_stores, count(*) AS n_offers FROM live JOIN stores USING (store_id) JOIN products USING (product_id)
        WHERE length(title) BETWEEN 6 AND 80 GROUP BY 1, 2, 3 HAVING bool_or(coalesce(lower(country) = 'nation_6', false)) AND bool_or(coalesce(lower(country) <> 'nation_6', true))"""
    ),
    "suggest_diverse": sql(
        "SELECT product_id, title, category, n_stores, n_offers FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n_stores DESC, n_offers DESC, product_id) AS rn FROM multi) WHERE rn = 1",
        """multi AS (SELECT product_id, title, category, count(DISTINCT store_id) AS n_stores, count(*) AS n_offers FROM live JOIN stores USING (store_id) JOIN products USING (product_id)
        WHERE length(title) BETWEEN 6 AND 80 GROUP BY 1, 2, 3 HAVING bool_or(coalesce(lower(country) = 'nation_6', false)) AND bool_or(coalesce(lower(country) <> 'nation_6', true)))""",
    ),
    "top_stores_audit": sql(
        "SELECT store_id, n_live, coalesce(country, 'global') AS market FROM (SELECT store_id, count(*) AS n_live FROM live GROUP BY 1) JOIN stores USING (store_id) ORDER BY n_live DESC, store_id LIMIT 20"
    ),
    "category_hub": sql(
        "SELECT product_id, offer_id, title, discount, ngn FROM (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY discount DESC, recorded_at DESC, offer_id) AS rn FROM deals WHERE category = 'PROMO' AND discount >= 2) WHERE rn = 1",
        DEALS,
    ),
    "three_pass_pool": sql(
        """SELECT product_id, offer_id, pass, pos FROM (SELECT *, row_number() OVER (PARTITION BY product_id, offer_id ORDER BY pass = 'B', pos, pass) AS rn FROM (
        SELECT product_id, offer_id, 'A' AS pass, row_number() OVER (ORDER BY discount DESC, offer_id) AS pos FROM deals WHERE country = 'NATION_6' AND discount > 0 QUALIFY pos <= 500
        UNION ALL SELECT product_id, offer_id, 'B', row_number() OVER (ORDER BY discount DESC, offer_id) AS pos FROM deals WHERE is_international AND discount > 0 QUALIFY pos <= 1000
        UNION ALL SELECT product_id, offer_id, 'C', row_number() OVER (ORDER BY recorded_at DESC, offer_id) AS pos FROM deals WHERE country = 'NATION_6' AND discount = 0 QUALIFY pos <= 1500)) WHERE rn = 1""",
        DEALS,
    ),
    "deals_page": sql(
        f"SELECT offer_id, discount, total, total > 48 AS has_more FROM (SELECT *, count(*) OVER () AS total FROM deals WHERE is_real_deal AND {REACH}) ORDER BY discount DESC, offer_id LIMIT 24 OFFSET 24",
        DEALS,
    ),
    "store_spacing_quota": sql(
        "SELECT offer_id, store_id, discount, row_number() OVER (PARTITION BY store_id ORDER BY discount DESC, offer_id) AS rank_in_store FROM deals WHERE discount > 0 QUALIFY rank_in_store <= 2", DEALS
    ),
    "round_robin_category": sql(
        "SELECT row_number() OVER (PARTITION BY category ORDER BY discount DESC, offer_id) AS turn, category, offer_id, discount FROM deals WHERE is_real_deal QUALIFY turn <= 12", DEALS
    ),
    "price_gap_report": sql(
        """SELECT product_id, n_stores, low, high, floor((high - low) * 100 / high)::BIGINT AS percent FROM (SELECT product_id, count(DISTINCT store_id) AS n_stores, min(ngn) AS low, max(ngn) AS high FROM live GROUP BY 1)
        WHERE n_stores >= 2 AND floor((high - low) * 100 / high) BETWEEN 10 AND 94"""
    ),
    "group_stats": sql(
        """SELECT product_id, count(DISTINCT store_id) AS n_stores, first(offer_id ORDER BY ngn, offer_id) AS best_offer, first(offer_id ORDER BY ngn DESC, offer_id DESC) AS worst_offer, max(ngn) - min(ngn) AS max_savings FROM live GROUP BY 1"""
    ),
    "group_by_signature": sql(
        """SELECT signature, max(title) AS title, count(*) AS n_stores, min(ngn) AS low, count(DISTINCT product_id) AS n_products FROM (
        SELECT *, brand || '|' || title AS signature, row_number() OVER (PARTITION BY brand, title, store_id ORDER BY ngn, offer_id) AS rn FROM live JOIN products USING (product_id)) WHERE rn = 1 GROUP BY 1"""
    ),
    "landed_price": sql(
        "SELECT offer_id, coalesce(country <> 'NATION_6', true) AS cross_border, CASE WHEN coalesce(country <> 'NATION_6', true) THEN floor((ngn * 130 + 50) / 100)::BIGINT ELSE ngn END AS landed_ngn FROM live JOIN stores USING (store_id)"
    ),
    "price_alternatives": sql(
        "SELECT b.product_id, b.title, b.ngn FROM best b JOIN best a ON a.product_id = '7' AND a.brand = b.brand AND b.product_id <> '7' WHERE b.ngn BETWEEN a.ngn * 0.15 AND a.ngn * 5",
        "best AS (SELECT product_id, title, brand, min(ngn) AS ngn FROM live JOIN products USING (product_id) GROUP BY 1, 2, 3)",
    ),
    "true_and_upper_median": sql("SELECT product_id, median(ngn)::DOUBLE AS true_median, list_sort(list(ngn))[floor(count(*) / 2)::INT + 1] AS upper_median FROM live GROUP BY 1"),
    "clone_band": sql(
        "SELECT offer_id, ngn, band FROM live JOIN stores USING (store_id) JOIN (SELECT product_id, median(ngn)::DOUBLE AS band FROM live JOIN stores USING (store_id) WHERE country IS NOT NULL GROUP BY 1) USING (product_id) WHERE country IS NULL AND ngn < 0.35 * band"
    ),
}
