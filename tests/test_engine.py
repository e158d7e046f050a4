"""Fixtures of edge rows for operators, and every query against its oracle at the smallest size."""

import hashlib
import hmac
from datetime import datetime as D

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pricewright import registry
from pricewright.functions import text as T
from pricewright.functions import vectors as V
from pricewright.operators import activity, graph, history, matching, offers, search
from pricewright.sources import feeds
from pricewright.streaming import jobs

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<float>' if isinstance(v, list) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first().r


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if value is None or value != value:
        return None
    return f"{float(value):.5g}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def agrees(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = registry.QUERIES[name](spark, sf_dir)
    names = sorted(got.columns)
    quoted = ", ".join(f'"{n}"' for n in names)
    want = con.execute(f"SELECT {quoted} FROM ({registry.ORACLES[name]})").fetchall()
    rows = [tuple(plain(v) for v in r) for r in got.select(*names).collect()]
    assert sorted(rows, key=repr) == sorted((tuple(plain(v) for v in r) for r in want), key=repr)
    return len(rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_oracle(spark, sf_dir, name):
    agrees(spark, sf_dir, name)


LARGER = ["browse_deals", "three_pass_pool", "price_timeseries", "orphan_reconcile", "fixed_window_limit", "vec_topk", "trigram_pairs", "same_product_links", "resignature", "fts_gate", "stream_price_changes"]


@pytest.mark.parametrize("name", LARGER)
def test_query_matches_oracle_on_more_rows(spark, name):
    assert agrees(spark, "/root/testdata/sf0.01", name) > 0


def test_fixed_windows_are_a_fold(spark):
    """A hot user, ties, nulls and windows across batches."""
    from random import Random

    draw = Random(3)
    rows = [(i, 1 if i % 3 else draw.randrange(9), D.fromtimestamp(1_700_000_000 + draw.randrange(90_000))) for i in range(3000)]
    rows += [(9000, None, D(2024, 1, 1)), (9001, 1, None), (9002, 77, D(2024, 1, 1)), (9003, 77, D(2024, 1, 1))]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    got = {(r.user_id, r.event_id): r.window_no for r in activity.fixed_windows(events, 3600).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for user in {u for _, u, t in rows if u is not None}:
        start, no = None, 0
        for t, i in sorted((t, i) for i, u, t in rows if u == user and t is not None):
            if start is None or (t - start).total_seconds() >= 3600:
                start, no = t, no + 1
            want[user, i] = no
    assert got == want
    assert activity.fixed_windows(events.limit(0), 3600).count() == 0


def test_nearest_takes_queries_in_blocks(spark, monkeypatch):
    rows = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(4)]) for i in range(60)] + [(60, None), (None, [1.0] * 4), (61, [0.0] * 4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = search.nearest(table, table.where("vec_id % 10 = 0"), search._rounded, 3).collect()
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    assert sorted(search.nearest(table, table.where("vec_id % 10 = 0"), search._rounded, 3).collect()) == sorted(whole)
    assert len(whole) == 18 and all(r.q_id != r.vec_id for r in whole)
    assert search.nearest(table, table.limit(0), search._rounded, 3).count() == 0


def test_identity_of_titles(spark):
    from pricewright.functions import identity as I

    def found(title):
        return one(spark, I.find_brand(T.strip_punct(F.col("t"))), t=title)

    assert [found(t) for t in ("Case for Samsung Galaxy S21", "Spigen, fits Apple iPhone", "Apple pie", "Apple iPhone 15", "Google Nest by Sony", "Google Pixel 8", "Fashion Nova HP dress", None)] == [
        None, None, None, "apple", "sony", "google", "fashionnova", None,
    ]
    signed = lambda t: one(spark, I.signature(*(lambda n: (I.find_brand(n), I.find_model(I.find_brand(n), n), I.inches(n)))(T.strip_punct(F.col("t")))), t=t)
    assert [signed(t) for t in ("Apple iPhone 15 Pro Max 256GB", "LG 55 inch OLED55C3 tv", "LG i7 16gb", "Samsung washing machine", "Nokia AB1200 6.1 inch")] == [
        "apple|iphone 15 pro max", "lg|oled55c3|55in", None, None, "nokia|ab1200",
    ]
    clash = lambda a, b: one(spark, I.tech_conflict(T.strip_punct(F.col("a")), T.strip_punct(F.col("b"))), a=a, b=b)
    assert clash("phone S23", "phone S24") and clash("S24 5G", "S23") and not clash("S24 AB1", "S23") and not clash("x 4gb 64gb", "x 8gb 128gb") and clash("LG oled tv", "Samsung oled tv") and not clash("sharp design", "sony design")
    assert clash("watch gen 4", "watch generation 5") and not clash("film 4k", "film 8k")
    assert one(spark, F.array_join(I.size_tokens(F.col("t")), ","), t="10ml20ml") == "10ml,20ml"
    assert clash("LG oled tv", "LG qled tv") and clash("x 64gb", "x 128gb") and not clash("LG oled tv", "LG tv") and clash("series 6", "series 7")
    assert one(spark, F.array_join(I.size_tokens(F.col("t")), ","), t='Cup 40 oz, 2.0l 12" 5in') == "12inch,2l,40oz,5inch"
    assert one(spark, F.array_join(I.fashion_size(F.col("t")), ","), t="UK 8 size M XXL sz 9.5") == "am,axxl,n9.5,uk8"
    assert [one(spark, I.audience(F.col("t")), t=t) for t in ("OMEN laptop", "womens men", "unisex kids", "boys tee")] == [None, "women", None, "kids"]


def test_shown_titles_and_links(spark):
    from pricewright.functions import display as D_

    shown = lambda f, t: one(spark, f(F.col("t")), t=t)
    assert shown(D_.clean_title_display, "<b>S0es</b>\u200b - -- new") == "S0es - new" and shown(D_.clean_title_display, "Sh0es") == "Shoes"
    assert shown(D_.clean_title_display, "Veat00l g00gle ZJM01 A0BK S0\u0001x") == "Veatool google ZJM01 A0BK S0 x"
    assert shown(D_.clean_title_display, " | Red – | shoe\ufffd - ") == "Red - shoe" and shown(D_.sanitize_label, "a\u0001b - - c") == "a b - - c"
    joined = "क्\u200dष \U0001f468\u200d\U0001f469 می\u200cخواهم"
    assert shown(D_.clean_title_display, f"{joined}\u202e\u200b") == joined
    chips = {
        "SAMSUNG Galaxy A06-A065F Android Mobile Smart Phone": "Samsung Galaxy A06", "Apple iPhone 17 Pro": "iPhone 17 Pro", "APPLE AIRPODS 4": "AirPods 4", "JBL Go 4 Portable Bluetooth Speaker": "JBL Go 4",
        "Samsung Galaxy A26 5g - 6.7 inch": "Samsung Galaxy A26 5G", "Galaxy S25 Fe": "Galaxy S25 FE", "<b>Nike</b> shoe with 2 laces": "Nike shoe", "x" * 50: "x" * 32, "": "",
        "Some very long name of a thing that goes on": "Some very long name of a thing",
    }
    assert {t: shown(D_.friendly_chip, t) for t in chips} == chips
    assert shown(D_.slug_title, "https://a.b/samsung-galaxy-a06-128gb-blue-356834.html") == "Samsung Galaxy A06 128GB Blue"
    assert shown(D_.slug_title, "https://a.b/Red-Shoe/dp/B07PXGQC1Q") == "Red Shoe" and shown(D_.slug_title, "https://a.b/dp/B07PXGQC1Q") is None
    assert shown(D_.display_store_name, None) == "" and shown(D_.display_store_name, "Shop - the best") == "Shop" and len(shown(D_.display_store_name, "x" * 50)) == 32
    assert shown(D_.slug_title, "https://a.b/p/red-big-shoe/bc189cd2-fca4-4021-aaaa-0123456789ab") == "Red Big Shoe"
    assert shown(D_.slug_title, "https://a.b/p/ABC12345") is None and shown(D_.slug_title, None) is None
    assert [shown(D_.is_relay, u) for u in ("https://www.google.co.uk/x", "https://notgoogle.com", "x", None)] == [True, False, False, False]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


class Fixed:
    """A catalog over rows given by hand."""

    def __init__(self, spark, points):
        schema = "product_id string, store_id string, offer_id string, cents long, currency string, ngn long, discount int, recorded_at timestamp, order_no long, line_no int, in_stock boolean"
        self.points = spark.createDataFrame(points, schema)
        self.offers = self.points.select("product_id", "store_id", "offer_id", "cents", "currency", "ngn", "discount", "recorded_at", "in_stock")
        self.live = self.offers.where("in_stock")


def point(product, store, ngn, day, discount=0, live=True, offer=None):
    return (product, store, offer or f"{product}-{store}", ngn, "NGN", ngn, discount, D(2001, 10, 1 + day), 1, 1, live)


def test_best_offer_flags(spark):
    old = D(2000, 1, 1)
    rows = [
        point("a", "1", 100, 20), point("a", "1", 50, 21, offer="a-1b"),  # one store only: no runner-up
        point("b", "1", 100, 20, offer="b-2"), point("b", "2", 100, 20, offer="b-1"),  # a tie goes to the smaller id
        point("c", "1", 90, 25), point("c", "2", 200, 26),
        (*point("d", "1", 70, 0)[:7], old, 1, 1, True),  # no price in the window
        point("e", "1", 10, 20, discount=5),
    ]
    got = {r.product_id: r for r in offers.best_offers(Fixed(spark, rows)).collect()}
    assert (got["a"].offer_id, got["a"].runner_ngn, got["a"].below_30d_high) == ("a-1b", None, True)
    assert (got["b"].offer_id, got["b"].cross_store_cheapest) == ("b-1", False)
    assert got["c"].cross_store_cheapest and got["c"].is_real_deal
    assert (got["d"].below_30d_high, got["d"].is_real_deal) == (None, None)
    assert got["e"].is_real_deal and got["e"].cross_store_cheapest is None


@pytest.mark.parametrize("gap,shown", [(20, True), (21, False), (22, False)])
def test_carry_forward_ends(spark, gap, shown):
    rows = Fixed(spark, [point("a", "1", 100, 0)]).points
    day = f"2001-10-{1 + gap:02d}"
    found = history.price_timeseries(rows, at="2001-11-05 00:00:00").where(F.col("day") == day).count()
    assert found == int(shown)


def test_change_capture(spark):
    rows = [point("a", "1", 100, 0), point("a", "1", 100, 1), point("a", "1", 90, 2), (*point("a", "1", 90, 3)[:4], "USD", 1, 0, D(2001, 10, 4), 1, 1, True)]
    got = history.capture_changes(Fixed(spark, rows).points).collect()
    assert sorted((r.cents, r.currency) for r in got) == [(90, "NGN"), (90, "USD"), (100, "NGN")]


def test_fixed_windows_begin_with_their_first_event(spark):
    rows = spark.createDataFrame([(i, 1, D(2024, 1, 1, 0, m)) for i, m in enumerate((0, 9, 10, 19, 21))], "event_id long, user_id long, ts timestamp")
    assert [r.window_no for r in activity.fixed_windows(rows, 600).orderBy("event_id").collect()] == [1, 1, 2, 2, 3]


def test_query_of_short_words_gets_no_word_bonus(spark):
    rows = spark.createDataFrame([("1", "a b c")], "product_id string, title string")
    assert search.scored(rows, "a b").first().score < 1 + search.PHRASE + search.COMPOUND
    assert search.scored(rows, "x_z%").first().phrase is False
    assert search.scored(rows, "a_b").first().phrase


def test_postings_generate_candidates(spark):
    titles = spark.createDataFrame([("1", "red widget"), ("2", "blue rod")], "product_id string, title string")
    asked = spark.createDataFrame([(1, "redd widgets")], "query_id int, query string")
    assert [r.product_id for r in search.postings_candidates(titles, asked, 4).collect()] == ["1"]


def test_text_functions(spark):
    c = F.col("t")
    assert one(spark, T.title_key(c), t="Red-Widget 2!") == "redwidget2"
    assert one(spark, T.clean_title(c), t="<b>Generic</b> Unbranded  phone") == "phone"
    assert one(spark, T.url_canonical(c), t="http://a/b?utm_x=1&q=2&REF=3#z") == "http://a/b?q=2"
    assert one(spark, T.url_canonical(c), t="http://a/b?ref=1") == "http://a/b"
    assert one(spark, T.required_numbers(c), t="S24 15 2024 pro 7 a9b") == ["15", "7"]
    assert one(spark, T.model_tokens(c), t="WH-1000XM5 S24 2024") == ["1000xm5", "s24"]
    assert one(spark, T.variant_tokens(c), t="Phone Pro Max plus") == ["plus", "pro max"]
    assert one(spark, T.storage_gb(c), t="8GB ram 1TB disk 5GB") == 1024
    assert one(spark, T.slug(c), t="Black & Decker!") == "black-and-decker"
    assert one(spark, T.ua_class(c), t="Mozilla iPad Mobile") == "tablet"
    assert one(spark, T.ua_class(c), t=None) == "unknown"
    assert one(spark, T.canonical_color(c, {"grey": ["grey", "gray"], "red": ["red"]}), t="gray grey case") == "grey"
    assert one(spark, T.canonical_color(c, {"grey": ["grey"], "red": ["red"]}), t="red grey case") is None
    assert one(spark, T.money_format(c), t=1_234_500) == "12.3K"
    assert one(spark, T.hmac_sha256(b"key", c), t="text") == hmac.new(b"key", b"text", hashlib.sha256).hexdigest()


def test_page_prices(spark):
    ld = '<script type="application/ld+json">{"@type":"Product","offers":{"price":"12.50"}}</script>'
    meta = "<meta content='9.99' property='og:price:amount'>"
    assert str(one(spark, T.html_price(F.col("h")), h=meta + ld)) == "9.99"
    assert str(one(spark, T.html_price(F.col("h")), h=ld)) == "12.50"
    assert str(one(spark, T.html_price(F.col("h")), h='<i itemprop="price" content="3"></i>')) == "3.00"
    assert one(spark, T.html_price(F.col("h")), h="<p>no price</p>") is None


def test_hashes_and_vectors(spark):
    for a, b in ((0, 0), (63, 0), (-1, 0), (-1, -(2**63)), (2**63 - 1, -(2**63))):
        assert one(spark, V.hamming64(F.col("a"), F.col("b")), a=a, b=b) == bin((a ^ b) & (2**64 - 1)).count("1")
    assert abs(one(spark, V.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) - 0.5**0.5) < 1e-6
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) is None


def test_components(spark):
    rows = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(50, 40)], "u long, v long")
    assert dict(tuple(r) for r in graph.components(rows).collect()) == {**{i: 0 for i in range(13)}, 40: 40, 50: 40}


def test_upsert_and_insert_if_absent(spark):
    now = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "x", 2), (2, "y", 3), (3, "z", 1)], "k int, v string, n int")
    assert sorted(tuple(r) for r in matching.upsert(now, new, ["k"], ["n"]).collect()) == [(1, "a", 1), (2, "y", 3), (3, "z", 1)]
    kept = matching.insert_if_absent(now, new.where("n <> 3"), ["k"])
    assert sorted(r.v for r in kept.collect()) == ["a", "b", "z"]


def test_spacing_keeps_stores_apart(spark):
    rows = spark.createDataFrame([(f"o{i}", s, i) for i, s in enumerate("aaabbc")], "offer_id string, store_id string, pos int")
    got = [r.store_id for r in matching.space_out(rows, 1, 10).orderBy("place").collect()]
    assert sorted(got) == list("aaabbc") and all(x != y for x, y in zip(got, got[1:]))


def test_feeds(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"shopping_results": [{"title": "Red widget", "link": "http://a/1?utm_s=1", "source": "A", "extracted_price": 5, "extracted_old_price": 10}, {"title": null, "link": "x", "source": "A", "extracted_price": 5}, {"title": "Red gear", "link": "http://a/2", "source": "A", "extracted_price": 0.1}]}')
    (tmp_path / "p.json").write_text('{"vendor": "B", "products": [{"title": "Red widget", "handle": "rw", "variants": [{"sku": "1", "price": "7.00", "available": true}, {"sku": "2", "price": "bad", "available": true}, {"sku": "3", "price": "1", "available": false}]}]}')
    (tmp_path / "w.json").write_text('[{"name": "Blue rod", "permalink": "http://w/1", "on_sale": true, "prices": {"price": "1250", "regular_price": "2000", "currency_code": "GBP", "currency_minor_unit": 2}}]')
    found = feeds.search_results(spark, f"file://{tmp_path}/s.json", "USD")
    shop = feeds.shopify_catalog(spark, f"file://{tmp_path}/p.json", "http://b", "USD")
    woo = feeds.woo_catalog(spark, f"file://{tmp_path}/w.json", "W")
    assert (found.count(), shop.count(), [str(r.price) for r in woo.collect()]) == (1, 1, ["12.50"])
    again = found.withColumn("url", F.lit("http://a/1"))
    assert sorted(r.store for r in feeds.fanout_union([found, again, shop, woo], "red widget").collect()) == ["A", "B"]
    rates = spark.createDataFrame([("USD", "NGN", 1400.0), ("USD", "GBP", 99.0)], "base string, quote string, rate double")
    assert {r.quote: r.rate for r in feeds.fx_rates(spark, rates).collect() if r.quote in ("NGN", "GBP")} == {"NGN": 1400.0, "GBP": 0.79}
    assert feeds.static_fallback(found.limit(0), shop).count() == 1
    assert one(spark, feeds.usable_url(F.col("u")), u="https://www.google.com/x") is False and one(spark, feeds.usable_url(F.col("u")), u="no url") is True
    sku = spark.createDataFrame([("s1",)], "sku string")
    assert {r.url for r in feeds.curated(sku, [("a", "http://a/"), ("b", "http://b/")]).collect()} == {"http://a/s1", "http://b/s1"}


def test_judged_pairs_keep_the_more_confident(spark):
    from pricewright.plans import matching_deep as md

    schema = "anchor_id long, candidate_id long, decision string, confidence double"
    held = spark.createDataFrame([(1, 2, "same", 0.6)], schema)
    new = spark.createDataFrame([(2, 1, "different", 0.9), (5, 4, "same", 0.5), (3, 3, "same", 1.0)], schema)
    assert sorted(tuple(r) for r in md.upsert_decision(held, new).collect()) == [(1, 2, "different", 0.9), (4, 5, "same", 0.5)]
    assert md.expand_query("Galaxy24 best tv", {"tv": "television"}, ["best"]) == ["galaxy24 best tv", "galaxy 24 best television", "galaxy24 tv"]
