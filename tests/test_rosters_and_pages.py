"""Rosters, JSON-LD, vetoes, merge constraints, near hashes and country rules on rows given by hand or by chance."""

import re
from random import Random

import pytest
from pyspark.sql import functions as F

from pricewright.functions import vetoes
from pricewright.operators import matching, pages, roster, search
from pricewright.plans import matching_deep


def brute_brand(norm, rows):
    brands = [r for r in rows if r[1] == "brand"]
    padded = f" {norm} "
    starts = [padded.find(f" {cue} {b[0]} ") + len(cue) + 1 for cue in (r[0] for r in rows if r[1] == "cue") for b in brands if f" {cue} {b[0]} " in padded]
    fits = min(starts, default=10**9)
    usable = [b for b in brands if 0 <= padded.find(f" {b[0]} ") < fits and (b[3] is None or re.search(b[3], norm))]
    return min(((b[4], -len(b[0]), b[0], b[2]) for b in usable), default=(None,) * 4)[3]


def test_roster_matches_brute_force(spark):
    draw = Random(6)
    words = ["alpha", "beta", "gamma", "delta", "for", "fits", "case", "with", "compatible", "x1"]
    rows = [("alpha", "brand", "alpha", None, False), ("alpha beta", "brand", "alphabeta", None, False), ("beta", "brand", "beta", r"\bx1\b", False), ("gamma delta case", "brand", "gdc", None, False), ("delta", "brand", "delta", None, True)]
    rows += [("for", "cue", None, None, False), ("compatible with", "cue", None, None, False), ("fits", "cue", None, None, False)]
    titles = [" ".join(draw.choice(words) for _ in range(draw.randrange(1, 8))) for _ in range(400)] + ["", None]
    frame = spark.createDataFrame([(t,) for t in titles + titles[:5]], "norm string")
    got = {r.norm: r.brand for r in roster.brands_of(frame, spark.createDataFrame(rows, roster.ROSTER)).collect()}
    want = {t: brute_brand(t, rows) for t in titles if t}
    assert got == {t: b for t, b in want.items() if b} and len(set(got.values())) == 5
    assert roster.brands_of(frame, spark.createDataFrame([], roster.ROSTER)).count() == 0


def test_roster_of_any_size_reads_titles_once(spark):
    names = spark.range(3000).select(F.concat(F.lit("Maker "), F.col("id").cast("string")).alias("brand"))
    frame = spark.createDataFrame([(f"new maker {i} phone",) for i in range(0, 6000, 500)], "norm string")
    found = roster.brands_of(frame, roster.roster_of(names))
    assert {r.brand for r in found.collect()} == {f"maker{i}" for i in range(0, 3000, 500)}


def test_models_and_fragrances(spark):
    table = spark.createDataFrame([("apple", 0, r"\b(iphone \d+( pro)?)\b"), ("sony", 0, "(tv)")], "brand string, rank int, pattern string")
    rows = [("apple iphone 15 pro 256gb", "apple"), ("dior sauvage eau de parfum 100ml", "dior"), ("dior sauvage elixir spray", "dior"), ("dior the new perfume", "dior"), ("acme ab1200 drill", "acme"), ("sony tv", "acme"), ("iphone 15", None)]
    got = {(r.norm, r.brand): r.model for r in roster.models_of(spark.createDataFrame(rows, "norm string, brand string"), table).collect()}
    assert list(map(got.get, rows)) == ["iphone 15 pro", "sauvage", "sauvageelixir", None, "ab1200", None, None]


def page(*blocks):
    return "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)


IDENTIFIERS = [
    (page('{"@type":"Product","gtin13":1234567890123,"isRelatedTo":{"@type":"Product","gtin":"99999999"}}'), ("1234567890123", None, None)),
    (page('{"@graph":[[{"@type":["Thing","ProductGroup"],"offers":{"gtin8":"12345678","mpn":5}}]]}'), ("12345678", "5", None)),
    (page("broken {", '{"@type":"Product","brand":{"name":" B "},"hasVariant":{"offers":[{"sku":1},{"gtin12":"123456789012"}]}}'), ("123456789012", None, "B")),
    (page('{"@type":"Product","gtin":"","gtin14":"1234 5678 9012 34"}'), ("12345678901234", None, None)),
    (page('[{"@type":"Product","name":"first"},{"@type":"Product","mpn":"second"},{"@type":"Product","mpn":"third"}]'), (None, "second", None)),
    (page('{"@type":"Product","gtin":"123"}'), (None, None, None)),
    (page('{"@type":"Offer","gtin":"12345678"}'), None),
    (page('"text"', "[]", "null", "3"), None),
    (None, None),
]


def test_jsonld_identifiers(spark):
    frame = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(IDENTIFIERS)], "page int, html string")
    got = {r.page: (r.gtin, r.mpn, r.brand) for r in pages.identifiers(frame).collect()}
    assert got == {i: want for i, (_, want) in enumerate(IDENTIFIERS) if want}
    assert pages.identifiers(frame.limit(0)).count() == 0


def test_jsonld_prices(spark):
    rows = [
        page('{"offers":[{"price":0},{"offers":{"lowPrice":"$1,200.50","priceCurrency":"USD"}}]}'),
        page('{"price":"free"}', '{"@graph":[{"highPrice":7}]}'),
        page('{"price":3,"offers":{"price":2}}'),
        page('{"isRelatedTo":{"price":2}}'),
    ]
    got = {r.page: (r.price, r.currency) for r in pages.prices(spark.createDataFrame(list(enumerate(rows)), "page int, html string")).collect()}
    assert got == {0: (1200.5, "USD"), 1: (7.0, None), 2: (3.0, None)}


@pytest.mark.parametrize(
    "a,b,rule",
    [
        ("MacBook Pro M4", "MacBook Pro M3", "variants"),
        ("MacBook Pro M4", "MacBook Air M4", "variants"),
        ("MacBook M4 Pro", "MacBook M4 Max", "variants"),
        ("iPhone 15 Pro", "iPhone 15", "variants"),
        ("iPhone 15", "iPhone 15 Pro Max", "variants"),
        ("Galaxy S24 Ultra", "Galaxy S24", "variants"),
        ("Galaxy S24", "Galaxy S25", "models"),
        ("Samsung Galaxy A17 5G", "Samsung Galaxy A15 5G", "models"),
        ("WH-1000XM5", "WH-1000XM4", "models"),
        ("iPhone 15", "iPhone 16", "numbers"),
        ("AirPods 4", "Apple AirPods 4th generation", None),
        ("Pegasus 41", "Nike Pegasus 41 2024 edition", None),
        ("Phone 128GB black", "Phone 256GB 5G", None),
        ("Brand-X speaker", "Brand X speaker", None),
    ],
)
def test_vetoes(spark, a, b, rule):
    told = vetoes.veto(vetoes.features(F.col("a")), vetoes.features(F.col("b")))
    frame = spark.createDataFrame([(a, b), (b, a)], "a string, b string")
    assert [r.rule for r in frame.select(told["rule"].alias("rule")).collect()] == [rule, rule]


def test_anchor_keeps_out_by_rule(spark):
    rows = [(1, "acme", "Phone 15 Pro", 100), (2, "acme", "phone 15 pro", 120), (3, "acme", "Phone 15", 100), (4, "acme", "Phone 16 Pro", 90), (5, "acme", "Phone 15 Pro", 1000), (6, "other", "Phone 16", 5)]
    got = {r.id: (r.rule, r.a_only, r.b_only) for r in matching_deep.anchored(spark.createDataFrame(rows, "id long, found string, title string, ngn long")).collect()}
    assert got == {1: (None, None, None), 2: (None, None, None), 3: ("variants", ["pro"], []), 4: ("numbers", ["15"], ["16"]), 6: (None, None, None)}


def test_merging_needs_a_new_store_and_a_brand(spark):
    """A chain that plain components would join: the middle has no brand, and two ends sell at the same stores."""
    rows = [(1, "a", ["s1"], 10, 20), (2, None, ["s2"], 10, 10), (3, "A", ["s3"], 10, 10), (4, "a", ["s3"], 10, 10), (5, "a", ["s4", "s3"], 70, 100), (6, "b", ["s9"], None, None), (7, "b", [], 5, 5)]
    frame = spark.createDataFrame(rows, "id long, brand string, stores array<string>, low long, high long")
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (6, 7), (1, 6)], "u long, v long")
    assert {tuple(r) for r in matching.merging_links(links, frame).collect()} == {(4, 5), (6, 7)}
    got = {r.node: (r.component, r.n, r.merged) for r in matching.merge_groups(links, frame).collect()}
    assert got == {4: (4, 2, False), 5: (4, 2, False), 6: (6, 2, True), 7: (6, 2, True)}


def test_near_hashes_match_a_scan(spark):
    draw = Random(9)
    base = [draw.getrandbits(64) for _ in range(40)]
    rows = [(i, h) for i, h in enumerate(base)] + [(100 + i, base[0]) for i in range(30)]
    for i, h in enumerate(base * 3):
        for _ in range(i % 13):
            h ^= 1 << draw.randrange(64)
        rows.append((200 + i, h))
    signed = [(i, h - (1 << 64) if h >> 63 else h) for i, h in rows] + [(None, 3), (999, None)]
    frame = spark.createDataFrame(signed, "vec_id long, hash long")
    near, left = search.nearest_hashes(frame, frame)
    got = {r.q_id: (r.distance, r.vec_id) for r in near.collect()}
    want = {}
    for i, h in rows:
        want[i] = min(((h ^ g).bit_count(), j) for j, g in rows if j != i)
    assert got == {i: w for i, w in want.items() if w[0] < search.PARTS * search.FLIPS} and len(got) > 100
    assert {r.q_id for r in left.collect()} == {i for i, _ in rows} - set(got)


def test_country_votes(spark):
    stores = [("1", "argos-uk", "Argos Germany", None), ("2", "shop", "Currys U.K. ", None), ("3", "x", "India Gate", "https://a.co.za/p"), ("4", "x4", "n", "http://de.com"), ("5", "x5", "n", None), ("6", "x6", "n", None), ("7", "listed", "South Africa", None), ("8", "us_x", None, None)]
    frame = spark.createDataFrame(stores, "store_id string, store_key string, name string, url string")
    offers = spark.createDataFrame([("4", "NGN"), ("4", "NGN"), ("5", "NGN"), ("5", None), ("1", "NGN")], "store_id string, currency string")
    listed = spark.createDataFrame([("listed", "AE"), ("listed", "AE")], "store_key string, country string")
    got = {r.store_id: (r.country, r.via, r.n_offers) for r in matching.country_votes(frame, offers, listed).collect()}
    assert got == {
        "1": ("UK", "id-pattern", 1), "2": ("UK", "name-pattern", 0), "3": ("ZA", "url-tld", 0), "4": ("NG", "offer-currency", 2),
        "5": (None, "unresolved", 2), "6": (None, "orphan-no-offers", 0), "7": ("AE", "roster", 0), "8": ("US", "id-pattern", 0),
    }
