"""Text, URL and page functions as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track a visit.
TRACKING = "utm_[a-z]+|gclid|fbclid|ref"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), use)[0]


def title_key(title: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(title), "[^a-z0-9]+", ""), 1, 120)


def clean_title(title: Column) -> Column:
    """Markup out, up to three leading no-brand words out, spaces collapsed."""
    bare = F.regexp_replace(title, "<[^>]*>", " ")
    bare = F.regexp_replace(bare, r"^(?i)\s*((generic|unbranded|no brand)\b[\s:,-]*){1,3}", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def strip_punct(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9.\s]", " "), r"\s+", " "))


def squash(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"\s+", "")


def slug(text: Column) -> Column:
    spelled = F.regexp_replace(F.lower(text), "&", " and ")
    return F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", "-"), F.lit("-"))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words of a text, each padded by two spaces before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    each = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def similarity(a: Column, b: Column) -> Column:
    """Share of common elements of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def url_canonical(url: Column) -> Column:
    """The URL without fragment and tracking parameters; null stays null."""
    bare = F.regexp_replace(url, "#.*$", "")
    kept = F.array_join(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"^(?i)({TRACKING})(=|$)")), "&")
    return F.concat(F.regexp_extract(bare, r"^[^?]*", 0), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def html_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def html_meta(html: Column, name: str) -> Column:
    """Content of a meta tag by name or property, attributes in either order."""
    one = F.regexp_extract(html, rf"""(?is)<meta[^>]*(?:name|property)=["']{name}["'][^>]*content=["']([^"']*)["']""", 1)
    two = F.regexp_extract(html, rf"""(?is)<meta[^>]*content=["']([^"']*)["'][^>]*(?:name|property)=["']{name}["']""", 1)
    return F.coalesce(F.nullif(one, F.lit("")), F.nullif(two, F.lit("")))


def html_entities(text: Column) -> Column:
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(sign))
    return text


def jsonld_price(html: Column) -> Column:
    """Price of the first product of the page's JSON-LD: its own, an offer's, the lowest of a range."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    paths = ["$.price", "$.offers.price", "$.offers[0].price", "$.offers.lowPrice", "$.lowPrice", "$[0].offers.price", "$['@graph'][0].offers.price"]
    prices = F.transform(blocks, lambda b: F.coalesce(*(F.get_json_object(b, p) for p in paths)).try_cast("decimal(12,2)"))
    return F.get(F.filter(prices, lambda p: p.isNotNull()), F.lit(0))


def html_price(html: Column) -> Column:
    """og price, then JSON-LD, then the itemprop price."""
    item = F.regexp_extract(html, r"""(?is)itemprop=["']price["'][^>]*content=["']([0-9.]+)""", 1)
    return F.coalesce(html_meta(html, "og:price:amount").try_cast("decimal(12,2)"), jsonld_price(html), F.nullif(item, F.lit("")).try_cast("decimal(12,2)"))


def valid_gtin(text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(digits).isin(8, 12, 13, 14), digits)


def ua_class(agent: Column) -> Column:
    """The first rule that fits: bots, then tablets, then phones."""
    return (
        F.when(agent.isNull() | (agent == ""), "unknown")
        .when(agent.rlike("(?i)bot|crawl|spider|slurp"), "bot")
        .when(agent.rlike("(?i)ipad|tablet"), "tablet")
        .when(agent.rlike("(?i)mobi|iphone|android"), "mobile")
        .otherwise("desktop")
    )


def required_numbers(text: Column) -> Column:
    """Standalone numbers of one to four digits that aren't years from 2015 to 2030."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?<![a-z0-9])(\d{1,4})(?![a-z0-9])"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: ~n.cast("int").between(2015, 2030))))


def model_tokens(text: Column) -> Column:
    """Words of 2 to 8 characters that mix letters and digits."""
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " ")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w).between(2, 8) & w.rlike("[a-z]") & w.rlike("[0-9]"))))


def storage_gb(text: Column) -> Column:
    """The largest plausible storage size, in GB."""
    gb = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\b(\d{1,4})\s?gb\b"), F.lit(1)), lambda n: n.cast("int"))
    tb = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\b(\d{1,2})\s?tb\b"), F.lit(1)), lambda n: n.cast("int") * 1024)
    return F.array_max(F.filter(F.concat(gb, tb), lambda n: n.between(8, 4096)))


def variant_tokens(text: Column) -> Column:
    """Variant words of a title; "pro max" stands for itself."""

    def named(padded: Column) -> Column:
        both = padded.contains(" pro max ")
        names = F.filter(F.array(*(F.lit(w) for w in ("air", "lite", "mini", "plus", "ultra"))), lambda w: F.contains(padded, F.concat(F.lit(" "), w, F.lit(" "))))
        single = F.filter(F.array(F.lit("max"), F.lit("pro")), lambda w: F.contains(padded, F.concat(F.lit(" "), w, F.lit(" "))))
        return F.array_sort(F.concat(names, F.when(both, F.array(F.lit("pro max"))).otherwise(single)))

    return let(F.concat(F.lit(" "), strip_punct(text), F.lit(" ")), named)


def canonical_color(text: Column, groups: dict[str, list[str]]) -> Column:
    """The colour group a title names; null unless exactly one."""
    padded = F.concat(F.lit(" "), strip_punct(text), F.lit(" "))
    hits = [F.when(padded.rlike(r"\b(" + "|".join(words) + r")\b"), name) for name, words in groups.items()]
    found = F.filter(F.array(*hits), lambda g: g.isNotNull())
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def first_rule(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The name of the first pattern that fits, in the order of the list."""
    chain = None
    for pattern, name in rules:
        chain = F.when(text.rlike(pattern), name) if chain is None else chain.when(text.rlike(pattern), name)
    return chain.otherwise(F.lit(default))


def money_format(cents: Column) -> Column:
    units = cents / 100
    return (
        F.when(units >= 1e9, F.concat(F.format_number(units / 1e9, 1), F.lit("B")))
        .when(units >= 1e6, F.concat(F.format_number(units / 1e6, 1), F.lit("M")))
        .when(units >= 1e3, F.concat(F.format_number(units / 1e3, 1), F.lit("K")))
        .otherwise(F.format_number(units, 0))
    )


def hmac_sha256(key: bytes, text: Column) -> Column:
    """Keyed digest of a text, composed of two hashes; keys of up to 64 bytes."""
    if len(key) > 64:
        raise ValueError("a key has at most 64 bytes")
    block = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.sha2(F.concat(F.unhex(F.lit(inner.hex())), text.cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer.hex())), F.unhex(first)), 256)
