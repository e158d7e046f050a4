"""Titles, store names and links as they are shown, as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewright.functions.text import let

# Characters that mean broken text, those that stand for a space, and invisible ones that reorder or hide what is shown. The joiners U+200C and U+200D stay: Indic and Arabic text and emoji need them.
BROKEN = r"\x{FFFD}"
CONTROLS = r"[\x{0000}-\x{001F}\x{007F}]"
HIDDEN = r"[\x{200B}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]"
# What separates the parts of a title.
DASHES = "[-–—|]"
# A word in which one or two zeros stand for an o: letters only, small ones on both sides.
ZEROS = "^[A-Za-z]*[a-z]0{1,2}[a-z][A-Za-z]*$"
# Words, and pairs of words, with which the specifications of a title begin.
SPEC_WORDS = ["smartphone", "cellphone", "unlocked", "ram", "|"]
SPEC_PAIRS = ["android mobile", "smart phone", "smart mobile", "wireless earbuds", "wireless headphones", "noise cancelling", "portable bluetooth", "active noise", "dual sim", "box deal"]
#: Measures that do so too, tried on a word with the next one.
SPEC_MEASURES = r'^(with \d|\d+gb rom|\d+ ?gb \+|rom \+|\d+\.\d+ ?inch|\d+\.\d+["”]|6\.\d|\(\d)'
# Brands that are written with one capital, even where a title shouts them.
SHOUTED = """apple samsung sony xiaomi huawei motorola nokia honor lenovo panasonic philips bosch infinix tecno redmi oppo vivo oneplus google microsoft asus acer razer
nike adidas yeezy puma reebok fila logitech corsair dyson bose marshall kitchenaid kenwood ninja cuisinart""".split()
# Product lines as they are written, words in capitals, and lines before which their maker is left out.
LINES = {"airpods": "AirPods", "macbook": "MacBook", "iphone": "iPhone", "ipad": "iPad", "imac": "iMac"}
CAPITALS = "fe se xl ue nfc tv hd uhd qled oled led lte mp gb tb ram rom cpu gpu usb hdmi".split()
MAKER, OWN_LINES = "apple", ["iphone", "ipad", "macbook", "airpods", "watch", "vision"]
#: What is no end of a short name.
LOOSE_ENDS = " /|-,&+:."
# Units in capitals behind a number.
SLUG_UNITS = ["gb", "tb", "mb", "mp", "mah", "hz", "inch"]
LONGEST = 32
# Hosts that only pass a visit on.
RELAYS = r"(^|\.)google\.com$|^(www\.)?google\.[a-z.]{2,8}$|(^|\.)(googleadservices\.com|googlesyndication\.com|doubleclick\.net)$"


def sanitize_label(text: Column) -> Column:
    """Markup, broken and hidden characters out, controls as spaces, spaces collapsed. Joiners stay."""
    bare = F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), CONTROLS, " ")
    bare = F.regexp_replace(bare, f"{BROKEN}|{HIDDEN}", "")
    return F.trim(F.regexp_replace(bare, r"\s{2,}", " "))


def _zeros_read(text: Column) -> Column:
    """Zeros as o in the words of letters that have them. Words and what stands between them alternate."""

    def read(text: Column) -> Column:
        words = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+|[^A-Za-z0-9]+"), F.lit(0))
        spelled = F.transform(words, lambda w: F.when(w.contains("0") & w.rlike(ZEROS), F.replace(w, F.lit("0"), F.lit("o"))).otherwise(w))
        return F.when(text.contains("0"), F.array_join(spelled, "")).otherwise(text)

    return let(text, read)


def clean_title_display(title: Column) -> Column:
    """``sanitize_label`` with zeros in words read as o, runs of separators as one dash, and none at the ends."""
    tidy = F.regexp_replace(_zeros_read(sanitize_label(title)), rf"{DASHES}+(\s*{DASHES}+)+", " - ")
    tidy = F.regexp_replace(F.regexp_replace(tidy, rf"^\s*{DASHES}+\s*", ""), rf"\s*{DASHES}+\s*$", "")
    return F.trim(F.regexp_replace(tidy, r"\s{2,}", " "))


def truncated(text: Column, longest: int = LONGEST) -> Column:
    return F.when(F.length(text) <= longest, text).otherwise(F.concat(F.trim(F.substring(text, 1, longest - 1)), F.lit("…")))


def display_store_name(name: Column, rules: list[tuple[str, str]] = ()) -> Column:
    """The first rule that fits the lower-case name, else the name up to " - ", cut to ``LONGEST``; empty for null."""
    bare = F.trim(F.coalesce(name, F.lit("")))
    cut = truncated(F.trim(F.substring_index(bare, " - ", 1)))
    chain = F.when(bare == "", "")
    for pattern, shown in rules:
        chain = chain.when(F.lower(bare).rlike(pattern), shown)
    return chain.otherwise(cut)


def _begins_specs(words: Column) -> Callable[[Column, Column], Column]:
    """Whether one of ``words``, in small letters, begins the specifications; the first doesn't."""

    def test(word: Column, i: Column) -> Column:
        pair = F.concat(word, F.lit(" "), F.coalesce(F.get(words, i + 1), F.lit("")))
        return (i > 0) & (word.isin(SPEC_WORDS) | F.trim(pair).isin(SPEC_PAIRS) | pair.rlike(SPEC_MEASURES))

    return test


def _written(word: Column, i: Column) -> Column:
    low = F.lower(word)
    table = F.create_map(*(F.lit(x) for pair in LINES.items() for x in pair))
    shouted = (i == 0) & (word == F.upper(word)) & (F.length(word) > 1) & low.isin(SHOUTED)
    upper = low.isin(CAPITALS) | low.rlike(r"^\d+g$")
    return F.coalesce(F.try_element_at(table, low), F.when(upper, F.upper(word)).when(shouted, F.initcap(word)).otherwise(word))


def _within(words: Column) -> Column:
    """As many whole words as fit; a first word that doesn't is cut."""
    # every word but the first takes two signs at least, with the space before it
    few = F.slice(words, 1, LONGEST)
    grown = F.transform(few, lambda w, i: F.array_join(F.slice(few, F.lit(1), i + 1), " "))
    whole = F.array_join(words, " ")
    longest = let(F.filter(grown, lambda t: F.length(t) <= LONGEST), lambda fit: F.get(fit, F.size(fit) - 1))
    return let(longest, lambda fit: F.when(F.length(F.coalesce(fit, F.lit(""))) * 2 < LONGEST, F.substring(whole, 1, LONGEST)).otherwise(fit))


def friendly_chip(title: Column) -> Column:
    """A short name of a title, word by word: up to the specifications, without a code behind a dash or loose ends, as brands and lines are written, cut to ``LONGEST``."""
    words = F.filter(F.split(F.trim(F.regexp_replace(title, "<[^>]*>", "")), r"\s+"), lambda w: w != "")

    def upto(words: Column) -> Column:
        first = let(F.transform(words, F.lower), lambda low: F.array_min(F.transform(low, lambda w, i: F.when(_begins_specs(low)(w, i), i))))
        return F.slice(words, F.lit(1), F.coalesce(first, F.size(words)))

    def named(name: Column) -> Column:
        # a last part of four signs or more is a code
        code = F.regexp_extract(name, "(?i)-\\s*([A-Z][A-Z0-9]{3,})$", 0)
        name = F.rtrim(F.substring(name, F.lit(1), F.length(name) - F.length(code)), F.lit(LOOSE_ENDS))
        return let(F.transform(F.split(name, " "), _written), lines)

    def lines(shown: Column) -> Column:
        own = (F.size(shown) > 1) & (F.lower(shown[0]) == MAKER) & F.lower(F.get(shown, F.lit(1))).isin(OWN_LINES)
        return F.when(own, F.slice(shown, F.lit(2), F.size(shown))).otherwise(shown)

    short = let(let(words, upto), lambda kept: F.array_join(kept, " "))
    return F.rtrim(let(let(short, named), _within), F.lit(LOOSE_ENDS))


def chip_label(brand: Column, model: Column, title: Column) -> Column:
    """Brand and model where both are known, else the title, cut to ``LONGEST``."""
    return F.when(brand.isNotNull() & model.isNotNull(), F.concat_ws(" ", F.initcap(brand), F.initcap(model))).otherwise(truncated(title))


def source_suffix(source: Column) -> Column:
    """The country after the last colon; null unless two lower-case letters."""
    return F.nullif(F.regexp_extract(source, ":([a-z]{2})$", 1), F.lit(""))


def source_query(source: Column) -> Column:
    return F.split_part(source, F.lit(":"), F.lit(2))


def host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def is_relay(url: Column) -> Column:
    """The address only passes a visit on to a store; false for null and for what is no address."""
    return F.coalesce(host(url).rlike(RELAYS), F.lit(False))


def _capital(word: Column) -> Column:
    """A word of a slug as a title has it."""
    unit = word.rlike(rf"(?i)^\d+({'|'.join(SLUG_UNITS)})$")
    return F.when(unit, F.upper(word)).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 20)))


def slug_title(url: Column) -> Column:
    """A title from an address: from the part of its path before "dp", else from that with the most words.

    Ids at its end are left out. Null for parts that are ids, short ones and single words.
    """
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda part: part != "")
    bare = F.transform(parts, lambda part: F.regexp_replace(part, r"\.[a-z]{2,4}$", ""))

    def rank(part: Column, i: Column) -> Column:
        words = F.size(F.filter(F.split(part, "-"), lambda w: w.rlike("[A-Za-z]")))
        opaque = part.rlike("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
        product = F.get(bare, i + 1) == "dp"
        return F.struct(F.coalesce(product, F.lit(False)).alias("product"), F.when(opaque, -1).otherwise(words).alias("n"), (-i).alias("at"), part.alias("slug"))

    slug = F.array_max(F.transform(bare, rank))["slug"]

    def titled(slug: Column) -> Column:
        words = F.filter(F.split(F.substring_index(slug, "~", 1), "-"), lambda w: w != "")
        last = F.get(words, F.size(words) - 1)
        ends = (F.size(words) > 1) & (last.rlike(r"^\d{5,}$") | last.rlike("^[A-Za-z0-9]{15,}$"))
        kept = F.when(ends, F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
        usable = (F.length(slug) >= 8) & ~slug.rlike("^[A-Z0-9]{6,}$") & (F.size(kept) > 1)
        return F.when(usable, F.array_join(F.transform(kept, _capital), " "))

    return let(slug, titled)


def jsonld_identifiers(html: Column) -> Column:
    """struct(gtin, mpn, brand) of a page's JSON-LD products: the first found at a product, its offers, variants or a graph.

    A gtin has 8, 12, 13 or 14 digits.
    """
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    fields = lambda names: F.regexp_extract_all(F.array_join(blocks, "\n"), F.lit(rf'(?is)"(?:{names})"\s*:\s*"([^"]+)"'), F.lit(1))
    digits = F.transform(fields("gtin|gtin8|gtin12|gtin13|gtin14"), lambda g: F.regexp_replace(g, "[^0-9]", ""))
    gtin = F.get(F.filter(digits, lambda g: F.length(g).isin(8, 12, 13, 14)), F.lit(0))
    named = F.regexp_extract_all(F.array_join(blocks, "\n"), F.lit(r'(?is)"brand"\s*:\s*(?:\{[^{}]*"name"\s*:\s*)?"([^"]+)"'), F.lit(1))
    return F.struct(gtin.alias("gtin"), F.get(fields("mpn"), F.lit(0)).alias("mpn"), F.get(named, F.lit(0)).alias("brand"))


def tagged_url(url: Column, tags: dict[str, str]) -> Column:
    """The address with the tag of its host's programme, if it has one."""
    own, shown = host(url), url
    for name, tag in tags.items():
        mark = F.when(url.contains("?"), F.lit("&")).otherwise(F.lit("?"))
        shown = F.when(own.rlike(rf"(^|\.){name.replace('.', '[.]')}$"), F.concat(url, mark, F.lit(tag))).otherwise(shown)
    return shown


def search_url(title: Column, store: Column, searches: dict[str, str]) -> Column:
    """The search page of a store for a title: its template with ``{q}`` replaced; null without one."""
    table = F.create_map(*(F.lit(x) for pair in searches.items() for x in pair))
    return F.replace(F.try_element_at(table, F.lower(F.trim(store))), F.lit("{q}"), F.url_encode(title))


def link_out(url: Column, title: Column, store: Column, tags: dict[str, str], searches: dict[str, str]) -> Column:
    """Where a visit goes: for a relay or a missing address the store's own search, else the tagged address."""
    return F.when(url.isNull() | is_relay(url), F.coalesce(search_url(title, store, searches), url)).otherwise(tagged_url(url, tags))
