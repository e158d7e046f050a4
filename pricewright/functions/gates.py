"""Classifiers of titles and rows, and overlap gates between two titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewright.functions import text as T

# Parts and accessories by name; things that are accessories of what a title says they are for; and words for "for".
PARTS = [
    "ear ?pads?", "ear ?cushions?", "ear ?cups?", "ear ?tips?", "silicone ?tips?", "headband", "head ?beam", "replacement", "spare ?parts?", "screen ?protectors?", "tempered ?glass",
    "pouch", "lanyard", "decals?", "skin ?stickers?", "accessor(y|ies) ?kit", "kit for", "flex ?cable", "charging ?port", "motherboard", "logic ?board", "repair ?(part|kit)",
    "lcd ?(screen|assembly|digitizer)", "digitizer",
]
FITTED = """case cover sleeve strap holder stand mount grip bumper shell guard dock cushion protector battery batteries charger cable cord adapter antenna remote""".split()
FOR_WORDS = ["for", "für", "fuer", "pour", "para"]
# Words by which a search result is noise, products that others are made for, and parts of phones.
NOISE = [
    "case", "cover", "skin", "holder", "stand", "tripod", "selfie stick", "screen protector", "tempered glass", "replacement", "repair", "lcd screen", "battery replacement", "charger only",
    "cable only", "adapter only", "lens kit", "gimbal", "water bottle pouch", "tumbler pouch", "tumbler sleeve", "tumbler boot", "silicone boot", "silicone sleeve", "straw cover",
    "straw replacement", "lid replacement", "spare part", "spare parts", "replacement straw", "replacement lid", "laptop battery", "replacement battery", "battery pack for",
    "keyboard for macbook", "keyboard cover for", "trackpad replacement", "screen for macbook", "lcd panel for", "display panel for", "ssd upgrade for", "ram upgrade for",
    "memory upgrade for", "charging port", "power button", "logic board",
]
MAKERS = ["apple", "samsung", "sony", "microsoft", "google"]
HOSTS = [
    "stanley ?quencher", "stanley ?ice ?flow", "stanley ?iceflow", "yeti +rambler", "hydroflask", "owala ?freesip", "airpods", r"iphone ?\d+", "ipad", "macbook", "imac", r"galaxy ?s\d+",
    "galaxy ?tab", "surface +pro", "surface +book", r"pixel ?\d+", "nintendo ?switch", "ps[45]", "xbox", "playstation",
]
PHONE_PARTS = ["motherboard", "main ?board", "logic ?board", "digitizer", "flex ?cable", "back ?glass"]
PHONES = ["iphone", r"galaxy ?s\d", "galaxy ?note", r"pixel ?\d", "redmi", "tecno", "infinix", "ipad"]
# Titles that name what no maker sells.
IMPOSSIBLE = [
    r"macbook[^a-z0-9]+.*\b(a1[0-9]|a2[0-9]|helio|snapdragon|exynos|kirin|dimensity|tensor)\b", "macbook[^a-z]+neo", r"iphone[^a-z]+.*\b(android|harmonyos|miui|oneui)\b",
    r"\bm[1-5]\b.*(snapdragon|mediatek|helio|a1[0-9]|a2[0-9])",
]
# Conditions other than new, and stores that sell such things.
USED_WORDS = ["refurb(ished)?", "renewed", "pre[- ]?owned", "open[- ]?box", "ex[- ]?display", "second[- ]?hand", "certified +pre[- ]?owned", "used"]
USED_STORES = ["back market", "backmarket", "refurbed", "obiwezy", "music magpie", "musicmagpie"]
FAKE = r"(?i)\b(replica|clone|first copy|dummy|fake)\b"
# Things in a feed that are no products.
NO_PRODUCTS = [
    "gift ?cards?", "e-?gift", "gift ?vouchers?", "vouchers?", "top[- ]?ups?", "recharge ?cards?", "airtime", "extended ?warranty", "warranty ?plan", "protection ?plan", "care ?plan", "insurance ?plan",
]
BLOCKED = r"(?i)^\s*\[blocked"


def _words(*lists: list[str]) -> str:
    """A pattern for any of the words as whole words."""
    return rf"\b({'|'.join(w for words in lists for w in words)})\b"


ACCESSORY_PATTERN = _words(PARTS)
FITTED_PATTERN, FOR_PATTERN = _words(FITTED), rf"(^|[^a-z0-9])({'|'.join(FOR_WORDS)}) +[^ ]"
HOST_PATTERN = rf"\bfor +(({'|'.join(MAKERS)}) +)?({'|'.join(HOSTS)})\b"
PHONE_PART_PATTERN, PHONE_PATTERN = _words(PHONE_PARTS), rf"\b({'|'.join(PHONES)})"
NOISE_PATTERN = rf"(^|[^a-z])({'|'.join(NOISE)})([^a-z]|$)"
IMPOSSIBLE_PATTERN = "|".join(IMPOSSIBLE)
USED_PATTERN, NO_PRODUCT_PATTERN = _words(USED_WORDS), _words(NO_PRODUCTS)


def _fits(title: Column, pattern: str) -> Column:
    return F.coalesce(F.lower(title).rlike(pattern), F.lit(False))


def is_accessory(title: Column) -> Column:
    """A part by name, or a thing that is fitted to others and is for one."""
    return _fits(title, ACCESSORY_PATTERN) | (_fits(title, FITTED_PATTERN) & _fits(title, FOR_PATTERN))


def is_noise(title: Column) -> Column:
    """What a search for a product should not anchor on: for another product, a part of a phone, or an accessory word."""
    part = _fits(title, PHONE_PART_PATTERN) & _fits(title, PHONE_PATTERN)
    return _fits(title, HOST_PATTERN) | part | _fits(title, NOISE_PATTERN)


def is_suspicious(title: Column) -> Column:
    return _fits(title, IMPOSSIBLE_PATTERN)


def is_used(title: Column, store: Column | None = None) -> Column:
    """A condition other than new in the title, or a store of such things."""
    named = _fits(title, USED_PATTERN)
    return named if store is None else named | F.coalesce(F.lower(store).rlike("|".join(USED_STORES)), F.lit(False))


def is_counterfeit(title: Column) -> Column:
    return title.rlike(FAKE)


def is_quality(title: Column, image: Column) -> Column:
    return image.isNotNull() & (image != "") & ~_fits(title, NO_PRODUCT_PATTERN)


def is_blocked(*texts: Column) -> Column:
    """A placeholder in any of the texts."""
    return F.coalesce(F.exists(F.array(*texts), lambda t: F.coalesce(t.rlike(BLOCKED), F.lit(False))), F.lit(False))


def tokens(title: Column) -> Column:
    return F.array_distinct(F.filter(F.split(T.strip_punct(title), " "), lambda w: F.length(w) >= 2))


def significant_overlap(a: Column, b: Column) -> Column:
    """Two shared words, or all of a title that has fewer."""
    shared = F.size(F.array_intersect(tokens(a), tokens(b)))
    return shared >= F.least(F.lit(2), F.size(tokens(a)), F.size(tokens(b)))


def distinctive_overlap(a: Column, b: Column, common: list[str]) -> Column:
    """Share of common words once frequent ones are out; 0 if either has none left."""
    drop = F.array(*(F.lit(w) for w in common)) if common else F.array().cast("array<string>")
    x, y = F.array_except(tokens(a), drop), F.array_except(tokens(b), drop)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def numbers_fit(wanted: Column, title: Column) -> Column:
    """All numbers that a query asks for stand in the title."""
    return F.size(F.array_except(T.required_numbers(wanted), T.required_numbers(title))) == 0


def models_fit(wanted: Column, title: Column) -> Column:
    """Every model token of a query, its letters and digits apart or not, is in the title."""
    close = T.squash(F.regexp_replace(title, "[^A-Za-z0-9]", ""))
    return F.forall(T.model_tokens(wanted), lambda m: F.contains(close, m))


def family(title: Column, families: list[tuple[str, str]]) -> Column:
    return T.first_rule(title, families)


def families_clash(a: Column, b: Column) -> Column:
    """Both known and different."""
    return F.coalesce(a != b, F.lit(False))


def tight_signature(signature: Column, loose: list[str]) -> Column:
    """Brand and model both present and the model no loose category."""
    parts = F.split(signature, r"\|")
    brand, model = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    good = (brand != "") & (brand != "?") & (model != "") & (model != "?")
    return F.coalesce(good & ~model.isin(*loose) if loose else good, F.lit(False))
