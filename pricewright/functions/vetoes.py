"""Rules by which two titles can't be one product, however alike they are, as a table of features and sides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewright.functions import text as T

# Words that make another product of a line, among them chips and their tiers.
VARIANTS = ["pro max", "ultra", "plus", "max", "pro", "mini", "lite", "se", "m4", "m5", "m3", "m2", "m1"]
CHIPS, TIERS = ["m1", "m2", "m3", "m4", "m5"], ["pro", "max", "ultra"]
# Words of letters and digits that are no model.
NO_MODEL = """5g 4g 3g 2g lte wifi wlan nfc 256gb 512gb 128gb 64gb 32gb 16gb 8gb 1tb 2tb 4tb 44mm 45mm 46mm 49mm 40mm 42mm 41mm 38mm
9oz 10oz 12oz 14oz 16oz 20oz 32oz 40oz oled qled uhd fhd hdr m1 m2 m3 m4 m5 h1 h2 h3 4k 8k""".split()
ORDINAL = r"^([1-9]|1[0-9]|20)(st|nd|rd|th)$"

#: (rule, sides) in order. ``both``: each title has something the other lacks. ``one``: either has.
RULES = [("numbers", "both"), ("models", "both"), ("variants", "one")]


def variants(title: Column) -> Column:
    """Variant words of a title, the chip with its tier as one more; "pro max" stands for its words."""
    low = F.lower(title)
    padded = F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9]+", "  "), F.lit(" "))
    single = [F.when(F.contains(padded, F.lit(f" {w} ")), w) for w in VARIANTS if " " not in w]
    joined = [F.when(F.contains(low, F.lit(w)), w) for w in [v for v in VARIANTS if " " in v] + [f"{c} {t}" for c in CHIPS for t in TIERS]]
    found = F.filter(F.array(*single, *joined), lambda w: w.isNotNull())
    return F.array_sort(F.when(F.array_contains(found, "pro max"), F.filter(found, lambda w: ~w.isin("pro", "max"))).otherwise(found))


def models(title: Column) -> Column:
    """Words of 2 to 8 letters and digits that may name a model."""
    return F.filter(T.model_tokens(title), lambda w: ~w.isin(NO_MODEL) & ~w.rlike(ORDINAL))


FEATURES = {"numbers": T.required_numbers, "models": models, "variants": variants}


def features(title: Column) -> Column:
    """struct of all that the rules look at."""
    return F.struct(*(make(title).alias(name) for name, make in FEATURES.items()))


def veto(a: Column, b: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """The first rule by which two titles (``features``) differ; null if none does.

    struct of rule, a_only and b_only, the words that only one of them has.
    """
    chain = None
    for name, sides in rules:
        a_only, b_only = F.array_except(a[name], b[name]), F.array_except(b[name], a[name])
        hit = (F.size(a_only) > 0) & (F.size(b_only) > 0) if sides == "both" else (F.size(a_only) > 0) | (F.size(b_only) > 0)
        told = F.struct(F.lit(name).alias("rule"), a_only.alias("a_only"), b_only.alias("b_only"))
        chain = F.when(hit, told) if chain is None else chain.when(hit, told)
    return chain


def rule_sql(a: str, b: str, rules: list[tuple[str, str]] = RULES) -> str:
    """The rule as DuckDB SQL over two rows with the features as columns."""
    lacks = lambda x, y, name: f"len(list_filter({x}.{name}, lambda w: NOT list_contains({y}.{name}, w))) > 0"
    return "CASE " + " ".join(f"WHEN {lacks(a, b, n)} {'AND' if s == 'both' else 'OR'} {lacks(b, a, n)} THEN '{n}'" for n, s in rules) + " END"


def features_sql(title: str) -> str:
    """The features as DuckDB columns."""
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    words = f"list_filter(string_split_regex(lower({title}), '[^a-z0-9]+'), lambda w: w <> '')"
    single = f"list_filter([{quoted([v for v in VARIANTS if ' ' not in v])}], lambda v: list_contains({words}, v))"
    joined = f"list_filter([{quoted(['pro max'] + [f'{c} {t}' for c in CHIPS for t in TIERS])}], lambda v: contains(lower({title}), v))"
    both = f"list_concat({single}, {joined})"
    return f"""list_filter(list_distinct({words}), lambda x: regexp_matches(x, '^\\d{{1,4}}$') AND NOT coalesce(try_cast(x AS INT) BETWEEN 2015 AND 2030, false)) AS numbers,
    list_filter(list_distinct({words}), lambda w: length(w) BETWEEN 2 AND 8 AND regexp_matches(w, '[a-z]') AND regexp_matches(w, '[0-9]') AND w NOT IN ({quoted(NO_MODEL)}) AND NOT regexp_matches(w, '{ORDINAL}')) AS models,
    CASE WHEN contains(lower({title}), 'pro max') THEN list_filter({both}, lambda w: w NOT IN ('pro', 'max')) ELSE {both} END AS variants"""
