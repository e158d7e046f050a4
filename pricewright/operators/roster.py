"""Brands and models of titles by rosters: tables of any size, matched as word runs.

A title's runs of words meet the roster in one equi-join, so a title is read
once however many names there are, and a roster too large to broadcast is
shuffled like any table. Rules then choose among the few hits of a title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.catalog import Catalog, sql
from pricewright.functions import identity as I
from pricewright.functions import text as T
from pricewright.operators.identity import IDENT, spelled
from pricewright.session import materialize

# Words that say what a thing fits, if a brand follows.
CUES = ["for use with", "compatible with", "compatible for", "replacement for", "spare for", "suitable for", "designed for", "works with", "fit for", "to fit", "compatible", "fits", "for"]
# Words of a fragrance's strength and form, words that are no part of its name, and those that make it another one.
STRENGTHS = ["eau de parfum", "eau de toilette", "eau de cologne", "edp", "edt", "edc", "parfum", "cologne", "elixir", "extrait"]
FORMS = ["deodorant", "deo stick", "shower gel", "body spray", "after shave", "aftershave", "body lotion", "hair mist", "travel spray", "refill", "gift set", "shaving gel", "shampoo", "balm"]
FILLERS = ["perfume", "fragrance", "cologne", "the", "by", "spray", "natural", "new", "original", "limited", "edition", "set"]
CONCENTRATED = ["elixir", "extrait"]
PEOPLE = ["men", "women", "unisex", "him", "her", "ladies", "gents"]

ROSTER = "phrase string, kind string, brand string, context string, yields boolean"


def default_roster(spark: SparkSession) -> DataFrame:
    """The short roster of ``functions.identity`` with its cues and types."""
    brands = [(b, "brand", I.SPELLINGS.get(b, b).replace(" ", ""), I.BACKED.get(b), b in I.YIELDING) for b in I.BRANDS]
    return spark.createDataFrame(brands + [(c, "cue", None, None, False) for c in CUES], ROSTER)


def roster_of(names: DataFrame) -> DataFrame:
    """Roster rows for the distinct ``brand`` names of a table."""
    phrase = T.strip_punct(F.col("brand"))
    rows = names.select(phrase.alias("phrase")).where("phrase <> ''").distinct()
    return rows.select("phrase", F.lit("brand").alias("kind"), F.replace("phrase", F.lit(" "), F.lit("")).alias("brand"), F.lit(None).cast("string").alias("context"), F.lit(False).alias("yields"))


def hits(titles: DataFrame, roster: DataFrame) -> DataFrame:
    """(norm, hits): where the phrases of ``roster`` stand in each distinct title, by words from 0.

    A hit has phrase, kind, brand, yields, start, end, and backed: whether the
    title fits the roster's context pattern, if it has one.
    """
    longest = roster.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 0
    words = F.split("norm", " ")
    runs = lambda i: F.transform(F.filter(F.sequence(F.lit(1), F.lit(max(1, longest))), lambda n: i + n <= F.size(words)), lambda n: F.struct(i.alias("start"), (i + n).alias("end"), F.array_join(F.slice(words, i + 1, n), " ").alias("phrase")))
    each = titles.select("norm").where("norm <> ''").distinct().select("norm", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.size(words) - 1), runs))).alias("r"))
    found = each.select("norm", "r.*").join(roster, "phrase").withColumn("backed", F.expr("context IS NULL OR norm rlike context"))
    return found.groupBy("norm").agg(F.collect_list(F.struct("kind", "start", "end", "phrase", "brand", "yields", "backed")).alias("hits"))


def chosen_brand(found: Column) -> Column:
    """The brand that the hits of a title name; null if none.

    A cue before a brand opens the part that says what the thing fits: brands
    whose first place is there don't count. Of the others the longest counts
    that its context backs; names that yield count only without any other.
    """
    brands = F.filter(found, lambda h: h["kind"] == "brand")
    cues = F.filter(found, lambda h: (h["kind"] == "cue") & F.exists(brands, lambda b: b["start"] == h["end"]))
    fits = F.coalesce(F.array_min(F.transform(cues, lambda h: h["end"])), F.lit(1 << 30))
    first = F.filter(brands, lambda h: ~F.exists(brands, lambda b: (b["phrase"] == h["phrase"]) & (b["start"] < h["start"])))
    usable = F.filter(first, lambda h: h["backed"] & (h["start"] < fits))
    order = F.transform(usable, lambda h: F.struct(h["yields"].alias("yields"), (-F.length(h["phrase"])).alias("n"), h["phrase"].alias("phrase"), h["brand"].alias("brand")))
    return F.array_min(order)["brand"]


def brands_of(titles: DataFrame, roster: DataFrame) -> DataFrame:
    """(norm, brand) of the distinct titles that name a brand of ``roster``."""
    return hits(titles, roster).select("norm", chosen_brand(F.col("hits")).alias("brand")).where("brand is not null")


def _any(words: list[str]) -> str:
    return "|".join(words)


def fragrance_line(brand: Column, norm: Column) -> Column:
    """The name of a fragrance: the words from its brand to its strength, form, size or wearer, as one; null for other things."""
    scented = norm.rlike(rf"\b({_any(STRENGTHS)}|perfume|fragrance|cologne)\b")
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    behind = F.when(F.contains(padded, F.concat(F.lit(" "), brand, F.lit(" "))), F.substring_index(F.concat(F.lit("\n"), F.replace(padded, F.concat(F.lit(" "), brand, F.lit(" ")), F.lit("\n"))), "\n", -1))
    name = F.regexp_replace(behind, rf"\b({_any(STRENGTHS)}|{_any(FORMS)}|\d+([.]\d+)? ?ml|(for )?({_any(PEOPLE)}))\b.*$", "")
    name = F.regexp_replace(F.regexp_replace(name, rf"\b({_any(FILLERS)})\b", " "), "[^a-z0-9]+", "")
    strong = behind.rlike(rf"\b({_any(CONCENTRATED)})\b") & ~name.rlike(_any(CONCENTRATED))
    name = F.when(strong, F.concat(name, F.lit("elixir"))).otherwise(name)
    return F.when(scented & (F.length(name) >= 3), name)


def models_of(rows: DataFrame, models: DataFrame) -> DataFrame:
    """``rows`` (norm, brand, ...) with ``model``: by the brand's first pattern that fits, else a fragrance's name, else a code.

    ``models`` (brand, rank, pattern) is joined by brand; patterns of other brands aren't tried.
    """
    pairs = rows.select("norm", "brand").where("brand is not null").distinct()
    fitting = pairs.join(models, "brand").where(F.expr("norm rlike pattern")).groupBy("norm", "brand").agg(F.min_by("pattern", "rank").alias("pattern"))
    hinted = fitting.select("norm", "brand", F.expr("regexp_extract(norm, pattern, 1)").alias("hinted"))
    codes = F.filter(F.regexp_extract_all(F.col("norm"), F.lit(I.CODE), F.lit(1)), lambda w: (F.length(w) >= 4) & ~w.rlike(I.SPEC))
    code = F.when(F.col("brand").isNotNull(), F.get(codes, F.lit(0)))
    found = F.coalesce(F.col("hinted"), fragrance_line(F.col("brand"), F.col("norm")), code)
    return rows.join(hinted, ["norm", "brand"], "left").withColumn("model", F.when(~found.rlike(I.SPEC), found)).drop("hinted")


def rosters(c: Catalog) -> DataFrame:
    """The default roster and the brands of the catalogue itself, stored."""
    return materialize(default_roster(c.spark).unionByName(roster_of(c.products)), "roster")


def rostered(c: Catalog) -> DataFrame:
    """Products with the brand and model that the rosters find in their listings."""
    rows = spelled(c).select("product_id", "norm")
    found = rows.join(brands_of(rows, rosters(c)), "norm", "left")
    table = c.spark.createDataFrame([(b, i, p) for i, (b, p) in enumerate(I.MODELS)], "brand string, rank int, pattern string")
    return models_of(found, table)


def q_roster_brand(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    rows = spelled(c).select("product_id", "norm")
    return rows.join(brands_of(rows, rosters(c)), "norm", "left").select("product_id", "brand")


def q_roster_model(spark, sf_dir):
    return rostered(Catalog(spark, sf_dir)).select("product_id", "brand", "model")


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}


def _sql() -> dict[str, str]:
    text = lambda x: "NULL" if x is None else f"'{x}'"
    brands = ", ".join(f"('{b}', '{I.SPELLINGS.get(b, b).replace(' ', '')}', {text(I.BACKED.get(b))}, {b in I.YIELDING})" for b in I.BRANDS)
    cues = ", ".join(f"('{c}')" for c in CUES)
    own = r"trim(regexp_replace(regexp_replace(lower(brand), '[^a-z0-9.\s]', ' ', 'g'), '\s+', ' ', 'g'))"
    ctes = rf"""r(phrase, b, context, yields) AS (SELECT * FROM (VALUES {brands}) UNION ALL SELECT DISTINCT {own}, replace({own}, ' ', ''), NULL, false FROM products),
    cue(cue) AS (VALUES {cues}), pad AS (SELECT product_id, norm, ' ' || norm || ' ' AS pad FROM norms),
    gov AS (SELECT product_id, min(instr(pad, ' ' || cue || ' ' || phrase || ' ') + length(cue) + 1) AS gov FROM pad, cue, r WHERE instr(pad, ' ' || cue || ' ' || phrase || ' ') > 0 GROUP BY 1),
    best AS (SELECT product_id, first(b ORDER BY yields, length(phrase) DESC, phrase) AS brand FROM pad JOIN r ON instr(pad, ' ' || phrase || ' ') > 0 LEFT JOIN gov USING (product_id)
      WHERE instr(pad, ' ' || phrase || ' ') < coalesce(gov, 1000000) AND (context IS NULL OR regexp_matches(norm, context)) GROUP BY 1),
    b AS (SELECT product_id, norm, best.brand FROM pad LEFT JOIN best USING (product_id))"""
    codes = f"list_filter(regexp_extract_all(norm, '{I.CODE}', 1), lambda w: length(w) >= 4 AND NOT regexp_matches(w, '{I.SPEC}'))"
    hinted = ", ".join(f"CASE WHEN brand = '{b}' THEN nullif(regexp_extract(norm, '{p}', 1), '') END" for b, p in I.MODELS)
    behind = "list_last(string_split(' ' || norm || ' ', ' ' || brand || ' '))"
    name = rf"regexp_replace(regexp_replace(regexp_replace({behind}, '\b({_any(STRENGTHS)}|{_any(FORMS)}|\d+([.]\d+)? ?ml|(for )?({_any(PEOPLE)}))\b.*$', ''), '\b({_any(FILLERS)})\b', ' ', 'g'), '[^a-z0-9]+', '', 'g')"
    strong = rf"CASE WHEN regexp_matches({behind}, '\b({_any(CONCENTRATED)})\b') AND NOT regexp_matches({name}, '{_any(CONCENTRATED)}') THEN {name} || 'elixir' ELSE {name} END"
    line = rf"CASE WHEN regexp_matches(norm, '\b({_any(STRENGTHS)}|perfume|fragrance|cologne)\b') AND contains(' ' || norm || ' ', ' ' || brand || ' ') AND length({strong}) >= 3 THEN {strong} END"
    return {
        "roster_brand": sql("SELECT product_id, brand FROM b", IDENT, ctes),
        "roster_model": sql(
            f"SELECT product_id, brand, CASE WHEN NOT regexp_matches(m, '{I.SPEC}') THEN m END AS model FROM (SELECT product_id, brand, coalesce({hinted}, {line}, CASE WHEN brand IS NOT NULL THEN {codes}[1] END) AS m FROM b)",
            IDENT,
            ctes,
        ),
    }


ORACLES = _sql()
