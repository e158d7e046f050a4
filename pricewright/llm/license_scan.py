"""License scans by diagonal voting, in DataFrame functions only.

Every run of k words of every document joins, by its hash, the places where
license templates hold it (the template table is a constant of this package, so
broadcasting it is bounded). Hits whose words agree vote for their diagonal,
document position less template position. Neighbouring diagonals of a template
merge, so words put in, left out or changed don't end a span. Spans with enough
votes are verified: the words of the template are looked up one by one in the
span, at their place give or take its diagonals, and the span counts when
enough of them, and all that the template requires, are there.

Texts are read once for the votes, as small rows of (position, k words), so
the work is in proportion to a text's length; only texts with a span to verify
are read again.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewright.llm.common import load, row_key
from pricewright.llm.license_texts import BASE, PHRASES, TEXTS
from pricewright.session import materialize

K = 3
#: Diagonals at most this far apart belong to one span; in long templates, this share of their words.
GAP, GAP_SHARE = 2, 1 / 16
#: Share of a template's words that a span has to hold; one word may always differ.
COVERAGE = 0.8

TEMPLATES = [*PHRASES, *TEXTS]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TEMPLATE = "template int, label string, base boolean, words array<string>, needed array<int>, banned array<string>, n_grams int, least int, votes int, reach int"


def parse(text: str) -> tuple[list[str], list[int], list[str]]:
    """(words, places of words that must be there, words that must not) of a template."""
    body, _, banned = text.partition(" / ")
    found = re.findall(WORD + "=?", body.translate(str.maketrans(UPPER, LOWER)))
    return [w.rstrip("=") for w in found], [i for i, w in enumerate(found) if w.endswith("=")], banned.split()


def template_rows(base: list[tuple[str, str]], templates: list[tuple[str, str]], gap: int, coverage: float) -> list[tuple]:
    """(template, label, base, words, needed, banned, number of k-grams, least words, least votes, reach of a diagonal)."""
    rows = []
    for number, (label, text) in enumerate([*base, *templates]):
        words, needed, banned = parse(text)
        grams = len(words) - K + 1
        if grams < 1:
            raise ValueError(f"a template has at least {K} words: {text}")
        least = max(K, min(len(words) - 1, math.ceil(coverage * len(words) - 1e-9)))
        # a changed word takes K k-grams away, so short templates need a single vote
        rows.append((number, label, number < len(base), words, needed, banned, grams, least, max(1, grams // 2 - K), max(gap, int(len(words) * GAP_SHARE))))
    return rows


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(f"({WORD})"), F.lit(0))


def hits(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, pos, template, at): the places of template k-grams, and a row
    with pos -1 for each document."""
    grams = templates.select("template", F.explode(F.sequence(F.lit(0), F.col("n_grams") - 1)).alias("at"), "words")
    grams = grams.select("template", "at", F.array_join(F.slice("words", F.col("at") + 1, K), " ").alias("gram"))
    grams = grams.withColumn("hash", F.xxhash64("gram"))
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("key"), words_of(F.col("text")).alias("words"))
    rolling = F.transform("words", lambda word, i: F.concat_ws(" ", word, *(F.get("words", i + j) for j in range(1, K))))
    # the null in front is the document's own row; beside the k-grams only columns of fixed size are exploded
    every = F.concat(F.array(F.lit(None).cast("string")), rolling)
    counted = rows.select("doc_id", "key", F.size("words").alias("n_words"), every.alias("grams"))
    # outer, or Spark would infer a filter that splits the text again for each of its words; it is never empty
    placed = counted.select("doc_id", "key", "n_words", F.posexplode_outer("grams").alias("pos", "own"))
    placed = placed.select("doc_id", "key", "n_words", (F.col("pos") - 1).alias("pos"), "own", F.xxhash64("own").alias("hash"))
    joined = placed.join(F.broadcast(grams), "hash", "left")
    return joined.where((F.col("own") == F.col("gram")) | (F.col("pos") < 0)).select("doc_id", "key", "n_words", "pos", "template", "at")


def diagonals(found: DataFrame) -> DataFrame:
    """Votes by (doc_id, key, template, diagonal): ``ats`` are the template places that agree."""
    places = found.where("template is not null")
    return places.groupBy("doc_id", "key", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))


def candidates(votes: DataFrame, templates: DataFrame) -> DataFrame:
    """Neighbouring diagonals merged: (doc_id, key, template, n, lo, hi) of the spans with enough votes."""
    sizes = F.broadcast(templates.where("not base").select("template", F.size("words").alias("n"), "votes", "reach"))  # a constant table
    by = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > F.col("reach")).cast("int"), F.lit(0))
    merged = (
        votes.join(sizes, "template")
        .withColumn("new", new)
        .withColumn("span", F.sum("new").over(by))
        .groupBy("doc_id", "key", "template", "n", "votes", "span")
        .agg(
            F.min("diagonal").alias("lo"),
            F.max("diagonal").alias("hi"),
            F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("n_votes"),
        )
    )
    return merged.where(F.col("n_votes") >= F.col("votes")).select("doc_id", "key", "template", "n", "lo", "hi")


def verified(docs: DataFrame, asked: DataFrame, templates: DataFrame, gap: int) -> DataFrame:
    """(doc_id, key, label, place, share) of the spans that hold enough words of their template."""
    each = asked.groupBy("doc_id", "key").agg(F.collect_list(F.struct("template", "n", "lo", "hi")).alias("asked"))
    each = materialize(each.withColumnRenamed("doc_id", "id"), "spans")
    keyed = docs.select("doc_id", row_key("doc_id", "text").alias("key"), "text")
    texts = keyed.join(each.withColumnRenamed("key", "of"), (F.col("key") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")))
    # a generator, so that the words of a text are split once, not once for each span
    split = texts.select("doc_id", "key", "asked", F.explode(F.array(words_of(F.col("text")))).alias("words"))
    first = lambda span: F.greatest(span["lo"] - gap, F.lit(0))
    cut = F.transform(
        "asked",
        lambda span: F.struct(
            span["template"].alias("template"), span["lo"].alias("lo"), span["hi"].alias("hi"), first(span).alias("first"),
            F.slice("words", first(span) + 1, F.greatest(span["hi"] + span["n"] + gap - first(span), F.lit(0))).alias("part"),
        ),
    )
    spans = split.select("doc_id", "key", F.explode_outer(cut).alias("span")).select("doc_id", "key", "span.*")
    joined = spans.join(F.broadcast(templates.drop("n_grams", "votes", "base", "reach")), "template")
    start, end = F.col("lo") - gap - F.col("first") + 1, F.col("hi") + gap - F.col("first") + 1
    near = lambda t: F.slice("part", F.greatest(t + start, F.lit(1)), F.greatest(t + end - F.greatest(t + start, F.lit(1)) + 1, F.lit(0)))
    held = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda t: F.array_contains(near(t), F.get("words", t)))
    passes = (
        (F.size("held") >= F.col("least"))
        & (F.size(F.array_except("needed", "held")) == 0)
        & ~F.arrays_overlap("part", "banned")
    )
    # repeated rows of a document are verified alike
    return (
        joined.withColumn("held", held)
        .where(passes)
        .select("doc_id", "key", "label", F.col("lo").alias("place"), (F.size("held") / (F.size("words") + F.col("hi") - F.col("lo"))).alias("share"), "template")
        .distinct()
    )


def license_scan(
    docs: DataFrame,
    base: list[tuple[str, str]] = BASE,
    templates: list[tuple[str, str]] = TEMPLATES,
    gap: int = GAP,
    coverage: float = COVERAGE,
) -> DataFrame:
    """One row per document with the licenses it names.

    doc_id, n_words, n_base (places of whole base phrases), first_word and
    last_word (their least and greatest start; else null), base_labels, labels
    (with those of verified spans), score (the best span's share: template words
    found, of the template's words and those put in between; 1 for a base
    phrase, 0 without any) and n_spans. A null
    text has no words; repeated rows give a row each; null doc_ids are kept;
    templates have any length from ``K`` words on.
    """
    table = docs.sparkSession.createDataFrame(template_rows(base, templates, gap, coverage), TEMPLATE)
    found = materialize(hits(docs, table), "hits")
    votes = materialize(diagonals(found), "votes")  # read twice below
    about = F.broadcast(table.select("template", "label", "base", "n_grams"))
    whole = votes.where(F.size("ats") > 0).join(about, "template").where(F.col("base") & (F.size("ats") == F.col("n_grams")))
    places = whole.select("doc_id", "key", "label", F.col("diagonal").alias("place"), F.lit(1.0).alias("share"), F.lit(True).alias("base"))
    wider = verified(docs, candidates(votes, table), table, gap).select(
        "doc_id", "key", "label", "place", "share", F.lit(False).alias("base")
    )
    at = F.when(F.col("base"), F.col("place").cast("long"))
    grouped = (
        places.unionByName(wider)
        .groupBy("doc_id", "key")
        .agg(
            F.count(at).alias("n_base"),
            F.min(at).alias("first_word"),
            F.max(at).alias("last_word"),
            F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label"))))).alias("base_labels"),
            F.concat_ws(",", F.array_sort(F.collect_set("label"))).alias("labels"),
            F.max("share").alias("score"),
            F.sum((~F.col("base")).cast("long")).alias("n_spans"),
        )
        .withColumnRenamed("doc_id", "id")
        .withColumnRenamed("key", "of")
    )
    rows = found.where("pos < 0").select("doc_id", "key", F.col("n_words").cast("long").alias("n_words"))
    return rows.join(grouped, (F.col("key") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(load(spark, sf_dir, "documents", "doc_id", "text"))


def op9_sql() -> str:
    def listed(items: list, kind: str) -> str:
        return "[" + ", ".join(f"'{x}'" if kind == "VARCHAR" else str(x) for x in items) + f"]::{kind}[]"

    rows = ", ".join(
        f"({t}, '{label}', {str(base).lower()}, {listed(words, 'VARCHAR')}, {listed(needed, 'INT')}, {listed(banned, 'VARCHAR')}, {grams}, {least}, {votes}, {reach})"
        for t, label, base, words, needed, banned, grams, least, votes, reach in template_rows(BASE, TEMPLATES, GAP, COVERAGE)
    )
    return rf"""
WITH t(template, label, base, tw, needed, banned, n_grams, least, min_votes, reach) AS (VALUES {rows}),
grams AS (SELECT template, tpos, array_to_string(tw[tpos+1:tpos+{K}], ' ') AS gram FROM (SELECT template, tw, unnest(generate_series(0, n_grams - 1)) AS tpos FROM t)),
d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
                             lambda x: x <> '') AS ws FROM documents
), p AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {K - 1})) AS i FROM d),
h AS (SELECT DISTINCT doc_id, template, tpos, i - 1 - tpos AS diagonal FROM p JOIN grams ON array_to_string(ws[i:i+{K - 1}], ' ') = gram),
v AS (SELECT doc_id, template, diagonal, count(*) AS votes FROM h GROUP BY ALL),
places AS (SELECT doc_id, label, diagonal AS place, 1.0::DOUBLE AS share, true AS base FROM v JOIN t USING (template) WHERE base AND votes = n_grams),
s AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM (
    SELECT doc_id, template, diagonal, coalesce((diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > reach)::INT, 0) AS new FROM v JOIN t USING (template))
), c AS (
  SELECT doc_id, template, min(s.diagonal) AS lo, max(s.diagonal) AS hi, count(DISTINCT tpos) AS n_votes
  FROM s JOIN h USING (doc_id, template, diagonal) GROUP BY doc_id, template, span
), e AS (
  SELECT doc_id, label, lo, hi, least, needed, tw, list_filter(generate_series(0, len(tw) - 1),
           lambda x: list_contains(ws[greatest(x + lo - {GAP} + 1, 1):greatest(x + hi + {GAP} + 1, 0)], tw[x + 1])) AS held,
         list_has_any(ws[greatest(lo - {GAP}, 0) + 1:hi + len(tw) + {GAP}], banned) AS other
  FROM c JOIN t USING (template) JOIN d USING (doc_id) WHERE NOT base AND n_votes >= min_votes
), wider AS (
  SELECT doc_id, label, lo AS place, len(held) / (len(tw) + hi - lo) AS share, false AS base FROM e WHERE len(held) >= least AND NOT other AND list_has_all(held, needed)
), f AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(place) FILTER (WHERE base) AS first_word, max(place) FILTER (WHERE base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         max(share) AS score, count(*) FILTER (WHERE NOT base) AS n_spans
  FROM (SELECT * FROM places UNION ALL SELECT * FROM wider) GROUP BY 1
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN f USING (doc_id)
"""
