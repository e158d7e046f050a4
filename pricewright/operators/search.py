"""Lexical search, suggestions, page extraction and vector neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.catalog import Catalog, sql
from pricewright.functions import text as T
from pricewright.functions import vectors as V
from pricewright.session import materialize

# Weights of the parts of a score, and the least similarity of a suggestion.
PHRASE, ALL_WORDS, COMPOUND, SIMILAR = 2.0, 0.8, 1.5, 0.5
SIMILAR_LEAST = 0.1


def scored(df: DataFrame, query: str, title: str = "title") -> DataFrame:
    """Search score of each title: term rank, trigram similarity, phrase, whole words, compound.

    ``%`` and ``_`` in the query are wildcards of the phrase. The term rank is
    the share of query words that the title has; ``fulltext`` ranks by stems.
    """
    q = query.lower().strip()
    words = [w for w in q.split(" ") if len(w) >= 2]
    padded = F.concat(F.lit(" "), F.lower(title), F.lit(" "))
    hits = sum((F.instr(padded, f" {w} ").cast("boolean").cast("int") for w in words), F.lit(0))
    joined = q.replace(" ", "")
    compound = F.lit(False)
    if len(q.split()) <= 2 and 5 <= len(joined) <= 24:
        compound = F.contains(F.replace(F.lower(title), F.lit(" "), F.lit("")), F.lit(joined))
    phrase = F.col(title).ilike(f"%{q}%")
    rank = hits / max(1, len(words))
    whole = (hits == len(words)) if words else F.lit(False)
    similar = T.similarity(T.trigrams(F.col(title)), T.trigrams(F.lit(q)))
    score = rank + SIMILAR * similar + PHRASE * phrase.cast("int") + ALL_WORDS * whole.cast("int") + COMPOUND * compound.cast("int")
    return df.withColumns({"matched": hits > 0, "similar": similar, "phrase": phrase, "compound": compound, "score": F.round(score, 6)})


def postings_candidates(titles: DataFrame, queries: DataFrame, least_shared: int = 2) -> DataFrame:
    """(query_id, product_id) that share trigrams, by an equi-join of postings; the scale path of fuzzy search."""
    left = titles.select("product_id", F.explode(T.trigrams(F.col("title"))).alias("g"))
    right = queries.select("query_id", F.explode(T.trigrams(F.col("query"))).alias("g"))
    return left.join(right, "g").groupBy("query_id", "product_id").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least_shared)


def suggest(c: Catalog, query: str, limit: int = 8) -> DataFrame:
    """One title each, best similarity; titles that hold the query only if none is similar, scored below all that are."""
    titles = c.products.select("title", T.trigrams(F.col("title")).alias("t"), T.trigrams(T.squash(F.col("title"))).alias("s"))
    score = F.greatest(T.similarity(F.col("t"), T.trigrams(F.lit(query))), T.similarity(F.col("s"), T.trigrams(F.lit(query.replace(" ", "")))))
    one = titles.groupBy(F.lower("title").alias("title")).agg(F.round(F.max(score), 6).alias("score"))
    best = F.broadcast(one.agg((F.coalesce(F.max("score"), F.lit(0.0)) > SIMILAR_LEAST).alias("similar")))  # one row
    held = T.squash(F.col("title")).contains(query.replace(" ", ""))
    part = F.round(F.lit(float(len(query))) / F.length("title") * SIMILAR_LEAST * 0.99, 6)
    found = one.join(best).where(F.when(F.col("similar"), F.col("score") > SIMILAR_LEAST).otherwise(held))
    return found.select("title", F.when(F.col("similar"), F.col("score")).otherwise(part).alias("score")).orderBy(F.desc("score"), "title").limit(limit)


def q_suggest_titles(spark, sf_dir):
    return suggest(Catalog(spark, sf_dir), "blu bolt")


def q_suggest_substring(spark, sf_dir):
    return suggest(Catalog(spark, sf_dir), "i")


def similar_pairs(titles: DataFrame, least: float) -> DataFrame:
    """(a, b, similar) of distinct titles at least ``least`` alike.

    Two such titles share one of the rarest trigrams of each: a title of n
    trigrams is looked up by its n - ceil(least * n) + 1 rarest ones only, so
    frequent trigrams pair few titles and no pair is lost.
    """
    one = titles.select("title").distinct().select("title", T.trigrams(F.col("title")).alias("grams")).where(F.size("grams") > 0)
    one = materialize(one.withColumn("id", F.monotonically_increasing_id()), "titles")  # pairs are of ids; titles come last
    placed = one.select("id", F.explode("grams").alias("g"))
    counted = placed.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    ranked = placed.join(counted, "g").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("ranked"))
    few = (F.size("ranked") - F.ceil(F.size("ranked") * least - 1e-9) + 1).cast("int")
    rare = ranked.select("id", F.explode(F.slice("ranked.g", F.lit(1), few)).alias("g"))
    pairs = rare.select(F.col("id").alias("x"), "g").join(rare.select(F.col("id").alias("y"), "g"), "g").where("x < y").select("x", "y").distinct()
    x, y = (one.select(F.col("id").alias(e), F.col("title").alias(f"t{e}"), F.col("grams").alias(f"g{e}")) for e in "xy")
    similar = F.round(T.similarity(F.col("gx"), F.col("gy")), 6)
    found = pairs.join(x, "x").join(y, "y").withColumn("similar", similar).where(F.col("similar") >= least)
    return found.select(F.least("tx", "ty").alias("a"), F.greatest("tx", "ty").alias("b"), "similar")


def q_trigram_pairs(spark, sf_dir):
    return similar_pairs(Catalog(spark, sf_dir).products, 0.5)


def q_query_score(spark, sf_dir):
    """Three points for a number of the query in a title, one for another word."""
    words = "brand 17 red 4".split()
    whole = F.lower(F.concat_ws(" ", "brand", "title"))
    score = sum((F.contains(whole, F.lit(w)).cast("int") * (3 if w.isdigit() else 1) for w in words), F.lit(0))
    return Catalog(spark, sf_dir).products.select("product_id", score.alias("score")).where("score > 1")


def q_url_canonical(spark, sf_dir):
    return Catalog(spark, sf_dir).table("pages").select("page_id", T.url_canonical(F.col("url")).alias("url"))


def q_html_title_meta(spark, sf_dir):
    pages = Catalog(spark, sf_dir).table("pages")
    return pages.select("page_id", T.html_entities(T.html_title(F.col("html"))).alias("title"), F.regexp_count("html", F.lit("<a href=")).alias("n_links"))


def q_url_hosts(spark, sf_dir):
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1))
    return Catalog(spark, sf_dir).table("pages").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("url").rlike("[?&](utm_|ref=)")).alias("n_tracked"))


def q_title_key_documents(spark, sf_dir):
    """Documents whose whole texts have the same letters and digits, the first named."""
    letters = F.regexp_replace(F.lower("text"), "[^a-z0-9]+", "")
    docs = Catalog(spark, sf_dir).table("documents").select("doc_id", F.sha2(letters, 256).alias("key"), F.length(letters).alias("n_key"))
    return docs.groupBy("key", "n_key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("first_id", "n", "n_key")


def q_content_hash(spark, sf_dir):
    return Catalog(spark, sf_dir).table("documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


def q_required_numbers(spark, sf_dir):
    docs = Catalog(spark, sf_dir).table("documents")
    return docs.select("doc_id", F.array_join(T.required_numbers(F.col("text")), ",").alias("numbers")).where("numbers <> ''")


def q_category_infer(spark, sf_dir):
    rules = [("(?i)\\b(ring|plate)\\b", "jewellery"), ("(?i)\\b(bolt|rod|gear|anvil)\\b", "hardware"), ("(?i)gizmo|widget", "gadgets")]
    return Catalog(spark, sf_dir).products.groupBy("category", T.first_rule(F.col("title"), rules, "other").alias("inferred")).agg(F.count(F.lit(1)).alias("n"))


#: Query vectors that a pass over all rows answers.
QUERY_BLOCK = 4096
#: Rows that a task scores at a time, and the most scores that it holds.
ROW_BLOCK, SCORES = 4096, 1 << 20


def _best_of_batch(ids: np.ndarray, queries: np.ndarray, score: Callable, k: int):
    """For each query the ``k`` best rows of each batch, by score and then vec_id, itself left out."""

    def best_of(own: np.ndarray, vectors: np.ndarray, some_ids: np.ndarray, some_queries: np.ndarray) -> tuple[np.ndarray, ...]:
        scores = score(vectors, some_queries)
        scores[own[:, None] == some_ids[None]] = -np.inf
        if len(own) > k:  # no row below the k-th best score is among the best
            least = np.partition(scores, len(own) - k, axis=0)[len(own) - k]
        else:
            least = np.full(len(some_ids), -np.inf)
        row, query = np.nonzero((scores >= least) & np.isfinite(scores))
        value = scores[row, query]
        order = np.lexsort((own[row], -value, query))
        row, query, value = row[order], query[order], value[order]
        first = np.searchsorted(query, query)  # where the rows of its query begin
        kept = np.arange(len(query)) - first < k
        return some_ids[query[kept]], own[row[kept]], value[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROW_BLOCK):
                batch = whole.slice(start, ROW_BLOCK)
                own = batch.column("vec_id").to_numpy()
                vectors = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                step = max(1, SCORES // batch.num_rows)
                for at in range(0, len(ids), step):
                    columns = best_of(own, vectors, ids[at : at + step], queries[at : at + step])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q_id", "vec_id", "score"])

    return run


def nearest(rows: DataFrame, queries: DataFrame, score: Callable, k: int) -> DataFrame:
    """(q_id, vec_id, score): the ``k`` best rows for each query.

    Queries are taken in blocks of ``QUERY_BLOCK`` vectors against all rows; a
    task keeps k rows by query and batch, and a top k over those follows. Rows
    and queries without a vector are left out.
    """
    rows, queries = (df.where("vec_id is not null and embedding is not null").select("vec_id", "embedding") for df in (rows, queries))
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    found = None
    for block in range(n):
        held = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == block).orderBy("vec_id").collect()  # about QUERY_BLOCK vectors
        ids, vectors = np.array([r.vec_id for r in held], np.int64), np.array([r.embedding for r in held], np.float64)
        part = rows.mapInArrow(_best_of_batch(ids, vectors, score, k), "q_id long, vec_id long, score double") if held else None
        found = part if found is None else found if part is None else found.unionByName(part)
    if found is None:
        return rows.sparkSession.createDataFrame([], "q_id long, vec_id long, score double")
    by = Window.partitionBy("q_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= k).drop("rn")


def _cosines(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows**2).sum(1))[:, None] * np.sqrt((queries**2).sum(1))[None]
    return np.divide(rows @ queries.T, norms, out=np.full((len(rows), len(queries)), -np.inf), where=norms > 0)


def _rounded(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    return np.round(_cosines(rows, queries), 4)


def _hybrid(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    return np.round(0.6 * _cosines(rows[:, :32], queries[:, :32]) + 0.4 * _cosines(rows[:, 32:64], queries[:, 32:64]), 4)


def _same_bits(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Less the Hamming distance of the signs."""
    a, b = (np.packbits(x[:, :64] > 0, axis=1).view(np.uint64)[:, 0] for x in (rows, queries))
    return -np.bitwise_count(a[:, None] ^ b[None]).astype(np.float64)


def asked(rows: DataFrame) -> DataFrame:
    """The query set of searches: every row whose id is divisible by 50."""
    return rows.where("vec_id % 50 = 0")


def q_vec_topk(spark, sf_dir):
    """Ten nearest by cosine."""
    rows = Catalog(spark, sf_dir).table("embeddings")
    found = nearest(rows, asked(rows), _rounded, 10)
    return found.join(rows.select("vec_id", "label"), "vec_id").select("q_id", "vec_id", "label", F.col("score").alias("similarity"))


def q_vec_hybrid(spark, sf_dir):
    """Ten best by 0.6 of one half's cosine and 0.4 of the other's."""
    rows = Catalog(spark, sf_dir).table("embeddings")
    return nearest(rows, asked(rows), _hybrid, 10)


def q_vec_get(spark, sf_dir):
    rows = Catalog(spark, sf_dir).table("embeddings")
    return rows.where(F.col("vec_id").isin(3, 7, 11)).select("vec_id", F.size("embedding").alias("n"), F.round(V.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm2"))


# Bits within which two hashes are one product, or alike enough for an upload.
SAME_BITS, NEAR_BITS = 6, 10


#: A hash of 64 bits is cut into so many parts of so many bits.
PARTS, PART_BITS = 4, 16
#: Flipped bits of a part that are looked up, stage by stage.
FLIPS = 3


def sign_hash(vector: Column) -> Column:
    """The signs of the first 64 elements as the bits of a long; more than 0 is a set bit."""
    bits = F.transform(F.slice(vector, 1, 64), lambda x, i: F.call_function("shiftleft", (x > 0).cast("long"), i))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda h, b: h.bitwiseOR(b))


def _parts(hash_: Column, flips: int) -> Column:
    """(part, value) of the parts of a hash, with exactly ``flips`` bits of each flipped in every way."""
    masks = F.array(*(F.lit(sum(1 << i for i in at)).cast("long") for at in combinations(range(PART_BITS), flips)))
    value = lambda k: F.shiftrightunsigned(hash_, k * PART_BITS).bitwiseAND(F.lit((1 << PART_BITS) - 1))
    return F.flatten(F.array(*(F.transform(masks, _flipped(k, value(k))) for k in range(PARTS))))


def _flipped(part: int, value: Column) -> Callable[[Column], Column]:
    return lambda mask: F.struct(F.lit(part).alias("part"), value.bitwiseXOR(mask).alias("value"))


def nearest_hashes(rows: DataFrame, queries: DataFrame, flips: int = FLIPS) -> tuple[DataFrame, DataFrame]:
    """((q_id, vec_id, distance), the queries left): the nearest of ``rows`` (vec_id, hash) to ``queries`` by bits, itself left out.

    Hashes are indexed by their parts. Two that differ in fewer than
    ``PARTS * (s + 1)`` bits have a part in which at most ``s`` bits differ, so
    looking parts up with up to s bits flipped finds all of them: a nearest one
    within that distance is the nearest there is, and its query is done. Others
    go on to the next s. Queries with none within ``PARTS * flips - 1`` bits are
    left. Equal hashes are one entry with its two smallest ids, so large groups
    of copies cost no more than one row. Ties go to the smallest id; nulls are
    left out.
    """
    rows = rows.where("vec_id is not null and hash is not null")
    least = rows.groupBy("hash").agg(F.min("vec_id").alias("one"))
    second = rows.join(least, "hash").where("vec_id > one").groupBy("hash").agg(F.min("vec_id").alias("two"))
    entries = materialize(least.join(second, "hash", "left"), "hash-entries")
    index = materialize(entries.select("hash", "one", "two", F.explode(_parts(F.col("hash"), 0)).alias("p")).select("p.*", F.col("hash").alias("near"), "one", "two"), "hash-parts")
    left = materialize(queries.where("vec_id is not null and hash is not null").select(F.col("vec_id").alias("q_id"), "hash"), "hash-queries")
    best, found = None, []
    for s in range(flips):
        asked = left.select("q_id", "hash", F.explode(_parts(F.col("hash"), s)).alias("p")).select("q_id", "hash", "p.*")
        other = F.when(F.col("one") == F.col("q_id"), F.col("two")).otherwise(F.col("one"))
        hits = asked.join(index, ["part", "value"]).select("q_id", F.bit_count(F.col("hash").bitwiseXOR(F.col("near"))).alias("distance"), other.alias("vec_id")).where("vec_id is not null")
        hits = hits if best is None else hits.unionByName(best.join(left, "q_id", "left_semi"))
        best = materialize(hits.groupBy("q_id").agg(F.min(F.struct("distance", "vec_id")).alias("b")).select("q_id", "b.*"), "hash-best")
        done = best.where(F.col("distance") < PARTS * (s + 1))
        found.append(done.select("q_id", "vec_id", "distance"))
        left = materialize(left.join(done, "q_id", "left_anti"), "hash-queries")
    near = found[0]
    for more in found[1:]:
        near = near.unionByName(more)
    return near, left


def q_phash_nearest(spark, sf_dir):
    """The stored hash nearest to each query's, its distance, and what that means: by parts, and for queries without a near one by a scan."""
    rows = Catalog(spark, sf_dir).table("embeddings")
    hashed = materialize(rows.select("vec_id", sign_hash(F.col("embedding")).alias("hash")), "hashes")
    near, left = nearest_hashes(hashed, asked(hashed))
    rest = nearest(rows, rows.join(left.select(F.col("q_id").alias("vec_id")), "vec_id", "left_semi"), _same_bits, 1)
    best = near.unionByName(rest.select("q_id", "vec_id", (-F.col("score")).cast("int").alias("distance")))
    match = F.when(F.col("distance") <= SAME_BITS, "same").when(F.col("distance") <= NEAR_BITS, "near").otherwise("none")
    return best.select("q_id", "distance", "vec_id", match.alias("match"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

# DuckDB macros can't go into one statement, so the trigram list is spelled out.
def _tri(x: str) -> str:
    words = f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _sim(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))))"


def _scored(source: str, query: str) -> str:
    words = [w for w in query.split(" ") if len(w) >= 2]
    hits = " + ".join(f"CAST(instr(' ' || lower(title) || ' ', ' {w} ') > 0 AS INT)" for w in words)
    joined = query.replace(" ", "")
    compound = f"contains(replace(lower(title), ' ', ''), '{joined}')"
    return f"""SELECT *, round(hits / {len(words)} + {SIMILAR} * sim + {PHRASE} * CAST(phrase AS INT) + {ALL_WORDS} * CAST(hits = {len(words)} AS INT) + {COMPOUND} * CAST(compound AS INT), 6) AS score FROM (
        SELECT *, {hits} AS hits, {_sim(_tri('title'), _tri(f"'{query}'"))} AS sim, title ILIKE '%{query}%' AS phrase, {compound} AS compound FROM {source})"""


DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def _cos(a: str, b: str) -> str:
    return f"({DOT.format(a=a, b=b)} / (sqrt({DOT.format(a=a, b=a)}) * sqrt({DOT.format(a=b, b=b)})))"


def _nearest_sql(name: str, score: str, extra: str = "") -> str:
    return f"""SELECT q_id, vec_id, {extra}{name} FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY {name} DESC, vec_id) AS rn FROM (
        SELECT b.vec_id AS q_id, a.vec_id, a.label, {score} AS {name} FROM embeddings a JOIN embeddings b ON b.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)) WHERE rn <= 10"""


ORACLES = {
    "suggest_titles": sql(
        f"""SELECT title, score FROM (SELECT lower(title) AS title, round(max(greatest({_sim(_tri('title'), _tri("'blu bolt'"))}, {_sim(_tri("replace(title, ' ', '')"), _tri("'blubolt'"))})), 6) AS score FROM products GROUP BY 1)
        WHERE score > 0.1 ORDER BY score DESC, title LIMIT 8"""
    ),
    "suggest_substring": sql("SELECT title, round(1.0 / length(title) * 0.1 * 0.99, 6)::DOUBLE AS score FROM (SELECT DISTINCT lower(title) AS title FROM products) WHERE contains(replace(title, ' ', ''), 'i') ORDER BY score DESC, title LIMIT 8"),
    "trigram_pairs": sql(f"SELECT a.title AS a, b.title AS b, round({_sim('a.t', 'b.t')}, 6) AS similar FROM t a JOIN t b ON a.title < b.title WHERE round({_sim('a.t', 'b.t')}, 6) >= 0.5", f"t AS (SELECT title, {_tri('title')} AS t FROM (SELECT DISTINCT title FROM products))"),
    "query_score": sql(
        "SELECT product_id, score FROM (SELECT product_id, contains(x, 'brand')::INT + 3 * contains(x, '17')::INT + contains(x, 'red')::INT + 3 * contains(x, '4')::INT AS score FROM (SELECT product_id, lower(brand || ' ' || title) AS x FROM products)) WHERE score > 1"
    ),
    "url_canonical": rf"""SELECT page_id, regexp_extract(bare, '^[^?]*') || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url FROM (SELECT page_id, bare,
        array_to_string(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?i)({T.TRACKING})(=|$)')), '&') AS q
        FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS bare FROM pages))""",
    "html_title_meta": """SELECT page_id, replace(replace(replace(replace(replace(replace(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS title,
        len(regexp_extract_all(html, '<a href='))::INT AS n_links FROM pages""",
    "url_hosts": "SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, count(*) AS n, count(*) FILTER (WHERE regexp_matches(url, '[?&](utm_|ref=)')) AS n_tracked FROM pages GROUP BY 1",
    "title_key_documents": "SELECT min(doc_id) AS first_id, count(*) AS n, length(k)::INT AS n_key FROM (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS k FROM documents) GROUP BY k HAVING count(*) > 1",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "category_infer": sql(
        r"""SELECT category, CASE WHEN regexp_matches(title, '(?i)\b(ring|plate)\b') THEN 'jewellery' WHEN regexp_matches(title, '(?i)\b(bolt|rod|gear|anvil)\b') THEN 'hardware' WHEN regexp_matches(title, '(?i)gizmo|widget') THEN 'gadgets' ELSE 'other' END AS inferred, count(*) AS n FROM products GROUP BY 1, 2"""
    ),
    "vec_topk": _nearest_sql("similarity", f"round({_cos('a.embedding', 'b.embedding')}, 4)", "label, "),
    "vec_hybrid": _nearest_sql("score", f"round(0.6 * {_cos('a.embedding[1:32]', 'b.embedding[1:32]')} + 0.4 * {_cos('a.embedding[33:64]', 'b.embedding[33:64]')}, 4)"),
    "vec_get": f"SELECT vec_id, len(embedding)::INT AS n, round({DOT.format(a='embedding', b='embedding')}, 4) AS norm2 FROM embeddings WHERE vec_id IN (3, 7, 11)",
    "phash_nearest": """SELECT q_id, distance, vec_id, CASE WHEN distance <= 6 THEN 'same' WHEN distance <= 10 THEN 'near' ELSE 'none' END AS match FROM (
        SELECT a.vec_id AS q_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: ((z[1] > 0) <> (z[2] > 0))::INT))::INT AS distance, b.vec_id,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY distance, b.vec_id) AS rn FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rn = 1""",
    "required_numbers": r"""SELECT doc_id, numbers FROM (SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'),
        lambda x: regexp_matches(x, '^\d{1,4}$') AND NOT coalesce(try_cast(x AS INT) BETWEEN 2015 AND 2030, false)))), ',') AS numbers FROM documents) WHERE numbers <> ''""",
}
