"""Language identification by Bayesian evidence fusion.

Evidence of a document: its text (likelihood of hashed byte trigrams under each
language), its declared language, its address suffix and its host. How far a
declaration or suffix is to be believed, and which languages a host has, is
counted over all documents by grouped aggregation; host priors are smoothed
towards those of their domain, and these towards the whole corpus. All evidence
is added up in logarithms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm.common import ALNUM, chunks, left_join_by_size, load, raw
from pricewright.session import materialize

LANGUAGES = ("de", "en", "es", "fr")
#: The class of texts that look like none of the languages.
UNKNOWN = "und"
#: Hashed trigrams in the likelihood table.
BUCKETS = 1 << 13
#: Neighbouring trigrams tell much the same, so their likelihood counts in part.
TEMPER = 0.25
#: Nats by trigram that a text must fall below even odds to look like none of the languages.
MARGIN = 1.5
#: Letters in lower case; all else is a space, so numbers, keys and addresses say little.
LETTERS = bytes(32 if 48 <= c <= 57 else c for c in ALNUM)
#: Documents that the wider prior is worth in a narrower one.
SMOOTHING = 20.0
#: Posterior probability below which a language is not accepted.
LEAST = 0.5


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigrams of all texts, text of each)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts).translate(LETTERS), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    inside = (of[2:] == of[:-2]) & ~((data[:-2] == 32) & (data[1:-1] == 32)) & ~((data[1:-1] == 32) & (data[2:] == 32))
    bucket = (code * np.uint32(2654435761)) >> np.uint32(19)
    return bucket[inside].astype(np.int64), of[:-2][inside]


def _count(languages: tuple[str, ...]):
    place = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(languages) * BUCKETS, np.int64)
        for batch in batches:
            for part in chunks(batch):
                which = np.array([place.get(d, -1) for d in part.column("declared").to_pylist()], np.int64)
                bucket, of = _trigrams(raw(part))
                used = which[of] >= 0
                held += np.bincount(which[of][used] * BUCKETS + bucket[used], minlength=len(held))
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(held[seen])], names=["cell", "n"])

    return run


def likelihoods(train: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """Log likelihood of each hashed trigram by language, and less than even odds for ``und``; a table of fixed size.

    ``train`` has text and declared; rows of other or no languages are left out.
    """
    rows = train.select("text", "declared").mapInArrow(_count(languages), "cell long, n long")
    rows = rows.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.full(len(languages) * BUCKETS, 0.5)
    table[rows.column("cell").to_numpy()] += rows.column("n").to_numpy()
    table = table.reshape(len(languages), BUCKETS)
    logs = np.log(table / table.sum(1, keepdims=True))
    return np.vstack([logs, np.full((1, BUCKETS), -np.log(BUCKETS) - MARGIN)]).astype(np.float32)


def _score(table: np.ndarray):
    columns = np.ascontiguousarray(table.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                texts = raw(part)
                bucket, of = _trigrams(texts)
                n = np.bincount(of, minlength=part.num_rows)
                some_word = pa.array([bool(t.translate(ALNUM).strip()) for t in texts])
                total = np.zeros((part.num_rows, table.shape[0]))
                some = np.flatnonzero(n)
                if len(some):
                    starts = np.append(0, np.cumsum(n[some]))[:-1]
                    total[some] = np.add.reduceat(columns[bucket], starts, axis=0, dtype=np.float64)
                kept = [part.column(c) for c in ("doc_id", "declared", "host", "suffix")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, some_word, pa.array(n, pa.int64()), pa.array(list(total), pa.list_(pa.float64()))],
                    names=["doc_id", "declared", "host", "suffix", "some_word", "n_trigrams", "scores"],
                )

    return run


def domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def _shares(counts: DataFrame, parent: list[Column], classes: list[str]) -> list[Column]:
    total = sum((F.col(f"n_{c}") for c in classes), F.lit(0.0))
    return [((F.col(f"n_{c}") + SMOOTHING * p) / (total + SMOOTHING)) for c, p in zip(classes, parent)]


def identify(docs: DataFrame, table: np.ndarray, languages: tuple[str, ...] = LANGUAGES, least: float = LEAST) -> DataFrame:
    """One row per document with its language: doc_id, language, posterior,
    text_language, declared, accepted.

    ``docs``: doc_id, text, declared, host and suffix (any may be null: a null
    host has the corpus prior, a null or unlisted declaration or suffix counts
    as such). A document is accepted unless it has no word or number at all,
    looks like none of the languages, or leaves the posterior below ``least``.
    A text without a trigram of letters says nothing (text_language is null):
    then declaration, suffix and host decide. Repeated rows give a row each,
    and ties go to the first language.
    """
    classes = [*languages, UNKNOWN]
    types = dict(docs.dtypes)
    schema = f"doc_id {types['doc_id']}, declared string, host string, suffix string, some_word boolean, n_trigrams long, scores array<double>"
    scored = docs.select("doc_id", "text", "declared", "host", "suffix").mapInArrow(_score(table), schema)
    best = F.when(F.col("n_trigrams") > 0, F.array_position("scores", F.array_max("scores")).cast("int"))
    known = F.when(F.col("declared").isin(*languages), F.col("declared")).when(F.col("declared").isNull(), F.lit("none")).otherwise(F.lit("other"))
    scored = materialize(scored.withColumn("best", best).withColumn("claim", known), "language-scores")
    counts = [F.count_if(F.col("best") == i + 1).cast("double").alias(f"n_{c}") for i, c in enumerate(classes)]
    whole = scored.agg(*(F.coalesce(c, F.lit(0.0)).alias(f"n_{k}") for c, k in zip(counts, classes))).first().asDict()
    n = sum(whole.values())
    root = [(whole[f"n_{c}"] + 1) / (n + len(classes)) for c in classes]
    hosts = scored.where("host is not null").groupBy("host").agg(*counts).withColumn("domain", domain(F.col("host")))
    domains = hosts.groupBy("domain").agg(*(F.sum(f"n_{c}").alias(f"n_{c}") for c in classes))
    wide = _shares(domains, [F.lit(r) for r in root], classes)
    domains = domains.select("domain", *(p.alias(f"d_{c}") for p, c in zip(wide, classes)))
    narrow = hosts.join(domains, "domain")
    size = sum((F.col(f"n_{c}") for c in classes), F.lit(0.0))
    priors = narrow.select("host", size.alias("n_host"), *(p.alias(f"p_{c}") for p, c in zip(_shares(narrow, [F.col(f"d_{c}") for c in classes], classes), classes)))
    claims = {r["claim"]: r for r in scored.groupBy("claim").agg(*counts).collect()}  # at most a row for each language and two more
    kinds = [*languages, "other", "none"]

    def belief(kind: str, i: int) -> float:
        c = classes[i]
        seen = claims[kind][f"n_{c}"] if kind in claims else 0.0
        return float(np.log((seen + 0.5) / (whole[f"n_{c}"] + 0.5 * len(kinds))))

    said = F.element_at(F.create_map(*[y for k in kinds for y in (F.lit(k), F.array(*(F.lit(belief(k, i)) for i in range(len(classes)))))]), F.col("claim"))
    ends = scored.where("suffix is not null").groupBy("suffix").agg(*counts)
    share = sum((F.col(f"n_{c}") for c in classes), F.lit(0.0)) / max(n, 1.0)
    ends = ends.select(
        "suffix", size.alias("n_suffix"), *(F.log((F.col(f"n_{c}") + SMOOTHING * share) / (whole[f"n_{c}"] + SMOOTHING)).alias(f"s_{c}") for c in classes)
    )
    joined = left_join_by_size(scored, materialize(priors, "host-priors"), "host", "n_host", n)
    joined = left_join_by_size(joined, materialize(ends, "suffixes"), "suffix", "n_suffix", n)
    top = F.array_max("scores")
    evidence = F.array(
        *(
            TEMPER * (F.col("scores")[i] - top)
            + F.log(F.coalesce(F.col(f"p_{c}"), F.lit(root[i])))
            + F.coalesce(F.col(f"s_{c}"), F.lit(0.0))
            + said[i]
            for i, c in enumerate(classes)
        )
    )
    fused = joined.withColumn("evidence", evidence).withColumn("most", F.array_max("evidence"))
    mass = F.aggregate("evidence", F.lit(0.0), lambda held, e: held + F.exp(e - F.col("most")))
    names = F.array(*(F.lit(c) for c in classes))
    fused = fused.withColumn("posterior", 1 / mass).withColumn(
        "language", F.element_at(names, F.array_position("evidence", F.col("most")).cast("int"))
    )
    accepted = F.col("some_word") & (F.col("language") != UNKNOWN) & (F.col("posterior") >= least)
    return fused.select(
        "doc_id", "language", "posterior", F.element_at(names, F.col("best")).alias("text_language"), "declared", accepted.alias("accepted")
    )


ADDRESS = r"(?i)\bhttps?://[a-z0-9.-]*\.([a-z]{2,18})\b"
LANG = r"""(?i)<html[^>]*\blang=["']?([a-z]{2})"""


def of_documents(docs: DataFrame) -> DataFrame:
    """Rows of ``documents``: source is their host.

    What they declare is the lang of an html element in the text, else the
    column lang; the suffix is that of a source which is a host name, else of
    the first address in the text.
    """
    suffix = F.coalesce(
        F.nullif(F.lower(F.regexp_extract("source", r"\.([A-Za-z]{2,18})$", 1)), F.lit("")),
        F.nullif(F.lower(F.regexp_extract("text", ADDRESS, 1)), F.lit("")),
    )
    marked = F.when(F.col("text").contains("<html"), F.nullif(F.lower(F.regexp_extract("text", LANG, 1)), F.lit("")))
    return docs.select("doc_id", "text", F.coalesce(marked, F.lower("lang")).alias("declared"), F.col("source").alias("host"), suffix.alias("suffix"))


def of_pages(pages: DataFrame) -> DataFrame:
    """Web pages: text without markup, the lang of the html element, the host and its last label."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), "<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", "^(?i)[a-z]+://([^/:?#]+)", 1))
    lang = F.lower(F.regexp_extract("html", LANG, 1))
    return pages.select(
        F.col("page_id").alias("doc_id"), bare.alias("text"), F.nullif(lang, F.lit("")).alias("declared"),
        F.nullif(host, F.lit("")).alias("host"), F.nullif(F.substring_index(host, ".", -1), F.lit("")).alias("suffix"),
    )


def identify_documents(docs: DataFrame) -> DataFrame:
    rows = of_documents(docs)
    return identify(rows, likelihoods(rows))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(load(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fusion over ``pages``, with the likelihoods of ``documents``."""
    table = likelihoods(of_documents(load(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")))
    rows = identify(of_pages(load(spark, sf_dir, "pages", "page_id", "url", "html")), table)
    return rows.withColumnRenamed("doc_id", "page_id")
