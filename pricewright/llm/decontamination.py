"""Benchmark decontamination with a distributed positional inverted index.

The index holds, per term and training document, the positions of the term.
Of each benchmark window (13 consecutive words, or a whole shorter item) the
rarest terms by corpus frequency are looked up, and their lists, less each
term's offset in the item, are intersected: what is left are alignments of an
item with a document. The words of an aligned document then tell which windows
occur there exactly. The rarest terms of a whole item, near their places give
or take some words, are a proximity match.

Texts are read three times, whatever the size of the benchmark: to count its
terms, to index the terms that some window or item asks for, and to verify.
The first two passes tell terms by a bitmap of fixed size; joins on whole terms
follow. The benchmark itself is planned block by block, and its lookups are
tables that the planner joins by their size. The intersection is grouped by
document and alignment, never by term, so a passage that a third of all
documents hold stays spread out.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm.common import ALNUM, chunks, load, raw, row_key, runs, small_batches, values, words
from pricewright.session import materialize

WINDOW = 13
#: Terms of a window whose lists are intersected.
RAREST = 2
#: Terms of an item that a proximity match holds, and by how many words their places may differ.
NEAR_TERMS, SLOP = 4, 2
#: Bytes of benchmark text planned at a time.
BLOCK_BYTES = 16 << 20
#: Bits of the bitmaps that tell terms in tasks.
BITS = 1 << 20


def bucket(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) & (BITS - 1)


def bitmap(terms: set[bytes]) -> np.ndarray:
    bits = np.zeros(BITS, bool)
    bits[[bucket(t) for t in terms]] = True
    return bits


def _told(bits: np.ndarray, seen: set[bytes]) -> frozenset[bytes]:
    """The words that a bitmap has."""
    each = list(seen)
    places = np.fromiter(map(xxhash.xxh3_64_intdigest, each), np.uint64, len(each)) & np.uint64(BITS - 1)
    return frozenset(each[i] for i in np.flatnonzero(bits[places]))


def _bits(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)


def _tally(packed: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _bits(packed)
        for batch in batches:
            seen: Counter = Counter()
            for part in chunks(batch):
                every: Counter = Counter()
                for text in raw(part):
                    every.update(words(text, ALNUM))
                seen.update({w: every[w] for w in _told(bits, every.keys())})
            yield pa.RecordBatch.from_pydict({"term": list(seen), "n": list(seen.values())}, schema=pa.schema([("term", pa.binary()), ("n", pa.int64())]))

    return run


def term_frequencies(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(term, n): occurrences in all documents of the terms in a bitmap, and of a few others."""
    rows = docs.select("text").mapInArrow(_tally(np.packbits(terms).tobytes()), "term binary, n long")
    return materialize(rows.groupBy("term").agg(F.sum("n").alias("n")), "frequencies")


def _post(packed: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _bits(packed)
        for batch in batches:
            for part in chunks(batch):
                terms, owner, positions = [], [], []
                texts = [list(words(text, ALNUM)) for text in raw(part)]
                asked = _told(bits, set().union(*texts))
                for row, own in enumerate(texts):
                    lists: dict[bytes, list[int]] = {w: [] for w in asked.intersection(own)}
                    if lists:
                        for at, w in enumerate(own):
                            if w in lists:
                                lists[w].append(at)
                    terms += lists
                    owner += [row] * len(lists)
                    positions += lists.values()
                of = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms, pa.binary()), part.column("doc_id").take(of), part.column("key").take(of), pa.array(positions, pa.list_(pa.int32()))],
                    names=["term", "doc_id", "key", "positions"],
                )

    return run


def build_index(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """The positional index of the terms in a bitmap (and a few others): (term, doc_id, key, positions), in the shared folder."""
    keyed = docs.select("doc_id", row_key("doc_id", "text").alias("key"), "text")
    schema = f"term binary, doc_id {dict(docs.dtypes)['doc_id']}, key long, positions array<int>"
    return materialize(keyed.mapInArrow(_post(np.packbits(terms).tobytes()), schema), "postings")


def _windows(own: list[bytes], window: int, rarest: int, frequency: dict[bytes, int]) -> list[list[int]]:
    """For each window of an item, the offsets of its rarest terms."""
    wide = min(window, len(own))
    rank = [(frequency.get(w, 0), at) for at, w in enumerate(own)]
    return [sorted(at for _, at in sorted(rank[s : s + wide])[:rarest]) for s in range(len(own) - wide + 1)] if own else []


def _lookups(items: list[tuple[int, list[bytes]]], frequency: dict[bytes, int], window: int | None, rarest: int) -> tuple[list, list]:
    """(lookups, needs): (term, item, offset) to look up, and the offsets that each window of an item needs.

    A window with a term that no document has needs nothing, for it can't occur.
    Without ``window`` an item is one.
    """
    asked, needs = set(), []
    for number, own in items:
        found = [w for w in _windows(own, window or max(1, len(own)), rarest, frequency) if all(frequency.get(own[at]) for at in w)]
        if found:
            needs.append((number, [list(w) for w in sorted({tuple(w) for w in found})]))
            asked |= {(own[at], number, at) for w in found for at in w}
    return sorted(asked), needs


LOOKUPS, NEEDS = "term binary, item long, offset int", "item long, windows array<array<int>>"


def alignments(index: DataFrame, lookups: DataFrame, needs: DataFrame) -> DataFrame:
    """(doc_id, key, item, diagonal) where all looked-up terms of a window of the item align."""
    aligned = (
        index.join(lookups, "term")
        .select("doc_id", "key", "item", "offset", F.explode("positions").alias("pos"))
        .groupBy("doc_id", "key", "item", (F.col("pos") - F.col("offset")).alias("diagonal"))
        .agg(F.collect_set("offset").alias("offsets"))
    )
    full = F.exists("windows", lambda w: F.size(F.array_except(w, F.col("offsets"))) == 0)
    return aligned.join(needs, "item").where(full).select("doc_id", "key", "item", "diagonal")


def proximity(index: DataFrame, lookups: DataFrame, needs: DataFrame, slop: int) -> DataFrame:
    """(doc_id, key, item, first, last): places where all looked-up terms of an item are near theirs.

    Each term is at its offset from a common place, give or take ``slop`` words
    in all; every window of ``slop`` and one diagonals is tested, so other
    occurrences nearby hide none.
    """
    place = F.floor(F.col("diagonal") / (slop + 1))
    window = F.transform(
        F.array_distinct("hits.diagonal"),
        lambda start: F.filter("hits", lambda hit: (hit["diagonal"] >= start) & (hit["diagonal"] <= start + slop)),
    )
    # 2 * (slop + 1) diagonals of a few offsets bound the hits of a group
    return (
        index.join(lookups, "term")
        .select("doc_id", "key", "item", "offset", F.explode("positions").alias("pos"))
        .withColumn("diagonal", F.col("pos") - F.col("offset"))
        .withColumn("near", F.explode(F.array(place, place + 1)))
        .groupBy("doc_id", "key", "item", "near")
        .agg(F.collect_set(F.struct("diagonal", "offset", "pos")).alias("hits"))
        .join(needs.select("item", F.size(F.get("windows", F.lit(0))).alias("n")), "item")
        .select("doc_id", "key", "item", "n", F.explode(window).alias("hits"))
        .where(F.size(F.array_distinct("hits.offset")) == F.col("n"))
        .select("doc_id", "key", "item", F.array_min("hits.pos").alias("first"), F.array_max("hits.pos").alias("last"))
        .distinct()
    )


def _verify(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                out: list[tuple] = []
                for text, found, near in zip(raw(part), part.column("found").to_pylist(), part.column("n_near").to_pylist()):
                    own = list(words(text, ALNUM)) if found or len(text) > 1 << 20 else text.translate(ALNUM).split()
                    hit, names = np.zeros(len(own), bool), set()
                    for place in found or ():
                        item = list(words(place["item_text"].encode(), ALNUM))
                        wide = min(window, len(item))
                        for diagonal in place["diagonals"]:
                            first = max(0, -diagonal)
                            last = min(len(item), len(own) - diagonal)
                            if last - first < wide:
                                continue
                            same = np.fromiter((own[diagonal + at] == item[at] for at in range(first, last)), bool, last - first)
                            whole = np.convolve(same, np.ones(wide, np.int64), "valid") == wide
                            starts = np.flatnonzero(whole) + first + diagonal
                            if len(starts):
                                hit |= runs(starts, wide, len(own))
                                names.add(place["item_id"])
                    n = int(hit.sum())
                    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
                    out.append((len(own), n, len(names), digest, n > 0 and 20 * n >= len(own), near or 0))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *columns], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"]
                )

    return run


def _items(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """(items, number of blocks): (item, item_id, text, block) of a benchmark; ``item`` numbers them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    n_bytes = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-n_bytes // block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int"))
    return materialize(items.withColumn("item", F.monotonically_increasing_id()), "items"), n


class Plan:
    """What a benchmark asks of the index; planned block by block, held as tables."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int, rarest: int, near_terms: int, block_bytes: int):
        spark = docs.sparkSession
        self.items, n_blocks = _items(benchmark, block_bytes)

        def blocks() -> Iterator[list[tuple[int, list[bytes]]]]:
            for block in range(n_blocks):
                rows = self.items.where(F.col("block") == block).select("item", "text").collect()  # block_bytes of text
                yield [(r.item, list(words(r.text.encode(), ALNUM))) for r in rows]

        every = np.zeros(BITS, bool)
        for items in blocks():
            every |= bitmap({w for _, own in items for w in own})
        frequencies = term_frequencies(docs, every)
        self.asked, tables = np.zeros(BITS, bool), {"exact": [], "near": []}
        for items in blocks():
            terms = spark.createDataFrame([(bytearray(t),) for t in {w for _, own in items for w in own}], "term binary")
            frequency = {bytes(t): n for t, n in frequencies.join(terms, "term").collect()}  # the terms of a block
            for kind, wide, few in (("exact", window, rarest), ("near", None, near_terms)):
                lookups, needs = _lookups(items, frequency, wide, few)
                self.asked |= bitmap({t for t, *_ in lookups})
                rows = spark.createDataFrame([(bytearray(t), i, at) for t, i, at in lookups], LOOKUPS), spark.createDataFrame(needs, NEEDS)
                tables[kind].append(tuple(materialize(df, f"{kind}-lookups") for df in rows))
        self.exact, self.near = ([_union(part) for part in zip(*tables[kind])] for kind in ("exact", "near"))


def _union(parts: tuple[DataFrame, ...]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    rarest: int = RAREST,
    slop: int = SLOP,
    near_terms: int = NEAR_TERMS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    ``benchmark`` has item_id and text and is planned block by block of
    ``block_bytes``; a block, not the benchmark, bounds what the driver holds,
    and documents are read as often for many blocks as for one. n_near counts
    the item_ids with a proximity match. A null text or item_id of an item is
    left out, items that repeat count once, and an item_id with several texts
    occurs when one does. A null document has no words; repeated rows give a
    row each; null doc_ids are kept.
    """
    with small_batches(docs.sparkSession):
        plan = Plan(docs, benchmark, window, rarest, near_terms, block_bytes)
        index = build_index(docs, plan.asked)
        places = alignments(index, *plan.exact).groupBy("doc_id", "key", "item").agg(F.collect_list("diagonal").alias("diagonals"))
        named = places.join(plan.items.select("item", "item_id", F.col("text").alias("item_text")), "item")
        found = named.groupBy("doc_id", "key").agg(F.collect_list(F.struct("item_id", "item_text", "diagonals")).alias("found"))
        near = proximity(index, *plan.near, slop).join(plan.items.select("item", "item_id"), "item")
        counted = near.groupBy("doc_id", "key").agg(F.count_distinct("item_id").alias("n_near"))
        each = materialize(found.withColumnRenamed("doc_id", "id").withColumnRenamed("key", "of"), "aligned")
        close = materialize(counted.withColumnRenamed("doc_id", "id2").withColumnRenamed("key", "of2"), "near")
    keyed = docs.select("doc_id", row_key("doc_id", "text").alias("key"), "text")
    joined = keyed.join(each, (F.col("key") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    joined = joined.join(close, (F.col("key") == F.col("of2")) & F.col("doc_id").eqNullSafe(F.col("id2")), "left")
    schema = "doc_id {}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near long".format(dict(docs.dtypes)["doc_id"])
    return joined.select("doc_id", "text", "found", "n_near").mapInArrow(_verify(window), schema)


def benchmark_proximity(docs: DataFrame, benchmark: DataFrame, slop: int = SLOP, near_terms: int = NEAR_TERMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, key, item_id, first, last): where the rarest terms of a whole item occur near their places."""
    plan = Plan(docs, benchmark, WINDOW, RAREST, near_terms, block_bytes)
    places = proximity(build_index(docs, plan.asked), *plan.near, slop)
    return places.join(plan.items.select("item", "item_id"), "item").select("doc_id", "key", "item_id", "first", "last").distinct()


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "benchmark", "item_id", "text"))


OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark
), bp AS (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(generate_series(1, len(ws) - least(13, len(ws)) + 1)) AS i FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i+n-1], ' ') AS s FROM bp),
dp AS (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n),
m AS (SELECT doc_id, i, dp.n, item_id FROM dp JOIN bw ON dp.n = bw.n AND array_to_string(ws[i:i+dp.n-1], ' ') = s),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY 1)
, tf AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM d) GROUP BY 1),
bt AS (SELECT item_id, item, o, term FROM (SELECT item_id, ws AS item, unnest(ws) AS term, unnest(generate_series(0, len(ws) - 1)) AS o FROM (SELECT DISTINCT item_id, ws FROM b WHERE len(ws) > 0))),
br AS (SELECT *, count(*) OVER (PARTITION BY item_id, item) AS n_terms FROM (
  SELECT item_id, item, o, term, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY item_id, item ORDER BY coalesce(n, 0), o) AS rn FROM bt LEFT JOIN tf ON term = w) WHERE rn <= {NEAR_TERMS}),
hits AS (SELECT doc_id, item_id, item, n_terms, o, pos - o AS diagonal FROM (SELECT doc_id, unnest(ws) AS w, unnest(generate_series(0, len(ws) - 1)) AS pos FROM d WHERE len(ws) > 0) JOIN br ON w = term),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (
  SELECT x.doc_id, x.item_id FROM hits x JOIN hits y ON x.doc_id = y.doc_id AND x.item_id = y.item_id AND x.item = y.item AND y.diagonal BETWEEN x.diagonal AND x.diagonal + {SLOP}
  GROUP BY x.doc_id, x.item_id, x.item, x.n_terms, x.diagonal HAVING count(DISTINCT y.o) = x.n_terms) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN near USING (doc_id)
"""
