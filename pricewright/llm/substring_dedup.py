"""Substring deduplication by seed and extend.

0. *Copies.* A document whose words are all those of a smaller one repeats as a
   whole, and is settled by one SHA-256 of its words.
1. *Seed.* Every other document is winnowed: of each ``window`` consecutive words the
   k-gram with the smallest hash is its anchor, so equal windows have equal
   anchors. Joining documents on anchors leaves those that two documents share.
2. *Join.* Each window that chose a shared anchor is joined to the smallest
   document with such a window, by the anchor and its context (a 96-bit key). That
   gives alignments: a document, a smaller one, the distance of their places,
   and how far the match may reach.
3. *Extend.* The words of the smaller document travel to the larger one, once for
   each passage, and are compared with its own, word by word, both ways over the
   whole reach. Only words that agree count; no hash decides.
4. *Keep.* Agreeing stretches of at least ``window`` words are the maximal
   repeats; adjoining ones merge.

Tasks first settle what their own part shows (a window that a smaller document of
the same part has, its words compared there and then, needs no further match), so an
anchor or window reaches the shuffle at most once for each part and document that
owns it, however many documents hold it; no pairs of documents are ever formed.
Texts are shuffled once, into a table in buckets of their key; later joins move only
positions and passages to them.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewright.llm.common import chunks, factors, gram_hashes, left_join_by_size, load, mix, raw, row_key, runs, values, words
from pricewright.session import materialize, scratch_root

WINDOW = 13
ANCHOR = 5
#: Stands for a null doc_id.
NO_ID = -(2**63)
#: Bytes of text whose documents a task settles among themselves.
PART_BYTES = 12 << 20
#: Bytes of text in a bucket of the keyed table, and how many buckets there are at most.
BUCKET_BYTES, MOST = 16 << 20, 50_000

SEEDS = "grp long, key long, doc_id long, pos int, also array<int>, more binary"
WINDOWS = "grp long, grp2 int, key long, doc_id long, pos int, also array<int>, more binary"


def anchors(grams: np.ndarray, wide: int) -> np.ndarray:
    """For each run of ``wide`` grams, where its anchor is: the first of the least."""
    n = max(0, len(grams) - wide + 1)
    best, at = grams[:n].copy(), np.zeros(n, np.int16)
    for j in range(1, wide):
        less = grams[j : j + n] < best
        np.copyto(best, grams[j : j + n], where=less)
        at[less] = j
    return at + np.arange(n, dtype=np.int32)


def in_order(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows by doc_id, so that the first of equal things in a part is that of its smallest document."""
    return batch.take(pa.array(np.argsort(values(batch, "doc_id"), kind="stable")))


class Part:
    """Some documents of a task with their words numbered, so that words compare as numbers."""

    def __init__(self, batch: pa.RecordBatch):
        self.keys, self.docs = values(batch, "key"), values(batch, "doc_id")
        vocabulary: defaultdict = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        each = [np.array([vocabulary[w] for w in words(t)] if len(t) > 1 << 20 else list(map(vocabulary.__getitem__, t.split())), np.int32) for t in raw(batch)]
        table = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))
        self.base = np.append(0, np.cumsum([len(x) for x in each]))
        self.flat = np.concatenate(each) if each else np.empty(0, np.int32)
        self.hashes = table[self.flat]
        self.owner = np.repeat(np.arange(len(each), dtype=np.int32), np.diff(self.base))

    def seeds(self, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(grams, starts, places): the hash of every run of ``anchor`` words, where windows within a document start, and where their anchors are."""
        grams = gram_hashes(self.hashes, anchor, 1)
        starts = np.arange(max(0, len(self.flat) - window + 1), dtype=np.int32)
        starts = starts[self.owner[starts] == self.owner[starts + window - 1]]
        return grams, starts, anchors(grams, window - anchor + 1)[starts]

    def contexts(self, starts: np.ndarray, window: int, seed: int) -> np.ndarray:
        """The hash of the window at each start."""
        total = np.zeros(len(starts), np.uint64)
        for j, f in enumerate(factors(window, seed)):
            total += self.hashes[starts + j] * f
        return mix(total)

    def same(self, own: np.ndarray, pos: np.ndarray, other: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
        """Whether the words of two windows are the same, for each pair."""
        i, j = self.base[own] + pos, self.base[other] + at
        equal = np.ones(len(i), bool)
        for step in range(window):
            equal &= self.flat[i + step] == self.flat[j + step]
        return equal


def _settle(part: Part, groups: list[np.ndarray], own: np.ndarray, pos: np.ndarray, window: int) -> Iterator[pa.RecordBatch]:
    """Rows of one part, in the order of its documents: what these settle goes out packed, the rest by group.

    With ``window``, positions whose window the smallest document of their
    group has too, word by word, are settled; without (anchors), all positions
    of a shared group are, and its smallest document stands for the group.
    """
    if not len(pos):
        return
    doc = part.docs[own]
    order = np.argsort(groups[0], kind="stable")  # by document within a group
    new = np.zeros(len(order), bool)
    new[0] = True
    for g in groups:
        new[1:] |= g[order][1:] != g[order][:-1]
    group = np.cumsum(new) - 1
    first_row = np.flatnonzero(new)
    if window:
        known = doc[order] != doc[order][first_row][group]
        later, least = order[known], order[first_row[group[known]]]
        known[known] = part.same(own[later], pos[later], own[least], pos[least], window)
        open_ = ~known
    else:
        last = np.append(first_row[1:], len(order)) - 1
        known = (doc[order][last] != doc[order][first_row])[group]
        open_ = ~known
        open_[first_row] = True
    picked, of = order[open_], group[open_]
    cut = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (own[picked][1:] != own[picked][:-1])))  # a group's positions in one document share a row
    size = np.diff(np.append(cut, len(picked)))
    also: list = [None] * len(cut)
    for i in np.flatnonzero(size > 1):
        also[i] = np.unique(pos[picked[cut[i] + 1 : cut[i] + size[i]]]).tolist()
    picked = picked[cut]
    tidy = np.argsort((own[picked].astype(np.int64) << 32) | pos[picked])  # rows of a document compress well together
    picked = picked[tidy]
    rest = pa.array(pos[picked], pa.int32()), pa.array([also[i] for i in tidy], pa.list_(pa.int32())), pa.nulls(len(cut), pa.binary())
    yield _batch(part, [g[picked] for g in groups], own[picked], *rest)
    sure = order[known]
    if len(sure):
        sure = sure[np.argsort((own[sure].astype(np.int64) << 32) | pos[sure])]
        cut = np.flatnonzero(np.append(True, own[sure][1:] != own[sure][:-1]))
        packed = pa.array([np.unique(x).astype("<i4").tobytes() for x in np.split(pos[sure], cut[1:])], pa.binary())
        spread = [part.keys[own[sure][cut]].view(np.uint64) for _ in groups]
        yield _batch(part, spread, own[sure][cut], pa.nulls(len(cut), pa.int32()), pa.nulls(len(cut), pa.list_(pa.int32())), packed)


def _batch(part: Part, groups: list[np.ndarray], own: np.ndarray, pos: pa.Array, also: pa.Array, more: pa.Array) -> pa.RecordBatch:
    names = ["grp", "grp2"][: len(groups)] + ["key", "doc_id", "pos", "also", "more"]
    arrays = [pa.array(groups[0].view(np.int64), pa.int64())]
    arrays += [pa.array(g.astype(np.uint32).view(np.int32), pa.int32()) for g in groups[1:]]
    arrays += [pa.array(part.keys[own], pa.int64()), pa.array(part.docs[own], pa.int64()), pos, also, more]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _whole(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                texts = raw(part)
                digests = []
                for text in texts:
                    own = list(words(text))
                    digests.append(hashlib.sha256(b" ".join(own)).digest() if len(own) >= window else None)
                columns = [part.column("key"), part.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "n_bytes", "whole"])

    return run


def _seed(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, limit=PART_BYTES):
                part = Part(in_order(piece))
                grams, _, at = part.seeds(window, anchor)
                at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at  # neighbouring windows share anchors
                own = part.owner[at]
                some = part.docs[own] != NO_ID
                at, own = at[some], own[some]
                yield from _settle(part, [grams[at]], own, at - part.base[own], 0)

    return run


def _positions(pos, more) -> np.ndarray:
    at = [np.asarray(pos if pos is not None else [], np.int64)]
    at += [np.frombuffer(m, "<i4").astype(np.int64) for m in (more if more is not None else [])]
    return np.unique(np.concatenate(at))


def _marked(part: Part, piece: pa.RecordBatch) -> np.ndarray:
    """Which words of a part are at the positions of its rows."""
    marks = np.zeros(len(part.flat), bool)
    for own, (pos, more) in enumerate(zip(piece.column("pos"), piece.column("more"))):
        base = part.base[own]
        if pos.values is not None and len(pos.values):
            marks[base + pos.values.to_numpy(zero_copy_only=False)] = True
        for m in more.as_py() or ():
            marks[base + np.frombuffer(m, "<i4")] = True
    return marks


def _context(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, limit=PART_BYTES):
                piece = in_order(piece)
                part = Part(piece)
                _, starts, at = part.seeds(window, anchor)
                starts = starts[_marked(part, piece)[at]]
                own = part.owner[starts]
                one, two = part.contexts(starts, window, 2), part.contexts(starts, window, 3) >> np.uint64(32)
                yield from _settle(part, [one, two], own, starts - part.base[own], window)

    return run


def in_buckets(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``keys``, so that joins on all of them don't move it again.

    There are ``n`` buckets, or one for each shuffle partition if that is more: Spark would rather shuffle than use fewer.
    """
    spark, name = df.sparkSession, f"keyed_{uuid.uuid4().hex}"
    n = min(MOST, max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", f"{scratch_root(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages asked of each text, as their words joined by spaces."""
    for batch in batches:
        for part in chunks(batch):
            rows: list[tuple] = []
            for row, (text, asked) in enumerate(zip(raw(part), part.column("asked").to_pylist())):
                own = list(words(text))
                rows += [(row, a["lo"], a["hi"], b" ".join(own[a["lo"] : a["hi"]])) for a in asked]
            of = pa.array([r[0] for r in rows], pa.int64())
            columns = [pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.binary()))]
            yield pa.RecordBatch.from_arrays([part.column("key").take(of), part.column("doc_id").take(of), *columns], names=["e_key", "e_doc", "e_lo", "e_hi", "passage"])


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """(keyed documents, matches): what of each document repeats one with a smaller doc_id.

    ``docs`` has doc_id and text; keyed documents have key, doc_id (``NO_ID``
    for null) and text. Matches have a row per key and doc_id: ``more`` (packed
    positions of windows whose words a task has compared), ``passages`` (place
    and words of a smaller document's passage, to be compared) and
    ``all_of_it`` for a copy of a whole document. Documents of fewer than
    ``window`` words and null texts have none; rows without a doc_id neither
    match nor are matched; rows that share a doc_id count as one document.
    """
    ranked = docs.select(row_key("doc_id", "text").alias("key"), F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    whole = materialize(ranked.mapInArrow(_whole(window), "key long, doc_id long, n_bytes long, whole binary"), "wholes")
    n_rows, n_bytes = whole.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    keyed = in_buckets(ranked, ["key", "doc_id"], math.ceil(n_bytes / BUCKET_BYTES))
    first = whole.where(F.col("whole").isNotNull() & (F.col("doc_id") != NO_ID)).groupBy("whole").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = left_join_by_size(whole.drop("n_bytes"), materialize(first, "first"), "whole", "n", n_rows)  # null digests match nothing
    copies = materialize(copies.where("doc_id > first_id").select("key", "doc_id").distinct(), "copies")
    seeds = keyed.join(copies, ["key", "doc_id"], "left_anti").select("key", "doc_id", "text").mapInArrow(_seed(window, anchor), SEEDS)
    by = Window.partitionBy("grp")
    shared = (
        seeds.withColumn("shared", F.col("more").isNotNull() | (F.min("doc_id").over(by) < F.max("doc_id").over(by)))
        .where("shared")
        .groupBy("key", "doc_id")
        .agg(F.concat(F.collect_list("pos"), F.flatten(F.collect_list("also"))).alias("pos"), F.collect_list("more").alias("more"))
    )
    near = keyed.join(shared, ["key", "doc_id"]).select("key", "doc_id", "text", "pos", "more")
    by = Window.partitionBy("grp", "grp2")
    least = F.min(F.struct(F.col("doc_id").alias("e_doc"), F.col("key").alias("e_key"), F.col("pos").alias("e_pos"))).over(by)
    covered = near.mapInArrow(_context(window, anchor), WINDOWS).withColumn("least", least)
    covered = covered.where("more is not null or least.e_doc < doc_id").withColumn("least", F.when(F.col("more").isNull(), F.col("least")))
    # what a task has settled has no place (null) and no partner; it goes through the same aggregation
    places = F.explode(F.concat(F.array("pos"), F.coalesce("also", F.array().cast("array<int>"))))
    placed = covered.select("key", "doc_id", "least.*", "more", places.alias("at"))
    reach = placed.groupBy("key", "doc_id", "e_doc", "e_key", (F.col("at") - F.col("e_pos")).alias("diagonal"))
    reach = reach.agg(F.min("at").alias("lo"), (F.max("at") + window).alias("hi"), F.collect_list("more").alias("more"))
    reach = materialize(reach.withColumn("e_lo", F.col("lo") - F.col("diagonal")).withColumn("e_hi", F.col("hi") - F.col("diagonal")), "alignments")
    alignments = reach.where("e_key is not null").drop("more", "diagonal")
    asked = alignments.select("e_key", "e_doc", "e_lo", "e_hi").distinct().groupBy(F.col("e_key").alias("key"), F.col("e_doc").alias("doc_id"))
    asked = asked.agg(F.collect_list(F.struct(F.col("e_lo").alias("lo"), F.col("e_hi").alias("hi"))).alias("asked"))
    cut = keyed.join(asked, ["key", "doc_id"]).select("key", "doc_id", "text", "asked")
    cut = materialize(cut.mapInArrow(_cut, "e_key long, e_doc long, e_lo int, e_hi int, passage binary"), "passages")
    carried = alignments.join(cut, ["e_key", "e_doc", "e_lo", "e_hi"]).groupBy("key", "doc_id").agg(F.collect_list(F.struct("lo", "passage")).alias("passages"))
    none = F.array().cast("array<binary>"), F.array().cast("array<struct<lo:int,passage:binary>>")
    settled = reach.where("e_key is null")
    every = [
        settled.select("key", "doc_id", "more", none[1].alias("passages"), F.lit(False).alias("all_of_it")),
        carried.select("key", "doc_id", none[0].alias("more"), "passages", F.lit(False).alias("all_of_it")),
        copies.select("key", "doc_id", none[0].alias("more"), none[1].alias("passages"), F.lit(True).alias("all_of_it")),
    ]
    matches = every[0].unionByName(every[1]).unionByName(every[2]).groupBy("key", "doc_id")
    return keyed, matches.agg(
        F.flatten(F.collect_list("more")).alias("more"), F.flatten(F.collect_list("passages")).alias("passages"), F.max("all_of_it").alias("all_of_it")
    )


def agreeing(own: list[bytes], lo: int, passage: list[bytes], window: int) -> np.ndarray:
    """Where windows start in ``own`` whose words a passage, laid at ``lo``, has too."""
    same = np.fromiter((a == b for a, b in zip(own[lo : lo + len(passage)], passage)), bool, min(len(passage), max(0, len(own) - lo)))
    if len(same) < window:
        return np.empty(0, np.int64)
    return np.flatnonzero(np.convolve(same, np.ones(window, np.int64), "valid") == window) + lo


def _apply(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                places = zip(part.column("more").to_pylist(), part.column("passages").to_pylist(), part.column("all_of_it").to_pylist())
                total, gone, digest, spans = [], [], [], []
                for text, (more, passages, copy) in zip(raw(part), places):
                    own = list(words(text))
                    at = [np.arange(len(own) - window + 1)] if copy else [_positions(None, more)]
                    at += [agreeing(own, p["lo"], p["passage"].split(b" "), window) for p in passages or () if not copy]
                    at = np.unique(np.concatenate(at))
                    kept = own
                    marks = np.zeros(0, np.int64)
                    if len(at):
                        mask = runs(at, window, len(own))
                        kept = [w for w, m in zip(own, mask) if not m]
                        marks = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                    total.append(len(own))
                    gone.append(len(own) - len(kept))
                    digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                    spans.append(marks.tolist())
                ids = part.column("doc_id")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None if i == NO_ID else i for i in ids.to_pylist()], pa.int64()),
                        pa.array(total, pa.int64()),
                        pa.array(gone, pa.int64()),
                        pa.array(digest, pa.string()),
                        pa.array(spans, pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "repeat_bounds"],
                )

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per document with what removing its repeats leaves.

    Columns: doc_id (a long), n_words, n_removed, kept_sha256 (of the kept
    words joined by one space) and repeat_bounds: the maximal repeats, as
    starts and ends in words by turns. A null text has no words. Rows with a
    null doc_id (and the long that stands for it, -2^63) keep all their words;
    repeated rows give a row each.
    """
    if not 1 <= anchor <= window:
        raise ValueError("an anchor has from 1 to `window` words")
    keyed, matches = repeats(docs, window, anchor)
    return keyed.join(matches, ["key", "doc_id"], "left").select("doc_id", "text", "more", "passages", "all_of_it").mapInArrow(
        _apply(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, repeat_bounds array<int>"
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(load(spark, sf_dir, "documents", "doc_id", "text")).drop("repeat_bounds")


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM w
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS s FROM p WHERE i + 12 <= len(ws)
), m AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM g
), c AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i FROM m WHERE least < doc_id
), k AS (
  SELECT p.doc_id, count(*) AS n_removed FROM p JOIN c USING (doc_id, i) GROUP BY 1
), t AS (
  SELECT p.doc_id, string_agg(p.ws[p.i], ' ' ORDER BY p.i) AS kept FROM p ANTI JOIN c USING (doc_id, i) GROUP BY 1
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
"""
