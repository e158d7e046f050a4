"""Exact deduplication with mergeable counting quotient filters.

A fingerprint of ``p`` bits splits into a segment (its highest bits), a
quotient and a remainder. Each partition of fingerprints becomes a counting
quotient filter, a table for each segment: a remainder lies in the slot of its
quotient or, where that is taken, in the next free one, so remainders are in
the order of their fingerprints. Three bits a slot tell what was moved
(occupied, continuation, shifted), a fourth marks digits of a count, which
follow their remainder. Decoding a filter gives its fingerprints and counts
back, sorted, so filters merge without loss: sorted remainders join, counts add
up, and the result is a filter again.

As fingerprints spread evenly over segments, so do merged filters over tasks,
also when a third of all rows are one text: a partition sends one remainder for
it. Fingerprints with a count above one route their documents to the byte
verification, which groups whole normalised texts. All others are unique.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm.common import left_join_by_size, load, values
from pricewright.session import materialize

#: Fingerprints that one segment of a merged filter holds on average.
SEGMENT_LOAD = 1 << 14
#: Bits of a fingerprint beyond those that number the rows: one unique row in 2^SPARE is verified for nothing.
SPARE = 12
#: Share of slots that a filter fills at most, before the digits of counts.
LOAD = 0.75
FILTER = "segment int, filter binary"


def pack(numbers: np.ndarray, bits: int) -> bytes:
    """Numbers of ``bits`` bits each, one after the other."""
    spread = (numbers[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8)).tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return (spread.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


@dataclass
class QuotientFilter:
    """A counting quotient filter of fingerprints of ``quotient + remainder`` bits.

    ``meta``: occupied, continuation, shifted and digit bits of each slot. A run
    that reaches the end of the table goes on behind it.
    """

    quotient: int
    remainder: int
    meta: np.ndarray
    slots: np.ndarray

    @classmethod
    def build(cls, prints: np.ndarray, counts: np.ndarray, bits: int) -> QuotientFilter:
        """A filter of sorted, distinct fingerprints and their counts."""
        n = len(prints)
        quotient = min(bits - 1, max(0, math.ceil(math.log2(max(1, n) / LOAD))))
        remainder = bits - quotient
        low = np.uint64(remainder)
        home = (prints >> low).astype(np.int64)
        rest = counts.astype(np.uint64) - np.uint64(1)  # a count of one takes no digit
        digits = np.zeros(n, np.int64)
        left = rest.copy()
        while left.any():
            digits += left > 0
            left = left >> low if remainder < 64 else left * 0
        width = 1 + digits
        ahead = np.cumsum(width) - width
        at = ahead + np.maximum.accumulate(home - ahead) if n else home
        size = max(1 << quotient, int(at[-1] + width[-1]) if n else 0)
        meta, slots = np.zeros((4, size), bool), np.zeros(size, np.uint64)
        meta[0, home] = True
        slots[at] = prints & ((np.uint64(1) << low) - np.uint64(1))
        meta[1, at[1:]] = home[1:] == home[:-1]
        meta[2, at] = at != home
        for step in range(int(digits.max(initial=0))):
            some = digits > step
            place = at[some] + 1 + step
            slots[place] = (rest[some] >> (low * np.uint64(step))) & ((np.uint64(1) << low) - np.uint64(1))
            meta[1:, place] = True
        return cls(quotient, remainder, meta, slots)

    def decode(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted fingerprints, counts)."""
        occupied, continuation, shifted, digit = self.meta
        used = np.flatnonzero((occupied | continuation | shifted) & ~digit)
        runs = np.flatnonzero(occupied).astype(np.uint64)
        run = np.cumsum(~continuation[used]) - 1
        prints = (runs[run] << np.uint64(self.remainder)) | self.slots[used]
        counts = np.ones(len(used), np.uint64)
        places = np.flatnonzero(digit)
        owner = np.searchsorted(used, places, "right") - 1
        step = (places - used[owner] - 1).astype(np.uint64)
        np.add.at(counts, owner, self.slots[places] << (step * np.uint64(self.remainder)))
        return prints, counts.astype(np.int64)

    def serialise(self) -> bytes:
        head = np.array([self.quotient, self.remainder, len(self.slots)], "<u4").tobytes()
        return head + np.packbits(self.meta).tobytes() + pack(self.slots, self.remainder)

    @classmethod
    def parse(cls, data: bytes) -> QuotientFilter:
        quotient, remainder, size = (int(x) for x in np.frombuffer(data, "<u4", 3))
        flags = -(-4 * size // 8)
        meta = np.unpackbits(np.frombuffer(data, np.uint8, flags, 12), count=4 * size).reshape(4, size).astype(bool)
        return cls(quotient, remainder, meta, unpack(data[12 + flags :], remainder, size))

    @classmethod
    def merge(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """One filter with all fingerprints; counts of equal ones add up."""
        bits = filters[0].quotient + filters[0].remainder
        parts = [f.decode() for f in filters]
        return cls.build(*add_up(np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])), bits)


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def add_up(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints and the sums of their counts."""
    if not len(prints):
        return prints, counts
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
    return prints[first], np.add.reduceat(counts, first)


def _build(segments: int, bits: int):
    """A partition's filter, as one serialised table for each segment; ``bits`` are those within a segment."""
    low = np.uint64(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [values(batch, "fp").view(np.uint64) for batch in batches]
        if not sum(map(len, parts)):
            return
        prints = np.concatenate(parts)
        prints, counts = add_up(prints, np.ones(len(prints), np.int64))
        segment = (prints >> low).astype(np.int64) if segments else np.zeros(len(prints), np.int64)
        inside = prints & ((np.uint64(1) << low) - np.uint64(1))
        cut = np.append(np.flatnonzero(np.append(True, segment[1:] != segment[:-1])), len(prints))
        for at in range(0, len(cut) - 1, 1024):
            edges = list(zip(cut[at : at + 1024], cut[at + 1 : at + 1025]))
            tables = [QuotientFilter.build(inside[a:b], counts[a:b], bits).serialise() for a, b in edges]
            yield pa.RecordBatch.from_arrays([pa.array([segment[a] for a, _ in edges], pa.int32()), pa.array(tables, pa.binary())], names=["segment", "filter"])

    return run


def _merge(bits: int):
    def run(rows: pa.Table) -> pa.Table:
        merged = QuotientFilter.merge([QuotientFilter.parse(x) for x in rows.column("filter").to_pylist()])
        prints, counts = merged.decode()
        several = counts > 1
        high = np.uint64(rows.column("segment")[0].as_py()) << np.uint64(bits)
        return pa.table({"fp": (prints[several] | high).view(np.int64), "n": counts[several]})

    return run


def geometry(n_rows: int) -> tuple[int, int]:
    """(bits that number the segments, bits of a fingerprint within one)."""
    whole = min(63, max(8, math.ceil(math.log2(max(2, n_rows)))) + SPARE)
    segments = min(28, max(0, math.ceil(math.log2(max(1, n_rows / SEGMENT_LOAD)))))
    return segments, whole - segments


def repeated_fingerprints(prints: DataFrame, n_rows: int) -> DataFrame:
    """(fp, n): the fingerprints in column ``fp``, of as many bits as ``geometry`` has it, that occur more than once."""
    segments, bits = geometry(n_rows)
    filters = prints.select("fp").where("fp is not null").mapInArrow(_build(segments, bits), FILTER)
    return filters.groupBy("segment").applyInArrow(_merge(bits), "fp long, n long")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are. A null text counts as
    empty, and all empty texts are equal. keep_id is the smallest doc_id of a
    group; rows with a null doc_id count in group_size but are kept only when
    no row of their group has a doc_id. Rows that repeat a doc_id with the same
    text are one document and share its ``kept``. Other columns are ignored.
    """
    texts = docs.select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("hash", F.xxhash64("norm"))
    prints = materialize(texts.select("doc_id", "hash", F.unhex(F.sha2("norm", 256)).alias("sha")), "prints")
    n_rows = prints.count()
    kept_bits = F.shiftrightunsigned("hash", 64 - sum(geometry(n_rows))).alias("fp")
    repeated = materialize(repeated_fingerprints(prints.select(kept_bits), n_rows), "repeated")
    routed = texts.join(repeated.select("fp"), F.shiftrightunsigned("hash", 64 - sum(geometry(n_rows))) == F.col("fp"), "left_semi")
    groups = routed.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    verified = groups.where("group_size > 1").select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    keep = F.coalesce("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")))
    joined = left_join_by_size(prints, materialize(verified, "verified"), "sha", "group_size", n_rows)
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents", "doc_id", "text"))


OP5_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
