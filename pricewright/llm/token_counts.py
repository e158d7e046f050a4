"""Token counts without token ids.

A byte-level BPE tokenizer splits texts before it merges bytes, and never
merges over white space that begins a word. So the pieces of a text are those
of its pre-tokens (a word with the white space before it), whatever stands
around them, and each distinct pre-token needs counting once.

Blocks of documents are written as their distinct pre-tokens (the dictionary)
and, per document, how often each occurs (frequencies, as packed indexes into
the dictionary). Only dictionaries travel, packed by hash bucket: where all of
a bucket meets, each distinct pre-token is encoded once; the numbers return to
their blocks and are joined to the frequencies there and summed. A pre-token
is sent once a block, however frequent, and buckets grow in number with the
documents, not in size.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm.common import chunks, load
from pricewright.session import materialize

LIMIT = 1024
#: Bytes of text in one block.
BLOCK_BYTES = 48 << 20
#: Documents for each hash bucket of pre-tokens, and the fewest buckets.
BUCKET_DOCS, BUCKETS = 2000, 64
BLOCKS = "block long, bucket int, base int, words binary, doc_ids array<long>, sizes array<long>, distinct_words array<int>, packed binary"

PRE_TOKEN = re.compile(r"\s*\S+|\s+")
#: Characters on which regular-expression libraries differ in what is white space.
UNCERTAIN = re.compile("[\x1c-\x1f\x85᠎​﻿]")


def _pack(index: np.ndarray, times: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(
        np.stack((index, times)).astype("<u4").view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1).tobytes()
    )


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    both = np.ascontiguousarray(flat.reshape(2, 4, -1).transpose(0, 2, 1)).view("<u4")[..., 0]
    return both[0].astype(np.int64), both[1].astype(np.int64)


def _pack_words(words: list[str]) -> bytes:
    data = [w.encode() for w in words]
    lengths = np.fromiter(map(len, data), np.uint32, len(data)).astype("<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(len(data).to_bytes(4, "little") + lengths + b"".join(data))


def _unpack_words(packed: bytes) -> pa.Array:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    ends = np.append(0, np.cumsum(np.frombuffer(raw, "<u4", n, 4))).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw[4 + 4 * n :]))


def _blocks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=BLOCK_BYTES):
                yield pa.RecordBatch.from_pylist(_block(part, buckets), schema=_ARROW)

    return run


def _block(part: pa.RecordBatch, buckets: int) -> list[dict]:
    """The rows of one block: its frequencies, and its dictionary by bucket."""
    block = int.from_bytes(os.urandom(8), "little", signed=True)
    vocabulary: defaultdict = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    index, times, distinct, sizes = [], [], [], []
    for text in part.column("text").to_pylist():
        text = text or ""
        found = Counter([text] if UNCERTAIN.search(text) else PRE_TOKEN.findall(text))
        found.pop("", None)
        index.append(np.fromiter(map(vocabulary.__getitem__, found), np.uint32, len(found)))
        times.append(np.fromiter(found.values(), np.uint32, len(found)))
        distinct.append(len(found))
        sizes.append(len(text) if text.isascii() else len(text.encode()))
    held = list(vocabulary)
    bucket = np.fromiter(map(xxhash.xxh3_64_intdigest, held), np.uint64, len(held)).astype(np.int64) & (buckets - 1)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(held), np.uint32)
    rank[order] = np.arange(len(held), dtype=np.uint32)
    index = [rank[i] for i in index]
    by_rank = [np.argsort(i) for i in index]
    steps = [np.diff(i[o], prepend=np.uint32(0)) for i, o in zip(index, by_rank)]
    rows = [
        {
            "block": block,
            "doc_ids": part.column("doc_id").to_pylist(),
            "sizes": sizes,
            "distinct_words": distinct,
            "packed": _pack(np.concatenate(steps), np.concatenate([t[o] for t, o in zip(times, by_rank)])),
        }
    ]
    cut = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(held))
    for base, end in zip(cut[:-1], cut[1:]):
        words = [held[i] for i in order[base:end]]
        rows.append({"block": block, "bucket": int(bucket[order[base]]), "base": int(base), "words": _pack_words(words)})
    return rows


_ARROW = pa.schema(
    [
        ("block", pa.int64()),
        ("bucket", pa.int32()),
        ("base", pa.int32()),
        ("words", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())),
        ("distinct_words", pa.list_(pa.int32())),
        ("packed", pa.binary()),
    ]
)


def check_tokenizer(path: str) -> None:
    """Raise ValueError unless pre-tokens can be counted on their own."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    pre = made.get("pre_tokenizer") or {}
    if made.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
        raise ValueError("only byte-level tokenizers without normaliser or prefix space are counted by pre-token")
    for token in made.get("added_tokens", []):
        if token["lstrip"] or token["rstrip"] or token["single_word"] or re.search(r"\s", token["content"]):
            raise ValueError("added tokens that look at or hold white space are not supported")


def _count(path: str):
    """Rows sorted by bucket get the pieces of their words; a bucket's distinct words are encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        now, known = None, {}
        for batch in batches:
            out = []
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist()):
                if bucket != now:
                    now, known = bucket, {}
                words = _unpack_words(packed).to_pylist()
                new = [w for w in words if w not in known]
                known.update(zip(new, map(len, tokenizer.encode_batch_fast(new, add_special_tokens=False))))
                n = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
                out.append(zstandard.ZstdCompressor(level=1).compress(n.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("home"), batch.column("base"), pa.array(out, pa.binary())], names=["home", "base", "n"])

    return run


def _sum(rows: pa.Table, counts: pa.Table) -> pa.Table:
    block = rows.to_pylist()[0]
    ordered = sorted(zip(counts.column("base").to_pylist(), counts.column("n").to_pylist()))
    each = [np.frombuffer(zstandard.ZstdDecompressor().decompress(n), "<u4") for _, n in ordered]
    pieces = np.concatenate(each).astype(np.int64) if each else np.empty(0, np.int64)
    distinct = np.array(block["distinct_words"], np.int64)
    ends = np.cumsum(distinct)
    steps, times = _unpack(block["packed"])
    index = np.cumsum(steps)
    before = np.append(0, index)[ends - distinct]
    index -= np.repeat(before, distinct)
    running = np.append(0, np.cumsum(pieces[index] * times)) if len(index) else np.zeros(1, np.int64)
    return pa.table(
        {
            "doc_id": pa.array(block["doc_ids"], pa.int64()),
            "n_bytes": pa.array(block["sizes"], pa.int64()),
            "n_tokens": pa.array(running[ends] - running[ends - distinct], pa.int64()),
        }
    )


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    ``path`` is a tokenizers .json file that every executor can read. Special
    strings inside texts count as the library's default has it. Null texts
    count as empty, with no tokens; repeated rows are counted each. A text
    with characters whose class differs between libraries is counted whole.
    """
    check_tokenizer(path)
    buckets = 1 << max(BUCKETS, docs.count() // BUCKET_DOCS).bit_length() - 1
    blocks = materialize(docs.select("doc_id", "text").mapInArrow(_blocks(buckets), BLOCKS), "blocks")
    entries = blocks.where("words is not null").select(F.col("block").alias("home"), "bucket", "base", "words")
    counted = entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count(path), "home long, base int, n binary")
    frequencies = blocks.where("packed is not null").select("block", "doc_ids", "sizes", "distinct_words", "packed")
    summed = frequencies.groupBy("block").cogroup(counted.groupBy("home"))
    out = summed.applyInArrow(_sum, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(load(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
