"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is read field by field and rebuilt as a tokenizers pipeline:
its normaliser (character map, extra spaces, dummy prefix), the metaspace
marker, unigram scores or the merges that BPE scores imply, and byte fallback.
Batches are encoded on several threads. Every encoding can be held against the
sentencepiece library (``parity``) and against its own text (``round_trip``).
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pricewright.llm.common import chunks, load

SPACE = "▁"
# Fixed values of the public model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

THREADS = 2
#: Bytes of text encoded at a time; an encoding takes a hundred times the memory of its text.
BATCH_BYTES = 1 << 18
#: Characters after which a text is cut at the next word.
PART = 1 << 16
#: Fixed value: how the library shows an unknown piece.
UNKNOWN_SHOWN = " \u2047 "


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    space_as_suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            if wire == 2:
                size, at = _varint(data, at)
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
            else:
                raise ValueError(f"wire type {wire} is not expected in a model")
            value, at = data[at : at + size], at + size
        yield number, value


def parse_model(data: bytes) -> Model:
    """The parts of a serialised model that encoding and decoding need."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    (score,) = struct.unpack("<f", v)
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.kind = v
                elif n == 24:
                    model.space_as_suffix = bool(v)
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.remove_extra_spaces = bool(v)
                elif n == 5:
                    model.escape_spaces = bool(v)
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """The merges that BPE scores imply: all splits of a piece into two pieces, best score first."""
    scores = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
    number = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    found = []
    for piece, score in scores.items():
        for at in range(1, len(piece)):
            left, right = piece[:at], piece[at:]
            if left in scores and right in scores:
                found.append((-score, number[piece], number[left], number[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def build_tokenizer(model: Model):
    """The tokenizers pipeline of a model.

    Only pieces that a text may spell are within its reach: byte, control and
    unused pieces keep their ids under names with a plain space, which no
    normalised text has.
    """
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if model.kind not in (UNIGRAM, BPE) or model.space_as_suffix or not model.escape_spaces:
        raise ValueError("only unigram and BPE models with leading, escaped spaces are supported")
    unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), 0)
    named = [p if kind in (NORMAL, USER_DEFINED) else f" {i}" for i, (p, _, kind) in enumerate(model.pieces)]
    own = [(p, s) for p, s, kind in model.pieces if kind == USER_DEFINED]
    if model.kind == UNIGRAM:
        normal = [s for _, s, kind in model.pieces if kind == NORMAL]
        best, least = max(normal, default=0.0), min(normal, default=0.0)
        # the scores that the library gives to pieces of the user
        scores = [len(p) * best - 0.1 if kind == USER_DEFINED else s if kind == NORMAL else best for p, s, kind in model.pieces]
        if min(scores, default=0.0) < least:
            raise ValueError("user-defined pieces that are less likely than all others are not supported")
        engine = models.Unigram(list(zip(named, scores)), unk_id=unknown, byte_fallback=False)
    else:
        if any(kind == UNUSED for *_, kind in model.pieces):
            raise ValueError("BPE models with unused pieces are not supported")
        spelled = [p if kind == BYTE else n for n, (p, _, kind) in zip(named, model.pieces)]  # merges can't reach byte pieces
        spelled[unknown] = model.pieces[unknown][0]
        engine = models.BPE({p: i for i, p in enumerate(spelled)}, merges(model), unk_token=spelled[unknown], fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(engine)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if any(normalizers.Sequence(steps).normalize_str(p) != p for p, _ in own):
        raise ValueError("user-defined pieces that the character map changes are not supported")
    if model.remove_extra_spaces:
        # spaces only: tabs and line ends are the character map's business
        steps += [normalizers.Replace(Regex(r"\A +"), ""), normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex(rf"[ {SPACE}]+\z"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
    if model.kind == BPE:
        tokenizer.add_tokens([AddedToken(p, normalized=False) for p, _ in own])
    strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return tokenizer


class Codec:
    """Encoding and decoding of batches with the pipeline of a model.

    Texts are normalised as wholes before the library splits them (one that
    only marks spaces needs no library), and long ones are cut before a space
    mark where no piece of the model reaches over it. Unigram byte fallback
    spells what the library leaves unknown. Decoding joins the bytes of the
    pieces, and leaves what isn't valid UTF-8 to the library.
    """

    def __init__(self, model: Model):
        self.model, self.whole, self.bare = model, build_tokenizer(model), build_tokenizer(model)
        self.marks_only = not model.charsmap and not model.remove_extra_spaces
        self.bare.normalizer = None
        reachable = [p for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED)]
        self.cuts = SPACE in reachable and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in reachable)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        self.unknown = next((i for i, (*_, kind) in enumerate(model.pieces) if kind == UNKNOWN), 0)
        self.spells = model.kind == UNIGRAM and model.byte_fallback and len(self.byte_ids) == 256
        shown = {BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: UNKNOWN_SHOWN.encode()}
        self.bytes = [shown.get(kind, lambda p: p.replace(SPACE, " ").encode())(p) for p, _, kind in model.pieces]

    def _normalised(self, text: str) -> str:
        if not self.marks_only:
            return self.whole.normalizer.normalize_str(text)
        return (SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE) if text else ""

    def _parts(self, text: str) -> list[str]:
        parts, at = [], 0
        while self.cuts and len(text) - at > PART:
            cut = at + PART
            while (cut := text.find(SPACE, cut)) > 0 and text[cut - 1] == SPACE:
                cut += 1
            if cut < 0:
                break
            parts.append(text[at:cut])
            at = cut
        return [*parts, text[at:]]

    def _spelled(self, encoding) -> list[int]:
        ids = []
        for i, token in zip(encoding.ids, encoding.tokens):
            ids += [self.byte_ids[b] for b in token.encode()] if i == self.unknown else [i]
        return ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        parts = [self._parts(self._normalised(t)) for t in texts]
        # the fast way doesn't tell what an unknown piece stands for
        encode = self.bare.encode_batch if self.spells else self.bare.encode_batch_fast
        made = encode([p for each in parts for p in each], add_special_tokens=False)
        ids = (self._spelled(e) if self.spells and self.unknown in e.ids else e.ids for e in made)
        return [next(ids) if len(each) == 1 else [i for _ in each for i in next(ids)] for each in parts]

    def decode(self, ids: list[list[int]]) -> list[str]:
        out = []
        for each in ids:
            data = b"".join(map(self.bytes.__getitem__, each))
            try:
                out.append(data[self.model.dummy_prefix and data[:1] == b" " :].decode())
            except UnicodeDecodeError:
                out.append(self.whole.decode(each, skip_special_tokens=False))
        return out


def _open(path: str, threads: int) -> Codec:
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    with open(path, "rb") as file:
        return Codec(parse_model(file.read()))


def _encode(path: str, threads: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _open(path, threads)
        for batch in batches:
            for part in chunks(batch, limit=BATCH_BYTES):
                ids = codec.encode([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str, threads: int = THREADS) -> DataFrame:
    """doc_id and ids array<int>; null and empty texts have no ids."""
    return docs.select("doc_id", "text").mapInArrow(_encode(path, threads), f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def _decode(path: str, threads: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _open(path, threads)
        for batch in batches:
            known = range(len(codec.bytes))
            texts = codec.decode([[x for x in i or [] if x in known] for i in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str, threads: int = THREADS) -> DataFrame:
    """doc_id and text of rows with ids; null ids are an empty text, and ids that the vocabulary lacks are left out."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path, threads), f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def _report(path: str, threads: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        codec = _open(path, threads)
        judge = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            for part in chunks(batch, limit=BATCH_BYTES):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = codec.encode(texts)
                back = codec.decode(ids)
                judged = judge.encode(texts, num_threads=threads)
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "parity", *["ids"] * with_ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(map(len, ids), pa.int64()),
                        pa.array([hashlib.sha256(np.array(i, "<i4").tobytes()).hexdigest() for i in ids]),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                        pa.array([a == b for a, b in zip(back, texts)]),
                        pa.array([a == b for a, b in zip(ids, judged)]),
                        *[pa.array(ids, pa.list_(pa.int32()))] * with_ids,
                    ],
                    names=names,
                )

    return run


def encode_decode(docs: DataFrame, path: str, threads: int = THREADS, with_ids: bool = False) -> DataFrame:
    """One row per document: what encoding and decoding gives, each verified.

    doc_id, n_tokens, ids_sha256 (of little-endian int32 ids), decoded_sha256,
    round_trip (the decoded text is the text), parity (the ids are those of
    the sentencepiece library) and, ``with_ids``, the ids. Null texts count as empty; repeated rows give a
    row each; null doc_ids and other columns don't matter.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean, parity boolean"
    return docs.select("doc_id", "text").mapInArrow(_report(path, threads, with_ids), schema + ", ids array<int>" * with_ids)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(load(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
