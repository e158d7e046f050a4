import struct

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pricewright.llm import sentencepiece_codec as sp
from pricewright.llm import token_counts as tc

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a  b   c\n\n d \t e", " lead", "trail  ", "\x1c odd\x85 white　space", "don't we'll 's", "<|endoftext|>", "x <|endoftext|>  y", "日本語 テスト", "\r\n\r\n ", "a  b"]


def test_counts_are_those_of_the_library(make, edge_rows):
    rows = [*edge_rows, *((100 + i, t) for i, t in enumerate(ODD))]
    judge = Tokenizer.from_file(JSON)
    want = sorted(
        ((i, len((t or "").encode()), n := len(judge.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows), key=repr
    )
    assert sorted((tuple(r) for r in tc.token_counts(make(rows), JSON).collect()), key=repr) == want
    assert tc.token_counts(make([]), JSON).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tc.check_tokenizer(public_tokenizers.path("word_bpe_49k.json"))


def test_encoding_edges(make, edge_rows):
    rows = [*edge_rows, *((100 + i, t) for i, t in enumerate(ODD))]
    got = sp.encode_decode(make(rows), MODEL).collect()
    assert len(got) == len(rows) and all(r.parity for r in got)
    marked = {i for i, t in rows if t and "▁" in t}  # the marker itself decodes to a space
    assert {r.doc_id for r in got if not r.round_trip} == marked
    assert sp.encode_decode(make([]), MODEL).count() == 0


def test_encode_then_decode(make):
    rows = [(1, "ein  Test\nmit 😀"), (2, None), (3, "")]
    ids = sp.encode(make(rows), MODEL)
    judge = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert {r.doc_id: r.ids for r in ids.collect()} == {i: judge.encode(t or "") for i, t in rows}
    assert {r.doc_id: r.text for r in sp.decode(ids, MODEL).collect()} == {1: rows[0][1], 2: "", 3: ""}


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def block(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


def unigram_model(own=(), fallback=True, extra_spaces=True):
    """A hand-written unigram model, never trained."""
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)]
    pieces += [(f"<0x{b:02X}>", 0, 6) for b in range(256)] if fallback else []
    pieces += [("▁", -3, 1), ("▁the", -2, 1), ("▁th", -4, 1), ("e", -3.5, 1), ("he", -3, 1), ("t", -4, 1), ("h", -4.2, 1), ("cat", -5, 1), ("ca", -4.5, 1), ("c", -6, 1), ("a", -5.5, 1)]
    pieces += [(p, 0, 4) for p in own]
    data = b"".join(block(1, block(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(k)) for p, s, k in pieces)
    trainer = varint(3 << 3) + varint(1) + varint(35 << 3) + varint(int(fallback))
    normal = varint(3 << 3) + varint(1) + varint(4 << 3) + varint(int(extra_spaces))
    return data + block(2, trainer) + block(3, normal)


UNIGRAM_TEXTS = [
    "the cat", "  the   the cat ", "hehethe", "xyz é", "", "that cat teeth", "the <s> cat", "a</s>", "<0x41> the", "<unk> cat", "the cat\n", " \t the", "\n", "the ▁ cat ▁", "▁",
    "日本 the", "at##the ## cat", "##",
]


@pytest.mark.parametrize(("own", "fallback", "extra_spaces"), [((), True, True), ((), False, True), ((), True, False), (("##",), True, True), (("##",), False, False)])
def test_unigram_is_that_of_the_library(own, fallback, extra_spaces):
    data = unigram_model(own, fallback, extra_spaces)
    judge = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = sp.Codec(sp.parse_model(data))
    for text in UNIGRAM_TEXTS:
        (ids,) = codec.encode([text])
        assert ids == judge.encode(text), text
        assert codec.decode([ids]) == [judge.decode(ids)]


def test_long_texts_are_cut_at_words(monkeypatch):
    monkeypatch.setattr(sp, "PART", 7)
    with open(MODEL, "rb") as file:
        data = file.read()
    for each in (data, unigram_model(), unigram_model(fallback=False)):
        codec, judge = sp.Codec(sp.parse_model(each)), sentencepiece.SentencePieceProcessor(model_proto=each)
        texts = ["the cat that   the cat xyz the é cat é é the", "a" * 50, "", *ODD, *UNIGRAM_TEXTS]
        assert codec.encode(texts) == judge.encode(texts)


def test_codec_is_the_pipeline():
    with open(MODEL, "rb") as file:
        codec = sp.Codec(sp.parse_model(file.read()))
    texts = [*ODD, "", " ", "a" * 300, "▁▁ x▁y  z"]
    assert codec.marks_only
    assert codec.encode(texts) == [e.ids for e in codec.whole.encode_batch(texts, add_special_tokens=False)]
    broken = [[3 + 0xC3, 3 + 0x28], [], [5]]
    assert codec.decode(broken) == codec.whole.decode_batch(broken, skip_special_tokens=False)


def test_decode_leaves_out_unknown_ids(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    (row,) = sp.encode(spark.createDataFrame([(1, "two words")], "doc_id long, text string"), path).collect()
    ids = [(1, [10**6, *row.ids, -1, None]), (2, None), (3, []), (4, [None])]
    got = {r.doc_id: r.text for r in sp.decode(spark.createDataFrame(ids, "doc_id long, ids array<int>"), path).collect()}
    assert got == {1: "two words", 2: "", 3: "", 4: ""}
