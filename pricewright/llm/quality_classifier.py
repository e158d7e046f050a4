"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded
by its content: its words, how far back each of them last stood, and the
three-byte runs of its text pick rows of three embedding tables (words and runs
by hash), whose means add up. Gated attention,
tanh(V h) * sigmoid(U h), weighs the passages of a bag; a logistic unit scores
the weighted passage representation. Only document labels train all of it,
embeddings included. Weights are learned on a sample bounded in documents
(``SAMPLE``) and bytes (``SAMPLE_BYTES``); scoring runs over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewright.llm.common import chunks, load, raw, word_hashes
from pricewright.session import materialize

PASSAGE = 64
#: Labelled documents, and bytes of their texts, that training uses at most.
SAMPLE, SAMPLE_BYTES = 2500, 6 << 20
THRESHOLD = 0.7
#: Rows of the hashed embedding tables and of that of recurrence, and widths of embeddings and gates.
ROWS, GAPS, HIDDEN, GATE = 1 << 13, 8, 8, 4
EPOCHS, BATCH, RATE, DECAY = 8, 50, 0.02, 1e-4
#: Embedding rows that a task adds up at a time.
AT_ONCE = 1 << 19

WHITE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Bags:
    """Passages of some texts: embedding rows of their byte runs, words and recurrences, in order, with how many
    runs and words each passage has."""

    n_passages: np.ndarray
    runs: np.ndarray
    n_runs: np.ndarray
    words: np.ndarray
    gaps: np.ndarray
    n_words: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Bags:
        """A text without words is one passage; bytes belong to the passage of the last word that began."""
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        begins = np.append(0, np.cumsum(sizes))
        white = WHITE[data]
        head = np.zeros(len(data) + 1, bool)
        head[begins] = True
        before = np.append(True, white)[:-1] | head[:-1]
        start = np.flatnonzero(~white & before)
        text_of = np.searchsorted(begins, start, "right") - 1
        n_words = np.bincount(text_of, minlength=len(texts))
        n_passages = np.maximum(1, -(-n_words // PASSAGE))
        base, first = np.append(0, np.cumsum(n_passages)), np.append(0, np.cumsum(n_words))
        passage = base[text_of] + (np.arange(len(start)) - first[text_of]) // PASSAGE
        total = int(base[-1])
        word = np.cumsum(np.bincount(start, minlength=len(data))[: len(data)]) - 1
        of_text = np.repeat(np.arange(len(texts)), sizes)
        of_byte = base[of_text]
        begun = word >= first[of_text]
        of_byte[begun] = passage[word[begun]]
        code = data.astype(np.uint32)
        code = (code[:-2] << np.uint32(16)) | (code[1:-1] << np.uint32(8)) | code[2:] if len(data) > 2 else code[:0]
        inside = of_text[2:] == of_text[:-2] if len(data) > 2 else np.zeros(0, bool)
        rows = ((code[inside] * np.uint32(2654435761)) >> np.uint32(19)).astype(np.uint16)
        hashes = np.concatenate([np.empty(0, np.uint64), *(word_hashes(t) for t in texts)])
        order = np.lexsort((hashes, passage))
        again = np.append(False, (hashes[order][1:] == hashes[order][:-1]) & (passage[order][1:] == passage[order][:-1]))[: len(order)]
        gaps = np.zeros(len(order), np.uint8)  # 0 for a word that is new to its passage, else the magnitude of the distance
        gaps[order[again]] = np.minimum(GAPS - 1, 1 + np.log2(order[again] - order[np.flatnonzero(again) - 1]).astype(np.int64))
        return cls(
            n_passages, rows, np.bincount(of_byte[: len(inside)][inside], minlength=total),
            (hashes & np.uint64(ROWS - 1)).astype(np.uint16), gaps, np.bincount(passage, minlength=total),
        )

    def pack(self) -> bytes:
        """Of one text."""
        head = np.concatenate(([len(self.n_runs)], self.n_runs, self.n_words)).astype("<u4")
        return head.tobytes() + self.runs.astype("<u2").tobytes() + self.words.astype("<u2").tobytes() + self.gaps.tobytes()

    @classmethod
    def unpack(cls, packed: list[bytes]) -> Bags:
        n, runs, n_runs, words, gaps, n_words = [], [], [], [], [], []
        for data in packed:
            (p,) = np.frombuffer(data, "<u4", 1)
            sizes = np.frombuffer(data, "<u4", 2 * p, 4).astype(np.int64)
            a, b = int(sizes[:p].sum()), int(sizes[p:].sum())
            rows = np.frombuffer(data, "<u2", a + b, 4 + 8 * int(p))
            n.append(p), n_runs.append(sizes[:p]), n_words.append(sizes[p:]), runs.append(rows[:a]), words.append(rows[a:])
            gaps.append(np.frombuffer(data, np.uint8, b, len(data) - b))
        return cls(np.array(n, np.int64), *(np.concatenate(x) for x in (runs, n_runs, words, gaps, n_words)))


def mean_rows(table: np.ndarray, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The mean table row of each passage; zeros for one without any."""
    out = np.zeros((len(n), table.shape[1]), table.dtype)
    of = np.repeat(np.arange(len(n)), n)
    for at in range(0, len(rows), AT_ONCE):
        each = of[at : at + AT_ONCE]
        starts = np.flatnonzero(np.append(True, each[1:] != each[:-1]))
        out[each[starts]] += np.add.reduceat(table[rows[at : at + AT_ONCE]], starts)
    return out / np.maximum(1, n)[:, None].astype(table.dtype)


Weights = dict[str, np.ndarray]
SHAPES = {"R": (ROWS, HIDDEN), "W": (ROWS, HIDDEN), "G": (GAPS, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "b": (1,)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(w: Weights, bags: Bags) -> tuple:
    """(scores, then what the gradients need)."""
    n = bags.n_passages
    starts = np.append(0, np.cumsum(n))[:-1]
    x = mean_rows(w["R"], bags.runs, bags.n_runs) + mean_rows(w["W"], bags.words, bags.n_words) + mean_rows(w["G"], bags.gaps, bags.n_words)
    h = np.tanh(x + w["e"])
    v, u = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    s = (v * u) @ w["a"]
    s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), n))
    a = s / np.repeat(np.add.reduceat(s, starts), n)
    z = np.add.reduceat(a[:, None] * h, starts)
    return _sigmoid(z @ w["c"] + w["b"]), h, v, u, a, z, starts


def _scatter(rows: np.ndarray, n: np.ndarray, grad: np.ndarray, size: int = ROWS) -> np.ndarray:
    each = np.repeat(grad / np.maximum(1, n)[:, None], n, 0)
    return np.stack([np.bincount(rows, each[:, i], size) for i in range(grad.shape[1])], 1)


def gradients(w: Weights, bags: Bags, y: np.ndarray) -> Weights:
    """Of the mean log loss."""
    n = bags.n_passages
    p, h, v, u, a, z, starts = forward(w, bags)
    d = (p - y) / len(y)
    da = (np.repeat(d[:, None] * w["c"], n, 0) * h).sum(1)
    ds = a * (da - np.repeat(np.add.reduceat(a * da, starts), n))
    dg = ds[:, None] * w["a"]
    dv, du = dg * u * (1 - v**2), dg * v * u * (1 - u)
    dx = (a[:, None] * np.repeat(d[:, None] * w["c"], n, 0) + dv @ w["V"].T + du @ w["U"].T) * (1 - h**2)
    return {
        "R": _scatter(bags.runs, bags.n_runs, dx), "W": _scatter(bags.words, bags.n_words, dx),
        "G": _scatter(bags.gaps, bags.n_words, dx, GAPS), "e": dx.sum(0),
        "V": h.T @ dv, "U": h.T @ du, "a": (v * u).T @ ds, "c": z.T @ d, "b": np.array([d.sum()]),
    }


def train(packed: list[bytes], y: np.ndarray, epochs: int = EPOCHS) -> Weights:
    """Fit the weights by Adam over small batches; equal data give equal weights. Without both labels the score is their share."""
    draw = np.random.Generator(np.random.PCG64(7))
    w = {k: draw.normal(0, 0.3, s).astype(np.float32) for k, s in SHAPES.items()}
    rate = float(y.mean())
    w["b"][:] = np.log(rate / (1 - rate)) if 0 < rate < 1 else 30 if rate else -30
    if not 0 < rate < 1:
        w["c"][:] = 0
        return w
    m, q = ({k: np.zeros(s, np.float32) for k, s in SHAPES.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = draw.permutation(len(y))
        for at in range(0, len(y), BATCH):
            some = order[at : at + BATCH]
            step += 1
            for k, g in gradients(w, Bags.unpack([packed[i] for i in some]), y[some]).items():
                g = (g + DECAY * w[k] * (k not in ("b", "e"))).astype(np.float32)
                m[k] = 0.9 * m[k] + 0.1 * g
                q[k] = 0.999 * q[k] + 0.001 * g * g
                w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.999**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            texts = raw(part)
            columns = [part.column("quality"), part.column("place"), pa.array(map(len, texts), pa.int64()), pa.array([Bags.of([t]).pack() for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["quality", "place", "n_bytes", "bag"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Weights | None:
    """Train on at most ``sample`` labelled documents that aren't held out; None without any.

    The sample is the first ones by a hash of doc_id, as long as their texts
    fit into ``sample_bytes``. Null labels and ids are left out; of several
    labels or texts of a doc_id the smallest is taken.
    """
    usable = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = chosen.withColumn("place", F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")))  # of the sample alone
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    bags = materialize(some.select("quality", "place", "text").mapInArrow(_bags, "quality int, place int, n_bytes long, bag binary"), "bags")
    one = bags.groupBy("place").agg(F.min(F.struct("n_bytes", "bag", "quality")).alias("r")).select("place", "r.*")
    held = F.sum("n_bytes").over(Window.orderBy("place"))  # at most `sample` rows
    rows = one.withColumn("held", held).where(F.col("held") <= sample_bytes).orderBy("place").toArrow()
    if not rows.num_rows:
        return None
    return train(rows.column("bag").to_pylist(), np.array([q > 0 for q in rows.column("quality").to_pylist()], np.float64))


def _score(w: Weights | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                bags = Bags.of(raw(part))
                scores = forward(w, bags)[0] if w else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(scores.astype(np.float64)), pa.array(bags.n_passages, pa.int64())], names=["doc_id", "score", "n_passages"]
                )

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted, n_passages.

    Null and empty texts are one empty passage and get its score; repeated rows
    score alike; a null doc_id is scored and not held out. Without usable
    labels every score is 0.5.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, score double, n_passages long"
    scored = docs.select("doc_id", "text").mapInArrow(_score(fit(docs, labels, sample)), schema)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages"
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "labels", "doc_id", "quality")
    return quality_scores(docs, labels)
