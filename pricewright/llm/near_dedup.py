"""Near-duplicate detection: consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of words are counted over all documents, by hashed
   word; the table has a fixed size, so tasks may hold it. A shingle of five
   words weighs its count times a damped mean of its words' inverse document
   frequencies (half of the weight is the same for all, or a large group of
   near copies would, by being large, make its own shingles weightless).
2. Each document gets ``BANDS * ROWS`` improved consistent weighted samples.
   Samples of two documents agree as often as their weighted Jaccard
   similarity. Documents that agree on a band are candidates.
3. Documents with the same words are one node. In a bucket every node is
   paired with the smallest one. Pairs whose samples agree often enough are
   verified by weighted Jaccard similarity over whole texts.
4. A bucket whose nodes the verified links don't join stays open: its texts meet
   in tiles, where pairs of different components are verified and united at
   once. A tile returns fewer links than it has nodes, however alike they are. No
   pair that shares a band is left out, unless links already join it or its
   samples rule it out.
5. Components of the verified links are classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm.common import ALNUM, chunks, gram_hashes, left_join_by_size, load, mix, raw, release, word_hashes
from pricewright.operators.graph import components
from pricewright.session import materialize

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 4
#: Hashed words in the table of document frequencies.
BUCKETS = 1 << 18
#: Rows of the tables of random numbers; three indexes of a shingle make its draw.
POOL = 1 << 14
#: Share of a weight that doesn't depend on document frequency.
FLOOR = 0.5
SEED = 20_240_601
#: Nodes of a bucket in one group, and bytes of their texts; a tile pairs two groups, so a task holds a part of a large bucket.
GROUP = 4096
GROUP_BYTES = 2 << 20
#: Candidates of a node in a tile from which their overlaps are counted by postings.
CROWD = 16

SIGNATURES = "doc_id long, n_bytes long, whole binary, signature binary, bands array<long>"


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held, docs = np.zeros(BUCKETS, np.int64), 0
        for part in chunks(batch):
            for text in raw(part):
                own = np.unique(word_hashes(text, ALNUM) & np.uint64(BUCKETS - 1)).astype(np.int64)
                held[own] += 1
                docs += 1
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, -1), pa.int32()), pa.array(np.append(held[seen], docs), pa.int64())], names=["bucket", "n"]
        )


def idf_table(docs: DataFrame) -> np.ndarray:
    """Damped inverse document frequency by hashed word, from ``FLOOR`` to 1; a table of ``BUCKETS`` entries."""
    rows = docs.select("text").mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    total = max(2, int(n[bucket < 0].sum()))
    count = np.ones(BUCKETS)
    count[bucket[bucket >= 0]] = n[bucket >= 0]
    return (FLOOR + (1 - FLOOR) * np.log(total / np.minimum(count, total)) / np.log(total)).astype(np.float32)


def weighted_shingles(text: bytes, idf: np.ndarray, counted: bool = False) -> tuple[np.ndarray, ...]:
    """Sorted shingle hashes and their TF-IDF weights (``counted``: and their counts); a text of fewer words is one shingle."""
    hashes = word_hashes(text, ALNUM)
    if not len(hashes):
        return (np.empty(0, np.uint64), np.empty(0, np.float32), np.empty(0, np.int64))[: 2 + counted]
    wide = min(SHINGLE, len(hashes))
    grams = gram_hashes(hashes, wide, wide)
    by_word = idf[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]
    running = np.append(0, np.cumsum(by_word, dtype=np.float64))
    mean = (running[wide:] - running[:-wide]) / wide
    shingles, first, times = np.unique(grams, return_index=True, return_counts=True)
    weights = (times * mean[first]).astype(np.float32)
    return (shingles, weights, times)[: 2 + counted]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum())
    union = float(a[1].sum()) + float(b[1].sum()) - shared
    return shared / union if union else 0.0


class Sampler:
    """Improved consistent weighted sampling with ``n`` samples."""

    def __init__(self, n: int):
        draw = np.random.Generator(np.random.PCG64(SEED))
        self.r = draw.gamma(2, 1, (POOL, n)).astype(np.float32)
        self.log_c = np.log(draw.gamma(2, 1, (POOL, n))).astype(np.float32)
        self.beta = draw.random((POOL, n), np.float32)

    def __call__(self, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each sample a 64-bit mark of the shingle and the quantised weight drawn."""
        n = self.r.shape[1]
        best, mark = np.full(n, np.inf, np.float32), np.zeros(n, np.uint64)
        each = np.arange(n)
        for at in range(0, len(shingles), 1024):
            part = shingles[at : at + 1024]
            low = np.uint64(POOL - 1)
            r = self.r[(part & low).astype(np.int64)]
            beta = self.beta[((part >> np.uint64(14)) & low).astype(np.int64)]
            t = np.log(weights[at : at + 1024])[:, None] / r
            t += beta
            np.floor(t, out=t)
            log_a = t - beta
            log_a += 1
            log_a *= r
            np.subtract(self.log_c[((part >> np.uint64(28)) & low).astype(np.int64)], log_a, out=log_a)
            pick = log_a.argmin(0)
            least = log_a[pick, each]
            better = least < best
            best[better] = least[better]
            level = t[pick, each].astype(np.int64).view(np.uint64)
            mark[better] = mix(part[pick] + level * np.uint64(0x9E3779B97F4A7C15))[better]
        return mark


def _sign(idf: np.ndarray, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(bands * rows)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        power = mix(np.arange(101, 101 + rows, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            for part in chunks(batch):
                whole, signature, keys, sizes = [], [], [], []
                for text in raw(part):
                    sizes.append(len(text))
                    shingles, weights = weighted_shingles(text, idf)
                    if not len(shingles):
                        whole.append(None), signature.append(None), keys.append(None)
                        continue
                    whole.append(xxhash.xxh3_128_digest(b" ".join(text.translate(ALNUM).split())))
                    marks = sampler(shingles, weights)
                    signature.append((marks >> np.uint64(48)).astype("<u2").tobytes())
                    keys.append(mix((marks.reshape(bands, rows) * power).sum(1, dtype=np.uint64) + salt).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(sizes, pa.int64()),
                        pa.array(whole, pa.binary()),
                        pa.array(signature, pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_bytes", "whole", "signature", "bands"],
                )

    return run


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a = np.frombuffer(b"".join(batch.column("sig_u").to_pylist()), "<u2").reshape(batch.num_rows, -1)
            b = np.frombuffer(b"".join(batch.column("sig_v").to_pylist()), "<u2").reshape(batch.num_rows, -1)
            same = (a == b).mean(1, dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(same)], names=["u", "v", "agree"])


def _star(rows: DataFrame) -> DataFrame:
    """(bucket, u, v): every node of a bucket with the smallest node of it."""
    least = rows.groupBy("bucket").agg(F.min("node").alias("v"), F.max("node").alias("most")).where("v < most").drop("most")
    return rows.join(least, "bucket").where("node <> v").select("bucket", F.col("node").alias("u"), "v")


def _agreement(star: DataFrame, nodes: DataFrame) -> DataFrame:
    pairs = star.select("u", "v").distinct()
    for end in ("u", "v"):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("signature").alias(f"sig_{end}")), end)
    return pairs.select("u", "v", "sig_u", "sig_v").mapInArrow(_agree, "u long, v long, agree double")


def _verify(idf: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            held: tuple = (None, None)
            for part in chunks(batch, "text_u"):
                for u, v in zip(raw(part, "text_u"), raw(part, "text_v")):
                    if held[0] != v:
                        held = v, weighted_shingles(v, idf)
                    same.append(weighted_jaccard(weighted_shingles(u, idf), held[1]))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(same, pa.float64())], names=["u", "v", "similarity"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    asked = materialize(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "asked")
    texts = texts.join(asked, "doc_id", "left_semi")  # few of the texts are shuffled
    for end in ("u", "v"):
        pairs = pairs.join(texts.select(F.col("doc_id").alias(end), F.col("text").alias(f"text_{end}")), end)
    checked = pairs.select("u", "v", "text_u", "text_v").mapInArrow(_verify(idf, threshold), "u long, v long, similarity double")
    return checked.where(F.col("similarity") >= threshold)


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, node, component, n, n_bytes): the buckets that hold more than one component, with their number of nodes and bytes."""
    known = rows.join(labels, "node", "left").select("bucket", "node", "n_bytes", F.coalesce("component", "node").alias("component"))
    sizes = known.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bytes"), F.min("component").alias("least"), F.max("component").alias("most")
    )
    sizes = materialize(sizes.where("least < most").select("bucket", "n", F.col("bytes").alias("n_bytes")), "open-sizes")
    return materialize(known.drop("n_bytes").join(sizes, "bucket"), "open")


def _tiles(held: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(bucket, tile, side, node, component, signature, text), sorted by tile: any two nodes of a bucket meet in a tile."""
    groups = F.greatest(F.ceil(F.col("n") / GROUP), F.ceil(F.col("n_bytes") / GROUP_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("node"), groups).cast("int")
    meet = F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    signed = held.join(nodes.select("node", "signature"), "node").join(texts.select(F.col("doc_id").alias("node"), "text"), "node")
    dealt = signed.withColumn("groups", groups).withColumn("side", own).withColumn("other", meet)
    dealt = dealt.withColumn("tile", F.least("side", "other") * F.col("groups") + F.greatest("side", "other"))
    rows = dealt.select("bucket", "tile", "side", "node", "component", "signature", "text")
    return rows.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", "component", "node")


class _Overlaps:
    """Weights that texts share, by postings of their shingles; a shingle that comes several times is as many features."""

    def __init__(self, texts: list[bytes], idf: np.ndarray):
        found = [self._features(t, idf) for t in texts]
        self.total = np.array([float(w.sum()) for _, w in found])
        node = np.repeat(np.arange(len(texts)), [len(f) for f, _ in found])
        _, feature = np.unique(np.concatenate([f for f, _ in found]), return_inverse=True)
        weight = np.concatenate([w for _, w in found])
        order = np.argsort(feature, kind="stable")
        self.node, self.weight = node[order], weight[order]
        self.starts = np.append(0, np.cumsum(np.bincount(feature)))
        self.own = np.split(feature, np.cumsum([len(f) for f, _ in found])[:-1])

    @staticmethod
    def _features(text: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shingles, weights, times = weighted_shingles(text, idf, counted=True)
        copy = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        return mix(np.repeat(shingles, times) + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.repeat(weights / times, times)

    def similarity(self, i: int) -> np.ndarray:
        """Weighted Jaccard similarity of text ``i`` with every text."""
        at = [slice(self.starts[f], self.starts[f + 1]) for f in self.own[i]]
        shared = np.bincount(np.concatenate([self.node[x] for x in at]), np.concatenate([self.weight[x] for x in at]), len(self.total))
        return shared / np.maximum(self.total + self.total[i] - shared, 1e-9)


def _links(idf: np.ndarray, least: float, threshold: float):
    """Verified links of each tile, as few as join what it can join: texts are compared and united here, and no other pair leaves the task."""

    def links(side: np.ndarray, node: np.ndarray, component: np.ndarray, sig: np.ndarray, texts: list[bytes]) -> list[tuple[int, int, float]]:
        across = side.min() < side.max()  # a tile of two groups: pairs within one have their own tile
        _, of = np.unique(component, return_inverse=True)
        parent = list(range(int(of.max()) + 1))
        held: dict[int, tuple] = {}
        overlaps, out = None, []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def shingles(i: int) -> tuple:
            if i not in held:
                held[i] = weighted_shingles(texts[i], idf)
            return held[i]

        for i in range(len(node)):
            agree = (sig[i] == sig[i + 1 :]).mean(1, dtype=np.float32)
            agree[of[i + 1 :] == of[i]] = -1
            if across:
                agree[side[i + 1 :] == side[i]] = -1
            near = np.flatnonzero(agree >= least)
            near = near[np.argsort(-agree[near], kind="stable")] + i + 1
            near = np.array([j for j in near.tolist() if root(int(of[j])) != root(int(of[i]))], np.int64)
            if len(near) > CROWD:
                overlaps = overlaps or _Overlaps(texts, idf)
                same = overlaps.similarity(i)[near]
                near = near[same >= threshold - 1e-3]
            for j in near.tolist():
                a, b = root(int(of[i])), root(int(of[j]))
                if a != b and (same := weighted_jaccard(shingles(i), shingles(j))) >= threshold:
                    parent[max(a, b)] = min(a, b)
                    out.append((max(int(node[i]), int(node[j])), min(int(node[i]), int(node[j])), same))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def found(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(rest)
            column = {name: table.column(name).to_numpy() for name in ("bucket", "tile", "side", "node", "component")}
            new = (np.diff(column["bucket"]) != 0) | (np.diff(column["tile"]) != 0)
            ends = [0, *(np.flatnonzero(new) + 1).tolist(), *([table.num_rows] if last else [])]
            for a, b in zip(ends, ends[1:]):
                part = table.slice(a, b - a)
                sig = np.frombuffer(b"".join(part.column("signature").to_pylist()), "<u2").reshape(b - a, -1)
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                if made := links(*(column[name][a:b] for name in ("side", "node", "component")), sig, texts):
                    u, v, same = zip(*made)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(same, pa.float64())], names=["u", "v", "similarity"])
                    release()
            rest[:] = table.slice(ends[-1]).to_batches()

        for batch in batches:
            if batch.num_rows:
                rest.append(batch)
                yield from found(False)
        if rest:
            yield from found(True)

    return run


def near_links(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, members): documents of different words, verified links (u, v, similarity) between them, and all documents.

    nodes: whole (a digest of the words), node (the smallest doc_id with these
    words) and n_whole (how many have them); members: doc_id and whole (null
    without words).
    """
    idf = idf_table(docs)
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    signed = materialize(texts.mapInArrow(_sign(idf, bands, rows), SIGNATURES), "signatures")
    # equal words have equal samples, so any row's stand for the node
    first = signed.where("whole is not null").groupBy("whole").agg(
        F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n_whole"), F.max("n_bytes").alias("n_bytes"),
        F.min_by(F.struct("signature", "bands"), "doc_id").alias("s"),
    )
    nodes = materialize(first.select("whole", "node", "n_whole", "n_bytes", "s.*"), "nodes")
    star = _star(nodes.select("node", F.explode("bands").alias("bucket")))
    least = threshold - 4 * (threshold * (1 - threshold) / (bands * rows)) ** 0.5
    compared = materialize(_agreement(star, nodes).where(F.col("agree") >= least).select("u", "v").distinct(), "likely")
    links = materialize(_verified(compared, texts, idf, threshold), "links")
    held = _open(nodes.select("node", "n_bytes", F.explode("bands").alias("bucket")), components(links))
    asked = materialize(held.select(F.col("node").alias("doc_id")).distinct(), "asked")
    tiles = _tiles(held, nodes, texts.join(asked, "doc_id", "left_semi"))
    more = tiles.mapInArrow(_links(idf, least, threshold), "u long, v long, similarity double").distinct()
    links = links.unionByName(materialize(more, "links"))
    return nodes.select("whole", "node", "n_whole"), links, signed.select("doc_id", "whole")


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document with a doc_id: doc_id, class_id, class_size, kept.

    A class is a component of documents linked by equal words or a weighted
    Jaccard similarity of at least ``threshold``; class_id is its smallest
    doc_id, whose row is kept. Documents without words (null or empty texts
    too) are each a class. Rows with a null doc_id are left out. Rows that share
    a doc_id have the class of their words; if those come under no smaller id,
    that is the id itself, and all of them are kept.
    """
    nodes, links, members = near_links(docs, threshold)
    classes = nodes.join(components(links), "node", "left").select("whole", "n_whole", F.coalesce("component", "node").alias("of"))
    named = left_join_by_size(members, materialize(classes, "node-classes"), "whole", "n_whole", members.count())
    named = materialize(named.select("doc_id", F.coalesce("of", "doc_id").alias("class_id")), "classes")
    sizes = materialize(named.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")), "class-sizes")
    return left_join_by_size(named, sizes, "class_id", "class_size", named.count()).select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(load(spark, sf_dir, "documents", "doc_id", "text"))
