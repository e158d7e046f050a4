"""Scoring of vectors in bounded pieces."""

import numpy as np
import pyarrow as pa

from pricewright.operators import search


def test_scores_are_held_in_pieces():
    """A batch of 5,000 rows against 700 queries, with many ties: no piece is larger than allowed, and the best are those of a sort."""
    rng = np.random.default_rng(1)
    vectors, ids = rng.integers(-1, 2, (5000, 6)).astype(np.float64), rng.permutation(5000)
    sizes = []

    def score(rows, queries):
        sizes.append(len(rows) * len(queries))
        return rows @ queries.T

    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(vectors.astype(np.float32)))], names=["vec_id", "embedding"])
    queries = np.argsort(ids)[:700]
    got = {}
    for out in search._best_of_batch(ids[queries], vectors[queries], score, 3)(iter([batch])):
        for q, row, value in zip(*(c.to_pylist() for c in out.columns)):
            got.setdefault(q, []).append((-value, row))
    assert max(sizes) <= search.SCORES
    for q in queries[:50]:
        want = sorted((-float(vectors[q] @ v), int(i)) for v, i in zip(vectors, ids) if i != ids[q])[:3]
        assert sorted(got[ids[q]])[:3] == want
