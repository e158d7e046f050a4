import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from conftest import words

from pricewright.llm import exact_dedup as ed
from pricewright.llm import near_dedup as nd
from pricewright.llm import substring_dedup as sd
from pricewright.operators.graph import components


def brute_substring(rows, window=13):
    least = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, ws in split:
        if i is not None:
            for s in range(len(ws) - window + 1):
                k = tuple(ws[s : s + window])
                least[k] = min(least.get(k, i), i)
    out = []
    for i, ws in split:
        gone = set()
        if i is not None:
            for s in range(len(ws) - window + 1):
                if least[tuple(ws[s : s + window])] < i:
                    gone |= set(range(s, s + window))
        kept = [w for j, w in enumerate(ws) if j not in gone]
        out.append((i, len(ws), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_substring_edges(make, edge_rows):
    got = [tuple(r)[:4] for r in sd.substring_dedup(make(edge_rows)).collect()]
    assert order(got) == order(brute_substring(edge_rows))


def test_substring_one_id_with_two_texts(make):
    a = words(40, 5)
    rows = [(1, " ".join(a)), (1, " ".join(a[20:] + words(20, 6))), (2, " ".join(words(9, 7) + a[5:25])), (2, "x " * 20)]
    got = [tuple(r)[:4] for r in sd.substring_dedup(make(rows)).collect()]
    assert order(got) == order(brute_substring(rows))


def test_substring_bounds_are_maximal_repeats(make):
    a, b = words(30, 8), words(20, 9)
    got = {r.doc_id: r.repeat_bounds for r in sd.substring_dedup(make([(1, " ".join(a)), (2, " ".join(b + a[3:25] + b))])).collect()}
    assert got == {1: [], 2: [20, 42]}


def test_substring_empty_table(make):
    assert sd.substring_dedup(make([])).count() == 0


def brute_exact(rows):
    groups = defaultdict(list)
    norm = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t in rows]
    for i, t in norm:
        groups[t].append(i)
    out = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids, default=None)
        out.append((i, keep, len(groups[t]), keep == i, hashlib.sha256(t.encode()).hexdigest()))
    return out


def test_exact_edges(make, edge_rows):
    got = [tuple(r) for r in ed.exact_dedup(make(edge_rows)).collect()]
    assert order(got) == order(brute_exact(edge_rows))
    assert ed.exact_dedup(make([])).count() == 0


def as_filter(prints, bits):
    return ed.QuotientFilter.build(*ed.add_up(prints, np.ones(len(prints), np.int64)), bits)


def test_filter_holds_fingerprints_and_counts():
    draw = np.random.default_rng(0)
    for bits, n, distinct in ((8, 700, 60), (20, 3000, 500), (63, 5000, 4000), (12, 1, 1), (9, 4000, 1)):
        pool = draw.integers(0, 2**bits, distinct).astype(np.uint64)
        prints = draw.choice(pool, n)
        made = as_filter(prints, bits)
        back = ed.QuotientFilter.parse(made.serialise())
        got, counts = back.decode()
        assert dict(zip(got.tolist(), counts.tolist())) == Counter(prints.tolist())
        assert (np.diff(got.astype(np.float64)) > 0).all()
        assert np.array_equal(back.meta, made.meta) and np.array_equal(back.slots, made.slots)
    none = ed.QuotientFilter.build(np.empty(0, np.uint64), np.empty(0, np.int64), 10)
    assert len(ed.QuotientFilter.parse(none.serialise()).decode()[0]) == 0


def test_filter_size():
    """Distinct fingerprints take a slot of remainder and four bits; well under the 16 bytes of a print and a count."""
    prints = np.unique(np.random.default_rng(4).integers(0, 2**26, 12_000).astype(np.uint64))
    made = as_filter(prints, 26)
    assert len(made.serialise()) * 8 / len(prints) < (made.remainder + 4) / (ed.LOAD / 2) + 1 < 46


def test_filters_merge_without_loss():
    draw = np.random.default_rng(0)
    prints = draw.integers(0, 500, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    parts = [as_filter(part, 24) for part in np.array_split(prints, 4)]
    merged, whole = ed.QuotientFilter.merge(parts), as_filter(prints, 24)
    assert np.array_equal(merged.meta, whole.meta) and np.array_equal(merged.slots, whole.slots)
    for segments in (0, 3):
        rows = []
        for part in np.array_split(prints, 4):
            batch = pa.RecordBatch.from_arrays([pa.array(part.view(np.int64))], names=["fp"])
            rows += list(ed._build(segments, 24 - segments)(iter([batch, batch.slice(0, 0)])))
        table = pa.Table.from_batches(rows)
        found = {}
        for segment in set(table.column("segment").to_pylist()):
            some = ed._merge(24 - segments)(table.filter(pa.compute.equal(table.column("segment"), segment))).to_pydict()
            found |= dict(zip(some["fp"], some["n"]))
        assert found == {k: n for k, n in Counter(prints.tolist()).items() if n > 1}


def test_near_edges(make, edge_rows):
    got = [tuple(r) for r in nd.near_dedup(make(edge_rows)).collect()]
    by = {i: c for i, c, *_ in got}
    assert len(got) == len(edge_rows) - 1 and None not in by
    assert by[1] == by[2] == by[3] == 1 and by[11] == 11
    assert by[4] == 4 and by[5] == 5 and by[6] == 6
    assert {(i, n, k) for i, _, n, k in got if i in (1, 2, 3, 9)} == {(1, 3, True), (2, 3, False), (3, 3, False), (9, 2, True)}
    assert nd.near_dedup(make([])).count() == 0


def test_near_matches_brute_force(spark, make):
    texts = {}
    for group in range(12):
        base = words(120, 100 + group)
        for copy in range(5):
            own = list(base)
            for j in range(copy):
                own[(17 * j + 11 * copy) % 120] = f"edit{group}{copy}{j}"
            texts[group * 10 + copy] = " ".join(own)
    docs = make(list(texts.items()))
    idf = nd.idf_table(docs)
    weights = {i: nd.weighted_shingles(t.encode(), idf) for i, t in texts.items()}
    links = {(b, a) for a in texts for b in texts if a < b and nd.weighted_jaccard(weights[a], weights[b]) >= 0.8}
    label = {i: i for i in texts}
    for _ in texts:
        for u, v in links:
            label[u] = label[v] = min(label[u], label[v])
    assert {r.doc_id: r.class_id for r in nd.near_dedup(docs).collect()} == label
    assert len(set(label.values())) < len(texts)


def test_samples_estimate_weighted_jaccard():
    draw = np.random.default_rng(3)
    ids = draw.integers(0, 2**63, 400).astype(np.uint64)
    w = draw.uniform(0.5, 3, 400).astype(np.float32)
    a, b = (np.sort(ids[:300]), None), (np.sort(ids[50:]), None)
    weight = dict(zip(ids.tolist(), w))
    wa, wb = (np.array([weight[i] for i in x.tolist()], np.float32) for x in (a[0], b[0]))
    sampler = nd.Sampler(600)
    same = (sampler(a[0], wa) == sampler(b[0], wb)).mean()
    assert abs(same - nd.weighted_jaccard((a[0], wa), (b[0], wb))) < 0.07


def test_near_compares_all_pairs_of_crowded_buckets(make, monkeypatch):
    """A family of unlike copies of one template, with planted near copies that no hub is like; one short band."""
    monkeypatch.setattr(nd, "GROUP", 20)
    draw = np.random.default_rng(8)
    base, texts = words(200, 900), {}
    for i in range(50):
        own = list(base)
        for at in range(0, 200, 32):
            own[at + int(draw.integers(0, 3))] = f"own{i}x{at}"
        texts[i] = " ".join(own)
        for at in (110, 145, 180):
            own[at] = f"copy{i}"
        texts[100 + i] = " ".join(own)
    docs = make(list(texts.items()))
    idf = nd.idf_table(docs)
    weights = {i: nd.weighted_shingles(t.encode(), idf) for i, t in texts.items()}
    batch = pa.RecordBatch.from_pydict({"doc_id": list(texts), "text": list(texts.values())})
    (signed,) = nd._sign(idf, 1, 2)(iter([batch]))
    bands = dict(zip(texts, map(set, signed.column("bands").to_pylist())))
    links = {(b, a) for a in texts for b in texts if a < b and bands[a] & bands[b] and nd.weighted_jaccard(weights[a], weights[b]) >= 0.8}
    assert len(links) >= 30
    labels = {r.node: r.component for r in components(nd.near_links(docs, bands=1, rows=2)[1]).collect()}
    assert [(u, v) for u, v in links if labels.get(u, u) != labels.get(v, v)] == []


def test_near_tiles_return_fewer_links_than_nodes(make, monkeypatch):
    """A family whose members are all near the threshold: rows out of the tiles don't grow with its pairs."""
    monkeypatch.setattr(nd, "CROWD", 4)
    draw = np.random.default_rng(5)
    base, texts = words(150, 77), {}
    for i in range(60):
        own = list(base)
        for at in draw.choice(150, int(draw.integers(1, 3)), replace=False):
            own[at] = f"own{i}x{at}"
        texts[i] = " ".join(own)
    docs = make(list(texts.items()))
    idf = nd.idf_table(docs)
    weights = {i: nd.weighted_shingles(t.encode(), idf) for i, t in texts.items()}
    near = {(b, a) for a in texts for b in texts if a < b and nd.weighted_jaccard(weights[a], weights[b]) >= 0.8}
    assert len(near) > 100 and len(near) < 1500
    _, links, _ = nd.near_links(docs)
    made = {(r.u, r.v) for r in links.collect()}
    assert made <= near and len(made) < 14 * len(texts)
    label = {i: i for i in texts}
    for _ in texts:
        for u, v in near:
            label[u] = label[v] = min(label[u], label[v])
    got = {r.doc_id: r.class_id for r in nd.near_dedup(docs).collect()}
    assert sum(got[i] == label[i] for i in texts) >= 0.9 * len(texts)


def test_near_overlaps_equal_weighted_jaccard():
    texts = [" ".join(words(n, 3)).encode() for n in (80, 60, 2)] + [b"same " * 50, b"same " * 30, b""]
    idf = np.linspace(0.5, 1, nd.BUCKETS).astype(np.float32)
    found = nd._Overlaps(texts, idf)
    each = [nd.weighted_shingles(t, idf) for t in texts]
    for i in range(5):
        assert np.allclose(found.similarity(i), [nd.weighted_jaccard(each[i], other) for other in each], atol=1e-5)


def test_near_one_id_with_two_texts(make):
    a, b = words(60, 41), words(60, 42)
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join(b)), (9, " ".join(a[:59] + ["end"]))]
    got = order(tuple(r) for r in nd.near_dedup(make(rows)).collect())
    assert got == order([(5, 5, 4, True), (5, 5, 4, True), (7, 5, 4, False), (9, 5, 4, False)])


def test_near_recall_by_link(spark):
    """Of all pairs of sf0.01 at 0.8 or more, found without sampling, at least nine in ten are in one class."""
    from pricewright.llm.common import load

    docs = load(spark, "/root/testdata/sf0.01", "documents", "doc_id", "text")
    idf = nd.idf_table(docs)
    weights = {r.doc_id: nd.weighted_shingles((r.text or "").encode(), idf) for r in docs.collect()}
    holders = defaultdict(list)
    for i, (shingles, _) in weights.items():
        for h in shingles.tolist():
            holders[h].append(i)
    pairs = {(a, b) for own in holders.values() for a in own for b in own if a < b}
    total = {i: float(w.sum()) for i, (_, w) in weights.items()}
    near = [(a, b) for a, b in pairs if min(total[a], total[b]) >= 0.8 * max(total[a], total[b]) and nd.weighted_jaccard(weights[a], weights[b]) >= 0.8]
    label = {r.doc_id: r.class_id for r in nd.near_dedup(docs).collect()}
    assert len(near) > 50 and sum(label[a] == label[b] for a, b in near) >= 0.9 * len(near)
