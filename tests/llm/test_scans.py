import hashlib
import re

from conftest import words

from pricewright.llm import decontamination as dc
from pricewright.llm import license_scan as ls

LOWER = str.maketrans(ls.UPPER, ls.LOWER)


def split(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute_contamination(rows, items, window=13):
    out = []
    for i, text in rows:
        ws, hit, names = split(text), set(), set()
        for name, item in items:
            if name is None or not (own := split(item)):
                continue
            n = min(window, len(own))
            asked = {tuple(own[s : s + n]) for s in range(len(own) - n + 1)}
            for s in range(len(ws) - n + 1):
                if tuple(ws[s : s + n]) in asked:
                    hit |= set(range(s, s + n))
                    names.add(str(name))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(ws), len(hit), len(names), digest, len(hit) > 0 and 20 * len(hit) >= len(ws)))
    return sorted(out, key=repr)


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog while seven wizards mix potions in the tower at night"),
    (2, "short item Here"),
    (3, None),
    (4, "!!!"),
    (5, "the the the the the the the the the the the the the the"),
    (2, "another text of item two"),
    (10, "a b a b a b a b a b a b a b a b"),
    (None, "short item here"),
]


def contaminated_rows(edge_rows):
    quick = ITEMS[0][1]
    return [
        *edge_rows,
        (20, "noise " * 5 + quick.upper() + " noise" * 300),
        (21, "x " + " ".join(quick.split()[2:15]) + ", y"),
        (22, " ".join(quick.split()[2:14])),
        (23, "a Short; item...here and short item\nhere"),
        (24, "the " * 40),
        (25, "b a " * 9),
        (26, " ".join(words(20, 4)) + " another text of item two"),
    ]


def test_decontamination_matches_brute_force(spark, make, edge_rows):
    rows = contaminated_rows(edge_rows)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block in (16 << 20, 60):
        got = sorted((tuple(r)[:6] for r in dc.decontaminate(make(rows), items, block_bytes=block).collect()), key=repr)
        assert got == brute_contamination(rows, ITEMS)


def test_decontamination_of_empty_tables(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in dc.decontaminate(make([(1, "a b")]), none).collect()] == [(1, 2, 0, 0)]
    assert dc.decontaminate(make([]), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def brute_near(rows, items, slop, few):
    """Item ids with a proximity match by document, in plain loops."""
    seen = [w for _, t in rows for w in split(t)]
    out = {}
    for i, text in rows:
        ws, names = split(text), set()
        for name, item in items:
            if name is None or not (own := split(item)):
                continue
            asked = sorted(range(len(own)), key=lambda at: (seen.count(own[at]), at))[:few]
            places = {at: [p - at for p, w in enumerate(ws) if w == own[at]] for at in asked}
            if any(all(any(d <= x <= d + slop for x in places[at]) for at in asked) for d in {x for p in places.values() for x in p}):
                names.add(str(name))
        out[i] = len(names)
    return out


def test_proximity_matches_brute_force(spark, make):
    """Stray terms before a phrase, a phrase twice, words put in, and items without words or terms, in blocks and without."""
    rows = [
        (1, "alpha x alpha beta x gamma delta"),
        (2, "x alpha beta gamma delta alpha beta gamma delta"),
        (3, "alpha x x x beta gamma delta"),
        (4, "x x alpha beta alpha x gamma delta"),
        (5, "alpha x beta gamma delta"),
        (6, "beta gamma"),
        (7, None),
        (8, "delta gamma beta alpha"),
    ]
    items = [(1, "alpha beta gamma delta"), (2, "beta gamma"), (3, "none of these"), (4, None), (None, "x"), (1, "x x"), (5, " - ")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for slop, few, block in ((0, 4, 1 << 20), (1, 4, 12), (2, 4, 1 << 20), (2, 3, 12), (3, 2, 30)):
        got = {r.doc_id: r.n_near for r in dc.decontaminate(make(rows), bench, slop=slop, near_terms=few, block_bytes=block).collect()}
        assert got == brute_near(rows, items, slop, few), (slop, few)
    places = dc.benchmark_proximity(make(rows), bench, slop=0).where("item_id = 1 and doc_id = 2").collect()
    assert {(r.first, r.last) for r in places} == {(1, 4), (5, 8)}


def test_blocks_read_documents_no_oftener(spark, make, monkeypatch):
    reads = []
    for name in ("term_frequencies", "build_index"):
        real = getattr(dc, name)
        monkeypatch.setattr(dc, name, lambda *a, real=real, name=name: reads.append(name) or real(*a))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    dc.decontaminate(make([(1, "a b")]), items, block_bytes=40).count()
    assert reads == ["term_frequencies", "build_index"]


def brute_base(text):
    ws, places, labels = split(text), [], set()
    for label, phrase in ls.BASE:
        p = phrase.split()
        for s in range(len(ws) - len(p) + 1):
            if ws[s : s + len(p)] == p:
                places.append(s)
                labels.add(label)
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_edges(make, edge_rows):
    mit = next(text for label, text in ls.PHRASES if text.startswith("permission is hereby")).split()
    rows = [
        *edge_rows,
        (30, "Released under the MIT License. Under  THE mit LICENSE! cc by nc"),
        (31, "the apache license, version 2.0 and apache license version"),
        (32, " ".join(mit[:7] + ["extra"] + mit[7:])),
        (33, "licensed under the GNU General Public License, version 3"),
        (34, "under the\x0bmit license " * 3),
        (35, "under the mit licensé"),
        (36, "the GNU General Public License, either version 3"),
        (37, "GNU Affero General Public License version 3"),
        (38, "Creative Commons Attribution-NonCommercial 4.0 International"),
        (39, "the GNU General Public License, version of your choice"),
    ]
    got = ls.license_scan(make(rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=repr) == sorted(
        ((i, *brute_base(t)) for i, t in rows), key=repr
    )
    by = {r.doc_id: r for r in got}
    assert by[32].labels == "mit" and by[32].n_base == 0 and 0.8 <= by[32].score < 1
    assert by[33].labels == "gpl-3" and by[33].score == 1
    assert by[36].labels == "gpl-3" and by[37].labels == "agpl-3" and by[38].labels == "cc-by-nc" and by[39].labels == ""
    assert by[30].labels == "cc-by-nc,mit" and (by[35].labels, by[35].base_labels, by[35].score) == ("mit", "", 0.75)
    assert ls.license_scan(make([])).count() == 0


def test_edited_templates_are_found(make):
    """Every template with one word put in, and the longer ones with one changed and many words left out."""
    rows, want = [], {}
    for number, (label, text) in enumerate(ls.TEMPLATES):
        own, needed, _ = ls.parse(text)
        middle = len(own) // 2
        free = [i for i in range(len(own)) if i not in needed and (i >= 3 or len(own) - i > 3)]
        edits = [own]
        if len(own) >= 5:
            edits.append(own[:3] + ["really"] + own[3:])
        if len(own) >= 7 and free:
            edits.append([*own[: free[-1]], "changed", *own[free[-1] + 1 :]])
        if len(own) > 65:
            edits.append(own[: middle - 5] + own[middle + 3 :])
        for edit, each in enumerate(edits):
            rows.append((number * 10 + edit, "some words before " + " ".join(each) + " and after"))
            want[number * 10 + edit] = label
    got = {r.doc_id: r for r in ls.license_scan(make(rows)).collect()}
    assert [(i, label, got[i].labels) for i, label in want.items() if label not in got[i].labels.split(",")] == []
    assert max(len(ls.parse(text)[0]) for _, text in ls.TEMPLATES) > 65


def test_license_scan_of_a_very_long_text(make):
    import time

    text = " ".join(words(1_000_000, 77)) + " under the mit license"
    began = time.perf_counter()
    (row,) = ls.license_scan(make([(1, text)])).collect()
    assert (row.n_words, row.first_word, row.labels) == (1_000_004, 1_000_000, "mit")
    assert time.perf_counter() - began < 60
