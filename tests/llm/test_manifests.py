import hashlib
import re
import zlib
from collections import Counter, defaultdict

from conftest import words
from pyspark.sql import functions as F

from pricewright.llm import line_dedup as ld
from pricewright.llm import merkle_manifest as mm
from pricewright.llm import spelling_groups as sg

WHITE = " \t\n\x0b\x0c\r"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def order(rows):
    return sorted(rows, key=repr)


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def brute_lines(rows, least_chars=20, least_docs=3, newest=True):
    held = defaultdict(set)
    split = [(i, (t or "").split("\n")) for i, t in rows]
    for i, lines in split:
        for line in lines:
            key = lower(line.strip(WHITE))
            if len(key) >= least_chars:
                held[key].add(i)
    place = lambda i: (i is not None, i or 0) if newest else (i is None, -(i or 0) if newest else (i or 0))
    stays = {k: (max if newest else min)(ids, key=place) for k, ids in held.items() if len(ids) >= least_docs}
    out = []
    for i, lines in split:
        kept = [line for line in lines if stays.get(lower(line.strip(WHITE)), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), digest("\n".join(kept))))
    return out


LINES = [
    (1, "A common line of the corpus\nown line number one, long enough\nshort"),
    (2, "  a COMMON line of the corpus\t\nshort\n\na common line of the corpus"),
    (3, "a common line of the corpus\r\nshort\nonly two have this long line"),
    (4, "only two have this long line\na common line of the corpus\n"),
    (5, None),
    (6, ""),
    (7, "\n\n"),
    (8, "ÉÉ été déjà vu, une ligne longue\nx"),
    (9, "éÉ été déjà vu, une ligne longue\nx"),
    (10, "ÉÉ été DÉjà vu, une ligne longue\nÉÉ été DÉjà vu, une ligne longue"),
    (10, "ÉÉ été DÉjà vu, une ligne longue\nÉÉ été DÉjà vu, une ligne longue"),
    (11, "ÉÉ été DÉjà vu, une ligne longue\nanother of the same document here"),
    (11, "another of the same document here"),
    (12, "ÉÉ été DÉjà vu, une ligne longue"),
    (None, "a common line of the corpus\nanother of the same document here"),
    (None, "a common line of the corpus"),
    (13, "\n".join(f"line {i % 700} of a very long document with repeats" for i in range(9000))),
    (14, "\n".join(f"line {i} of a very long document with repeats" for i in range(0, 700, 3))),
    (15, "\n".join(f"line {i} of a very long document with repeats" for i in range(0, 700, 2))),
]


def test_lines_match_brute_force(make):
    for newest in (True, False):
        found = ld.line_dedup(make(LINES), newest=newest)
        got = [(r.doc_id, r.n_lines, r.n_dropped, digest(r.kept_text)) for r in found.collect()]
        assert order(got) == order(brute_lines(LINES, newest=newest))
    assert ld.line_dedup(make([])).count() == 0


def test_frequent_lines_are_decided_alike(make, monkeypatch):
    monkeypatch.setattr(ld, "FEW", 3)
    monkeypatch.setattr(ld, "SHARE", 60)
    docs = make(LINES)
    assert ld.frequent(ld.line_table(docs, 20), 600).count() > 0
    got = [(r.doc_id, r.n_lines, r.n_dropped, digest(r.kept_text)) for r in ld.line_dedup(docs).collect()]
    assert order(got) == order(brute_lines(LINES))


def test_bitmaps_hold_only_words_with_dropped_lines(make):
    rows = [(1, "\n".join([f"x{i}" for i in range(200)] + ["a line that many documents have"])), (2, "a line that many documents have"), (3, "a line that many documents have")]
    held = {r.doc_id: r for r in ld.line_bitmaps(make(rows)).collect()}
    assert set(held) == {1, 2} and held[1].n_dropped == 1
    ((word, bits),) = held[1].keep
    assert word == 3 and bits & (2**64 - 1) == 2**64 - 1 - (1 << 200 % 64)


def test_lines_run_no_python(make):
    plan = ld.line_dedup(make(LINES))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_manifest(rows, tampered):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: digest("".join(map(part, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))

    def tree(level):
        levels = [level]
        while len(level) > 1:
            level = [digest("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
            levels.append(level)
        return levels

    def climb(levels, i, held):
        siblings = []
        for level in levels[:-1]:
            run = range(i // 3 * 3, min(i // 3 * 3 + 3, len(level)))
            siblings += [level[j] for j in run if j != i]
            held = digest("".join(held if j == i else level[j] for j in run))
            i //= 3
        return siblings, held

    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = {name: tree([leaf(r, r["text"]) for r in groups[name]]) for name in names}
    above = tree([trees[name][-1][0] for name in names])
    out = []
    for s, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            siblings, held = climb(trees[name], i, leaf(r, tampered(r)))
            more, held = climb(above, s, held)
            own = trees[name][0][i]
            out.append((r["doc_id"], own, trees[name][-1][0], above[-1][0], digest("".join(siblings + more)), held, held == above[-1][0]))
    return out


DOC = "doc_id long, source string, lang string, n_chars long, text string, leaf string, at long, n long"


def documents(spark, sizes):
    rows, i = [], 0
    for source, n in sizes:
        for k in range(n):
            i += 1
            text = [f"a line\nand {i}", "", None, "é\n" * 3, "plain"][i % 5]
            rows.append({"doc_id": i * 7 % 1000 if i % 11 else None, "source": source, "lang": None if i % 4 else "en", "n_chars": i % 3 or None, "text": text, "leaf": "x", "at": 1, "n": None})
    rows += rows[:2]
    names = [f.split()[0] for f in DOC.split(", ")]
    return rows, spark.createDataFrame([tuple(r[c] for c in names) for r in rows], DOC)


def check_manifest(rows, docs):
    touched = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.col("text").isNotNull()
    text = F.when(touched, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))

    def tampered(r):
        even = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        return r["text"].replace("\n", "") if even and r["text"] is not None else r["text"]

    got = [tuple(r)[:7] for r in mm.merkle_manifest(docs, text).collect()]
    want = brute_manifest(rows, tampered)
    assert order(got) == order(want)
    return want


def test_manifest_matches_brute_force(spark):
    rows, docs = documents(spark, [("b", 100), (None, 28), ("a", 1), ("", 9), ("é", 3), ("z", 2)])
    want = check_manifest(rows, docs)
    assert {w[-1] for w in want} == {True, False}


def test_manifest_over_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(mm, "STEP", 2)
    rows, docs = documents(spark, [("b", 250)] + [(f"s{i}", 1) for i in range(30)])
    check_manifest(rows, docs)


def test_manifest_of_one_and_of_none(spark):
    rows, docs = documents(spark, [("only", 1)])
    check_manifest(rows[:1], docs.limit(1))
    assert mm.merkle_manifest(docs.limit(0)).count() == 0
    (one,) = mm.merkle_manifest(docs.limit(1)).collect()
    assert one.verified and one.n_siblings == 0 and one.root == one.leaf and one.proof_sha256 == digest("")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(counts, ratio=2):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(near[w]), form.get(w), counts[form[w]] if w in form else None, root))
    return out


def brute_words(rows, damage):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if damage and i is not None and h % damage == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 3}


def test_spelling_matches_brute_force(spark, make, edge_rows):
    common = ["spelling", "colour", "color", "Éclair", "éclair", "naïvely", "naively", "analyse", "analyze", "abcde", "abcdé"]
    rows = [(i, " ".join(common[: 1 + i % len(common)] + words(3, i))) for i in range(60)] + edge_rows
    for damage in (None, 3):
        counts = brute_words(rows, damage)
        held = sg.word_counts(make(rows), damage=damage)
        assert {r.word: r.n for r in held.collect()} == counts
        assert order(tuple(r) for r in sg.spelling_groups(held).collect()) == order(brute_spelling(counts))
    assert sg.spelling_groups(sg.word_counts(make([]))).count() == 0


def test_spelling_of_crowded_segments(spark, monkeypatch):
    """Very many words share each half; groups are cut until few pairs are left, and no link is lost."""
    monkeypatch.setattr(sg, "PAIRS", 20)
    letters = "abcd"
    counts = {f"stem{a}{b}{c}{d}": 3 + (7 * ord(a) + ord(d)) % 40 for a in letters for b in letters for c in letters for d in letters}
    counts |= {w + "s": 500 for w in list(counts)[::5]} | {"x" * 3000: 4, "x" * 3001: 9, "stem": 3, "tem": 50, "s": 9, "t": 3, "te": 5}
    held = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert order(tuple(r) for r in sg.spelling_groups(held).collect()) == order(brute_spelling(counts))
