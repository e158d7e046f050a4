import zlib

import numpy as np
from pyspark.sql import functions as F

from pricewright.llm import language_id as li
from pricewright.llm import quality_classifier as qc
from pricewright.llm import warc_revisits as wr
from pricewright.llm.common import load


def test_language_edges(spark, make, edge_rows):
    got = li.identify_documents(make(edge_rows)).collect()
    assert len(got) == len(edge_rows)
    assert {r.doc_id for r in got if not r.accepted} == {4, 5, 6}
    assert li.identify_documents(make([])).count() == 0


def test_language_of_text_and_evidence(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    table = li.likelihoods(li.of_documents(docs.where("doc_id % 2 = 0")))
    blind = li.of_documents(docs.where("doc_id % 2 = 1")).withColumn("truth", F.col("declared")).withColumn("declared", F.lit(None).cast("string"))
    got = li.identify(blind, table).join(blind.select("doc_id", "truth"), "doc_id").collect()
    assert sum(r.language == r.truth for r in got) >= 0.97 * len(got) and all(r.accepted for r in got)


def test_declaration_decides_a_short_text(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    every = li.of_documents(docs)
    short = every.limit(4).select((F.col("doc_id") + 10_000).alias("doc_id"), F.lit("la de").alias("text"), F.lit("es").alias("declared"), "host", "suffix")
    got = li.identify(every.unionByName(short), li.likelihoods(every)).where("doc_id >= 10000").collect()
    assert {(r.language, r.text_language != "de") for r in got} == {("es", True)}


def test_host_prior_decides_without_text(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    table = li.likelihoods(li.of_documents(docs))
    french = li.of_documents(docs.where("lang = 'fr'")).withColumn("host", F.lit("a.site.example")).withColumn("declared", F.lit(None).cast("string"))
    bare = french.limit(3).withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("text", F.lit("12"))
    got = li.identify(french.unionByName(bare).unionByName(li.of_documents(docs.where("lang = 'en'"))), table).where("doc_id >= 10000").collect()
    assert {r.language for r in got} == {"fr"}


def brute_fusion(rows):
    """(language, posterior, accepted) of (text, declared, host, suffix), in plain loops."""
    import math
    from collections import Counter

    classes = [*li.LANGUAGES, li.UNKNOWN]

    def grams(text):
        data = (text or "").encode().translate(li.LETTERS)
        for i in range(len(data) - 2):
            a, b, c = data[i : i + 3]
            if not (a == b == 32 or b == c == 32):
                yield ((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 19

    table = {c: Counter() for c in li.LANGUAGES}
    for text, declared, _, _ in rows:
        if declared in table:
            table[declared].update(grams(text))
    totals = {c: sum(t.values()) + 0.5 * li.BUCKETS for c, t in table.items()}
    scores = []
    for text, *_ in rows:
        own = list(grams(text))
        each = [sum(math.log((table[c][g] + 0.5) / totals[c]) for g in own) for c in li.LANGUAGES]
        scores.append((own, [*each, len(own) * (-math.log(li.BUCKETS) - li.MARGIN)]))
    best = [classes[s.index(max(s))] if own else None for own, s in scores]
    whole = Counter(b for b in best if b)
    n, kinds = sum(whole.values()), [*li.LANGUAGES, "other", "none"]

    def claim(d):
        return "none" if d is None else d if d in li.LANGUAGES else "other"

    def shares(counts, parent):
        return {c: (counts[c] + li.SMOOTHING * parent[c]) / (sum(counts.values()) + li.SMOOTHING) for c in classes}

    def counts(keep):
        return Counter(b for b, row in zip(best, rows) if b and keep(row))

    root = {c: (whole[c] + 1) / (n + len(classes)) for c in classes}
    out = []
    for (own, score), (text, declared, host, suffix) in zip(scores, rows):
        prior = root
        if host is not None:
            domain = ".".join(host.split(".")[-2:])
            wide = shares(counts(lambda r: r[2] is not None and ".".join(r[2].split(".")[-2:]) == domain), root)
            prior = shares(counts(lambda r: r[2] == host), wide)
        end = counts(lambda r: r[3] == suffix) if suffix is not None else None
        said = counts(lambda r: claim(r[1]) == claim(declared))
        evidence = []
        for c, s in zip(classes, score):
            e = li.TEMPER * (s - max(score)) + math.log(prior[c]) + math.log((said[c] + 0.5) / (whole[c] + 0.5 * len(kinds)))
            if end:
                e += math.log((end[c] + li.SMOOTHING * sum(end.values()) / n) / (whole[c] + li.SMOOTHING))
            evidence.append(e)
        most = max(evidence)
        language, posterior = classes[evidence.index(most)], 1 / sum(math.exp(e - most) for e in evidence)
        out.append((language, posterior, any(ch.isalnum() for ch in text or "") and language != li.UNKNOWN and posterior >= li.LEAST))
    return out


def test_fusion_matches_brute_force(spark):
    german, english = "der hund und die katze sind im haus", "the dog and the cat are in the house"
    rows = [(german, "de", "a.x.de", "de")] * 6 + [(english, "en", "b.x.com", "com")] * 9 + [("zqxj kvwq", "en", "b.x.com", "com")]
    rows += [("42", None, "a.x.de", "de"), ("haus", "en", None, None), ("the", "de", "c.x.de", "de"), ("", "de", "a.x.de", "de"), (None, None, None, None)]
    rows += [(english, "xx", "b.x.com", None), ("7 8", "fr", "unseen.org", "org"), ("--", "en", "b.x.com", "com")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, declared string, host string, suffix string")
    got = {r.doc_id: r for r in li.identify(frame, li.likelihoods(frame)).collect()}
    for i, (language, posterior, accepted) in enumerate(brute_fusion(rows)):
        assert (got[i].language, got[i].accepted) == (language, accepted) and abs(got[i].posterior - posterior) < 1e-4, rows[i]


def test_documents_with_markup_and_addresses(spark):
    rows = [(1, '<html lang="FR"> see http://a.example.DE/x', "en", "src1"), (2, "no address", None, "News.Example.org"), (3, "x https://b.co.uk.", "en", "src2"), (4, None, None, None)]
    got = li.of_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id: (r.declared, r.suffix) for r in got} == {1: ("fr", "de"), 2: (None, "org"), 3: ("en", "uk"), 4: (None, None)}


def test_page_languages(spark, sf_dir):
    got = li.page_language_id(spark, sf_dir).collect()
    assert sum(r.language == r.declared for r in got) >= 0.97 * len(got)


def test_quality_on_held_out_rows(spark, sf_dir):
    docs, labels = load(spark, "/root/testdata/sf0.01", "documents"), load(spark, "/root/testdata/sf0.01", "labels")
    got = qc.quality_scores(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    assert all(r.predicted == int(r.score >= 0.7) for r in got)


def test_quality_edges(spark, make, edge_rows):
    labels = spark.createDataFrame([(1, 1, "x"), (3, 0, "x"), (8, 1, "x"), (7, None, "x"), (None, 1, "x"), (1, 1, "y")], "doc_id long, quality int, text string")
    got = qc.quality_scores(make(edge_rows), labels).collect()
    assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[4] == by[5]
    assert {r.score for r in qc.quality_scores(make(edge_rows), labels.limit(0)).collect()} == {0.5}
    assert qc.quality_scores(make([]), labels).count() == 0


def small_weights(draw):
    return {k: draw.normal(size=s) for k, s in qc.SHAPES.items()}


TEXTS = ["two words", "", "  lead " + "ab cd " * 100 + "é end\n", "x", "Some other text, of " + "many words " * 60]


def test_forward_pass_matches_brute_force():
    """Passages, hashed embeddings, attention and score in plain loops."""
    import math

    import xxhash

    w = small_weights(np.random.default_rng(1))
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    want = []
    for text in TEXTS:
        data = text.encode()
        spans = [(i, j) for i in range(len(data)) if (i == 0 or data[i - 1 : i].isspace()) and not data[i : i + 1].isspace() for j in [i]]
        n = max(1, -(-len(spans) // qc.PASSAGE))
        owner = [max(0, sum(s <= at for s, _ in spans) - 1) // qc.PASSAGE for at in range(len(data))]
        hidden = []
        for p in range(n):
            runs = [((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 % 2**32) >> 19 for i in range(len(data) - 2) if owner[i] == p]
            own = [xxhash.xxh3_64_intdigest(x) % qc.ROWS for x in data.split()[p * qc.PASSAGE : (p + 1) * qc.PASSAGE]]
            x = w["e"].copy()
            last = [max((j for j in range(i) if own[j] == own[i]), default=None) for i in range(len(own))]
            gaps = [0 if j is None else min(qc.GAPS - 1, 1 + int(math.log2(i - j))) for i, j in enumerate(last)]
            for table, rows in (("R", runs), ("W", own), ("G", gaps)):
                if rows:
                    x = x + sum(w[table][r] for r in rows) / len(rows)
            hidden.append(np.tanh(x))
        logits = [sum(math.tanh(h @ w["V"][:, k]) * sigmoid(h @ w["U"][:, k]) * w["a"][k] for k in range(qc.GATE)) for h in hidden]
        weight = [math.exp(x - max(logits)) for x in logits]
        z = sum(a * h for a, h in zip(weight, hidden)) / sum(weight)
        want.append(sigmoid(z @ w["c"] + w["b"][0]))
    bags = qc.Bags.of([t.encode() for t in TEXTS])
    assert np.allclose(qc.forward(w, bags)[0], want)
    packed = qc.Bags.unpack([qc.Bags.of([t.encode()]).pack() for t in TEXTS])
    assert np.allclose(qc.forward(w, packed)[0], want)


def test_attention_gradients():
    w, bags, y = small_weights(np.random.default_rng(2)), qc.Bags.of([t.encode() for t in TEXTS]), np.array([1.0, 0, 1, 1, 0])

    def loss(w):
        p = qc.forward(w, bags)[0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = qc.gradients(w, bags, y)
    for k in w:
        at = np.unravel_index(np.abs(g[k]).argmax(), w[k].shape)
        moved = {a: b.copy() for a, b in w.items()}
        moved[k][at] += 1e-6
        assert abs((loss(moved) - loss(w)) / 1e-6 - g[k][at]) < 1e-3, k


RECORD = "record_id long, url string, warc_date timestamp, warc_type string, headers map<string,string>, status int, site string, hour string"


def test_revisits(spark):
    from datetime import datetime as D

    rows = [
        (1, "http://A.example/x?utm_source=z#top", D(2024, 1, 1, 1), "response", {"etag": '"a"', "content-type": "t", "date": "old"}),
        (2, "https://a.example/x", D(2024, 1, 1, 2), "revisit", {"etag": 'W/"a"', "content-type": "no", "date": "new"}),
        (3, "https://a.example/x", D(2024, 1, 9, 2), "revisit", {"etag": '"b"'}),
        (4, "https://a.example/x", D(2024, 1, 1, 0), "revisit", {"etag": '"a"'}),
        (5, "https://a.example/x", D(2024, 1, 5), "response", {"last-modified": "m"}),
        (6, "https://a.example/x", D(2024, 1, 6), "revisit", {"last-modified": "m", "etag": '"q"'}),
        (7, "https://a.example/x", D(2024, 1, 7), "revisit", None),
        (8, None, D(2024, 1, 7), "revisit", {"etag": '"a"'}),
        (9, "https://a.example/x", None, "revisit", {"etag": '"a"'}),
        (10, "https://b.example", D(2024, 2, 1), "response", None),
        (11, "https://b.example/", D(2024, 2, 1), "revisit", {}),
        (None, "https://b.example/", D(2024, 2, 1), "revisit", {}),
        (12, "https://b.example/", D(2024, 2, 1), "warcinfo", {}),
    ]
    records = spark.createDataFrame([(*r, 200 if r[3] == "response" else 304, "x", "y") for r in rows], RECORD)
    records = records.unionByName(records.where("record_id = 2"))
    others = [
        (13, "https://a.example/x", D(2024, 1, 1, 1, 30), "response", {"etag": '"a"'}, 404, "x", "y"),
        (14, "https://a.example/x", D(2024, 1, 5, 1), "response", {"etag": '"b"'}, 206, "x", "y"),
        (15, "https://a.example/x", D(2024, 1, 5, 2), "response", {"etag": '"b"'}, None, "x", "y"),
        (5, "https://a.example/y", D(2024, 1, 4), "response", {"last-modified": "n"}, 200, "x", "y"),  # the later record of this id wins
    ]
    records = records.unionByName(spark.createDataFrame(others, RECORD))
    got = {r.record_id: (r.ref_id, r.status, r.headers) for r in wr.resolve_revisits(records).collect()}
    assert got.pop(2) == (1, "resolved", {"etag": 'W/"a"', "content-type": "t", "date": "new"})
    assert got.pop(6) == (5, "resolved", {"last-modified": "m", "etag": '"q"'})
    assert {k: v[:2] for k, v in got.items()} == {3: (5, "unverified"), 4: (None, "missing"), 7: (5, "unverified"), 8: (None, "missing"), 9: (None, "missing"), 11: (10, "unverified")}
    assert wr.resolve_revisits(records.limit(0)).count() == 0


def test_permitted_headers(spark):
    """What a 304 answer may not change: the payload's description, fields of the connection and those that Connection names, null values."""
    from datetime import datetime as D

    stored = {"etag": '"a"', "content-type": "t", "x-a": "1", "x-b": "1", "x-null": "old", "keep-alive": "kept as recorded"}
    fresh = {
        "etag": '"a"', "content-type": "no", "content-length": "0", "connection": "close , X-A", "x-a": "2", "x-b": "2", "keep-alive": "9", "te": "x", "trailer": "x", "upgrade": "h2c",
        "proxy-authenticate": "x", "proxy-connection": "x", "transfer-encoding": "chunked", "x-null": None, "vary": "accept",
    }
    at = D(2024, 1, 1, 1)  # two full responses at one instant: the larger id is the later one
    rows = [(1, "u.v/", at, "response", None, 200, "x", "y"), (2, "u.v/", at, "response", stored, 200, "x", "y"), (3, "u.v/", at, "revisit", fresh, 304, "x", "y")]
    (got,) = wr.resolve_revisits(spark.createDataFrame(rows, RECORD)).collect()
    assert (got.ref_id, got.status) == (2, "resolved")
    assert got.headers == {"etag": '"a"', "content-type": "t", "x-a": "1", "x-b": "2", "x-null": "old", "keep-alive": "kept as recorded", "vary": "accept"}


def test_capture_log_of_odd_pages(spark):
    """Null and repeated ids and urls, a very long page, other columns."""
    pages = [(1, "http://a.b/", "x"), (1, "http://a.b/", "x"), (None, "http://a.b/", "x"), (5, None, None), (7, "not an address", "long " * 200_000)]
    log = wr.capture_log(spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, headers string"))
    got = {r.record_id: r.status for r in wr.resolve_revisits(log).collect()}
    assert got == {5: "resolved", 6: "resolved", 21: "missing", 22: "missing", 29: "resolved", 30: "changed"}
