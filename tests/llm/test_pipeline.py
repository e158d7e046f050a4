import corpus_pipeline
from test_dedup import brute_exact
from test_scans import brute_contamination

from pricewright.llm import near_dedup as nd
from pricewright.llm.common import load
from pricewright.llm.registry import ORACLES, QUERIES


def test_pipeline_matches_brute_force(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").orderBy("doc_id").collect()
    rows = [(r.doc_id, r.text) for r in docs if any(c.isalnum() for c in r.text)]
    rows = [row for row, found in zip(rows, brute_exact(rows)) if found[3]]
    kept = spark.createDataFrame(rows, "doc_id long, text string")
    idf = nd.idf_table(kept)
    weights = [nd.weighted_shingles(t.encode(), idf) for _, t in rows]
    label = list(range(len(rows)))
    links = [(a, b) for a in range(len(rows)) for b in range(a) if nd.weighted_jaccard(weights[a], weights[b]) >= 0.8]
    for _ in range(20):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    rows = [row for i, row in enumerate(rows) if label[i] == i]
    items = [tuple(r) for r in load(spark, sf_dir, "benchmark", "item_id", "text").collect()]
    bad = {found[0] for found in brute_contamination(rows, items) if found[5]}
    want = {i for i, _ in rows if i not in bad}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want)
    assert all(r.parity and r.round_trip and len(r.ids) == r.n_tokens for r in got)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_stages_keep_the_columns(spark, make, edge_rows, sf_dir):
    docs = make(edge_rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    got = last(spark, docs, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "parity", "ids"]
    rows = got.collect()
    assert len(rows) == len(edge_rows) and all(r.parity for r in rows) and last(spark, docs.limit(0), sf_dir).count() == 0


def test_one_query_for_each_operator():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in QUERIES and set(ORACLES) <= set(QUERIES)
