import corpus_pipeline
from weftgraph.llm import queries

SF = "/root/testdata/sf0.001"


def test_every_stage_keeps_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.count() <= kept
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "personal data", "BPE encoding"]


def test_pipeline_matches_the_operators_one_by_one(spark):
    from weftgraph.llm import decontaminate, quality, simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {i for i, t in rows.items() if not any(rule.rejects(quality.Figures(t)) for rule in quality.RULES.values())}
    fps = {i: simhash.fingerprint(rows[i]) for i in good}
    root = {i: i for i in good}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in good:
        for b in good:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    one = {find(i) for i in good}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    index = decontaminate.Benchmark([(r.item_id, r.text) for r in bench])
    order = sorted(one)
    hit = {order[h[0]] for h in index.hits([rows[i] for i in order])}
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").collect()} == one - hit
    assert out.where("NOT decodes").isEmpty()


def test_queries_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
