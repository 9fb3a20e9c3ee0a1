import corpus_pipeline as pipeline
from brute import contamination, jaccard_components, squeezed

from ragloom.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_stages_against_loops(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = set(texts)
    made = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(path := str(tmp_path / name.replace(" ", "-")))
        docs = spark.read.parquet(path)
        made[name] = docs

    def ids(name):
        rows = [r.doc_id for r in made[name].select("doc_id").collect()]
        assert len(rows) == len(set(rows))
        return set(rows)

    toxic = {r.doc_id for r in toxicity.op10_toxicity(spark, SF).filter("predicted = 1").collect()}
    kept -= toxic
    assert ids("toxicity") == kept

    groups = {}
    for i in kept:
        groups.setdefault(squeezed(texts[i]), []).append(i)
    kept = {min(g, key=lambda i: (-len(texts[i]), i)) for g in groups.values()}
    assert ids("exact dedup") == kept

    rows = [(i, texts[i]) for i in sorted(kept)]
    least = jaccard_components(rows)
    kept = {rows[i][0] for i, (_, c) in least.items() if c == rows[i][0]}
    assert ids("n-gram jaccard join") == kept

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    order = sorted(kept)
    kept = {i for i, (_, hit, _) in zip(order, contamination([texts[i] for i in order], items)) if not hit}
    assert ids("benchmark decontamination") == kept

    pieces = made["packing"].toPandas()
    assert set(pieces.doc_id) == kept
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()


def test_run_equals_the_stages(spark):
    assert pipeline.run(spark, SF).count() > 0
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram jaccard join", "benchmark decontamination", "packing"]
