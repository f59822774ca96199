import corpus_pipeline
from tidewright.llm import language, packing, secrets, simhash, spans


def test_stages_chain_and_agree_with_plain_steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = corpus_pipeline.run(spark, sf).collect()
    kept = language.keep_identified(docs).collect()
    assert len(kept) == docs.count()  # every text has a letter
    near = {r["doc_id"] for r in simhash.near_duplicates(docs).collect() if r["kept"]}
    one = docs.where(docs.doc_id.isin(near))
    two = corpus_pipeline.substring_dedup(spark, one, sf)
    three = corpus_pipeline.secret_scans(spark, two, sf)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in three.select("doc_id").collect()} <= near
    assert three.columns == two.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in three.collect())
    want = sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packing.cut(three).collect())
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert secrets.scan(three).count() == 0
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "secret_scans", "best_fit_packing"]


def test_stages_on_edges(spark, edge_docs, no_docs, sf):
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            out.collect()
            docs = docs if docs is no_docs else out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect() is not None
    assert spans.deduplicate(no_docs).count() == 0
