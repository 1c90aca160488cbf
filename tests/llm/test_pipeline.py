from tests.conftest import DATA
from turnstone.llm import pipeline, simhash, substring_dedup


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, f"{DATA}/sf0.001")
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if name != "pack_sequences":
            assert docs.columns == columns
        if name == "near_dedup":
            want = {r.component_id for r in simhash.near_duplicates(before).collect()}
            assert {r.doc_id for r in docs.collect()} == want
        if name == "passage_dedup":
            kept = {r.doc_id: r for r in substring_dedup.remove_repeats(before).collect()}
            rows = {r.doc_id: r for r in docs.collect()}
            assert set(rows) == {i for i, r in kept.items() if not r.n_removed or r.n_removed < r.n_words}
            assert all(r.text == (kept[i].kept if kept[i].n_removed else kept[i].text) and r.n_chars == len(r.text) for i, r in rows.items())
        if name == "redact_secrets":
            assert docs.count() == before.count() and docs.where("text LIKE '%AKIA%'").count() == 0
        if name == "pack_sequences":
            assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}


def test_run_and_odd_rows(spark, odd_docs, no_docs, tmp_path):
    assert pipeline.run(spark, f"{DATA}/sf0.001").count() > 0
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        assert (pipeline.run(spark, str(tmp_path / name)).count() > 0) == (name == "odd")
