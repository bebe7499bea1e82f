"""The corpus pipeline stage by stage, each against its operator's plain version."""

import corpus_pipeline as cp
from spanloom.llm import quality, substrings
from spanloom.llm.base import table


def test_stages(spark, data, tmp_path):
    docs, kept = table(spark, data, "documents"), []
    for i, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs)
        if i < len(cp.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    verdict = quality.judge(table(spark, data, "documents").select("doc_id", "text"))
    assert ids(kept[0]) == ids(verdict.where("kept"))
    assert set(ids(kept[1])) < set(ids(kept[0])) and len(set(ids(kept[1]))) == len(ids(kept[1]))
    before = [tuple(r) for r in kept[1].select("doc_id", "text").collect()]
    assert sorted((r.doc_id, len((r.text or "").split())) for r in kept[2].collect()) == sorted((d, n - gone) for d, n, gone, _ in substrings.brute_force(before))
    words = sum(len(r.text.split()) for r in kept[2].collect())
    assert abs(sum(len(r.text.split()) for r in kept[3].collect()) - 1.5 * words) < 30
    assert all(r.n_chars == len(r.text) for r in kept[3].collect())
    assert set(ids(kept[4])) == set(ids(kept[3]))


def test_no_documents(spark, data):
    none = table(spark, data, "documents").where("false")
    for _, stage in cp.STAGES:
        assert stage(spark, none, data).count() == 0


def test_run(spark, data):
    assert cp.run(spark, data).count() > 0


def test_odd_rows(spark, data, odd):
    """Nulls, repeated rows, long texts, and columns whose names clash with the operators' own, through all stages."""
    docs = odd.withColumnsRenamed({"size": "kept_sha256", "row": "rejected_by"})
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert {r.rejected_by for r in docs.collect()} <= {"s"} and {r.kept for r in docs.collect()} <= {True}
    assert sorted({r.doc_id for r in docs.collect()}) and cp.packing(spark, docs, data).count() > 0
