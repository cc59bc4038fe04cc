"""Each stage on the result of the one before, against what its operator says."""

import corpus_pipeline as cp
from strandloom.workspace import materialize


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, left = docs.columns, docs.count()
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    for name, stage in cp.STAGES[:-1]:
        docs = materialize(stage(spark, docs, small), name)
        assert docs.columns == columns
        assert 0 < docs.count() <= left
        if name == "line_dedup":
            assert docs.count() == left
            assert docs.where("n_chars <> length(text)").count() == 0
        left = docs.count()
    coded = cp.STAGES[-1][1](spark, docs, small)
    same = coded.join(docs, "doc_id").where("decoded_sha256 = sha2(cast(text as binary), 256)").count()
    assert same == coded.count() == left


def test_clean_documents_of_good_label_stay(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    kept = cp.drop_low_quality(spark, docs, small)
    good = docs.join(labels.where("quality = 1"), "doc_id")
    assert good.join(kept.select("doc_id"), "doc_id", "left_anti").count() <= 0.01 * good.count()


def test_odd_tables(spark, small):
    """Null and empty texts, repeated rows, clashing columns, a table without n_chars, an empty table."""
    long = "one very long text " * 20_000
    rows = [(1, None, "a"), (2, "", "b"), (3, "some plain words of a text", None), (3, "some plain words of a text", None), (4, long, "c"), (None, "a text without a key", "d")]
    docs = spark.createDataFrame([(d, t, s, "en", "x", 1, 0.5, "old") for d, t, s in rows], "doc_id long, text string, source string, lang string, kept string, n_lines int, quality double, ids string")
    for table in (docs, docs.limit(0)):
        step = table
        for name, stage in cp.STAGES[:-1]:
            step = materialize(stage(spark, step, small), f"odd_{name}")
            assert step.columns == docs.columns
        last = cp.STAGES[-1][1](spark, step, small)
        assert last.count() == step.count()
        assert table is not docs or {r.doc_id for r in step.collect()} <= {1, 2, 3, 4, None}
    lines = {r.doc_id: r.text for r in cp.drop_repeated_lines(spark, docs.where("doc_id <> 3"), small).collect()}
    assert (lines[1], lines[2], lines[4]) == ("", "", long)
