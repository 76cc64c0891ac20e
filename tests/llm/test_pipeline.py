"""The corpus pipeline against the brute-force versions, stage after stage."""

import plain
from test_operators import corpus

from eventloom.llm import langid


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows, item = corpus()
    documents = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = {r.doc_id for r in langid.accepted(documents).collect()}
    texts = [(r[0], r[1]) for r in rows if r[0] in left]
    texts = [(d, t) for (d, t), (_, _, c) in zip(texts, plain.classes(texts, 5, 80, 100), strict=True) if d == c]
    texts = [(d, t) for (d, t), e in zip(texts, plain.leaks(texts, [(1, item)]), strict=True) if not e[3]]
    enc = plain.encoding()
    expected = {d: enc.encode_ordinary(plain.redacted(t)) for d, t in texts}
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: r.ids for r in found.collect()} == expected
    stage = documents
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == documents.columns
