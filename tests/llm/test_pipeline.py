"""The pipeline: each stage on what the one before kept, against the operators' own rules."""

import corpus_pipeline
from auditloom.llm import exact_dedup, quality, queries, sentencepiece_nbest

from test_similar_texts import kept as kept_of


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == docs.columns
            path = str(tmp_path / str(k))
            out.write.parquet(path)
            kept.append((docs, out := spark.read.parquet(path)))
            docs = out
        else:
            last = out.collect()
    before, after = kept[0]
    model = quality.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = {r.doc_id for r in quality.score_quality(before, model, score_col="s").collect() if r.s >= corpus_pipeline.LEAST_QUALITY}
    assert {r.doc_id for r in after.collect()} == want
    before, after = kept[1]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in exact_dedup.group_copies(before).collect() if r.kept}
    before, after = kept[2]
    assert {r.doc_id for r in after.collect()} == kept_of([(r.doc_id, r.text) for r in before.collect()])
    before, after = kept[3]
    ids = {r.doc_id for r in before.collect()}
    assert {r.doc_id for r in after.collect()} <= ids
    vocabulary = sentencepiece_nbest.Vocabulary(sentencepiece_nbest.read_model(queries.PIECES))
    texts = {r.doc_id: r.text for r in after.collect()}
    assert len(last) == after.count()
    assert all(sentencepiece_nbest.decode_ids(vocabulary, r.ids) == texts[r.doc_id] for r in last)


def test_encoding_searches_and_decodes(spark):
    """The last stage asks for several segmentations, as the encoding query does, and its ids are decoded."""
    rows = [(1, "The  cat sat\non a mat ▁ñ", "en", "a"), (2, "", "en", "b"), (3, None, None, None), (4, "word " * 500, "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in corpus_pipeline.STAGES[4][1](spark, docs, "").collect()}
    want = {r.doc_id: r.nbest for r in sentencepiece_nbest.encode(docs, sentencepiece_nbest.read_model(queries.PIECES), queries.N_BEST).collect()}
    assert {i: r.text for i, r in got.items()} == {i: text for i, text, *_ in rows} and [got[i].round_trip for i in (1, 2, 3, 4)] == [True, True, None, True]
    for i in (1, 2, 4):
        assert (got[i].ids, got[i].score, got[i].n_segmentations) == (want[i][0].ids, want[i][0].score, len(want[i]))
        assert got[i].margin == want[i][0].score - want[i][-1].score
    assert got[1].margin > 0 and got[1].n_segmentations == queries.N_BEST and got[3].ids is None
