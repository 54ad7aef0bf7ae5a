"""The pipeline's stages on a small table, against what each must drop and keep."""

import corpus_pipeline


def test_stages(spark, tmp_path):
    clean = "Der Hund lief über die Wiese und sah die Katze am Ufer des Flusses sitzen. "
    other = "The river ran slowly past the old mill while children played near the bridge. "
    item = "a farmer has seven green barrels of cider and sells three of them at the market today"
    rows = [
        (1, clean * 3, "de"), (2, other * 3, "en"), (3, other * 3 + "End.", "en"), (4, "12 -- 34", "en"), (5, None, None),
        (6, "We noted that " + item + " as told.", "en"), (7, "use password = hunter2hunter2 now, please do", "en"), (7, "use password = hunter2hunter2 now, please do", "en"),
        (8, "", None),
    ]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
        if k == 3:
            text = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert ids[0] == [1, 2, 3, 6, 7, 7]
    assert ids[1] == [1, 2, 6, 7]
    assert ids[2] == ids[3] == [1, 2, 7]
    assert text[7] == ("use [assign] now, please do", 27) and text[1][0] == clean * 3
    assert set(ids[4]) == {1, 2, 7}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in whole.select("doc_id").collect()) == ids[4]
