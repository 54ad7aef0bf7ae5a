"""The pipeline and its stages on empty, unlabelled and odd tables, and against brute force on a table of planted rows."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_leaks, prose
from sparkwell.llm import secrets

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, folder, rows, items, kind=KIND):
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_empty_tables_stay_empty(spark, tmp_path):
    docs = written(spark, tmp_path, [], [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_unlabelled_documents_with_letters_stay(spark, tmp_path):
    rows = [(1, "The river ran slowly past the old mill.", None, "s", 39), (None, "Noch ein Satz über den Fluss.", None, "s", 29), (3, "12 34", None, "s", 5), (4, None, None, "s", None)]
    docs = written(spark, tmp_path, rows, [(1, None), (2, "")])
    kept = corpus_pipeline.language_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.text for r in kept.collect()} == {rows[0][1], rows[1][1]}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id or 0 for r in whole) == [0, 1]


def test_other_columns_and_repeated_rows(spark, tmp_path):
    """Columns named as the operators' own ones pass through unchanged; rows without doc_id are judged by their texts."""
    r = random.Random(2)
    item = "a farmer has seven green barrels of cider and sells three of them at the market today"
    texts = [prose(r, 30), item, prose(r, 25), prose(r, 25) + " password=hunter2hunter2"]
    rows = [(i, t, "en", "s", len(t), 7, "x") for t in texts for i in (None, None, 5)]
    kind = KIND + ", hash int, label string"
    docs = written(spark, tmp_path, rows, [(1, item)], kind)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert {(x.hash, x.label) for x in docs.collect()} == {(7, "x")}
    left = sorted((x.doc_id or 0, x.text) for x in docs.collect())
    clean = [texts[0], texts[2], texts[3].replace("password=hunter2hunter2", "[assign]")]
    assert left == sorted((i, t) for t in clean for i in (0, 0, 5))


@pytest.mark.parametrize("seed", [1, 2])
def test_stages_are_brute_force(spark, tmp_path, seed):
    """Near copies, benchmark passages and secrets among clean texts: what is left after each stage, by plain recounts."""
    r = random.Random(seed)
    items = [(k, prose(r, 14)) for k in range(6)]
    rows = []
    for i in range(90):
        words = prose(r, r.randint(30, 90)).split()
        if i % 9 == 4:
            words[10:10] = r.choice(items)[1].split()
        if i % 7 == 3:
            words.append("AKIA" + "B" * r.randint(8, 20))
        rows.append((i, " ".join(words), "en"))
    for i in range(90, 130):
        words = r.choice(rows[:90])[1].split()
        words[r.randrange(len(words))] = r.choice(words)
        rows.append((i, " ".join(words[: len(words) - r.randint(0, 3)]), "en"))
    rows += [(200, "", "en"), (201, "42", "en"), (202, None, None)]
    docs = written(spark, tmp_path, [(i, t, lang, "s", len(t or "")) for i, t, lang in rows], items)
    texts = {i: t for i, t, _ in rows if t and any(c.isalpha() for c in t)}
    groups = brute_components(texts)
    singles = {i: t for i, t in texts.items() if groups[i][1] == i}
    dirty = {d for d, _ in brute_leaks(list(singles.items()), items)}
    clean = {i: t for i, t in singles.items() if i not in dirty}
    assert dirty and len(singles) < len(texts)
    for k, want in enumerate((texts, singles, clean)):
        docs = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert {x.doc_id: x.text for x in docs.collect()} == want, corpus_pipeline.STAGES[k][0]
    told = {x.doc_id: (x.text, x.n_chars) for x in corpus_pipeline.secret_stage(spark, docs, str(tmp_path)).collect()}
    for i, t in clean.items():
        spans = secrets.python_spans(t)
        assert told[i] == ((t[: spans[0][0]] + "[access]", spans[0][0] + 8) if spans else (t, len(t)))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in packed} == set(clean)
