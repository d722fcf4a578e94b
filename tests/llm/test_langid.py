import pytest
from conftest import SF_DIR
from rows import DOCS, LONG, clashing, docs, empty

import __spark_entry__ as driver
from rasterlake.llm import langid


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.read.parquet(f"{SF_DIR}/documents.parquet"), per_lang=100)


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = driver.queries()["op9_language_id"](spark, SF_DIR).collect()
    assert len(got) == len(truth)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) <= 0.002 * len(got)


def test_counts_do_not_depend_on_blocks(monkeypatch):
    text = "Über den Häusern, 12 --- und mehr " * 40
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "BLOCK", 1 << 20)
    assert (langid.counts(text) == whole).all()
    assert langid.counts("").sum() == 0


def test_odd_rows(spark, model):
    rows = clashing(spark)
    found = langid.identify(rows, model)
    assert found.columns == [*rows.columns, "lang_pred", "_score", "_rejected"]
    got = {r.doc_id: r for r in found.filter("doc_id is not null").collect()}
    for i in (3, 4, 5, 9):
        assert (got[i].lang_pred, got[i]._score, got[i]._rejected) == ("und", 0.0, True)
    assert got[7].lang_pred == "de" and not got[7]._rejected
    assert langid.keep_identified(rows, model).columns == rows.columns
    assert langid.identify(empty(spark), model).count() == 0


def test_far_texts_are_rejected(spark, model):
    rows = [(1, "漢字仮名交じり文の例です。これは日本語の文章であり、学習した言語ではありません。" * 20, None, None), (2, "Привет, это русский текст, который далек от всех. " * 20, None, None)]
    assert all(r.rejected for r in langid.identify(docs(spark, rows), model).collect())


def test_nothing_to_learn_from(spark):
    model = langid.train(empty(spark))
    assert all(r.lang_pred == "und" and r.rejected for r in langid.identify(docs(spark), model).collect())
    only = langid.train(docs(spark, [(1, LONG, "x", None), (2, None, "y", None), (3, "text", None, None)]))
    assert set(only.langs) == {"x"}
    assert len(DOCS) == langid.identify(docs(spark), only).count()


def test_null_and_equal_ids_are_learned_from(spark):
    de = [f"Der Text Nummer {i} über das schöne Haus und die Straße am Wald." for i in range(400)]
    en = [(i, f"The text number {i} about the nice house and the road by the wood.", "en", None) for i in range(400)]
    for the_id in (None, 7):
        model = langid.train(docs(spark, en + [(the_id, t, "de", None) for t in de]), per_lang=20)
        assert set(model.langs) == {"de", "en"}
    same = langid.train(docs(spark, en + [(i % 3, "Immer derselbe deutsche Satz über die Straße.", "de", None) for i in range(900)]), per_lang=20)
    assert set(same.langs) == {"de", "en"}


def test_nearest_centroid_by_brute_force(spark, model):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(200).collect()
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows), model).collect()}
    for r in rows:
        tf = [float(c) for c in langid.counts(r.text)]
        vector = [__import__("math").log1p(c) * float(w) for c, w in zip(tf, model.idf)]
        norm = sum(v * v for v in vector) ** 0.5
        live = [(i, v / norm) for i, v in enumerate(vector) if v]
        cosines = [sum(v * float(c[i]) for i, v in live) for c in model.centroids]
        assert abs(max(cosines) - got[r.doc_id].score) < 1e-4
        assert max(c for c, lang in zip(cosines, model.langs) if lang == got[r.doc_id].lang_pred) > max(cosines) - 1e-4
