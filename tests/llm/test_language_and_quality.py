from __future__ import annotations

import gc
import weakref
import zlib

import numpy as np
import pytest

from weirflow.llm import langid, quality, queries


def fold(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_language_query(spark, sf_dir, docs):
    got = queries.op2_language_id(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97


def test_quality_query(spark, sf_dir, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.op1_quality_classifier(spark, sf_dir).collect()}
    assert sorted(got) == sorted(docs)
    assert all(r.held_out == (fold(i, 5) == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    assert np.mean([got[i].predicted == q for i, q in labels.items()]) > 0.9


def by_hand(scores, switch):
    """The best path by trying all."""
    import itertools

    best = max(itertools.product(range(scores.shape[1]), repeat=len(scores)), key=lambda p: sum(scores[i, k] for i, k in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:], strict=False)))
    return sum(scores[i, k] for i, k in enumerate(best)) - switch * sum(a != b for a, b in zip(best, best[1:], strict=False))


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(1)
    scores = rng.normal(size=(20, 3)).astype(np.float32)
    texts = [rng.integers(0, 20, n) for n in (0, 1, 5, 6, 3, 6)]
    for words, path in zip(texts, langid.viterbi(scores, texts, 1.0), strict=True):
        assert len(words) == len(path)
        if len(words):
            own = scores[words]
            got = sum(own[i, k] for i, k in enumerate(path)) - 1.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))
            assert got == pytest.approx(by_hand(own, 1.0), abs=1e-5)


@pytest.fixture(scope="module")
def model():
    english = "the cat and the dog are in the house with that other thing " * 5
    german = "der hund und die katze sind nicht auf dem haus mit einem anderen " * 5
    russian = "это просто русский текст о доме и собаке " * 5
    return langid.Model([("en", english), ("de", german), ("ru", russian)])


def test_mixed_text_is_labelled_in_spans(model):
    text = "the cat and the dog are in the house " + "der hund und die katze sind nicht auf dem haus " + "русский текст о собаке это просто"
    lang, score, spans = next(langid.Labeller(model, 3.0).predict([text]))
    assert [s[0] for s in spans] == ["en", "de", "ru"] and spans[0][1:] == (0, 9) and lang == "de" and 0 < score < 1


def test_scripts_narrow_candidates(model):
    assert [r[0] for r in langid.Labeller(model).predict(["русский", "кот кот", "cat", "Katze und"])] == ["ru", "ru", "en", "de"]
    assert langid.script("abc") == "Latin" and langid.script("дом") == "Cyrillic" and langid.script("漢字") == "Han" and langid.script("ñandú") == "Latin"


def test_odd_texts_have_no_language(model):
    got = list(langid.Labeller(model).predict([None, "", " \n", "123 !! ²½ Ⅷ_", "a" * 300_000, "x " * 50_000]))
    assert [r[0] for r in got[:4]] == ["und"] * 4 and all(r[1] == 0 for r in got[:4]) and all(r[0] != "und" for r in got[4:])
    assert next(langid.Labeller(model).predict(["漢字"]))[1] <= 0.5


def test_caches_do_not_change_results(model, monkeypatch):
    texts = [f"the cat number word{i} und der hund{i}" for i in range(300)]
    whole = list(langid.Labeller(model).predict(texts))
    monkeypatch.setattr(langid, "CORES", 20)
    monkeypatch.setattr(langid, "PASS_WORDS", 50)
    assert list(langid.Labeller(model).predict(texts)) == whole


def test_a_labellers_caches_go_with_its_last_use(model):
    gc.disable()
    try:
        labeller = langid.Labeller(model)
        assert [r[0] for r in labeller.predict(["the cat"])] == ["en"]
        left = weakref.ref(labeller.parts)
        labeller = None
        assert left() is None
    finally:
        gc.enable()


@pytest.mark.parametrize("rows", [[], [(None, None, None), (1, None, "en"), (2, "", None), (2, "the cat", "en"), (2, "the cat", "en")]])
def test_language_of_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'x' as lang_pred", "text as spans")
    model = langid.train(df)
    got = langid.predict(df, model)
    assert got.count() == len(rows) and got.columns == ["doc_id", "lang_pred", "score", "spans"]
    kept = langid.keep_known(df, model)
    assert kept.columns == df.columns and kept.count() == sum(bool(r[1]) for r in rows)


@pytest.mark.parametrize("rows", [[], [(None, None), (1, None), (2, ""), (2, "good text here"), (2, "good text here")]])
def test_quality_of_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "0 as quality")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality.score(df, quality.train(df, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)


def test_training_never_sees_the_held_out_fold(spark):
    docs = spark.createDataFrame([(i, f"{('bad', 'good')[i % 2]} text") for i in range(200)], "doc_id long, text string")
    right = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    turned = spark.createDataFrame([(i, i % 2 if fold(i, 5) else 1 - i % 2) for i in range(200)], "doc_id long, quality int")
    a, b = (quality.score(docs, quality.train(docs, x)).orderBy("doc_id").collect() for x in (right, turned))
    assert a == b
    assert all((r.score > 0.5) == bool(r.doc_id % 2) for r in a)


def test_shapes():
    assert [quality.shape(p) for p in ("Hello", "HELLO!!!", "a1", "|", "the***")] == ["Aaa", "AA!!", "a9", "|", "aa**"]


def test_a_text_without_spaces_is_read_to_its_end(model):
    english, german = "thecatandthedogareinthehouse" * 4, "derhundunddiekatzesindnichtaufdemhaus" * 12
    (lang, _, spans), (_, _, apart) = langid.Labeller(model, 3.0).predict([english + german, "cat " + english + "кот" * 60 + " кот"])
    assert lang == "de" and spans[0] == ("en", 0, 1) and ("de", 0, 1) in spans
    assert apart[0][0] == "en" and apart[-1] == ("ru", 1, 3)
    word = "abcdefgh" * 40 + "xyz"
    cut = langid.pieces(word)
    assert "".join(p[0] for p in cut) == word
    assert sorted(t[j : j + n] for _, t, k in cut for n in langid.ORDERS for j in range(min(k, len(t) - n + 1))) == sorted(langid.grams(word))


def test_every_language_is_learned(spark):
    rows = [(i, f"l{i % 230:03d}", "the cat") for i in range(1380)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert model.langs == sorted({lang for i, lang, _ in rows if fold(i, 3) != 1}) and len(model.langs) > 200


def test_quality_reads_a_part_without_spaces_to_its_end():
    reader = quality.Reader()
    words, shapes, _ = reader.read("first,second/third")
    assert len(set(words)) == 3 and words.tolist() == reader.read("first second third")[0].tolist() and len(shapes) == 1
    long = "ab," * 100
    for one, other in ((long + "x", long + "y"), ("." * 100 + "1", "." * 100 + "2")):
        assert reader.read(one)[0].tolist() != reader.read(other)[0].tolist()
    assert reader.read("." * 100 + "1")[1].tolist() != reader.read("." * 100 + "A")[1].tolist()
