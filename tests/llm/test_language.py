"""Held-out accuracy, the filter's corrections, and odd inputs."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from fieldtally.llm import language, queries


def test_grams_of_texts():
    codes, counts = language.grams_of(["Ab c", "", None, "1 2", "é"])
    def code(s):
        return sum(ord(c) << 21 * i for i, c in enumerate(s))
    assert counts.tolist() == [3, 0, 0, 0, 1]
    assert codes.tolist() == [code(" ab"), code("ab "), code(" c "), code(" é ")]


def test_filters_list_all_languages_of_a_gram():
    grams = np.arange(1000, 1400)
    lang = np.array(["xx"] * 400 + ["yy"] * 200, dtype=object)
    model = language.build(lang, np.concatenate([grams, grams[:200]]), np.ones(600, dtype=int), 0.1, 16)
    found = model._lookup(grams.astype(np.uint64))[:, 0]
    assert model.languages == ["xx", "yy"]
    assert (found[:200] == 3).all() and (found[200:] & 1 == 1).all()
    other = model._lookup(np.arange(10**6, 10**6 + 20000).astype(np.uint64))[:, 0]
    assert abs((other & 1).mean() - model.false[0]) < 0.002


def test_more_languages_than_bits_of_a_byte():
    lang = np.repeat(np.array([f"l{i:02}" for i in range(20)], dtype=object), 50)
    grams = np.arange(1000)
    model = language.build(lang, grams, np.ones(1000, dtype=int), 0.2, 16)
    found = model._lookup(grams.astype(np.uint64))
    number = grams // 50
    assert ((found[grams, number // 8] >> (number % 8)) & 1).all()


@pytest.mark.parametrize("size", ["sf0.01"])
def test_held_out_accuracy(spark, testdata, size):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{testdata}/documents.parquet").collect()}
    rows = queries.queries()["op6_language"](spark, testdata).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.99


def test_odd_inputs(spark, testdata):
    docs = spark.read.parquet(f"{testdata}/documents.parquet")
    model = language.fit(docs)
    rows = [(1, None, 3), (2, "", 3), (3, "12 !!", 3), (4, "the " * 40000, 3), (4, "the " * 40000, 3)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score int")
    found = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert [found[i].score for i in (1, 2, 3)] == [0.0] * 3
    assert found[4].lang_pred == "en" and language.identify(odd, model).count() == 5
    assert language.identify(odd.where("doc_id > 9"), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "abc", None), (3, "12", "de")], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == []
    assert {r.lang_pred for r in language.identify(docs, model).collect()} == {"und"}


def test_the_sample_is_bounded(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('word ', id) AS text", "'en' AS lang")
    docs = docs.union(spark.createDataFrame([(9000, "une autre", "fr")], docs.schema))
    model = language.fit(docs, fit_rows=100)
    assert model.languages == ["en", "fr"]


def test_copies_of_one_text_take_their_part_of_the_sample(spark, monkeypatch):
    """A third of the rows is one text; by a hash of the text all of them went in, or none."""
    seen = spark.sparkContext.accumulator(0)
    whole = language.grams_of

    def counted(texts):
        seen.add(len(texts))
        return whole(texts)

    monkeypatch.setattr(language, "grams_of", counted)
    got = []
    build = language.build
    monkeypatch.setattr(language, "build", lambda lang, gram, n, *a: got.append(dict(zip(gram, n))) or build(lang, gram, n, *a))
    code = sum(ord(c) << 21 * i for i, c in enumerate("qqq"))
    for copy in ("qqq", "qqq qqq", "qqq b"):
        docs = spark.range(2000).selectExpr("id AS doc_id", f"if(id % 2 = 0, '{copy}', concat('word ', uuid())) AS text", "'en' AS lang")
        docs = language.written(docs, "test-copies")
        seen.value = 0
        language.fit(docs, fit_rows=100)
        assert 20 <= seen.value <= 100  # the copies are one of them
        assert 49 <= got[-1][code] / copy.count("qqq") <= 51


def signs(rnd, n):
    return "".join(map(chr, rnd.integers(0x4E00, 0x9F00, n)))


def test_a_script_with_many_grams_is_listed_and_kept(spark):
    """150,000 n-grams: a list of 20,000 knew an eighth of each text, and all were rejected."""
    rnd = np.random.default_rng(2)
    rows = [(i, signs(rnd, 500), "zh") for i in range(300)] + [(1000 + i, f"the text of it {i}", "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert corpus_pipeline.language_id(spark, docs, "").count() == len(rows)


def test_the_limit_is_that_of_the_language(spark, monkeypatch):
    """Texts of which three tenths are common: all of the language score about as much."""
    rnd = np.random.default_rng(3)
    common = [signs(rnd, 10) for _ in range(15)]
    rows = [(i, " ".join([*common, *(signs(rnd, 10) for _ in range(35))]), "zh") for i in range(400)]
    rows += [(1000 + i, "the text of it is the same in every document", "en") for i in range(20)]
    rows += [(2000, " ".join(signs(rnd, 10) for _ in range(50)), None)]  # nothing of it is known
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fit = language.fit
    monkeypatch.setattr(language, "fit", lambda docs: fit(docs, fit_rows=40))
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows} - {2000}


def test_a_filter_too_large_to_send_gives_the_same(spark, monkeypatch):
    rows = [
        (1, "the cat sat on the mat", "en", 5), (2, "le chat est sur la table", "fr", 6), (3, "the dog ate it", "en", 7),
        (4, "der hund ist im haus", "de", 8), (5, None, "de", 1), (6, "1 2 3", None, 1), (7, "zzz qqq", None, 2),
        (8, "le chien et le chat", None, 3), (8, "le chien et le chat", None, 3),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _row int")
    model = language.fit(docs)
    wanted = [tuple(r) for r in language.identify(docs, model).collect()]
    usual = [tuple(r) for r in language.usual_scores(docs, model).collect()]
    monkeypatch.setattr(language, "LISTED", 10)
    large = language.fit(docs)
    assert large.table is not None and large.languages == model.languages
    assert np.allclose(large.false, model.false)
    by_join = [tuple(r) for r in language.identify(docs, large).collect()]
    assert sorted(by_join, key=str) == sorted(wanted, key=str)
    assert sorted(map(tuple, language.usual_scores(docs, large).collect())) == sorted(usual)
    assert language.fit(docs.where("lang = 'none'")).languages == []


def test_score_is_that_of_plain_sets(spark):
    def grams(text):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        return [f" {w} "[i : i + 3] for w in words for i in range(len(w))]

    rows = [(1, "the cat sat on the mat", "en"), (2, "le chat est sur la table", "fr"), (3, "the dog ate le chat", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lists = {"en": set(grams(rows[0][1])), "fr": set(grams(rows[1][1]))}
    for r in language.identify(docs, language.fit(docs, cover=1.0, typical=0.0)).collect():
        own = grams(r.text)
        share = {name: sum(g in s for g in own) / len(own) for name, s in lists.items()}
        best = max(sorted(share), key=share.get)
        # A filter of some thousand places finds hardly anything that is not in it.
        assert r.lang_pred == best and abs(r.score - share[best]) < 0.05


def test_marks_stay_in_their_words():
    def words(text):
        codes, _ = language.grams_of([text])
        return ["".join(chr(int(c) >> 21 * i & 0x1FFFFF) for i in range(3)) for c in codes]

    assert words("हिन्दी भाषा") == [" हि", "हिन", "िन्", "न्द", "्दी", "दी ", " भा", "भाष", "ाषा", "षा "]
    assert words("\u0301\u0301 1") == [] and words("e\u0301a") == [" e\u0301", "e\u0301a", "\u0301a "]
    assert len(words("ภาษาไทยที่")) == 10
