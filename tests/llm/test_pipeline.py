"""Every stage on its own input, by brute force where there is one; then the whole pipeline."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from fieldtally.llm import pii
from test_jaccard import brute, corpus
from test_sites_and_lines import counts


@pytest.fixture(scope="module")
def steps(spark, testdata):
    """{stage: (input rows, output)}, each output written and read again."""
    docs = spark.read.parquet(f"{testdata}/documents.parquet")
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, testdata), f"test-{name}")
        made[name] = before, docs
    return made


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_stages_keep_the_columns(steps):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_rules", "near_duplicates", "personal_data", "packing"]
    for name in names[:-1]:
        before, after = steps[name]
        assert after.schema == before.schema


def test_languages_known_from_labels_stay(steps):
    before, after = steps["language_id"]
    assert after.count() == before.count()  # every document here is in one of four languages


def test_quality_rules_reject_what_fails(steps):
    before, after = map(texts, steps["quality_rules"])
    assert after.keys() <= before.keys()
    for doc, text in before.items():
        words, _, _, _, repeated = counts(text)
        if words < 50 or 100 * repeated > 50 * words:
            assert doc not in after
        else:  # no document of these is depleted
            assert set(after[doc].split("\n")) <= set(text.split("\n"))
            assert len(after[doc].split()) >= 0.3 * words


def test_one_of_each_group_stays(steps):
    before, after = map(texts, steps["near_duplicates"])
    assert after.keys() == {label for label, _, _ in brute(list(before.items())).values()}
    assert all(after[d] == before[d] for d in after)


def test_personal_data_is_gone(steps):
    before, after = map(texts, steps["personal_data"])
    assert after == {d: pii.redacted(t) for d, t in before.items()}
    assert any(after[d] != before[d] for d in after)
    rows = steps["personal_data"][1].collect()
    assert all(r.n_chars == len(r.text) for r in rows)


def test_sequences_hold_every_document(steps):
    before, after = steps["packing"]
    length, size = defaultdict(int), defaultdict(int)
    for r in after.collect():
        length[r.doc_id] += r.length
        size[r.sequence_id] += r.length
        total = r.doc_tokens
        assert len(r.ids) == 4 * r.length and r.length <= total
    assert length.keys() == texts(before).keys() and max(size.values()) <= 2048


def test_run_is_registered(spark, testdata, steps):
    run = __spark_entry__.queries()["pipeline"]
    assert run(spark, testdata).count() == steps["packing"][1].count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_tables(spark, testdata):
    long = " ".join(f"the{i % 7001} and{i}" for i in range(20000))
    rows = [(1, None, "en", None), (2, "", None, "a"), (None, dict(corpus())[0] or "x", "en", "a"), (4, long, "en", "a"),
            (4, long, "en", "a"), (5, long + " m@x.org", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = {"score": F.lit(1), "removed": F.lit(2), "_id": F.lit(3), "ids": F.lit(4), "Text_": F.lit(5), "t": F.lit(6)}
    for frame in (docs.withColumns(extra), docs.withColumns(extra).where("doc_id > 99")):
        for name, stage in corpus_pipeline.STAGES:
            after = corpus_pipeline.written(stage(spark, frame, testdata), f"test-odd-{name}")
            if name != "packing":
                assert after.columns == frame.columns
            frame = after
        assert frame.select("doc_id").distinct().count() <= 2
