"""Line frequency and site quality: SQL, hand-made cases and held-out labels."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
import corpus_pipeline
from fieldtally.llm import lines, oracle, quality, queries


def test_lines_equal_their_sql(spark, testdata, oracle_con):
    found = queries.queries()["op7_lines"](spark, testdata)
    assert compare.differences(found, oracle_con, oracle.SQL["op7_lines"]) is None


@pytest.fixture(scope="module")
def oracle_con(testdata):
    return compare.connect(testdata)


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {j for w in where.values() if len(w) > 1 for i in w for j in (i, i + 1, i + 2)}
    full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)),
        len(repeated),
    )


TEXTS = [
    None, "", "\n\n", "one", "a b c a b c", "a a a a", "a b a b a b a", "x\nx\n y\nx \n\n", "é漢 \x0b\x0c\r\x1c #|",
    "w " * 20000, " ".join(f"w{i % 977}" for i in range(20000)), "$x$ [a] \\d .*",
]


def test_counts_of_odd_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = lines.counted(docs).collect()
    for r in rows:
        assert tuple(r[c] for c in lines.COUNTS) == counts(TEXTS[r.doc_id])
        words, repeated = r.n_words, r.n_repeat_words
        assert r.base_failed == (words < 50 or 100 * repeated > 50 * words)


def body(i, n=60):
    return " ".join(f"own{i}x{k}" for k in range(n))


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, removed int")


def test_frequent_lines_go_and_depleted_documents_too(spark):
    line = "Shared  line " + " ".join(f"s{k}" for k in range(30))
    whole = " ".join(f"c{k}" for k in range(60))
    docs = [(i, "a", f"{line.upper() if i % 2 else line}\n{body(i)}", 0) for i in range(20)]
    docs += [(100 + i, "a", f"{whole}\n{body(i, 5)}", 0) for i in range(8)]  # nothing much but the line
    docs += [(200 + i, "b", f"{line}\n{body(200 + i)}", 0) for i in range(3)]  # rare on this host
    docs += [(300 + i, None, whole, 0) for i in range(9)]  # copies of one text are one document
    frame = rows_of(spark, docs)
    judged = {r._id: r for r in lines.verdicts(frame).collect()}
    assert judged[0].n_removed_words == 0 and judged[1].n_removed_words == 32
    assert all(judged[i].kept for i in range(20))
    assert [judged[100 + i].kept for i in range(8)] == [True] + [False] * 7
    assert all(judged[200 + i].n_removed_words == 0 for i in range(3))
    assert all(judged[300 + i].kept for i in range(9))
    kept = lines.cleaned(frame)
    assert kept.columns == frame.columns
    text = {r.doc_id: r.text for r in kept.collect()}
    assert text[0] == docs[0][2] and text[1] == body(1) and len(text) == 20 + 1 + 3 + 9


def test_a_line_goes_from_a_large_host_too(spark):
    """Eight of 500 documents are less than 2%; they were let through by the share."""
    line = "Licence of this text " + " ".join(f"s{k}" for k in range(30))
    docs = [(i, "a", f"{line}\n{body(i)}" if i < 8 else body(i), 0) for i in range(500)]
    docs += [(1000 + i, "b", f"{line}\n{body(1000 + i)}", 0) for i in range(5)]  # not above the count
    frame = rows_of(spark, docs)
    text = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, frame, "").collect()}
    assert len(text) == len(docs)
    assert sorted(i for i, t in text.items() if line in t) == [0, *range(1000, 1005)]
    assert sum(r.n_removed_words > 0 for r in lines.verdicts(frame).collect()) == 0  # as the SQL has it


def test_nulls_repeats_and_no_rows(spark):
    docs = [(1, None, None, 0), (None, "a", body(1), 0), (2, "a", body(2), 0), (2, "a", body(2), 0), (3, "a", "", 0)]
    frame = rows_of(spark, docs)
    assert sorted(r.kept for r in lines.verdicts(frame).collect()) == [False, False, True, True, True]
    assert sorted(str(r.doc_id) for r in lines.cleaned(frame).collect()) == ["2", "2", "None"]
    assert lines.cleaned(frame.where("doc_id > 9")).count() == 0


def test_no_python_in_the_plan(spark, testdata):
    plan = queries.queries()["op7_lines"](spark, testdata)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_of_held_out_documents(spark, testdata):
    found = queries.queries()["op2_quality"](spark, testdata)
    truth = spark.read.parquet(f"{testdata}/labels.parquet").select("doc_id", "quality")
    rows = found.join(truth, "doc_id").where("held_out").collect()
    right = sum(r.kept == (r.quality == 1) for r in rows)
    assert len(rows) > 50 and right / len(rows) > 0.95
    assert found.count() == spark.read.parquet(f"{testdata}/documents.parquet").count()


def site(spark, rows):
    names = "host string, path string, " + ", ".join(f"_{m} double" for m in quality.MEASURES) + ", _label int"
    return spark.createDataFrame([(h, p, *[0.0] * len(quality.MEASURES), y) for h, p, y in rows], names).select(
        F.col("host").alias("_host"), F.col("path").alias("_path"), "host", "path", *(f"_{m}" for m in quality.MEASURES), "_label"
    )


def test_sparse_sites_shrink_to_their_prior(spark):
    rows = [("good", "x", 1)] * 200 + [("bad", "x", 0)] * 200 + [("new", "x", 0)] + [("new", "x", None)]
    rows += [("mixed", "p", 1)] * 100 + [("mixed", "q", 0)] * 100 + [(None, None, None)] * 2
    found = quality.combine(site(spark, rows), quality.Classifier([0.0] * len(quality.MEASURES), 0.0))
    by = {(r.host, r.path): r for r in found.collect()}
    assert found.count() == len(rows)
    assert by["good", "x"].p_quality > 0.9 > 0.1 > by["bad", "x"].p_quality
    assert by["mixed", "p"].path_rate > 0.9 > 0.1 > by["mixed", "q"].path_rate
    assert abs(by["mixed", "p"].host_rate - 0.5) < 0.05
    assert 0.2 < by["new", "x"].path_rate < 0.8 and 0.3 < by[None, None].path_rate < 0.7


def test_quality_without_usable_labels(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, None, "x y"), (2, None, "x y")], "doc_id long, source string, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    args = (F.col("source"), F.lit("p"), ["doc_id"])
    rows = quality.judge(docs, labels, *args).collect()
    assert len(rows) == 3 and all(abs(r.p_quality - 0.5) < 1e-6 for r in rows)
    assert quality.judge(docs.where("doc_id > 9"), labels, *args).count() == 0


def test_copies_take_their_part_of_the_fit(spark, monkeypatch):
    """Half of the labelled rows have equal measures; by a hash of them all went in, or none."""
    names = [f"_{m}" for m in quality.MEASURES]
    fitted = []
    monkeypatch.setattr(quality, "logistic", lambda x, y, times: fitted.append((x, y, times)))
    for value in range(4):
        rows = [(float(value if i % 2 else 100 + i), *[0.0] * (len(names) - 1), i % 3 // 2) for i in range(6000)]
        frame = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", _label int")
        quality.fit(frame, fit_rows=300)
        x, y, times = fitted[-1]
        assert len(y) <= 200 and 250 <= times.sum() <= 350
        assert 148 <= times[x[:, 0] == value].sum() <= 152


def test_a_weighted_fit_is_that_of_the_repeated_rows():
    rnd = np.random.default_rng(1)
    x, times = rnd.normal(size=(60, 9)), rnd.integers(1, 5, 60)
    y = (x[:, 0] + rnd.normal(size=60) > 0).astype(float)
    one = quality.logistic(x, y, times=times.astype(float))
    other = quality.logistic(np.repeat(x, times, axis=0), np.repeat(y, times))
    assert np.allclose([*one.weights, one.constant], [*other.weights, other.constant])


def _prior_worth(n, s, mean):
    """Documents that a prior of these means is worth, by the spread of the groups' rates beyond chance."""
    n, s, mean = np.array(n, float), np.array(s, float), np.broadcast_to(mean, len(n)).astype(float)
    by_chance = mean * (1 - mean)
    spread = (n * (s / n - mean) ** 2).sum() - by_chance.sum()
    excess = spread / max(n.sum() - (n**2).sum() / n.sum(), 1.0)
    if len(n) < 2 or excess <= 0:
        return 1e6
    return float(np.clip((n * by_chance).sum() / n.sum() / excess - 1, 1.0, 1e6))


def test_rates_of_hosts_and_paths_are_recomputed(spark):
    """Sites of different quality, nested, some with one document, a null host, a host of a third of all rows."""
    rnd = random.Random(11)
    sites = {("good", p): (0.95, 8) for p in "abcd"} | {("bad", p): (0.1, 8) for p in "abcd"}
    sites |= {("mixed", "up"): (0.95, 70), ("mixed", "down"): (0.05, 70), ("mixed", None): (0.5, 2)}
    sites |= {("big", "x"): (0.6, 90), (None, "y"): (0.3, 5)} | {(f"single{i}", "z"): (0.5, 1) for i in range(12)}
    docs, labels = [], []
    for (host, path), (rate, n) in sites.items():
        for _ in range(n):
            i, good = len(docs), rnd.random() < rate
            # Texts tell little: a label shows in them only now and then.
            words = [rnd.choice(["the", "cat", "of", "house", "and", "tree", "a", "river"]) for _ in range(rnd.randrange(30, 80))]
            words += ["###"] * rnd.randrange(0, 3 if good else 6)
            docs.append((i, " ".join(words), host, path))
            if rnd.random() < 0.8:
                labels.append((i, int(good)))
    frame = spark.createDataFrame(docs, "doc_id long, text string, host string, path string")
    known = dict(labels)
    rows = quality.judge(
        frame, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("host"), F.col("path"), ["doc_id", "host", "path"]
    ).collect()
    assert len(rows) == len(docs)
    share = {r.doc_id: float(known[r.doc_id]) if r.doc_id in known else 1 / (1 + math.exp(-r.evidence)) for r in rows}
    of_path, of_host = defaultdict(list), defaultdict(list)
    for r in rows:
        of_path[r.host, r.path].append(share[r.doc_id])
        of_host[r.host].append(share[r.doc_id])
    rate = (sum(share.values()) + 0.5) / (len(share) + 1)
    host_worth = _prior_worth([len(v) for v in of_host.values()], [sum(v) for v in of_host.values()], rate)
    whole = {h: (sum(v) + host_worth * rate) / (len(v) + host_worth) for h, v in of_host.items()}
    path_worth = _prior_worth(
        [len(v) for v in of_path.values()], [sum(v) for v in of_path.values()], [whole[h] for h, _ in of_path]
    )
    assert host_worth < 100 and path_worth < 100
    for r in rows:
        # A document does not vouch for itself.
        others = [sum(v) - share[r.doc_id] for v in (of_host[r.host], of_path[r.host, r.path])]
        host = (others[0] + host_worth * rate) / (len(of_host[r.host]) - 1 + host_worth)
        path = (others[1] + path_worth * host) / (len(of_path[r.host, r.path]) - 1 + path_worth)
        odds = r.evidence + math.log(path / (1 - path)) - math.log(rate / (1 - rate))
        assert r.host_rate == pytest.approx(host, abs=1e-6) and r.path_rate == pytest.approx(path, abs=1e-6)
        assert r.p_quality == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-6)
    by = {(h, p): np.mean([r.path_rate for r in rows if (r.host, r.path) == (h, p)]) for h, p in sites}
    assert by["good", "a"] > by["bad", "a"] + 0.3 and by["mixed", "up"] > by["mixed", "down"] + 0.3
