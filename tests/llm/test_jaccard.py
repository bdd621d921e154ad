"""Links and classes against brute force; tiles, pruning and components."""

import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.llm import components as graph
from fieldtally.llm import jaccard, queries
from fieldtally.llm.components import components
from fieldtally.llm.shared import written


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(docs, threshold=0.8):
    """{doc: (class, links, texts)} of (doc, text) pairs with distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    met = {(min(p), max(p)) for group in where.values() for p in combinations(group, 2)}
    links = defaultdict(set)
    for i, j in met:
        common = len(sets[i] & sets[j])
        if common >= threshold * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
            links[i].add(j)
            links[j].add(i)
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            best = min([label[i], *(label[j] for j in links[i])])
            changed |= best != label[i]
            label[i] = best
    return {i: (label[i], len(links[i]), len({sets[j] for j in links[i]} - {sets[i]})) for i in sets}


def near(rnd, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rnd.randrange(len(words))] = f"w{rnd.random()}"
    return " ".join(words)


def corpus(seed=2):
    rnd = random.Random(seed)
    texts = []
    for group in range(12):
        words = [f"t{rnd.randrange(500)}" for _ in range(rnd.choice([6, 40, 200]))]
        texts += [near(rnd, words, rnd.randrange(6)) for _ in range(rnd.choice([1, 3, 40]))]
        texts += [" ".join(words)] * rnd.choice([1, 5])
    texts += ["one", "one", "one two three", "", "a b c d e", "a b c d e f"]
    return list(enumerate(texts))


def test_links_are_those_of_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for sizes in ({}, {"block": 4, "verified": 4}):
        rows = jaccard.join(frame, **sizes).collect()
        assert {r.doc_id: (r.class_id, r.n_links, r.n_texts) for r in rows} == brute(docs)
        assert len(rows) == len(docs)


def test_registered_query(spark, testdata):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{testdata}/documents.parquet").collect()]
    rows = queries.queries()["op4_jaccard"](spark, testdata).collect()
    assert {r.doc_id: (r.class_id, r.n_links, r.n_texts) for r in rows} == brute(docs)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [
        (5, "a b c d e f g"), (5, "a b c d e f g"), (3, "a b c d e f g"), (None, "a b c d e f g"),
        (None, "only here"), (None, "only here"), (7, None), (8, ""), (9, " \n "), (8, ""), (11, long), (10, long),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({"node": F.lit(1), "ID": F.lit("x"), "t": F.lit(2), "odd.name": F.lit(3)})
    found = jaccard.join(docs).collect()
    assert len(found) == len(rows)
    four = [r for r in found if r.class_id == 3]
    assert len(four) == 4 and {r.n_links for r in four} == {3}
    assert [r.n_links for r in found if r.doc_id in (7, 8, 9)] == [0] * 4
    assert {r.class_id for r in found if r.doc_id in (10, 11)} == {10}
    kept = jaccard.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["10", "3", "7", "8", "8", "9", "None"]
    none = docs.where("doc_id > 99")
    assert jaccard.join(none).count() == 0 and jaccard.without_copies(none).count() == 0


def test_one_document_of_each_group_stays(spark):
    docs = corpus(seed=9)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r.doc_id for r in jaccard.without_copies(frame).collect()}
    assert kept == {label for label, _, _ in brute(docs).values()}


def test_signatures_estimate_the_similarity():
    a = " ".join(f"w{i}" for i in range(1000))
    b = " ".join(f"w{i}" for i in range(100, 1100))
    made, counts = jaccard.shingles_of([a, b])
    x, y = jaccard.signatures(made, counts)
    sets = shingles(a), shingles(b)
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert counts.tolist() == [996, 996]
    assert abs((x == y).mean() - true) < 0.1


def test_the_posterior_keeps_pairs_at_the_threshold():
    needed = jaccard.least_matches(0.8, jaccard.TOLERANCE)
    rnd = np.random.default_rng(1)
    hits = rnd.random((200_000, jaccard.HASHES)) < 0.8
    total = hits.cumsum(axis=1)[:, jaccard.STEP - 1 :: jaccard.STEP]
    assert ((total >= needed).all(axis=1)).mean() > 0.99999
    other = (rnd.random((20_000, jaccard.HASHES)) < 0.35).cumsum(axis=1)[:, jaccard.STEP - 1 :: jaccard.STEP]
    assert (other >= needed).all(axis=1).mean() < 0.001
    assert (np.diff(needed) >= 0).all()


def templated(n=1200, words=300, same=0.75):
    """Texts that share runs of a common text; no two are linked."""
    base = [f"b{i}" for i in range(words)]
    own = int(words * (1 - same))
    return [" ".join(base[: words - own] + [f"o{k}x{i}" for i in range(own)]) for k in range(n)]


def test_few_texts_on_a_template_pass_the_long_signature():
    texts = templated()
    made, counts = jaccard.shingles_of(texts)
    long = jaccard.short(jaccard.signatures(made, counts, 0, jaccard.LONG))
    a, b = map(np.array, zip(*combinations(range(len(texts)), 2), strict=True))
    first, second = set(made[: counts[0]].tolist()), set(made[counts[0] : counts[:2].sum()].tolist())
    assert 0.57 < len(first & second) / len(first | second) < 0.63
    passed = []
    for sig in (long[:, : jaccard.HASHES], long):
        rate = 0
        for part in np.array_split(np.arange(len(a)), 40):
            stays = jaccard._stays(sig[a[part]], sig[b[part]], counts[a[part]], counts[b[part]], 0.8, jaccard.TOLERANCE)
            rate += stays.sum()
        passed.append(rate / len(a))
    assert passed[0] > 0.2 and passed[1] < 0.01
    reached = [len(others) for _, others in jaccard._reached(long, counts, 0.8, jaccard.TOLERANCE)]
    assert sum(reached) < len(texts) / 10


def test_texts_on_a_template_and_links_among_them(spark):
    texts = templated(n=300)
    texts += [t + " end" for t in texts[:5]]
    docs = list(enumerate(texts))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = jaccard.join(frame, block=64, verified=32).collect()
    assert {r.doc_id: (r.class_id, r.n_links, r.n_texts) for r in rows} == brute(docs)


def test_the_long_posterior_keeps_pairs_at_the_threshold():
    needed = jaccard.least_matches(0.8, jaccard.TOLERANCE, jaccard.LONG)
    assert len(needed) == jaccard.LONG // jaccard.STEP
    hits = np.random.default_rng(2).random((100_000, jaccard.LONG)) < 0.8
    total = hits.cumsum(axis=1, dtype=np.int16)[:, jaccard.STEP - 1 :: jaccard.STEP]
    assert ((total >= needed).all(axis=1)).mean() > 0.99999


def test_keys_of_any_type(spark):
    docs = corpus(seed=5)
    expected = brute([(f"k{i:04}", t) for i, t in docs])
    frame = spark.createDataFrame([(f"k{i:04}", t) for i, t in docs], "doc_id string, text string")
    found = jaccard.join(frame)
    assert found.schema["class_id"].dataType.simpleString() == "string"
    assert {r.doc_id: (r.class_id, r.n_links, r.n_texts) for r in found.collect()} == expected
    kept = {r.doc_id for r in jaccard.without_copies(frame).collect()}
    assert kept == {label for label, _, _ in expected.values()}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rnd = random.Random(shape)
    edges = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(50, i) for i in range(100)],
        "random": [(rnd.randrange(80), rnd.randrange(80)) for _ in range(50)],
        "none": [],
    }[shape]
    label = {i: i for e in edges for i in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in found} == label and len(found) == len(label)


def test_edges_that_are_stars_take_no_round(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(graph, "written", lambda df, name: steps.append(name) or written(df, name))
    edges = [(5, 1), (1, 9), (9, 1), (8, 2), (7, 7), (2, 2), (None, 3), (4, None)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, found)) == [(1, 1), (2, 2), (5, 1), (7, 7), (8, 2), (9, 1)]
    assert steps == ["edges"]


def test_forests_of_tiles_are_stars(spark):
    # Neighbours in this chain pass, others do not: all lead to the smallest all the same.
    sig = np.zeros((6, 128), dtype=np.uint8)
    for i in range(6):
        sig[i, 14 * i :] = 1
    nodes = [30, 50, 10, 40, 60, 20]
    rows = [(1, 0, node, 100, row.tobytes()) for node, row in zip(nodes, sig, strict=True)]
    tiles = spark.createDataFrame(rows, "key long, tile long, node long, n int, sig binary").coalesce(1)
    found = jaccard._forests(tiles, 0.8, 1e-9).collect()
    assert sorted(map(tuple, found)) == [(node, 10) for node in sorted(nodes) if node != 10]
