"""SuperMinHash ranks, and the groups against brute force and SQL."""

import random
import re
from itertools import combinations

import compare
import numpy as np
import pytest

from fieldtally.llm import jaccard, queries, superminhash


def shingles(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(docs):
    """{doc: (shingles, component)} of (doc, text) pairs with distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(sorted(sets), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
            a, b = sorted((root(i), root(j)))
            label[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def found(rows):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def plain(elements, places):
    """The definition: one permutation and one rank per round for each element, without stopping."""
    from fieldtally.llm.shared import mixed

    best = [1 << 64] * places
    for e in elements:
        p = list(range(places))
        for j in range(places):
            x = int(mixed(np.array([(int(e) + ((2 * j + 1) * 0x9E3779B97F4A7C15)) % (1 << 64)], dtype=np.uint64))[0])
            k = j + ((x >> 32) * (places - j) >> 32)
            p[j], p[k] = p[k], p[j]
            best[p[j]] = min(best[p[j]], j << 32 | x & 0xFFFFFFFF)
    return best


def test_ranks_are_those_of_the_definition():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 2, 30, 700])
    elements = rng.integers(0, 1 << 63, sizes.sum(), dtype=np.uint64)
    made = superminhash.signatures(elements, sizes)
    at = 0
    for row, n in zip(made, sizes, strict=True):
        assert row.tolist() == plain(elements[at : at + n], superminhash.PLACES)
        at += n


def test_estimate_varies_less_than_that_of_independent_hashes():
    rng = np.random.default_rng(4)
    equal = []
    for _ in range(300):
        e = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        a, b = superminhash.signatures(np.concatenate([e[:50], e[10:]]), np.array([50, 50]))
        equal.append((a == b).mean())
    p = 40 / 60
    assert abs(np.mean(equal) - p) < 0.01
    assert np.var(equal) < 0.9 * p * (1 - p) / superminhash.PLACES


def near(rnd, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rnd.randrange(len(words))] = f"w{rnd.random()}"
    return " ".join(words)


def corpus(seed=2):
    rnd = random.Random(seed)
    texts = []
    for _ in range(12):
        words = [f"T{rnd.randrange(500)}" for _ in range(rnd.choice([6, 40, 200]))]
        texts += [near(rnd, words, rnd.randrange(6)) for _ in range(rnd.choice([1, 3, 40]))]
        texts += [" ".join(words), " ".join(words).lower()] * rnd.choice([1, 3])
    return list(enumerate([*texts, "one", "One", "one two three", "", None, "a b c d e", "a b c d e f", "É f", "é f"]))


def test_groups_are_those_of_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for sizes in ({}, {"block": 4, "verified": 4}):
        rows = superminhash.near_duplicates(frame, **sizes).collect()
        assert found(rows) == brute(docs) and len(rows) == len(docs)
        assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_registered_query(spark, oracle, testdata):
    from fieldtally.llm import oracle as sql

    df = queries.queries()["op12_superminhash"](spark, testdata)
    assert compare.differences(df, oracle, sql.SQL["op12_superminhash"]) is None


def test_a_template_below_the_threshold_moves_no_sets(spark):
    rnd = random.Random(5)
    shared = [f"s{i}" for i in range(230)]
    texts = [" ".join([*shared, *[f"o{rnd.random()}" for _ in range(75)]]) for _ in range(60)]
    sets = [np.unique(jaccard.shingles_of([t])[0]) for t in texts]
    ranks = superminhash.signatures(np.concatenate(sets), np.array([len(s) for s in sets]))
    short = (superminhash.mixed(ranks) >> np.uint64(56)).astype(np.uint8)
    n = np.array([len(s) for s in sets])
    assert not list(superminhash._forest(short, n, superminhash.LEAST))
    docs = list(enumerate(texts))
    rows = superminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), verified=16)
    assert found(rows.collect()) == brute(docs)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_odd_rows(spark, kind):
    long = " ".join(f"w{i}" for i in range(60000))
    docs = [(2**60 + 3, long), (2**60 + 1, long + " end"), (5, None), (6, " \t"), (7, "x"), (7, "x"), (None, "x"), (None, "y")]
    if kind == "string":
        docs = [(f"d{i}" if i is not None else None, t) for i, t in docs]
    frame = spark.createDataFrame([(*d, 1, "z") for d in docs], f"doc_id {kind}, text string, node int, `a.b` string")
    rows = [tuple(r) for r in superminhash.near_duplicates(frame).collect()]
    a, b, c, d, e = (f"d{i}" if kind == "string" else i for i in (2**60 + 3, 2**60 + 1, 5, 6, 7))
    wanted = [
        (a, 59996, b, False), (b, 59997, b, True), (c, 0, c, True), (d, 0, d, True), (e, 1, e, True), (e, 1, e, True),
        (None, 1, e, False), (None, 1, None, True),
    ]
    assert sorted(rows, key=str) == sorted(wanted, key=str)
    assert superminhash.near_duplicates(frame.limit(0)).collect() == []
