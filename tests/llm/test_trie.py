"""The trie of conversation beginnings against brute force, SQL and odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import compare
import pytest

from fieldtally.llm import prefix_trie, queries


def rebuilt(rows):
    """{conv_id: turns} of (conv_id, turn, role, text), one turn number each."""
    own = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    return made


def brute(rows):
    made = rebuilt([r for r in rows if r[0] is not None])
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(own) - 1) * words
    found = set()
    for node, own in members.items():
        ends = ",".join(str(c) for c in own if len(made[c]) == len(node))
        found.add(
            (
                own[0], len(node), members[node[:-1]][0] if node else None, len(own), children.get(node, 0),
                leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return found


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def found(df):
    order = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = [tuple(r) for r in df.select(*order).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def talks(seed, n=150, most=9):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.randrange(1, most)):
            text = " ".join(rnd.choice("abc") for _ in range(rnd.randrange(3)))
            rows.append((c * rnd.choice([1, 1, 3]) if t == 0 else rows[-1][0], t, rnd.choice(["user", None]), text))
    # One number per conversation and turn.
    return list({(r[0], r[1]): r for r in rows}.values())


@pytest.mark.parametrize("slab, shard", [(32, 16384), (2, 7), (1, 40)])
def test_nodes_are_those_of_brute_force(spark, slab, shard):
    rows = talks(slab)
    long = [(40 + c, t, "user", f"x {t}") for c in (0, 1) for t in range(70)]
    rows = [r for r in rows if r[0] not in (40, 41)] + long
    assert found(prefix_trie.trie(frame(spark, rows), slab=slab, shard=shard)) == brute(rows)


def test_a_hot_beginning_spans_shards(spark):
    # Every conversation of three turns is the same one; every fifth goes on.
    rows = [(c, t, "user", f"turn {t}") for c in range(400) for t in range(3 + (c % 5 == 0))]
    assert found(prefix_trie.trie(frame(spark, rows), shard=16)) == brute(rows)


def test_registered_query_equals_sql(spark, oracle, testdata):
    from fieldtally.llm import oracle as sql

    df = queries.queries()["op13_prefix_trie"](spark, testdata)
    assert compare.differences(df, oracle, sql.SQL["op13_prefix_trie"]) is None


def test_odd_rows(spark):
    long = "w " * 200_000
    rows = [
        (7, None, None, None),
        (7, 0, "user", long),
        (-5, 1, "user", "a"),
        (2**60 + 1, 3, "x", "a b"),
        (None, 1, "user", "left out"),
    ]
    assert found(prefix_trie.trie(frame(spark, rows))) == brute(rows)
    assert found(prefix_trie.trie(frame(spark, rows[:0]))) == set()
    # Repeated rows are turns of their own; their order does not matter. Further columns do not either.
    twice = [(3, 0, "user", "a b")] * 3
    numbered = [(3, i, "user", "a b") for i in range(3)]
    extra = frame(spark, twice).selectExpr("*", "'x' AS k1", "1 AS slab", "2 AS `a.b`", "3 AS pos")
    assert found(prefix_trie.trie(extra)) == brute(numbered)
    # Turns of one number come in an order of their own, the same in every conversation.
    tied = [(c, 0, "user", t) for c in (60, 61) for t in "abcd"]
    nodes = found(prefix_trie.trie(frame(spark, tied)))
    assert max(n[1] for n in nodes) == 4
