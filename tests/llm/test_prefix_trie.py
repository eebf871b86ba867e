import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from stratalake.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    convs = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            convs[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        out[c] = convs.get(first, [])[:h] + own[h:]
    return out


def expected(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for node, ids in members.items():
        below = [v for v in members if v[: len(node)] == node]
        children = sum(len(v) == len(node) + 1 for v in below)
        leaves = sum(not any(w[:-1] == v for w in members if w) for v in below)
        saved = sum((len(members[v]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", v[-1][1])) for v in below if v)
        ends = ",".join(str(c) for c in sorted(c for c in ids if len(convs[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(ids), len(node), parent, len(ids), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows_of(seed, n=60, longest=7):
    rng = random.Random(seed)
    texts = ["hi", "hello there", "", None, "a  b\tc\x0bd", "é x 漢", "yes"]
    rows = []
    for c in range(-45, n):
        if rng.random() < 0.15:
            continue  # so that some lenders are missing
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([t, t, t, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    return rows + rows[:9] + [(None, 1, "user", "no conversation")]


def trie(spark, rows, do_rebuild, **options):
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as place", "2 as block", "3 as n", "4 as t1", "5 as words", "6 as first")
    turns = prefix_trie.turn_table(turns)
    convs, turns = prefix_trie.rebuilt(turns) if do_rebuild else (turns.select("conv_id").distinct(), turns)
    return [tuple(r) for r in prefix_trie.prefix_trie(convs, turns, **options).collect()]


@pytest.mark.parametrize("options", [{}, {"columns": 1}, {"columns": 3, "ids_per_piece": 2}])
def test_rebuilt_conversations_against_the_definition(spark, options):
    rows = rows_of(1)
    got = trie(spark, rows, True, **options)
    assert len(got) == len(set(got))
    assert set(got) == expected(rebuilt(ordered(rows)))


def test_long_and_common_conversations(spark):
    """Many blocks; a third of all conversations alike; ends inside, at the border and at the end of a block; a lone turnless one."""
    common = [("user", "the same"), ("assistant", "answer one two")]
    convs = {c: common for c in range(100, 160)} | {1: [("user", f"x {i}") for i in range(43)], 2: [("user", f"x {i}") for i in range(16)], 3: [("user", f"x {i}") for i in range(8)]}
    convs |= {4: [("user", f"x {i}") for i in range(24)] + [("user", "other")], 5: [("assistant", "x 0")]}
    rows = [(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)]
    assert set(trie(spark, rows, False, ids_per_piece=7)) == expected(convs)


def test_turnless_conversations_and_an_empty_table(spark):
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1)
    assert trie(spark, [(lone, 1, "user", "only")], True) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert trie(spark, [], True) == []
