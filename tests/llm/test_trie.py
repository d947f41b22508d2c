"""The trie of conversations against a plain one, with blocks so small that most nodes reach over their borders."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from altertrace.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, node string, task string, seq string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)


def turns(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def plain(convs):
    members = {}
    for c, w in convs.items():
        for d in range(len(w) + 1):
            members.setdefault(tuple(w[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    rows = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in own if len(convs[c]) == len(p))
        rows.append((
            min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(children.get(p, [])), sum(q not in children for q in below),
            sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    out = []
    for c in [*range(0, 60), *range(100, 160), 205, 333, -7]:
        kind = draw.random()
        for t in range(draw.choice([1, 2, 3, 4, 9])):
            text = "hot" if kind < 0.4 else draw.choice(["a", "bb", "", "é€𝄞"])
            out.append((c, t, draw.choice(["user", "assistant"]) if kind > 0.8 else "user", text))
    out += [(70, None, "user", "first"), (70, 5, None, None), (70, 5, "", ""), (None, 1, "user", "x"), (None, None, None, None), (71, 1, "us", "erx"), (72, 1, "user", "x")]
    out += [(80, i % 40, "user", "long " * 3) for i in range(700)]
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("limit", [1, 3, 17, 1 << 16])
def test_trie_equals_plain_trie(spark, rows, limit):
    got = trie.trie(frame(spark, rows).repartition(3), limit=limit).collect()
    assert sorted(map(tuple, got), key=str) == plain(rebuilt(turns(rows)))


def test_trie_of_conversations_as_they_are(spark, rows):
    got = trie.trie(frame(spark, rows), group=None, limit=5).collect()
    assert sorted(map(tuple, got), key=str) == plain(turns(rows))


def test_copies_of_one_conversation_over_many_blocks(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(1000, 1300) for t in range(3)]
    got = trie.trie(frame(spark, rows), group=None, limit=10).collect()
    assert sorted(map(tuple, got), key=str) == plain(turns(rows))


def test_empty_and_turnless(spark):
    assert trie.trie(frame(spark, [])).count() == 0
    assert trie.trie(frame(spark, [(None, 1, "user", "x")])).count() == 0
    # conversations that lose all their turns: the root is a leaf
    few = [(c, 0, "user", "x") for c in range(201, 240) if zlib.crc32(str(c).encode()) % 6 > 0]
    got = [tuple(r) for r in trie.trie(frame(spark, few), limit=4).collect()]
    assert got == plain(rebuilt(turns(few))) and len(got) == 1 and got[0][5] == 1


def test_extents_of_every_candidate():
    draw = np.random.default_rng(2)
    lcp = draw.integers(0, 4, 53)
    table = trie.Minima(lcp)
    row, depth = (x.reshape(-1) for x in np.meshgrid(np.arange(53), np.arange(5)))
    for r, d, a, b in zip(row, depth, table.first(row, depth), table.last(row, depth)):
        x = y = r
        while x > 0 and lcp[x] >= d:
            x -= 1
        while y < 52 and lcp[y + 1] >= d:
            y += 1
        assert (a, b) == (x, y)
