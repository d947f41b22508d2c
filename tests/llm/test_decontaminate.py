"""Benchmark decontamination against plain windows, with one automaton and with many."""

import hashlib
import random
import re

import pytest

from altertrace.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, row string, key string, items string, starts string"
ITEMS = "item_id long, text string, item string, words string, shard string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, window=10):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for a in range(len(w) - n + 1) if n else ():
            grams.setdefault(tuple(w[a : a + n]), set()).add("" if i is None else str(i))
    sizes = {len(g) for g in grams}
    out = []
    for doc, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if g := grams.get(tuple(w[a : a + n])):
                    hit |= set(range(a, a + n))
                    found |= g
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def docs_frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOCS)


def items_frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], ITEMS)


@pytest.fixture(scope="module")
def tables():
    draw = random.Random(3)
    vocabulary = ["".join(draw.choice("abcé9ü") for _ in range(draw.randint(1, 3))) for _ in range(12)]
    say = lambda n: draw.choice([" ", ", ", "\n"]).join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, say(draw.choice([3, 4, 9, 10, 11, 30]))) for i in range(40)]
    items += [(3, say(20)), (3, items[3][1]), (50, items[5][1]), (None, say(12)), (None, None), (60, ""), (61, " ?! "), (70, say(9000)), (71, "a " * 40)]
    docs = []
    for i in range(120):
        parts = [say(draw.randint(0, 40))]
        for _ in range(draw.choice([0, 0, 1, 3])):
            w = words(draw.choice(items)[1])
            a = draw.randrange(len(w) + 1)
            parts += [" ".join(w[a : a + draw.randint(1, 25)]).upper().replace("É", "é").replace("Ü", "ü"), say(draw.randint(0, 5))]
        docs.append((i, " - ".join(parts)))
    docs += [docs[5], (5, docs[6][1]), (None, docs[7][1]), (500, None), (501, ""), (502, "\x00 ::"), (503, items[-2][1]), (504, "a " * 20_000), (505, "zzz " * 3000 + items[0][1])]
    return docs, items


@pytest.mark.parametrize("shard", [100_000, 300])
def test_hits_equal_plain_windows(spark, tables, shard):
    docs, items = tables
    found = decontaminate.find(docs_frame(spark, docs).repartition(3), items_frame(spark, items), shard=shard, carry=["doc_id"])
    got = decontaminate.digests(found).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, items)


def test_pieces_of_long_items_lose_no_window(spark, tables, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(decontaminate, "PIECE", 7)
    machine, seen = decontaminate.Automaton(), []
    names = sorted({w for _, t in items for w in words(t)})
    for k, (_, t) in enumerate(items):
        w = [names.index(x) for x in words(t)]
        for a in range(0, len(w), decontaminate.PIECE):
            if a and len(w) - a < 10:
                break
            machine.add(k, w[a : a + decontaminate.PIECE + 9])
            seen.append(k)
    scan = decontaminate.Scanner(*machine.finished()).scan
    want = {r[0]: r[2] for r in plain([d for d in docs if d[0] is not None and d[0] > 8], items)}
    for doc, t in docs:
        if doc in want and want[doc] is not None:
            spans, _, longest = scan([names.index(x) if x in names else -1 for x in words(t)])
            hit = {i for s, e in spans for i in range(s, e)}
            assert len(hit) == want[doc] and (not hit or longest >= 3)


def test_longest_match_is_tracked(spark):
    docs = [(1, "x one two three four y three four five"), (2, "nothing here")]
    found = {r["row"]["doc_id"]: r["longest"] for r in decontaminate.find(docs_frame(spark, docs), items_frame(spark, [(1, "one two three four five six")]), window=3).collect()}
    assert found == {1: 4, 2: 0}


def test_cleaned_texts_lose_their_hits_only(spark):
    item = "the quick brown fox jumps over the lazy dog again"
    docs = [
        (1, f"Before, {item.upper()}! After {'and more words ' * 4}"), (2, "clean text é stays\n as it is"), (3, item), (4, None), (5, ""),
        (6, " ".join("w%d" % i for i in range(30)) + " " + item + " " + item.replace(" ", "  ")),
    ]
    df = docs_frame(spark, docs)
    out = decontaminate.cleaned(df, items_frame(spark, [(1, item)]))
    assert out.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {1: f"Before, ! After {'and more words ' * 4}", 2: docs[1][1], 4: None, 5: "", 6: " ".join("w%d" % i for i in range(30)) + " "}


def test_empty_tables(spark, tables):
    docs, items = tables
    assert decontaminate.find(docs_frame(spark, []), items_frame(spark, items)).count() == 0
    got = decontaminate.digests(decontaminate.find(docs_frame(spark, docs[:5]), items_frame(spark, []))).collect()
    assert [tuple(r)[2:4] for r in got] == [(0, 0)] * 5
