"""Vector codes against plain integer k-means, and the limb products against Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from altertrace.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, x string, row string, d string, code string, error string, l string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "a", "b", "c", "d", "e", "f") for i, v, l in rows], SCHEMA)


def plain(rows, entries, rounds, parts=4):
    """The same by loops over Python integers, for vectors of one length."""
    kept = [(i, [math.floor(1024 * x) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    size = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((distance(cut(v, p), c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        mine = [[near(v, p)[1] for _, v, _ in kept] for p in range(parts)]
        for p in range(parts):
            for k in range(len(books[p])):
                if members := [cut(v, p) for (_, v, _), m in zip(kept, mine[p]) if m == k]:
                    books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for i, v, l in kept:
        found = [near(v, p) for p in range(parts)]
        out.append((i, l, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    labels = {}
    for _, l, _, e in out:
        labels[l] = labels.get(l, 0) + e
    digest = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    return [(i, c, e, labels[l], digest) for i, l, c, e in out]


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("scale", [1.0, 3e4])
def test_codes_equal_plain_integers(spark, scale):
    draw = random.Random(7)
    rows = [(draw.randrange(500), [scale * draw.gauss(0, 1) for _ in range(8)], draw.choice([0, 1, None])) for _ in range(120)]
    rows += [rows[0]] * 30 + [(None, rows[3][1], 1), (1000, None, 0), (1001, [1.0] * 7 + [None], 0), (1002, [float("nan")] * 8, 0), (1003, [float("-inf")] + [0.0] * 7, 0)]
    got = codes.compressed(frame(spark, rows).repartition(5), entries=6, rounds=3).collect()
    assert ordered(map(tuple, got)) == ordered(plain(rows, 6, 3))


def test_codes_with_fewer_vectors_and_other_lengths(spark):
    rows = [(1, [0.5, -0.5, 0.25, 1.0], 3), (2, [1.0] * 4, None), (3, [0.1] * 6, 3), (4, [], 3), (5, [0.2] * 6, None)]
    got = {r["vec_id"]: r for r in codes.compressed(frame(spark, rows)).collect()}
    assert {i: r["code"] for i, r in got.items()} == {1: "00000000", 2: "01010100", 3: "00000000", 4: "00000000", 5: "01010101"}
    assert all(r["error"] == r["label_error"] == 0 for r in got.values())
    assert len({got[i]["codebooks_sha256"] for i in (1, 3, 4)}) == 3 and got[3]["codebooks_sha256"] == got[5]["codebooks_sha256"]
    assert codes.compressed(frame(spark, [])).count() == 0
    assert codes.compressed(frame(spark, [(1, None, 2)])).count() == 0


def test_error_is_the_distance_to_the_decoded_vector(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    books = codes.fit(df, entries=16, rounds=2)
    for r in codes.encode(df, books).collect():
        x = [math.floor(1024 * float(np.float64(v))) for v in r["row"]["embedding"]]
        back = codes.decoded(r["code"], books[len(x)])
        assert r["error"] == sum((a - b) ** 2 for a, b in zip(x, back))


def test_limb_products_are_exact():
    draw = np.random.default_rng(3)
    for bits, d in ((3, 1), (20, 16), (27, 5), (29, 16), (30, 3)):
        x, y = (draw.integers(-(1 << bits), 1 << bits, (9, d)) for _ in range(2))
        x[0], y[0] = -(1 << bits), -(1 << bits)
        want = [[sum(int(a) * int(b) for a, b in zip(r, s)) for s in y] for r in x]
        assert codes.products(x, y).tolist() == want
        assert all(np.abs(l).max() <= 2 ** ((53 - max(0, (d - 1).bit_length())) // 2) for l in codes.limbs(x, (53 - max(0, (d - 1).bit_length())) // 2))
    with pytest.raises(OverflowError):
        codes.nearest(np.array([[1 << 40] * 4]), np.array([[0] * 4]))
