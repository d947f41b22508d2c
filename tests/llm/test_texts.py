"""BPE, quality, lattice, toxicity and n-gram join on small tables with nulls, empties, repeats and clashing columns."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from altertrace.llm import bpe, lattice, ngrams, quality, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, chunk string, score string, row string, ids string, bucket string, n string"


def low(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", "z", "a", "b", "c") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("abcdeéß'") for _ in range(draw.randint(1, 6))) for _ in range(60)]
    base = [[draw.choice(vocabulary) for _ in range(draw.choice([5, 60, 80, 90]))] for _ in range(30)]
    near = []
    for words in base[:12]:
        for _ in range(4):
            w = list(words)
            w[draw.randrange(len(w))] = "Changed"
            near.append(w)
    texts = [" ".join(w) for w in base + near]
    out = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    out += [(200, None, None), (201, "", "s0"), (202, "\n\t  ", "s1"), (203, "one", "s1"), (204, "One", "s1"), (203, "one", "s1"), (None, texts[0], "s0"), (205, "x" * 300_000 + " y" * 5000, "s2")]
    return out


def test_bpe_equals_tiktoken_and_round_trips(spark, rows):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = [(300 + i, t, "s0") for i, t in enumerate(["it's we'll ''s", "a  b\n\n c ", "12éé 34", "<|endoftext|>", "　x 'S", "tabs\t\tand 'd've"])]
    encoded = bpe.encode(table(spark, rows + extra), RANKS, public_tokenizers.PATTERN, chunk=2000)
    got = sorted((r["doc_id"] or -1, np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["bytes"])) for r in bpe.decode(encoded, RANKS).collect())
    want = sorted((i or -1, plain.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows + extra)
    assert got == want
    one = encoded.where("doc_id = 300").select(bpe.ids_array(F.col("ids")).alias("a")).first()["a"]
    assert one == plain.encode_ordinary("it's we'll ''s")
    assert bpe.encode(table(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_split_is_the_pattern():
    import regex

    pattern, draw = regex.compile(public_tokenizers.PATTERN), random.Random(3)
    parts = ["'", "s", "re", "ll", "v", "e", "d", " ", "  ", "\n", "1", "é", "!", "\t", "　", "²", " '", "I'm"]
    for _ in range(2000):
        texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(3)]
        hashes, counts, word = bpe.split(texts)
        found = [pattern.findall(t) for t in texts]
        assert [word(i) for i in range(len(hashes))] == sum(found, [])
        assert counts.tolist() == [len(f) for f in found]


def shingles(text, k):
    w = WORD.findall(low(text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100), (2, 1, 2)])
def test_ngram_components_equal_brute_force(spark, rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t, _ in rows]
    known = [x for x in sets if x[0] is not None]
    comp = {n: n for n in range(len(known))}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(known)):
        for b in range(a):
            x, y = known[a][1], known[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                comp[root(a)] = root(b)
    least = collections.defaultdict(lambda: 10**9)
    for n, (i, _) in enumerate(known):
        least[root(n)] = min(least[root(n)], i)
    want = sorted((i, len(s), i if not s else least[root(n)]) for n, (i, s) in enumerate(known))
    out = ngrams.join(table(spark, rows), k=k, num=num, den=den, bits=12, nearest=1).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out if r["doc_id"] is not None) == want
    assert [r["component_id"] for r in out if r["doc_id"] is None] == [None]


def test_ngram_join_of_nothing(spark):
    assert ngrams.join(table(spark, [])).count() == 0


def test_tree_loses_no_partner():
    draw = np.random.default_rng(1)
    points = draw.poisson(2, size=(300, 16))
    points[150:] = points[:150] + (draw.random((150, 16)) < 0.1)
    sizes = points.sum(axis=1)
    tree = ngrams.Tree(points, sizes, leaf=4, fan=3)
    for q, n in zip(points, sizes):
        want = {j for j in range(300) if 100 * np.minimum(q, points[j]).sum() * 185 >= 85 * 100 * (n + sizes[j]) and 85 * n <= 100 * sizes[j] and 85 * sizes[j] <= 100 * n}
        assert set(tree.partners(q, int(n), 85, 100)[0].tolist()) == want


def test_quality_equals_brute_force(spark, rows):
    line = "the common line of this host"
    more = [(400 + i, f"{line}\nown {' '.join(f'w{i}x{j}' for j in range(60))}\n{line}", "h") for i in range(8)] + [(450, "\n".join([line, "a b", line.upper()] * 12 + ["z " * 3]), "h"), (451, "###$ <b> " * 40, "h")]
    data = rows + more
    out = quality.judge(table(spark, data), min_docs=3, max_share=0.5, cleaned=True)
    assert out.select("row.*").columns == [c.split()[0] for c in SCHEMA.split(", ")]
    seen, size = collections.defaultdict(set), collections.Counter(s for _, _, s in data)
    for n, (_, t, s) in enumerate(data):
        for x in (t or "").split("\n"):
            if w := tuple(WORD.findall(low(x))):
                seen[s, w].add(n)
    often = {key for key, ds in seen.items() if len(ds) > 3 and len(ds) > 0.5 * size[key[0]]}
    assert ("h", tuple(line.split())) in often
    want = []
    for i, t, s in data:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        c = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        rep = {j + k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in range(3)}
        gone = sum(len(WORD.findall(x)) for x in lines if (s, tuple(WORD.findall(low(x)))) in often)
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        left = "\n".join(x for x in t.split("\n") if (s, tuple(WORD.findall(low(x)))) not in often)
        want.append((i or -1, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), failed, not failed and len(w) - gone >= 0.5 * len(w), left))
    got = [(r["row"]["doc_id"] or -1, *(r[m] for m in quality.METRICS), r["base_failed"], r["kept"], r["cleaned_text"]) for r in out.collect()]
    assert sorted(got) == sorted(want)
    assert quality.kept_rows(table(spark, [])).count() == 0


def test_pipeline_judges_hosts_of_any_size_by_share(spark):
    import corpus_pipeline

    line = " ".join(f"common{j}" for j in range(70))
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    for size in (50, 600):  # a tenth of the documents of either host holds the line
        data = [(i, f"{line}\n{own(i)}" if i % 10 == 0 else own(i), "h") for i in range(size)]
        left = {r["doc_id"] for r in corpus_pipeline.drop_poor(spark, table(spark, data), "").collect()}
        assert left == {i for i in range(size) if i % 10}


def test_lattice_base_and_marginals(spark, rows):
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = {(r["doc_id"], r["n_tokens"]): r for r in lattice.score(table(spark, rows), path, chunk=3000).collect()}
    train = [(i, t or "") for i, t, _ in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter()
    for _, t in train:
        c.update([*WORD.findall(low(t)), "\n"])
    n, v = sum(c.values()), len(c)
    for i, t, _ in rows:
        w = [*WORD.findall(low(t or "")), "\n"]
        r = out[i, len(w)]
        assert (r["n_known"], r["train_tokens"]) == (sum(c[x] > 0 for x in w), n)
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(math.fsum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert lattice.score(table(spark, []), path).count() == 0


def test_lattice_sums_all_segmentations():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, normal, by_byte, longest = lattice.pieces(path)
    logs = np.log(np.random.default_rng(2).dirichlet(np.ones(model.get_piece_size())) + 1e-12)
    scored = lattice.Lattice(path, logs)

    def paths(text):
        if not text:
            return 1.0
        total = sum(math.exp(logs[normal[text[:k]]]) * paths(text[k:]) for k in range(1, min(longest, len(text)) + 1) if text[:k] in normal)
        if text[0] not in normal:
            total += math.prod(math.exp(logs[by_byte[b]]) for b in text[0].encode()) * paths(text[1:])
        return total

    for w in ("the", "hello", "étre", "a一\U0001f600b"):
        assert scored.score(w.encode()) == pytest.approx(math.log(paths("▁" + w)))


def test_toxicity_learns_and_locates(spark):
    draw = random.Random(7)
    calm = ["river", "stone", "light", "garden", "window", "paper", "morning", "letter"]
    docs, labels = [], []
    for i in range(400):
        sentences = [" ".join(draw.choice(calm) for _ in range(8)) for _ in range(4)]
        bad = i % 5 == 0
        if bad:
            sentences[2] += " " + draw.choice(["vile", "grubly" + draw.choice("abcdefgh")])
        docs.append((i, ". ".join(sentences) + ".", "s"))
        labels.append((i, int(bad)))
    docs += [(900, None, "s"), (901, "", None), (None, "vile", "s"), (0, docs[0][1], "s")]
    labels += [(None, 1), (5000, 1), (3, None), (0, 1)]
    frame, known = table(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(frame, known, toxicity.is_training("doc_id"), min_bags=3, least_ratio=10.0)
    out = toxicity.score(frame, model).collect()
    for r in out:
        i = r["row"]["doc_id"]
        assert 0 <= r["score"] <= 1
        if i is not None and i < 400:
            assert r["predicted"] == int(i % 5 == 0)
            for span in r["offending"]:
                assert re.search("vile|grubly", r["row"]["text"][span["start"] : span["end"]])
        elif i in (900, 901):
            assert (r["score"], r["predicted"], r["offending"]) == (0.0, 0, [])
    assert any(r["offending"] for r in out)
    assert toxicity.kept_rows(frame, model).columns == frame.columns
    nothing = toxicity.fit(frame, known.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score(frame, nothing).collect()} == {0.0}
    assert toxicity.score(table(spark, []), model).count() == 0


def test_small_buckets_are_bounded_at_once_as_by_their_trees():
    import numpy as np
    import pyarrow as pa

    from altertrace.llm import ngrams

    rng = np.random.default_rng(5)
    size = np.array([1, 2, 3, 40, 64, 17, 5])
    start = np.cumsum(size) - size
    points = rng.integers(0, 4, (4, 256))[rng.integers(0, 4, size.sum())] + (rng.random((size.sum(), 256)) < 0.08)
    n, comp = points.sum(axis=1), rng.integers(0, 6, size.sum())
    comp[start[2] : start[2] + 3] = 1
    blobs = pa.chunked_array([pa.array([ngrams.packed(p, "<u4") for p in points], pa.binary())])
    for nearest in (None, 1, 4):
        got = ngrams.small_linked(start, size, n, comp, blobs, 85, 100, nearest)
        want = [a + ngrams.tree_linked(points[a : a + m].astype(np.int32), n[a : a + m], comp[a : a + m], 85, 100, nearest) for a, m in zip(start, size) if len(set(comp[a : a + m])) > 1]
        assert sorted(map(tuple, got.tolist())) == sorted(map(tuple, np.concatenate(want).tolist())) and len(got) > 50, nearest
