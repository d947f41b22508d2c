"""WARC, main text, top-k, mixing, chat formatting and the pipeline on small tables."""

import base64
import collections
import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from altertrace.llm import chat, html, mix, topk, warc
from altertrace.plans.tables import scratch_path

PAGES = "page_id long, url string, html string, id string, value string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "a", "b", "c") for i, u, h in rows], PAGES)


def test_warc_round_trip_over_many_ranges(spark):
    draw = random.Random(1)
    noise = bytes(draw.randrange(256) for _ in range(3000)).decode("latin-1")
    rows = [(i, f"http://x/{i}", noise[i * 7 :] + str(i % 20) + "\r\n\r\nWARC/1.0\r\n\x1f" * 3) for i in range(60)]
    rows += [(100 + i, "http://copy/", "same") for i in range(50)] + [(200, None, None), (201, "a\r\nb%", ""), (None, "u", "same"), (None, "u", "alone"), (100, "http://copy/", "same")]
    path = warc.write(pages(spark, rows), scratch_path(spark, "warc"))
    found = warc.read(spark, path, range_bytes=1000).collect()
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = []
    for i, u, h in rows:
        body = (h or "").encode()
        revisit = i is not None and least[h or ""] != i
        want.append((str(i), "revisit" if revisit else "response", str(u), str(least[h or ""]) if revisit else "None", base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body), b"" if revisit else body))
    got = [(str(r["record_id"]), r["record_type"], str(r["target_uri"]), str(r["refers_to"]), r["payload_digest"], r["payload_bytes"], bytes(r["payload"] or b"")) for r in found]
    assert sorted(got) == sorted(want)
    # any gzip reader can read the archives
    whole = b"".join(zlib_all(open(os.path.join(path.removeprefix("file:"), f), "rb").read()) for f in os.listdir(path.removeprefix("file:")) if f.startswith("part"))
    assert whole.count(b"WARC-Type: response") == sum(w[1] == "response" for w in want)
    assert warc.read(spark, warc.write(pages(spark, []), scratch_path(spark, "warc"))).count() == 0


def zlib_all(data):
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out)


def test_main_text(spark):
    menu = "<nav><ul><li><a href='/a'>Home</a></li></ul></nav>"
    article = "<article><header>by me</header><h1>Title &amp; more</h1><p>First  <b>bold<br>line<p>Second\n one.<aside>Side</aside><form>Name <input></form></article>"
    long = "A sentence of running text that is long enough to count as such. " * 3
    cases = [
        ("<html><head><title>T</title><script>var t='</p>';</script></head><body>" + menu + article + "<div class='comments'>Nice!</div><footer>&copy; x</footer></body></html>", "Title & more First bold line Second one."),
        (f"<body>{menu}<div class=ad>Buy now</div><div><p>{long}</p><p>short.</p></div><ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul><div id='cookie-notice'>We use cookies</div></body>", f"{long.strip()} short."),
        (None, ""), ("", ""), ("<p></p>", ""), ("plain text only", "plain text only"), ("<article>" + "w " * 200_000 + "</article>", ("w " * 200_000).strip()),
    ]
    data = [(i, "u", h) for i, (h, _) in enumerate(cases)] + [(0, None, cases[0][0]), (None, "u", None)]
    got = html.extract(pages(spark, data)).collect()
    for r in got:
        if r["page_id"] is not None:
            assert (r["text"], r["n_chars"]) == (cases[r["page_id"]][1], len(cases[r["page_id"]][1]))
    assert len(got) == len(data) and html.extract(pages(spark, [])).count() == 0


def test_main_text_of_marked_pages_follows_the_windows():
    long = "A sentence of running text that is long enough to count as such."
    links = "<ul><li><a href=x>one more story</a></li><li><a href=y>another story</a></li></ul>"
    # an article mark on a teaser card does not take the body away
    assert html.main_text(f"<body><article><p>Read on</p></article>{links}<hr>{links}<div><p>{long}</p><p>End.</p></div></body>") == f"{long} End."
    # lists of links in the article are left out, its short lines are not
    page = f"<article><h1><a href=/here>Title</a></h1>{links * 2}<p>By me</p>{links * 2}<p>{long}</p>{links * 2}<p>Short end.</p></article>"
    assert html.main_text(page) == f"Title By me {long} Short end."


def test_main_text_leaves_out_no_more_than_it_names():
    long = "A sentence of running text that is long enough to count as such."
    # figures and field sets are text
    page = f"<article><p>{long}</p><figure><table><tr><td>cell<td>value</table><pre>code</pre><figcaption>Caption</figcaption></figure><fieldset>Set</fieldset></article>"
    assert html.main_text(page) == f"{long} cell value code Caption Set"
    # silent elements without an end tag do not take the rest
    for tag in ("<select><option>no", "<object data=x>", "<canvas>", "<math><mi>no", "<svg><title>no</title><path d=''>", "<iframe src=x>", "<textarea>", "<button>", "<noscript>", "<template>"):
        assert html.main_text(f"<body><p>{long}</p>{tag}<p>The rest.</p><p>{long}</p>") == f"{long} The rest. {long}"
    for part in ("<select><option>no<option>no</select>", "<object><p>no</p></object>", "<svg><foreignObject><div>no</div></foreignObject></svg>", "<canvas><canvas>no</canvas>no</canvas>", "<textarea></p>no</textarea>", "<button>no</button>"):
        assert html.main_text(f"<p>{long} A{part}b</p>") == f"{long} A b"
    # a short close behind silent lines
    silent = "<nav>a</nav>" * 4
    assert html.main_text(f"<p>{long}</p>{silent}<p>It ends.</p>{silent}<p>Imprint</p>") == f"{long} It ends."
    assert html.kept(np.array([200, 0, 0, 0, 0, 40])).tolist() == [True] + [False] * 4 + [True]


@pytest.mark.parametrize("bits,scale", [(6, 256), (2, 256), (3, 1)])
def test_topk_equals_brute_force(spark, bits, scale):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(700, 12)) * (100 if scale == 1 else 0.3)
    x[300:420] = x[7]  # many ties
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [None] * 12), (1002, [float("nan")] * 12), (1003, [float("inf")] + [0.0] * 11), (1004, []), (None, [0.5] * 12), (1050, [1.0] * 3), (0, x[3].tolist())]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in data], "vec_id long, embedding array<double>, x string, block string")
    got = topk.search(frame, F.col("vec_id") % 50 == 0, k=5, scale=scale, rows_per_block=200, queries_per_block=4, bits=bits).collect()
    good = [(i, np.floor(scale * np.array(v)).astype(int)) for i, v in data if i is not None and v and len(v) == 12 and None not in v and np.isfinite(v).all()]
    want = collections.Counter()
    for i, q in good:
        if i % 50 == 0:
            want.update({(i, s, v) for s, v in []})
    for i in {i for i, _ in good if i % 50 == 0 and i != 0}:
        q = dict(good)[i]
        best = sorted((-int(q @ v), j) for j, v in good if j != i)[:5]
        assert [(-s, j) for s, j in best] == [(r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])]
    assert topk.search(frame.where("false"), F.lit(True)).count() == 0


def test_topk_sends_no_side_through_the_driver(spark):
    frame = spark.range(600).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.sin(F.col("id") + i)).alias("embedding"))
    found = topk.search(frame, F.col("vec_id") % 50 == 0, k=5, rows_per_block=20, queries_per_block=2)
    assert found.count() == 60 and len(found.collect()) == 60
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_mix_stays_within_a_block(spark):
    rows = [(i, f"t{i}", ["a", "b", "c", None][min(3, i % 7)], 9) for i in range(4000)] + [(None, None, "a", 9)] * 3 + [(1, "t1", "b", 9)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_slot int")
    weights = {"a": 0.5, "b": 0.3, "c": 0.17}
    out = mix.mix(docs, weights, block=4).collect()
    assert len(out) == len(rows)
    runs = collections.defaultdict(list)
    for r in out:
        runs[r["mix_slot"]].append(r)
    slots = sorted(s for s in runs if s < 1 << 62)
    assert all(len({r["source"] for r in runs[s]}) == 1 and len(runs[s]) <= 4 for s in slots)
    shares = {r["source"]: r["mix_share"] for r in out}
    assert shares[None] is None and sum(v for v in shares.values() if v) == 97
    size = collections.Counter(r["source"] for r in out)
    done = collections.Counter()
    over = min(size[s] // 4 * 97 / shares[s] for s in weights)  # until the first source runs out
    for t in range(int(over)):
        done[runs[t][0]["source"]] += 1
        for s in weights:
            assert abs(done[s] - (t + 1) * weights[s] / 0.97) < 1
    assert sorted(r["doc_id"] or -1 for r in mix.interleaved(docs.drop("mix_slot")).collect()) == sorted(r[0] or -1 for r in rows)
    once = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).drop("mix_slot")
    for options in ({"block": 4}, {"weights": weights, "block": 1}):
        order = [r["doc_id"] for r in mix.mix(once, **options).orderBy("mix_slot", "source", "mix_rank").collect()]
        assert [r["doc_id"] for r in mix.interleaved(once, partitions=5, **options).collect()] == order
    assert mix.interleaved(docs.where("false")).count() == 0
    assert mix.mix(docs.where("false")).count() == 0


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": 0.3333, "b": 0.6666, "c": 0.0001}, {"a": 7.25, "b": 0.5, "c": 3}])
def test_deviation_from_the_true_weight_over_many_blocks(spark, weights):
    total = sum(weights.values())
    rows = [(s, k) for s, w in weights.items() for k in range(int(10_000 * w / total) + 1)]
    docs = spark.createDataFrame([(n, f"t{n}", s) for n, (s, _) in enumerate(rows)], "doc_id long, text string, source string")
    out = sorted((r["mix_slot"], r["source"]) for r in mix.mix(docs, weights, block=1).collect())
    done = collections.Counter()
    for t, (slot, source) in enumerate(out[:10_000]):
        assert slot == t
        done[source] += 1
        assert all(abs(done[s] - (t + 1) * w / total) < 1 + 1e-9 for s, w in weights.items())


def test_mix_of_many_sources(spark):
    given = spark.createDataFrame([(None, 70), ("a", 500), ("b", 300), ("c", 129), ("d", 1)], "source string, share long")
    slots = [{r["source"]: (r["share"], r["slots"]) for r in f(given, 1000).collect()} for f in (mix.schedule, mix.long_schedule)]
    assert slots[0] == slots[1] and len(slots[0]) == 5
    docs = spark.createDataFrame([(i, f"t{i}", f"s{i % 1500}") for i in range(3000)], "doc_id long, text string, source string")
    for weights in (None, {f"s{i}": 0.5 + 0.5 * (i < 100) for i in range(1500)}):
        cycle = 1600 if weights else 1500
        out = mix.mix(docs, weights, block=1).collect()
        assert len({r["mix_slot"] for r in out}) == len(out) == 3000 and max(r["mix_slot"] for r in out) < 2 * cycle
        shares = {r["source"]: r["mix_share"] for r in out}
        assert shares == {f"s{i}": 2 if weights and i < 100 else 1 for i in range(1500)}
        for r in out:  # released, and before its deadline
            assert r["mix_block"] * cycle // shares[r["source"]] <= r["mix_slot"] < -(-(r["mix_block"] + 1) * cycle // shares[r["source"]])
    assert mix.interleaved(docs, block=1).count() == 3000
    with pytest.raises(ValueError):
        mix.mix(docs, {"s1": 1.0, "s2": 1e-9})


def test_sizes_as_weights(spark):
    docs = spark.createDataFrame([(i, s) for i, s in enumerate("a" * 1000 + "b" * 300 + "c")] + [(0, None)] * 300, "doc_id long, source string")
    assert {r["source"]: r["share"] for r in mix.sized(docs).collect()} == {"a": 100, "b": 43, None: 43, "c": 1}
    assert mix.sized(docs.where("false")).count() == 0


def test_top_k_compares_equal_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0]), (3, [2.0]), (4, [0.25, 0.0]), (50, [3.0]), (51, [])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 1, 256 * 128), (0, 2, 4, 256 * 64), (50, 1, 3, 768 * 512), (50, 2, 2, 768 * 256)]


def test_parents_in_a_circle(spark):
    # 1 -> 2 -> 1 with a tail 3 -> 2; 10 -> 12 -> 11 -> 10; an ordinary tree beside them
    rows = [(1, 1, 2), (1, 2, 1), (1, 3, 2), (1, 10, 12), (1, 12, 11), (1, 11, 10), (1, 20, None), (1, 21, 20), (2, 1, 1), (2, 2, 1), (2, 3, 9)]
    trees = spark.createDataFrame([(t, i, p, 0.5) for t, i, p in rows], "tree long, id long, parent long, score double")
    paths = collections.defaultdict(list)
    for r in chat.branches(trees).collect():
        paths[r["tree"], r["leaf"]].append((-r["depth_from_leaf"], r["id"]))
    got = {k: [i for _, i in sorted(v)] for k, v in paths.items()}
    assert got == {(1, 3): [1, 2, 3], (1, 12): [10, 11, 12], (1, 21): [20, 21], (2, 2): [1, 2], (2, 3): [3]}


def test_main_text_names_count_as_a_whole():
    long = "A sentence of running text that is long enough to count as such."
    for page in (
        f'<div class="content has-sidebar"><p>{long}</p></div>', f'<div class="with-sidebar"><article><p>{long}</p></article></div>',
        f'<article><section class="side-effects"><p>{long}</p></section></article>', f'<div class="sidebar"><p>{long}</p><div class="comments">no</div></div>',
    ):
        assert html.main_text(page) == long
    assert html.main_text(f'<article><p>{long}<p class="share-price">Up 3<p>See <a href=x>the list of references here</a>.</article>') == f"{long} Up 3 See the list of references here."
    names = "ad-slot site-header cookie-notice comment-list main-nav user-comments newsletter_signup share-buttons post-footer related sideBar"
    assert all(html.marked(n) for n in names.split()[:-1])
    assert not any(html.marked(n) for n in "has-sidebar no-ads side-effects share-price heading adventure article loading".split())


@pytest.mark.parametrize("part", ["<a ", "<textarea>", "<div></b>", "<a \"x\" ", "<!--", "<b></i>", "<svg><p>", "<", "<a '"])
def test_broken_markup_takes_linear_time(part):
    import time

    start = time.process_time()
    html.main_text(part * (1_000_000 // len(part)))
    assert time.process_time() - start < 8


def test_queries_are_registered():
    names = entry_points.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)} and "pipeline" in names


def test_pipeline_follows_the_mixture(spark, sf, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = [r["doc_id"] for r in mix.mix(docs, mix.sized(docs)).orderBy("mix_slot", "source", "mix_rank").collect()]
    out = corpus_pipeline.run(spark, sf).collect()
    assert [r["doc_id"] for r in out] == want and [r["place"] for r in out] == list(range(len(want)))


def test_pipeline_mixes_to_unequal_targets(spark):
    import corpus_pipeline

    size = {"a": 640, "b": 160, None: 40}
    docs = spark.createDataFrame([(n, f"t{n}", s) for n, s in enumerate(s for s, k in size.items() for _ in range(k))], "doc_id long, text string, source string")
    rows = [r["source"] for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]
    parts = {r["source"]: r["share"] for r in mix.sized(docs).collect()}
    first = collections.Counter(rows[:320])
    assert collections.Counter(rows) == size and all(abs(first[s] - 320 * k / sum(parts.values())) <= mix.BLOCK for s, k in parts.items())


def test_pipeline_keeps_columns(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "bpe":
            assert out.columns == docs.columns
        rows = out.count()
        assert rows <= n if name != "mix" else rows == n
        n, docs = rows, out
    assert n > 0 and docs.select("doc_id").distinct().count() == n
