"""The registered queries of the operators, on the whole tables, with the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from altertrace.llm import bpe, chat, codes, decontaminate, html, lattice, mix, ngrams, quality, topk, toxicity, trie, warc
from altertrace.plans.tables import scratch_path

#: name -> (query, SQL or None)
REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
BYTE_BPE = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


@query()
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record and read back."""
    path = warc.write(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    back = warc.read(spark, path)
    return back.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


@query()
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


TOP = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query(TOP)
def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every query vector."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


MIX_BLOCK = 4
MIX = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST('0x' || substr(md5('1|' || COALESCE(CAST(doc_id AS VARCHAR), '') || '|' || COALESCE(text, '')), 1, 15) AS BIGINT) AS o FROM documents),
n AS (SELECT source, pow(COUNT(*), {mix.POWER}) AS n FROM documents GROUP BY source),
s AS (SELECT source, CAST(greatest(floor(n * {mix.PARTS} / (SELECT MAX(n) FROM n) + 0.5), 1) AS BIGINT) AS share FROM n),
i AS (SELECT *, row_number() OVER (ORDER BY share, source NULLS FIRST) AS i FROM s),
a AS (SELECT list(share ORDER BY i) AS shares, COUNT(*) AS n, CAST(SUM(share) AS BIGINT) AS c FROM i),
e AS (
  SELECT -1 AS t, list_transform(shares, lambda x: 0) AS done, CAST(-1 AS BIGINT) AS pick FROM a
  UNION ALL
  SELECT t + 1, list_transform(range(1, n + 1), lambda j: done[j] + CASE WHEN j = p THEN 1 ELSE 0 END), p FROM (
    SELECT e.t, e.done, a.n, list_min(list_filter(list_transform(range(1, a.n + 1), lambda j: CASE
      WHEN e.done[j] < a.shares[j] AND (e.done[j] * a.c) // a.shares[j] <= e.t + 1
      THEN (((e.done[j] + 1) * a.c + a.shares[j] - 1) // a.shares[j]) * 100000 + j END), lambda k: k IS NOT NULL)) % 100000 AS p
    FROM e, a WHERE e.t < a.c - 1)),
slots AS (SELECT i.source, i.share, list(e.t ORDER BY e.t) AS slots FROM e JOIN i ON e.pick = i.i GROUP BY ALL),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY o, doc_id) - 1 AS mix_rank FROM d)
SELECT r.doc_id, r.source, ((mix_rank // {MIX_BLOCK}) // share) * (SELECT c FROM a) + slots[(mix_rank // {MIX_BLOCK}) % share + 1] AS mix_slot,
  mix_rank // {MIX_BLOCK} AS mix_block, mix_rank, share AS mix_share
FROM r JOIN slots ON r.source IS NOT DISTINCT FROM slots.source
"""


@query(MIX)
def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in a mixture of all sources, weighted by their sizes to a power, in blocks of four."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix.mix(docs, mix.sized(docs), block=MIX_BLOCK, carry=["doc_id", "source"])


NGRAMS = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM w),
u AS (SELECT s, MIN(doc_id) AS rep, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
t AS (SELECT rep, n, unnest(s) AS g FROM u),
c AS (SELECT a.rep AS a, b.rep AS b, COUNT(*) AS k, ANY_VALUE(a.n) AS an, ANY_VALUE(b.n) AS bn FROM t a JOIN t b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 100 * k >= 85 * (an + bn - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT rep AS x, rep AS y FROM u UNION SELECT reach.x, e.b FROM reach JOIN e ON reach.y = e.a),
m AS (SELECT x, MIN(y) AS comp FROM reach GROUP BY x),
cc AS (SELECT m.x, MIN(u.rep) AS r, comp FROM m JOIN u ON u.rep = m.x GROUP BY ALL)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, COALESCE(m.comp, s.doc_id) AS component_id
FROM s LEFT JOIN u ON s.s = u.s LEFT JOIN m ON u.rep = m.x
"""


@query(NGRAMS)
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 4-word shingles with a Jaccard similarity of 0.85 or more."""
    return ngrams.join(table(spark, sf_dir, "documents"), k=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, COALESCE('=' || source, '-') AS host, COALESCE(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
x AS (SELECT r, unnest(w[1:len(w)]) AS w, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT r, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
tw AS (SELECT r, i, COUNT(*) OVER (PARTITION BY r, w, w2, w3) AS c FROM g WHERE w3 IS NOT NULL),
rep AS (SELECT r, COUNT(DISTINCT i + k) AS n_repeat_words FROM tw, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY r),
lines AS (SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT r, host, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw FROM lines),
lv AS (SELECT * FROM lw WHERE len(lw) > 0),
dup AS (SELECT r, COUNT(*) - COUNT(DISTINCT line) AS n_dup_lines FROM lv GROUP BY r),
hosts AS (SELECT host, COUNT(*) AS size FROM d GROUP BY host),
often AS (SELECT lv.host, lw FROM lv JOIN hosts USING (host) GROUP BY lv.host, lw, size HAVING COUNT(DISTINCT r) > 3 AND COUNT(DISTINCT r) > 0.05 * size),
gone AS (SELECT lv.r, SUM(len(lv.lw)) AS gone FROM lv JOIN often ON lv.host = often.host AND lv.lw = often.lw GROUP BY lv.r),
m AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, COALESCE(n_dup_lines, 0) AS n_dup_lines,
  COALESCE(n_repeat_words, 0) AS n_repeat_words, COALESCE(gone, 0) AS gone
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - gone >= 0.5 * n_words AS kept FROM m
"""


@query(QUALITY)
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and verdict on every document; its host is its source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality.judge(docs, carry=["doc_id"]).select("row.doc_id", *quality.METRICS, "base_failed", "kept")


@query()
def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and lattice scores of every document."""
    return lattice.score(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


@query()
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and read back."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.digests(chat.format_branches(chat.chain(rows.unionByName(more)), best=1))


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, verdict and offending sentences of every document, learned from the labels of three quarters of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.is_training("doc_id"))
    held = F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 4 == 2, F.lit(False))
    return toxicity.score(docs, model, carry=["doc_id"]).select("row.doc_id", held.alias("held_out"), "score", "predicted", "offending")


def codes_sql(rounds: int = codes.ROUNDS, parts: int = codes.PARTS, entries: int = codes.ENTRIES) -> str:
    """SQL of the compressed vectors: a pair of common table expressions for each round."""
    near = "SELECT p.vec_id, p.part, p.x, min_by({{'e': entry, 's': s}}, {{'s': s, 'e': entry}}) AS b FROM (SELECT p.vec_id, p.part, p.x, c.entry, CAST(list_sum(list_transform(list_zip(p.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT) AS s FROM p JOIN c{0} c ON p.part = c.part) p GROUP BY ALL"
    steps = [
        f"""k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"p AS (SELECT vec_id, i AS part, x[len(x) * i // {parts} + 1:len(x) * (i + 1) // {parts}] AS x FROM k, range({parts}) AS t(i))",
        f"c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY entry < {entries})",
    ]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(r)})")
        steps.append(f"""m{r} AS (SELECT part, entry, list(v ORDER BY j) AS x FROM (SELECT part, b.e AS entry, j, CAST(floor(CAST(SUM(x[j]) AS DOUBLE) / COUNT(*)) AS BIGINT) AS v
  FROM a{r}, range(1, (SELECT max(len(x)) + 1 FROM p)) AS t(j) WHERE j <= len(x) GROUP BY ALL) GROUP BY ALL)""")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, COALESCE(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON c.part = m.part AND c.entry = m.entry)")
    steps.append(f"z AS ({near.format(rounds)})")
    steps.append("w AS (SELECT vec_id, string_agg(format('{:02x}', b.e), '' ORDER BY part) AS code, CAST(SUM(b.s) AS BIGINT) AS error FROM z GROUP BY vec_id)")
    steps.append("l AS (SELECT label, CAST(SUM(error) AS BIGINT) AS label_error FROM w JOIN k USING (vec_id) GROUP BY label)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})")
    return f"WITH {', '.join(steps)} SELECT w.vec_id, code, error, label_error, codebooks_sha256 FROM w JOIN k USING (vec_id) JOIN l ON k.label IS NOT DISTINCT FROM l.label, h"


@query(codes_sql())
def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors, with the errors of each and of its label."""
    return codes.compressed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


TRIE = """
WITH t AS (SELECT conv_id AS c, list({'r': COALESCE(role, ''), 't': COALESCE(text, '')} ORDER BY turn NULLS FIRST, role, text) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, w, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 6 AS h FROM t),
s AS (SELECT h.c, list_concat(COALESCE(b.w, [])[1:h.h], h.w[h.h + 1:]) AS w FROM h LEFT JOIN t b ON b.c = h.c - (h.c % 100 + 100) % 100),
m AS (SELECT c, d, w[1:d] AS p, w[1:d - 1] AS up, len(w) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE length(w[d].t) END AS chars FROM (SELECT c, w, unnest(range(0, len(w) + 1)) AS d FROM s)),
n AS (SELECT p, d, any_value(up) AS up, MIN(c) AS conv_id, COUNT(*) AS n_convs, (COUNT(*) - 1) * any_value(chars) AS own,
  sha256(COALESCE(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY p, d),
k AS (SELECT up, d - 1 AS d, COUNT(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, COALESCE(kids, 0) AS kids FROM n LEFT JOIN k ON n.d = k.d AND n.p = k.up),
u AS (SELECT a.p, a.d, SUM(CASE WHEN b.kids = 0 THEN 1 ELSE 0 END) AS n_leaves, SUM(b.own) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM f) b JOIN f a ON a.d = b.e AND a.p = b.p[1:b.e] GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.kids AS n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN u ON f.d = u.d AND f.p = u.p LEFT JOIN f q ON q.d = f.d - 1 AND f.d > 0 AND q.p = f.up
"""


@query(TRIE)
def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return trie.trie(table(spark, sf_dir, "conversations"))


LEAKS = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) END) AS g FROM b),
k AS (SELECT DISTINCT n FROM g),
x AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM w, k WHERE len(w) >= n)),
f AS (SELECT x.r, x.i, x.n, g.item_id FROM x JOIN g ON x.n = g.n AND x.g = g.g),
hit AS (SELECT r, COUNT(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM f)) GROUP BY r),
it AS (SELECT r, COUNT(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, COALESCE(CAST(item_id AS VARCHAR), '') AS s FROM f) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""


@query(LEAKS)
def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows of benchmark items hit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digests(decontaminate.find(docs, table(spark, sf_dir, "benchmark"), carry=["doc_id"]))


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
