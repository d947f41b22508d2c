"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

The rows of a source, in an order drawn from a seed, form blocks. Time runs in slots of one block. With weight w, block i
of a source is released at slot floor(i / w) and has to be placed before slot ceil((i + 1) / w); placing the released
block with the earliest deadline in every slot keeps each source within one block of its share at any time.

Weights are whole parts; a fraction counts as the number that it is written as, so 0.0001 is one part in 10,000. After a cycle of as
many slots as there are parts, every source stands exactly at its share, so the schedule of one cycle repeats without any
rounding, and the slot of any block follows from its number alone. The schedule grows with the parts that the
weights state, not with the data; up to ``NATIVE`` slots times sources it is one expression on one row, and longer cycles (up to ``MOST`` slots) are
laid out on the driver, with the same result. Rows are numbered within their source from counts of buckets, so a
source that holds a third of all rows is no more work for one task than any other.

When a source runs out, its slots fall away and the others go on in their order: no row is left out. Until then the
deviation is below one block.

Defined results: a null source is a source of its own; sources without a weight come after all others, in one block
sequence by source; null ids and texts, empty texts and repeated rows are placed like any row, rows that are alike in
an order that does not matter; an empty table gives an empty table; the four columns added replace columns of
their names.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from altertrace.plans.tables import cut, lookup

BLOCK = 16
#: Slots times sources that one expression lays out, and slots that a cycle may have at all.
NATIVE, MOST = 1 << 18, 1 << 20
#: What a source's size counts for, and the parts of the largest source, where sizes give the weights.
POWER, PARTS = 0.7, 100
ROWS_PER_BUCKET = 50_000
LEAST_BITS = 6


#: Weights by source: numbers, or a table ``source, share`` of whole parts; None: equal weights.
Weights = dict[str | None, float] | DataFrame | None


def shuffled(seed: int, id_col: str, text_col: str) -> Column:
    """A number below 2^60 drawn from the seed, a row's id and its text: the order of the rows of a source."""
    value = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def in_parts(weights: dict[str | None, float]) -> dict[str | None, int]:
    """Whole parts in exactly the proportions of some weights; those of 0 or less have none."""
    exact = {s: Fraction(str(w)) for s, w in weights.items() if w is not None and w > 0}
    whole = math.lcm(*(x.denominator for x in exact.values()))
    least = math.gcd(*(int(x * whole) for x in exact.values())) or 1
    return {s: int(x * whole) // least for s, x in exact.items()}


def sized(docs: DataFrame, source_col: str = "source", power: float = POWER, parts: int = PARTS) -> DataFrame:
    """``source, share``: parts by the number of a source's rows to a power below 1, so that small sources are seen more often than they
    are large; the largest source has ``parts``, every other one at least one."""
    counts = cut(docs.groupBy(F.col(source_col).alias("source")).agg(F.pow(F.count(F.lit(1)), F.lit(power)).alias("size")))
    most = counts.agg(F.max("size")).first()[0] or 1.0
    share = F.greatest(F.floor(F.col("size") * parts / F.lit(most) + 0.5), F.lit(1)).cast("long")
    return counts.select("source", share.alias("share"))


def schedule(given: DataFrame, cycle: int) -> DataFrame:
    """``source, share, slots``: the slots of a source's blocks in one cycle, by earliest deadline among those released."""
    one = given.groupBy().agg(F.sort_array(F.collect_list(F.struct("share", "source"))).alias("s"))

    def slot(state: Column, t: Column) -> Column:
        # for every source: is its next block released, and when is its deadline
        def key(source: Column, i: Column) -> Column:
            n = F.element_at(state["done"], i + 1)
            released = (n * cycle) <= (t * source["share"] + source["share"] - 1)  # floor(n / w) <= t
            deadline = F.ceil((n + 1) * cycle / source["share"]).cast("long")
            return F.when(released & (n < source["share"]), F.struct(deadline.alias("deadline"), i.alias("i")))

        pick = F.array_min(F.filter(F.transform(F.col("s"), key), lambda x: x.isNotNull()))["i"]
        done = F.transform(state["done"], lambda n, i: n + F.when(i == pick, F.lit(1)).otherwise(F.lit(0)))
        return F.struct(done.alias("done"), F.concat(state["picks"], F.array(F.coalesce(pick, F.lit(-1)))).alias("picks"))

    start = F.struct(F.transform("s", lambda _: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("picks"))
    run = one.select("s", F.aggregate(F.sequence(F.lit(0), F.lit(max(cycle, 1) - 1)), start, slot, lambda x: x["picks"]).alias("picks"))
    every = run.select(F.posexplode("s").alias("i", "source"), "picks")
    slots = F.filter(F.transform("picks", lambda p, t: F.when(p == F.col("i"), t)), lambda t: t.isNotNull())
    return every.select(F.col("source.source").alias("source"), F.col("source.share").alias("share"), slots.alias("slots"))


def long_schedule(given: DataFrame, cycle: int) -> DataFrame:
    """As :func:`schedule`, for sources by the thousand: the driver keeps the blocks in heaps, so a slot takes a logarithm of the sources."""
    rows = given.orderBy("share", F.asc_nulls_first("source")).collect()
    waiting = [(0, i) for i in range(len(rows))]  # release, source
    ready: list[tuple[int, int]] = []  # deadline, source
    slots: list[list[int]] = [[] for _ in rows]
    for t in range(cycle):
        while waiting and waiting[0][0] <= t:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(len(slots[i]) + 1) * cycle // rows[i]["share"]), i))
        if ready:
            i = heapq.heappop(ready)[1]
            slots[i].append(t)
            if (n := len(slots[i])) < rows[i]["share"]:
                heapq.heappush(waiting, (n * cycle // rows[i]["share"], i))
    schema = StructType([*given.schema.fields, StructField("slots", ArrayType(IntegerType()))])
    return given.sparkSession.createDataFrame([(*r, s) for r, s in zip(rows, slots)], schema)


class Places:
    """Where the rows of ``docs`` go: their shuffled order, the buckets of a source and the schedule of a cycle."""

    def __init__(self, docs: DataFrame, weights: Weights, source_col: str, id_col: str, text_col: str, block: int, seed: int):
        self.block = block
        self.key = [F.col(source_col).alias("source"), shuffled(seed, id_col, text_col).alias("order"), F.col(id_col).alias("id")]
        largest = docs.groupBy(source_col).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        bits = max(LEAST_BITS, math.ceil(math.log2(max(1, largest / ROWS_PER_BUCKET))))
        # buckets follow the order, so that a row's number is the rows of earlier buckets and its place in its own
        self.bucket = F.shiftright("order", 60 - bits)
        counted = docs.select(*self.key).select("source", self.bucket.alias("bucket")).groupBy("source", "bucket").count()
        earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        self.starts = counted.select("source", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("start"))
        if weights is None:
            target = docs.select(F.col(source_col).alias("source")).distinct().withColumn("share", F.lit(1).cast("long"))
        elif isinstance(weights, dict):
            target = docs.sparkSession.createDataFrame(list(in_parts(weights).items()), "source string, share long")
        else:
            target = cut(weights.where("share > 0").select("source", F.col("share").cast("long").alias("share")))
        self.cycle, n = target.agg(F.coalesce(F.sum("share"), F.lit(0)), F.count(F.lit(1))).first()
        if self.cycle > MOST:
            raise ValueError(f"the weights have {self.cycle} parts, a cycle at most {MOST}: state them in fewer parts")
        self.plan = (schedule if self.cycle * n <= NATIVE else long_schedule)(target, self.cycle)

    def rows(self, docs: DataFrame, row: Column | None = None) -> DataFrame:
        """The rows' keys and buckets, with ``row``."""
        return docs.select(*([row.alias("row")] if row is not None else []), *self.key).withColumn("bucket", self.bucket)

    def ranked(self, rows: DataFrame) -> DataFrame:
        """Adds ``rank`` in the source, the least rank of the rows with the same key as ``tie``, ``share`` and ``slots``."""
        starts = self.starts.alias("a").join(self.plan.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.*", "share", "slots")
        within = Window.partitionBy("source", "bucket").orderBy("order", "id")
        placed = rows.withColumn("place", F.row_number().over(within) - 1).withColumn("first", F.rank().over(within) - 1)
        same = placed["source"].eqNullSafe(starts["source"]) & (placed["bucket"] == starts["bucket"])
        numbers = [(F.col("start") + F.col(c)).cast("long").alias(n) for c, n in (("place", "rank"), ("first", "tie"))]
        return placed.join(starts, same).select(*[placed[c] for c in rows.columns], *numbers, "share", "slots")

    def block_of(self, rank: str) -> Column:
        return F.floor(F.col(rank) / F.lit(self.block)).cast("long")

    def slot_of(self, rank: str) -> Column:
        """The slot of a row by its rank, its source's share and slots; sources without a weight come behind everything."""
        whole, share = self.block_of(rank), F.col("share")
        slot = F.floor(whole / share) * F.lit(self.cycle) + F.element_at("slots", (whole % share + 1).cast("int"))
        return F.coalesce(slot, F.lit(1 << 62) + whole).cast("long")


def mix(
    docs: DataFrame, weights: Weights = None, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, seed: int = 1, carry: list[str] | None = None,
) -> DataFrame:
    """Adds ``mix_slot`` (the block's place), ``mix_block`` (its number in the source), ``mix_rank`` (the row's number in the
    source) and ``mix_share`` (slots a cycle, null without a weight). Order by slot, source and rank to get the mixture.

    Of the columns of ``docs`` those in ``carry`` stay, all if None. Without ``weights`` all sources get the same weight. Two jobs count the rows of a source's buckets; the rows move once.
    """
    added = ["mix_slot", "mix_block", "mix_rank", "mix_share"]
    places = Places(docs, weights, source_col, id_col, text_col, block, seed)
    row = F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns if c not in added])
    ranked = places.ranked(places.rows(docs, row))
    return ranked.select("row.*", places.slot_of("rank").alias("mix_slot"), places.block_of("rank").alias("mix_block"), F.col("rank").alias("mix_rank"), F.col("share").alias("mix_share"))


def _stretch(slot: Column, bounds: list[int]) -> Column:
    """How many of the rising ``bounds`` are at most ``slot``, by bisection."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    held = F.array(*[F.lit(b).cast("long") for b in bounds])
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda low, s: F.when(F.get(held, low + s - 1) <= slot, low + s).otherwise(low))


def interleaved(
    docs: DataFrame, weights: Weights = None, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, seed: int = 1, partitions: int | None = None,
) -> DataFrame:
    """The rows of ``docs`` in the order of the mixture: written, they lie in the files one after the other.

    Whole rows move once. Keys alone are ranked first and written; the schedule is cut into ``partitions`` stretches of about as
    many rows (as many as the session has shuffle partitions, if None), and for every stretch, source and bucket the least
    key and the rank that it starts from are kept. With those a row finds its stretch from its own key, is sent there, and counts on
    from that rank. Rows alike in id and text all lie in the stretch of the first of them.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = Places(docs, weights, source_col, id_col, text_col, block, seed)
    # rows with the same key stay together, so a stretch takes all of them by the least of their ranks
    keys = cut(places.ranked(places.rows(docs)).select("source", "bucket", "order", "id", "tie", places.slot_of("tie").alias("slot")))
    quantiles = keys.agg(F.percentile_approx("slot", [i / n for i in range(1, n)] or [1.0], F.lit(max(10_000, 20 * n))).alias("q")).first()["q"]
    bounds = sorted(set(quantiles or [])) if n > 1 else []
    stretch = _stretch(F.col("slot"), bounds).alias("stretch")
    firsts = keys.select("*", stretch).groupBy("source", "bucket", "stretch").agg(F.min(F.struct("order", "id")).alias("key"), F.min("tie").alias("tie"))
    base = F.min("tie").over(Window.partitionBy("source", "stretch")).alias("base")  # one row for each bucket in it
    edges = firsts.select("source", "bucket", F.struct("key", "stretch", base).alias("edge"))
    edges = lookup(edges.groupBy("source", "bucket").agg(F.sort_array(F.collect_list("edge")).alias("edges")))

    rows = places.rows(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    same = rows["source"].eqNullSafe(edges["source"]) & (rows["bucket"] == edges["bucket"])
    own = F.array_max(F.filter("edges", lambda e: e["key"] <= F.struct("order", "id")))
    sent = rows.join(edges, same).select(*[rows[c] for c in rows.columns], own.alias("own"))
    sent = sent.select("row", "source", "order", "id", F.col("own.stretch").alias("stretch"), F.col("own.base").alias("base")).repartitionByRange(n, "stretch")
    within = Window.partitionBy("stretch", "source").orderBy("order", "id")
    ranked = sent.select("row", "source", (F.col("base") + F.row_number().over(within) - 1).cast("long").alias("rank"))
    plan = lookup(places.plan)
    placed = ranked.join(plan, ranked["source"].eqNullSafe(plan["source"]), "left").select("row", ranked["source"], "rank", places.slot_of("rank").alias("slot"))
    return placed.sortWithinPartitions("slot", "source", "rank").select("row.*")
