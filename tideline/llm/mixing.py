"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled by hash. Each gets a virtual finish time: the words
of its source up to and with it, over as many rounds as documents may repeat, divided by
the source's target. In the order of these times the mix takes documents until the total
budget is spent. DataFrame functions only.

Nothing needs a source or the whole mix in one task: running totals are taken in two
levels, over sums of hash or time slices and then inside each slice.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import WORD, documents, stage

#: Rows that one slice should hold.
SLICE_ROWS = 2_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], budget: Fraction, most: int) -> DataFrame:
    """``(source, size, rows)`` with ``place`` (from 0, by code point, null last) and ``target``.

    Weights repeat along the places. The budget, a share of all sizes, is dealt by weight; no
    target exceeds ``most`` times its source's size, and what is above goes to the others by
    weight. Solved at once: with sources sorted by the level at which they are full, the full
    ones are a prefix, and the level of the rest is (budget - full) / their weights.
    One row per source, so the windows here are small.
    """
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = (
        sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("place") % len(weights)).cast("long"))
        .withColumn("full", F.col("size") * most)
    )
    by_level = Window.orderBy(F.col("full") / F.col("weight"), "place")
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("size").over(every) * budget.numerator - F.coalesce(F.sum("full").over(before), F.lit(0)) * budget.denominator
    leveled = placed.withColumn("order", F.row_number().over(by_level)).withColumn(
        "level", left.cast("double") / float(budget.denominator) / F.sum("weight").over(after).cast("double")
    )
    free = F.col("full").cast("double") > F.col("level") * F.col("weight")
    first = F.min(F.when(free, F.col("order"))).over(every)
    level = F.max(F.when(F.col("order") == F.col("first"), F.col("level"))).over(every)
    return (
        leveled.withColumn("first", first)
        .withColumn("common", level)
        .select("source", "size", "rows", "place", F.when(F.col("order") >= F.col("first"), F.col("common") * F.col("weight")).otherwise(F.col("full").cast("double")).alias("target"))
    )


def _queued(docs: DataFrame, sources: DataFrame, id: str, source: str, size: Column, seed: str) -> DataFrame:
    """(row, size, source_size, place, target, before, mark): each document with the words of its source up to and with it."""
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit("null"))))
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("from"), size.alias("size"), mark.alias("mark"))
    known = sources.select(F.col("source").alias("from_"), F.col("size").alias("source_size"), "place", "target", F.ceil(F.col("rows") / SLICE_ROWS).alias("slices"))
    sliced = (
        rows.join(known, F.col("from").eqNullSafe(F.col("from_")))
        .drop("from", "from_")
        .withColumn("slice", F.floor(F.conv(F.substring("mark", 1, 8), 16, 10).cast("long") * F.col("slices") / F.lit(float(1 << 32))))
    )
    sums = sliced.groupBy("place", "slice").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("place").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("place", "slice", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("place", "slice").orderBy("mark", "size").rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.join(sums, ["place", "slice"])
        .withColumn("upto", F.col("ahead") + F.sum("size").over(inside))
        .select("row", "size", "source_size", "place", "target", "upto", "mark")
    )


def _finish(turn: Column | int) -> Column:
    return (F.col("upto") + F.col("source_size") * turn).cast("double") / F.when(F.col("target") > 0, F.col("target"))


def mix(
    docs: DataFrame,
    size: Column,
    id: str = "doc_id",
    source: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    budget: Fraction = Fraction(3, 2),
    most: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """(row, size, source_size, target, copies): every document, whole in ``row``, and how often it is taken.

    ``size`` is a column of ``docs``, never null. A null source is a source of its own, the last one; a null id
    has a fixed place in the shuffle. Repeated rows count each for itself, documents of equal
    hash and size may swap places. A document without words is taken like any other, but
    changes no sum; a source without words has target 0 and none is taken. An empty table
    gives an empty result. Re-runs agree, whatever the partitions.
    """
    narrow = stage(docs.select(id, source, size.alias("words")))
    sizes = narrow.groupBy(F.col(source).alias("source")).agg(F.sum("words").alias("size"), F.count(F.lit(1)).alias("rows"))
    sources = stage(targets(sizes, weights, budget, most))
    queue = stage(_queued(narrow, sources, id, source, F.col("words"), seed).drop("row"))
    turns = queue.select("size", "place", "mark", F.explode(F.array(*(F.struct(_finish(t).alias("at"), F.lit(t).alias("turn")) for t in range(most)))).alias("t"))
    turns = turns.select("size", "place", "mark", "t.at").filter("at is not null")
    everything, n = sources.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    spent = everything * budget.numerator // budget.denominator
    steps = max(1024, n // 100_000)
    # Even slices of time where most sources still run, growing ones after that.
    late = 2 * steps + F.floor(F.log2(F.col("at") / 2) * (steps // 4))
    sliced = turns.withColumn("slice", F.when(F.col("at") < 2, F.floor(F.col("at") * steps)).otherwise(late))
    sums = sliced.groupBy("slice").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("upto", F.sum("words").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)))
    over = sums.filter(F.col("upto") > spent).agg(F.min_by(F.struct("slice", (F.col("upto") - F.col("words")).alias("ahead")), "slice")).first()[0]
    last = None
    if over is not None:
        order = Window.orderBy("at", "place", "mark", "size").rowsBetween(Window.unboundedPreceding, 0)
        one = sliced.filter(F.col("slice") == over["slice"]).withColumn("upto", F.sum("size").over(order) + over["ahead"])
        last = one.filter(F.col("upto") <= spent).agg(F.max(F.struct("at", "place"))).first()[0]
        if last is None:  # not even the first of this slice fits
            last = sliced.filter(F.col("slice") < over["slice"]).agg(F.max(F.struct("at", "place"))).first()[0]
    key = lambda t: F.struct(_finish(t).alias("at"), F.col("place"))
    if over is None:
        taken = [_finish(t).isNotNull() for t in range(most)]
    elif last is None:
        taken = [F.lit(False) for _ in range(most)]
    else:
        limit = F.struct(F.lit(last["at"]).alias("at"), F.lit(last["place"]).alias("place"))
        taken = [F.coalesce(key(t) <= limit, F.lit(False)) for t in range(most)]
    copies = sum((t.cast("long") for t in taken), F.lit(0).cast("long"))
    return _queued(docs, sources, id, source, size, seed).select("row", "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, size: Column) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    return mix(docs, size).select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def op10(spark, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    docs = documents(spark, sf_dir).select("doc_id", "source", words(F.col("text")).alias("words"))
    taken = mix(docs, F.col("words"))
    return taken.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS mark
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::INT AS place FROM d GROUP BY source
), w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS full_size FROM s
), l AS (
  SELECT *, row_number() OVER o AS pos,
         (3 * (SELECT sum(source_size) FROM w) - 2 * coalesce(sum(full_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / 2.0
           / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY full_size::DOUBLE / weight::DOUBLE, place)
), f AS (
  SELECT min(pos) AS pos, min_by(level, pos) AS level FROM l WHERE full_size::DOUBLE > level * weight
), t AS (
  SELECT l.source, l.source_size, l.place, CASE WHEN l.pos >= f.pos THEN f.level * l.weight ELSE l.full_size::DOUBLE END AS target FROM l LEFT JOIN f ON true
), q AS (
  SELECT d.*, source_size, place, target, row_number() OVER () AS id,
         sum(size) OVER (PARTITION BY place ORDER BY mark, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), i AS (
  SELECT id, size, place, mark, (upto + turn * source_size)::DOUBLE / target AS fin FROM q, (VALUES (0), (1)) v(turn) WHERE target > 0
), c AS (
  SELECT id, size, sum(size) OVER (ORDER BY fin, place, mark ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM i
), k AS (
  SELECT id, sum(size)::BIGINT AS taken FROM c WHERE 2 * spent <= 3 * (SELECT sum(source_size) FROM w) GROUP BY id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN k USING (id)
"""
