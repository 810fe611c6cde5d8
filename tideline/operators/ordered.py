"""Ordered computations inside groups that may be arbitrarily large.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task; if one key holds
a third of the table that task holds a third of the table.  :func:`ordered_scan` gives the
same answers with every group cut into chunks along its own order:

1. rows get a chunk number, a function of the leading order value and, where many rows
   share one such value, of the next order value too; a chunk is a contiguous stretch of
   the order, so inexact cut points change balance, never results;
2. ordinary windows run inside ``(group, chunk)``;
3. one summary row per chunk is carried across the chunks of its group (a tiny window)
   and joined back on ``(group, chunk)``, the partitioning the rows already have.

Cut points are pooled over all rows being cut, so no ``(group, chunk)`` holds more than
about ``rows / buckets`` rows, whatever the sizes of the groups, unless more rows than that
agree in the first two order values.  Groups by entity are cut
only for entities found to be large; when there are none the plan is a plain window.
A table that is cut is staged first, so whatever produced it runs once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import stage

# A key is "hot" above this share of all rows, hence there are at most 1/HOT_SHARE hot
# keys: the bound that makes a literal list of them safe at any data size.
HOT_SHARE = 1.0 / 1024
# Below this many rows a key never needs cutting: one task sorts it in well under a second.
# A session may set another number, in tests a small one that cuts every key.
HOT_FLOOR = 200_000
FLOOR_KEY = "spark.tideline.hot.floor"


def hot_floor(spark: SparkSession) -> int:
    return int(spark.conf.get(FLOOR_KEY, str(HOT_FLOOR)))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def default_buckets(spark: SparkSession) -> int:
    """As many chunks as shuffle partitions, within reason for a cut-point array."""
    return max(16, min(1 << 15, shuffle_partitions(spark)))


def hot_values(df: DataFrame, key: str, share: float = HOT_SHARE, floor: int | None = None) -> list:
    """Values of ``key`` holding more than ``share`` of the rows and more than ``floor`` rows.

    Runs one job: counts combine map-side, at most ``1 / share`` values come back.  A plan
    with several ordered steps over one table should call this once and pass the list on.
    """
    floor = hot_floor(df.sparkSession) if floor is None else floor
    counts = df.groupBy(key).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    big = counts.filter((F.col("__n") > F.lit(int(floor))) & (F.col("__n") > total * F.lit(share)) & F.col(key).isNotNull())
    return [r[0] for r in big.select(key).collect()]


def cut_points(df: DataFrame, value: Column | str, buckets: int) -> Column:
    """Scalar subquery with two-level cut points of ``value`` (mergeable sketch, one row)."""
    side = max(2, round(buckets**0.5))
    n = side * side
    value = F.col(value) if isinstance(value, str) else value
    cuts = F.percentile_approx(value.cast("double"), [i / n for i in range(1, n)], max(1000, 20 * n))
    coarse = F.transform(F.sequence(F.lit(1), F.lit(side - 1)), lambda i: F.element_at("c", (i * side).cast("int")))
    fine = F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda i: F.slice("c", i * side + 1, F.lit(side - 1)))
    # a value that is two cut points holds more rows than one chunk should
    heavy = F.array_distinct(F.filter("c", lambda x, i: (i > 0) & (x == F.get("c", i - 1))))
    return df.agg(cuts.alias("c")).select(F.struct(coarse.alias("coarse"), fine.alias("fine"), F.lit(side).alias("side"), heavy.alias("heavy"))).scalar()


def bucket_of(value: Column, cuts: Column) -> Column:
    """How many cut points are <= value; two short array scans instead of one long one."""
    at = F.size(F.filter(cuts["coarse"], lambda c: c <= value))
    return at * cuts["side"] + F.size(F.filter(F.element_at(cuts["fine"], at + 1), lambda c: c <= value))


def ordered_scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    *,
    number: str | None = None,
    sums: dict[str, str] | None = None,
    totals: dict[str, tuple[str, str]] | None = None,
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
    fill: dict[str, str] | None = None,
    back_fill: dict[str, str] | None = None,
    descending: bool = False,
    hot: Sequence | str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Add ordered columns per group ``by``, rows ordered by ``order``.

    ``number``     name of a running row number from 1
    ``sums``       new name -> column: running sum, current row included
    ``totals``     new name -> (``sum``/``max``/``min``/``count``, column): over the whole group
    ``lag/lead``   new name -> column: value in the previous / next row
    ``fill``       new name -> column: last non-missing value up to the current row
    ``back_fill``  new name -> column: first non-missing value from the current row on

    ``order[0]`` must be numeric.  ``hot`` lists the values of ``by[0]`` whose groups are
    cut (``None``: found by :func:`hot_values`); ``hot="all"`` cuts every group, for the
    few-and-huge groups of metric curves, whose ``by`` columns may be NULL: that is a group.
    """
    sums, totals, lag, lead = sums or {}, totals or {}, lag or {}, lead or {}
    fill, back_fill = fill or {}, back_fill or {}
    by, order = list(by), list(order)
    if hot is None:
        hot = hot_values(df, by[0]) if by else "all"
    cut_all = isinstance(hot, str)
    if cut_all and hot != "all":
        raise ValueError("hot must be a list of values, None or 'all'")

    if not cut_all and not hot:
        rows, chunk = df, [F.col(b) for b in by]
    else:
        df = stage(df)  # read three times below: cut points, chunk summaries, rows
        cut_rows = df if cut_all else df.filter(F.col(by[0]).isin(list(hot)))
        n = buckets or default_buckets(df.sparkSession)
        rows = df.withColumn("__cuts", cut_points(cut_rows, order[0], n))
        lead_value = F.col(order[0]).cast("double")
        at = bucket_of(lead_value, F.col("__cuts")).cast("long")
        if len(order) > 1 and isinstance(df.schema[order[1]].dataType, T.NumericType):
            # rows of a heavy leading value come before the others of its chunk, cut by the next value
            rows = rows.withColumn("__next", cut_points(cut_rows, order[1], n))
            heavy = F.array_contains(F.col("__cuts.heavy"), lead_value)
            part = F.when(heavy, bucket_of(F.col(order[1]).cast("double"), F.col("__next"))).otherwise(F.lit(2 * n + 16))
            at = at * F.lit(2 * n + 17) + F.coalesce(part, F.lit(0))
        at = -at if descending else at
        at = at if cut_all else F.when(F.col(by[0]).isin(list(hot)), at).otherwise(0)
        rows = rows.withColumn("__c", at).drop("__cuts", "__next")
        if cut_all and by:  # one key that is never NULL, so that NULL groups find their carried row
            rows = rows.withColumn("__key", F.struct(*by))
        chunk = ([F.col("__key")] if cut_all and by else [F.col(b) for b in by]) + [F.col("__c")]

    # inside a group, or inside a chunk of it
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    local = W.partitionBy(*chunk).orderBy(*keys)
    upto = local.rowsBetween(W.unboundedPreceding, W.currentRow)
    onward = local.rowsBetween(W.currentRow, W.unboundedFollowing)
    all_ = W.partitionBy(*chunk)
    own = [F.col(c) for c in df.columns]
    pieces: dict[str, Column] = {}
    if number:
        pieces[number] = F.row_number().over(local).cast("long")
    pieces |= {o: F.sum(c).over(upto) for o, c in sums.items()}
    pieces |= {o: getattr(F, fn)(c).over(all_) for o, (fn, c) in totals.items()}
    pieces |= {o: F.lag(c).over(local) for o, c in lag.items()}
    pieces |= {o: F.lead(c).over(local) for o, c in lead.items()}
    pieces |= {o: F.last(c, ignorenulls=True).over(upto) for o, c in fill.items()}
    pieces |= {o: F.first(c, ignorenulls=True).over(onward) for o, c in back_fill.items()}
    if rows is df:
        return df.select(*own, *[e.alias(o) for o, e in pieces.items()])

    # one row per chunk
    key = F.struct(*[F.col(c) for c in order])
    last_by, first_by = (F.min_by, F.max_by) if descending else (F.max_by, F.min_by)
    aggs = [F.count("*").alias("__n")]
    aggs += [F.sum(c).alias(f"__s_{o}") for o, c in sums.items()]
    aggs += [getattr(F, fn)(c).alias(f"__t_{o}") for o, (fn, c) in totals.items()]
    aggs += [last_by(c, key).alias(f"__g_{o}") for o, c in lag.items()]
    aggs += [first_by(c, key).alias(f"__d_{o}") for o, c in lead.items()]
    aggs += [last_by(c, F.when(F.col(c).isNotNull(), key)).alias(f"__f_{o}") for o, c in fill.items()]
    aggs += [first_by(c, F.when(F.col(c).isNotNull(), key)).alias(f"__b_{o}") for o, c in back_fill.items()]
    summed = rows if cut_all else rows.filter(F.col(by[0]).isin(list(hot)))
    keys_out = ["__key"] if cut_all and by else by
    chunks = summed.groupBy(*keys_out, "__c").agg(*aggs)

    # carried across the chunks of a group: one row per chunk
    group = [F.col(b) for b in keys_out] or [F.lit(0)]
    before = W.partitionBy(*group).orderBy("__c").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*group).orderBy("__c").rowsBetween(1, W.unboundedFollowing)
    step = W.partitionBy(*group).orderBy("__c")
    whole = W.partitionBy(*group)
    merge = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    carried = [F.sum("__n").over(before).alias("__n")]
    carried += [F.sum(f"__s_{o}").over(before).alias(f"__s_{o}") for o in sums]
    carried += [merge[fn](f"__t_{o}").over(whole).alias(f"__t_{o}") for o, (fn, _) in totals.items()]
    carried += [F.lag(f"__g_{o}").over(step).alias(f"__g_{o}") for o in lag]
    carried += [F.lead(f"__d_{o}").over(step).alias(f"__d_{o}") for o in lead]
    carried += [F.last(f"__f_{o}", ignorenulls=True).over(before).alias(f"__f_{o}") for o in fill]
    carried += [F.first(f"__b_{o}", ignorenulls=True).over(after).alias(f"__b_{o}") for o in back_fill]
    carry = chunks.select(*keys_out, "__c", *carried)

    helpers = {}
    if lag or lead:
        helpers["__h_n"] = F.row_number().over(local)
    if lead:
        helpers["__h_size"] = F.count("*").over(all_)
    if cut_all:  # group totals come with the carried row
        pieces = {o: e for o, e in pieces.items() if o not in totals}
    extra = ["__key"] if cut_all and by else []
    out = rows.select(*own, *extra, "__c", *[e.alias(f"__l_{o}") for o, e in pieces.items()], *[e.alias(h) for h, e in helpers.items()])
    out = out.join(carry, [*keys_out, "__c"], "left")

    def here(o):
        return F.col(f"__l_{o}")

    result = list(own)
    if number:
        result.append((here(number) + F.coalesce("__n", F.lit(0))).cast("long").alias(number))
    for o in sums:
        before_it = F.col(f"__s_{o}")
        result.append(F.when(before_it.isNull(), here(o)).otherwise(F.coalesce(here(o), F.lit(0)) + before_it).alias(o))
    for o in totals:
        result.append((F.col(f"__t_{o}") if cut_all else F.coalesce(F.col(f"__t_{o}"), here(o))).alias(o))
    for o in lag:
        result.append(F.when(F.col("__h_n") == 1, F.col(f"__g_{o}")).otherwise(here(o)).alias(o))
    for o in lead:
        result.append(F.when(F.col("__h_n") == F.col("__h_size"), F.col(f"__d_{o}")).otherwise(here(o)).alias(o))
    for o in fill:
        result.append(F.coalesce(here(o), F.col(f"__f_{o}")).alias(o))
    for o in back_fill:
        result.append(F.coalesce(here(o), F.col(f"__b_{o}")).alias(o))
    return out.select(*result)


def lookup(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left", *, hot: Sequence | str | None = None, salts: int | None = None) -> DataFrame:
    """Join many ``rows`` to a ``table`` with one row per key, when keys may be hot.

    Rows of a hot key are spread over ``salts`` values of a hash of the row (as many as there
    are shuffle partitions, so that one key can use the whole cluster); the table's
    row for that key is repeated once per salt.  One shuffle join on ``(key, salt)``; Spark
    still broadcasts ``table`` by itself when its measured size allows.  The salt is a
    hash, not a random number, so a retried task puts every row back where it was.

    ``hot`` lists hot values of ``on[0]`` (``None``: found by :func:`hot_values`, so at most
    ``salts / HOT_SHARE`` rows are added); ``hot="all"`` spreads every key, for tables with
    one row per group, and matches NULL keys to each other, since they are a group.  With no
    hot key this is a plain join.
    """
    if how not in ("left", "inner"):
        raise ValueError("lookup supports left and inner joins")
    on = list(on)
    if hot is None:
        hot = hot_values(rows.select(on[0]), on[0])
    if not hot:
        return rows.join(table, on, how)
    salts = salts or shuffle_partitions(rows.sparkSession)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(salts)).cast("int")
    copies = F.sequence(F.lit(0), F.lit(salts - 1))
    if hot != "all":
        is_hot = F.col(on[0]).isin(list(hot))
        spread, copies = F.when(is_hot, spread).otherwise(0), F.when(is_hot, copies).otherwise(F.array(F.lit(0)))
    left, right = rows.withColumn("__salt", spread), table.withColumn("__salt", F.explode(copies))
    if hot == "all":
        key = F.struct(*on).alias("__on")
        return left.select("*", key).join(right.select(key, "__salt", *[c for c in table.columns if c not in on]), ["__on", "__salt"], how).select(
            *rows.columns, *[c for c in table.columns if c not in on]
        )
    return left.join(right, [*on, "__salt"], how).drop("__salt")
