"""Adapters that give the given tables the roles the operators work on.

All times are days (double) from the entity's index: its first order, or first event.
"""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import bucketize, day_offset
from ..operators.ordered import HOT_SHARE, hot_floor, hot_values, lookup
from ..sources.tables import read_table

ACCRUAL, FORECAST = 365.25, 180.0
EVENT_ACCRUAL, EVENT_FORECAST = 7.0, 3.0
SEED = 11
MEASURES = ["AF", "AO", "NF", "NO", "RF", "RO"]
MEASURE_ORDER = ["t", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "value"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
STUDY_END = "2001-08-01"
HIGH_VALUE = 250000.0


# declared, so that no read has to open files to infer a schema
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, f"{d}/{name}.parquet", SCHEMAS[name])


def index_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("index_ts"))


# session -> (kind, folder, floor) -> hot keys; a session's entries go with it
_HOT: WeakKeyDictionary = WeakKeyDictionary()


def _remembered(spark: SparkSession, kind: str, d: str, find: Callable[[int], list]) -> list:
    floor, known = hot_floor(spark), _HOT.setdefault(spark, {})
    if (kind, d, floor) not in known:
        known[kind, d, floor] = find(floor)
    return known[kind, d, floor]


def hot_ids(spark: SparkSession, d: str) -> list:
    """Customers large enough, in orders or line items, to need cutting in ordered steps.

    A table of no more rows than the floor cannot contain one; its row count comes from
    the file footers.  Remembered per session: a stale list can only cost balance.
    """

    def find(floor: int) -> list:
        orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
        if items.count() <= floor and orders.count() <= floor:
            return []
        per_order = items.groupBy("l_orderkey").agg(F.count("*").alias("k"))
        sized = orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.sum(F.coalesce("k", F.lit(0)) + 1).alias("n"))
        total = sized.agg(F.sum("n")).scalar()
        return [r[0] for r in sized.filter((F.col("n") > floor) & (F.col("n") > total * F.lit(HOT_SHARE))).select("o_custkey").collect()]

    return _remembered(spark, "id", d, find)


def hot_users(spark: SparkSession, d: str) -> list:
    events = table(spark, d, "events")
    return _remembered(spark, "user", d, lambda floor: [] if events.count() <= floor else hot_values(events, "user_id", floor=floor))


def hot_orders(spark: SparkSession, d: str) -> list:
    items = table(spark, d, "lineitem")
    return _remembered(spark, "order", d, lambda floor: [] if items.count() <= floor else hot_values(items, "l_orderkey", floor=floor))


def spine(spark: SparkSession, d: str, days: DataFrame | None = None) -> DataFrame:
    """Customers with at least one order, with their study end and death time.

    ``days`` is a staged ``order_days``, read instead of the orders where a plan has one.
    """
    index = index_dates(spark, d) if days is None else days.groupBy("id").agg(F.min("index_ts").alias("index_ts"))
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "id").join(index, "id")
    c = c.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        "id", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("acctbal"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"),
        day_offset(F.lit(STUDY_END).cast("timestamp_ntz"), "index_ts").alias("study_end"),
        F.when(F.col("c_acctbal") < 0, (F.lit(1000) + F.col("id") % 1000).cast("double")).alias("death"),
        acctbal_bucket().cast("string").alias("balance"),
    ).select("id", "segment", "acctbal", "balance", "nation", "region", "study_end", "death")


def acctbal_bucket():
    b = F.col("c_acctbal")
    return bucketize([(b < 0, "debt"), (b < 3000, "low"), (b < 7000, "mid")], "high")


def order_days(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their day offset from the customer's index, and that index."""
    o = lookup(table(spark, d, "orders").withColumnRenamed("o_custkey", "id"), index_dates(spark, d), ["id"], "inner", hot=hot_ids(spark, d))
    return o.select("id", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", day_offset("o_orderdate", "index_ts").alias("t"), "index_ts")


def orders_by_day(spark: SparkSession, d: str) -> DataFrame:
    return order_days(spark, d).drop("index_ts")


def study_ends(days: DataFrame) -> DataFrame:
    """Study end of each customer in ``order_days``."""
    return days.groupBy("id").agg(day_offset(F.lit(STUDY_END).cast("timestamp_ntz"), F.min("index_ts")).alias("study_end"))


def event_logs(spark: SparkSession, d: str, days: DataFrame | None = None) -> dict[str, DataFrame]:
    """Two event logs: urgent orders after day 0, finished and unfinished."""
    days = orders_by_day(spark, d) if days is None else days
    u = days.filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("t") > 0))
    u = u.withColumn("indicator", F.when(F.col("o_totalprice") > HIGH_VALUE, "major"))
    pick = lambda c: u.filter(c).select("id", "o_orderkey", "t", "indicator")
    return {"closed": pick(F.col("o_orderstatus") == "F"), "open": pick(F.col("o_orderstatus").isin("O", "P"))}


def switch_times(spark: SparkSession, d: str, days: DataFrame | None = None) -> DataFrame:
    days = orders_by_day(spark, d) if days is None else days
    return days.filter((F.col("o_orderpriority") == "2-HIGH") & (F.col("t") > 0)).groupBy("id").agg(F.min("t").alias("switch_t"))


def measures(spark: SparkSession, d: str) -> DataFrame:
    """Line items as measurements: six measures at shipping days, some before day 0."""
    o = lookup(table(spark, d, "orders").withColumnRenamed("o_custkey", "id"), index_dates(spark, d), ["id"], "inner", hot=hot_ids(spark, d))
    o = o.select(F.col("o_orderkey").alias("l_orderkey"), "id", "index_ts")
    li = lookup(table(spark, d, "lineitem"), o, ["l_orderkey"], "inner", hot=hot_orders(spark, d))
    return li.select(
        "id", F.concat("l_returnflag", "l_linestatus").alias("measure"), day_offset("l_shipdate", "index_ts").alias("t"),
        F.col("l_extendedprice").alias("value"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


def event_measures(spark: SparkSession, d: str) -> DataFrame:
    """The event stream as short-horizon measurements, days from the user's first event."""
    e = table(spark, d, "events")
    first = e.groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    e = lookup(e, first, ["user_id"], "inner", hot=hot_users(spark, d))
    return e.select(F.col("user_id").alias("id"), F.col("event_type").alias("measure"), day_offset("ts", "first_ts").alias("t"), "value", "event_id")


def scored_rows(spark: SparkSession, d: str) -> DataFrame:
    """Line items as scored rows with heavily tied scores, two models, five repetitions."""
    li = table(spark, d, "lineitem")
    y = F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y")
    first = F.col("l_discount") * 6.0 + F.col("l_linenumber") / 100.0
    second = F.col("l_quantity") / 64.0
    models = F.map_from_arrays(F.array(F.lit("m1"), F.lit("m2")), F.array(first, second))
    return li.select((F.col("l_orderkey") % 5).alias("seed"), y, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.explode(models).alias("model", "score"))


def labelled_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "source", "lang")
    n = F.col("n_chars").cast("double")
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"), (n / (n + 1500.0)).alias("score"), "source", "lang")


def result_grid(spark: SparkSession, d: str) -> DataFrame:
    """Events as a grid of results: method, seed, forecast and a metric."""
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("method"), (F.col("user_id") % 50).alias("seed"), (F.col("user_id") % 3).alias("forecast")).agg(F.avg("value").alias("metric"))
