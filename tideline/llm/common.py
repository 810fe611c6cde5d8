"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"

#: Elements that one block of ``running`` or ``highest`` takes by itself.
BLOCK = 256
#: Code points of a part of a text.
PART = 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors and the driver see.

    Without the setting (tests) a folder below the warehouse is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends in files."""
    path = shared(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where it is used inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def running(values: Column) -> Column:
    """For each element the sum of those before it; in blocks, so long arrays stay cheap."""

    def blocks(v: Column) -> Column:
        each = F.when(F.size(v) == 0, F.array().cast("array<long>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(v, b * BLOCK + 1, BLOCK)))
        )
        return let(each, lambda s: let(F.transform(s, lambda _, b: total(F.slice(s, 1, b))), lambda before: sums(v, before)))

    def sums(v: Column, before: Column) -> Column:
        def one(_: Column, i: Column) -> Column:
            b = F.floor(i / BLOCK).cast("int")
            return F.get(before, b) + total(F.slice(v, b * BLOCK + 1, i - b * BLOCK))

        return F.transform(v, one)

    return let(values, blocks)


def highest(values: Column) -> Column:
    """For each element the largest of those before it, null for the first; in blocks, as ``running``."""

    def blocks(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        each = F.transform(numbers, lambda b: F.array_max(F.slice(v, b * BLOCK + 1, BLOCK)))
        return let(each, lambda s: let(F.transform(s, lambda _, b: F.array_max(F.slice(s, 1, b))), lambda before: F.transform(v, lambda _, i: one(v, before, i))))

    def one(v: Column, before: Column, i: Column) -> Column:
        b = F.floor(i / BLOCK).cast("int")
        return F.greatest(F.get(before, b), F.array_max(F.slice(v, b * BLOCK + 1, i - b * BLOCK)))

    return let(values, lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(v))


def parts(text: Column) -> Column:
    """A text in parts of ``PART`` code points, for ``cut``."""
    return F.when(F.length(text) <= PART, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}+"), F.lit(0)))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text that ``parts`` has cut: the text before them is not read."""
    first, last = (F.floor(x / PART).cast("int") for x in (start, end))
    near = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
    return F.substring(near, (start - first * PART).cast("int") + 1, (end - start).cast("int"))


def untouched(found: Column, others: Column) -> Column:
    """Those of ``found``, spans by ascending start, that overlap none of ``others``, spans in any order.

    Both are merged by start; a span is free if no other before it ends behind its start and the
    next other starts behind it. The work grows with the number of spans, not with its square.
    """
    never = F.lit(-(1 << 62))

    def apart(f: Column) -> Column:
        mine = F.transform(f, lambda m, i: F.struct(m["start"].alias("start"), F.lit(1).alias("own"), m["end"].alias("end"), i.alias("at")))
        theirs = F.transform(others, lambda m: F.struct(m["start"].alias("start"), F.lit(0).alias("own"), m["end"].alias("end"), F.lit(-1).alias("at")))
        return let(F.array_sort(F.concat(theirs, mine)), lambda order: judged(f, order))

    def judged(f: Column, order: Column) -> Column:
        reached = highest(F.transform(order, lambda m: F.when(m["own"] == 0, m["end"]).otherwise(never)))
        coming = highest(F.transform(F.reverse(order), lambda m: F.when(m["own"] == 0, -m["start"]).otherwise(never)))
        return let(reached, lambda r: let(coming, lambda c: kept(f, order, r, c)))

    def kept(f: Column, order: Column, reached: Column, coming: Column) -> Column:
        def free(m: Column, i: Column) -> Column:
            before, after = F.get(reached, i), F.get(coming, F.size(order) - 1 - i)
            return F.when((m["own"] == 1) & (F.coalesce(before, never) <= m["start"]) & (F.coalesce(after, never) <= -m["end"]), m["at"])

        return F.transform(F.filter(F.transform(order, free), lambda at: at.isNotNull()), lambda at: F.get(f, at))

    return let(found, lambda f: F.when((F.size(f) == 0) | (F.size(others) == 0), f).otherwise(apart(f)))


def spans(text: Column, pattern: str, groups: tuple[int, ...] = ()) -> Column:
    """Leftmost non-overlapping matches with their places in code points.

    Array of (start, end, text, g1, g2, ...), a ``g`` for each group asked for. Matches
    must not be empty. A null text counts as empty.
    """
    text = F.coalesce(text, F.lit(""))
    found = F.struct(
        F.split(text, pattern, -1).alias("between"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        *(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups),
    )

    def placed(f: Column) -> Column:
        def one(before: Column, i: Column) -> Column:
            start = before + F.length(F.get(f["between"], i))
            hit = F.get(f["hit"], i)
            return F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("text"), *(F.get(f[f"g{g}"], i).alias(f"g{g}") for g in groups))

        lengths = F.transform(f["hit"], lambda h, i: (F.length(h) + F.length(F.get(f["between"], i))).cast("long"))
        return F.transform(running(lengths), one)

    kind = "array<struct<start:long,end:long,text:string" + "".join(f",g{g}:string" for g in groups) + ">>"
    return F.when(text.rlike(pattern), let(found, placed)).otherwise(F.array()).cast(kind)


def joined(marks: Column) -> Column:
    """``kind:start:end`` of (kind, start, end) structs, joined by commas."""
    return F.array_join(F.transform(marks, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")
