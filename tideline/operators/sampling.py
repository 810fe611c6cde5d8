"""Splits, permutations and subsamples that depend only on (seed, key)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import keyed_uniform
from .ordered import lookup, ordered_scan


def with_repetitions(df: DataFrame, n: int, name: str = "seed", first: int = 1) -> DataFrame:
    """Repeat every row for ``n`` seeds: the repetition is a column, not a loop."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))))


def split_assign(df: DataFrame, *, id: str, seed, fractions: dict[str, float], name: str = "split") -> DataFrame:
    """Independent random split by entity; all rows of an entity get the same part."""
    if abs(sum(fractions.values()) - 1.0) > 1e-9:
        raise ValueError("fractions must sum to 1")
    u, upto = keyed_uniform(seed, "split", F.col(id)), 0.0
    parts = list(fractions.items())
    out = None
    for part, share in parts[:-1]:
        upto = round(upto + share, 12)
        out = (F if out is None else out).when(F.col("__u") < F.lit(upto), F.lit(part))
    last = F.lit(parts[-1][0])
    return df.withColumn("__u", u).withColumn(name, last if out is None else out.otherwise(last)).drop("__u")


def stratified_split(df: DataFrame, *, id: str, stratum: str, seed, holdout: float = 0.4, test_share: float = 0.5, mode: str = "validation") -> DataFrame:
    """Class-balanced train / validation / test.

    The first cut takes ``holdout`` of every stratum, the second splits that remainder.
    In ``test`` mode validation rows join the training part.  Expects one row per entity.
    """
    if mode not in ("validation", "test"):
        raise ValueError("mode must be 'validation' or 'test'")
    rows = df.withColumn("__u", keyed_uniform(seed, "stratified", F.col(id)))
    ranked = ordered_scan(rows, [stratum], ["__u", id], number="__i", totals={"__n": ("count", id)}, hot="all")
    train = F.round(F.col("__n") * F.lit(1.0 - holdout))
    valid = train + F.round((F.col("__n") - train) * F.lit(1.0 - test_share))
    part = F.when(F.col("__i") <= train, "train").when(F.col("__i") <= valid, "validation").otherwise("test")
    out = ranked.withColumn("split", part).drop("__u", "__i", "__n")
    if mode == "test":
        out = out.withColumn("split", F.when(F.col("split") == "validation", "train").otherwise(F.col("split")))
    return out


def in_split(df: DataFrame, assigned: DataFrame, id: str, parts: Sequence[str]) -> DataFrame:
    """Rows of the entities assigned to the given parts."""
    return df.join(assigned.filter(F.col("split").isin(list(parts))).select(id), id, "left_semi")


def subsample(df: DataFrame, *, key: Sequence[str], seed, fraction: float) -> DataFrame:
    return df.filter(keyed_uniform(seed, "subsample", *[F.col(k) for k in key]) < F.lit(float(fraction)))


def permuted_lists(df: DataFrame, *, key: Sequence[str], column: str, seed, replicates: int = 1, name: str = "permuted") -> DataFrame:
    """``df`` with ``name``, the list of the values of ``column`` that the replicates' random permutations of the rows put in a row's place.

    Positions come from ordered scans (key order, and keyed-hash order by replicate) and one equi
    join on the position, so no task sees the whole table. Rows are numbered and joined once,
    whatever the number of replicates: only drawn values are sorted for each. The join is a merge by
    hint, since Spark may take the lists for a small table and send all replicates
    through the driver.  ``key`` identifies a row and starts with a numeric column.
    """
    key = list(key)
    drawn = with_repetitions(df.select(*key, F.col(column).alias("__v")), replicates, "__replicate")
    hashed = drawn.withColumn("__u", keyed_uniform(seed, "permute", F.col("__replicate"), *[F.col(k) for k in key]))
    source = ordered_scan(hashed, ["__replicate"], ["__u", *key], number="__pos", hot="all")
    lists = source.select("__pos", "__replicate", "__v").repartition("__pos").groupBy("__pos").agg(F.collect_list(F.struct("__replicate", "__v")).alias("__l"))
    in_turn = F.transform(F.array_sort("__l", lambda a, b: a["__replicate"] - b["__replicate"]), lambda x: x["__v"])
    target = ordered_scan(df, [], key, number="__pos", hot="all")
    return target.join(lists.select("__pos", in_turn.alias(name)).hint("merge"), "__pos").select(*df.columns, name)


def permute_column(df: DataFrame, *, key: Sequence[str], column: str, seed, replicates: int = 1, name: str = "permuted") -> DataFrame:
    """Reassign ``column`` by a random permutation of the rows, per replicate; see ``permuted_lists``."""
    lists = permuted_lists(df, key=key, column=column, seed=seed, replicates=replicates, name="__lists")
    return lists.select(*df.columns, F.posexplode("__lists").alias("__i", name)).select((F.col("__i") + 1).alias("replicate"), *df.columns, name)


def permute_static(df: DataFrame, *, id: str, column: str, seed, replicates: int = 1, name: str = "permuted", hot: Sequence | None = None) -> DataFrame:
    """Permute an entity-level column between entities; all rows of an entity move together."""
    per_entity = df.groupBy(id).agg(F.max(column).alias(column))
    moved = permute_column(per_entity, key=[id], column=column, seed=seed, replicates=replicates, name=name)
    rows = with_repetitions(df, replicates, "replicate")
    return lookup(rows, moved.select("replicate", id, name).hint("merge"), [id, "replicate"], "left", hot=hot)
