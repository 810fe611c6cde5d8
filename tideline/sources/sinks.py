"""Parquet sinks keyed by configuration, and reuse of finished output."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, set beside the warehouse where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    For tables used several times or grown in a loop: their lineage runs once, a lost
    executor costs nothing but re-reading files, and readers get column pruning and sizes.
    """
    path = f"{shared_dir(df.sparkSession)}/tideline-stage/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str], mode: str = "overwrite") -> None:
    """One directory per configuration; re-running a configuration replaces only its own.

    Rows are not clustered by ``keys`` first: a configuration holding most of the rows
    would then be written by one task.
    """
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_by_level(df: DataFrame, path: str, key: str, levels: Sequence[str]) -> dict[str, str]:
    """One file set per listed value of ``key``, in one pass over ``df``; their paths by value.

    Rows of other values are not written; a value without rows gets an empty file set.
    """
    paths = {v: f"{path}/{key}={v}" for v in levels}
    empty = df.sparkSession.createDataFrame([], df.drop(key).schema)
    for p in paths.values():
        empty.write.parquet(p)
    write_partitioned(df.filter(df[key].isin(list(levels))), path, [key], "append")
    return paths


def write_bundle(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Several tables saved together under one directory."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_curves(df: DataFrame, path: str, feature: str = "feature") -> None:
    """Curves to one directory per feature."""
    write_partitioned(df, path, [feature])


def config_key(config: dict) -> str:
    """Stable short name of a full configuration."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def materialize(spark: SparkSession, build: Callable[[], DataFrame], root: str, config: dict, use_cache: bool = True) -> DataFrame:
    """Result of ``build()`` as a Parquet table named by its configuration.

    A finished table is read back without calling ``build``; an unfinished one (no success
    marker) is written again.
    """
    path = f"{root.rstrip('/')}/{config_key(config)}"
    if not (use_cache and _exists(spark, path)):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
