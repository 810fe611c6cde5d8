"""Readers with declared schemas: single tables, tagged directories, result splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """One table by path.  Text formats need a schema: nothing is inferred."""
    if schema is None and fmt in ("csv", "json"):
        raise ValueError(f"{fmt} needs a declared schema")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_directory(spark: SparkSession, path: str, schema: T.StructType | str, tag: str, fmt: str = "csv", **options) -> DataFrame:
    """Every file of a directory stacked, the file's stem as column ``tag``."""
    options = {"header": True, **options} if fmt == "csv" else options
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)
    return read_table(spark, path, schema, fmt, **options).withColumn(tag, stem)


def read_measure_files(spark: SparkSession, paths: dict[str, str], schema: T.StructType | str, tag: str, fmt: str = "csv", **options) -> DataFrame:
    """As :func:`read_directory` when the files are listed by name."""
    options = {"header": True, **options} if fmt == "csv" else options
    parts = [read_table(spark, p, schema, fmt, **options).withColumn(tag, F.lit(n)) for n, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_splits(validation: DataFrame | None, test: DataFrame | None, name: str = "split_mode") -> DataFrame:
    """Validation and test results stacked with their split as a column."""
    parts = [df.withColumn(name, F.lit(k)) for k, df in (("validation", validation), ("test", test)) if df is not None]
    if not parts:
        raise ValueError("at least one result table is needed")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def read_grid(spark: SparkSession, path: str, tags: Sequence[str] = ()) -> DataFrame:
    """A whole result grid: one read of a partitioned directory, tags are its partitions."""
    df = spark.read.parquet(path)
    missing = set(tags) - set(df.columns)
    if missing:
        raise ValueError(f"grid lacks the tags {sorted(missing)}")
    return df
