"""File readers for the plant exports.

Only header lines are read on the driver (a bounded ``limit``); data rows
are parsed by the distributed CSV reader and repaired with column
expressions.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import coerce_numeric, coerce_timestamp
from ..operators.ingest import norm_columns


def list_files(spark: SparkSession, path: str, glob_pattern: str = "*.csv") -> list[str]:
    """Data files under ``path`` via Spark's file listing (works for any Hadoop FS URI).

    The ``binaryFile`` source prunes the content column, so only paths are read.
    """
    rows = (spark.read.format("binaryFile").option("pathGlobFilter", glob_pattern).load(path)
            .select("path").orderBy("path").toLocalIterator())
    return [r[0] for r in rows]


def _first_file(spark: SparkSession, path: str) -> str:
    files = list_files(spark, path)
    return files[0] if files else path


def read_multirow_header(spark: SparkSession, path: str, names_row: int = 1, clock_name: str = "CLOCK") -> DataFrame:
    """A1: headerless export; line ``names_row`` holds the names, data rows are the ones
    whose first field parses as a timestamp (title / unit rows drop out).

    First column → ``clock_name``; a blank name → ``col_<i>``; values → double.
    """
    head = spark.read.option("header", False).csv(_first_file(spark, path)).limit(names_row + 1).collect()
    raw = list(head[names_row])
    names = [clock_name if i == 0 else ((str(v).strip() if v is not None and str(v).strip() else f"col_{i}"))
             for i, v in enumerate(raw)]
    df = spark.read.option("header", False).csv(path)
    ts = coerce_timestamp(F.col(df.columns[0]))
    df = df.withColumn(df.columns[0], ts).where(F.col(df.columns[0]).isNotNull())
    df = df.select(F.col(df.columns[0]).alias(names[0]),
                   *[coerce_numeric(F.col(c)).alias(n) for c, n in zip(df.columns[1:], names[1:])])
    return df


def choose_source(paths: Sequence[str], hints: Sequence[str] = ("BF", "DATA", "PARA")) -> str:
    """A2: the first path whose name contains a hint (case-insensitive), else the last."""
    for p in paths:
        if any(h.lower() in os.path.basename(p.rstrip("/")).lower() for h in hints):
            return p
    return list(paths)[-1]


def read_single_header(spark: SparkSession, paths: Sequence[str], hints=("BF", "DATA", "PARA")) -> DataFrame:
    return spark.read.option("header", True).csv(choose_source(paths, hints))


def read_burden_csv(spark: SparkSession, path: str) -> DataFrame:
    """A4: header CSV, BOM stripped by the reader, padded names and values trimmed,
    names normalised (trim → upper → '_')."""
    df = (spark.read.option("header", True).option("encoding", "UTF-8")
          .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path))
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return norm_columns(df)


def read_matrix_long(spark: SparkSession, path: str) -> DataFrame:
    """Labelled square matrix (first column = row label) → long (a, b, value); blanks → NULL."""
    df = spark.read.option("header", True).csv(path)
    first = df.columns[0]
    others = df.columns[1:]
    long = df.withColumnRenamed(first, "col_a").unpivot(["col_a"], others, "col_b", "v")
    return long.select("col_a", "col_b", coerce_numeric(F.col("v")).alias("value"))


def read_partition(spark: SparkSession, path: str, column: str, value, schema: str) -> DataFrame:
    """Read one partition (pruned by the reader); empty frame of ``schema`` if absent."""
    from pyspark.errors import AnalysisException
    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return df.where(F.col(column) == F.lit(value))
