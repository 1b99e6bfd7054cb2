"""Tables behind diagnostics: what a plot would show, and CSV output. Drawing is left to the reader."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from .calibrate import sample


def scatter(df: DataFrame, x: str, y: str, key: str, most: int = 200_000) -> DataFrame:
    """x and y of the same `most` rows every time."""
    return sample(df, most, key).select(key, x, y)


def summary(df: DataFrame, *cols: str) -> DataFrame:
    """One row: min, p50, p99 and max of each column."""
    each = []
    for c in cols:
        each += [F.min(c).alias(f"{c}_min"), F.percentile(c, F.lit(0.5)).alias(f"{c}_p50"), F.percentile(c, F.lit(0.99)).alias(f"{c}_p99"), F.max(c).alias(f"{c}_max")]
    return df.agg(*each)


def histogram(df: DataFrame, col: str, low: float, high: float, bins: int) -> DataFrame:
    """bin, n for every bin; values outside fall into the first or last."""
    at = F.least(F.greatest(F.floor((F.col(col) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1))
    n = df.where(F.col(col).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(F.broadcast(n), "bin", "left").fillna(0, ["n"])


def heat_map(df: DataFrame, x: str, y: str, span: Sequence[float], bins: int) -> DataFrame:
    """bx, by, n of the cells that hold points; span: low and high of x, low and high of y."""
    cell = lambda c, lo, hi: F.least(F.greatest(F.floor((F.col(c) - lo) / (hi - lo) * bins), F.lit(0)), F.lit(bins - 1))
    return df.groupBy(cell(x, span[0], span[1]).alias("bx"), cell(y, span[2], span[3]).alias("by")).agg(F.count("*").alias("n"))


def build_times(spark: SparkSession, path: str, dataset: str = "dataset", method: str = "method", value: str = "hours") -> DataFrame:
    """A row a dataset, a column a method, from a CSV of long form."""
    return spark.read.csv(path, header=True, inferSchema=True).groupBy(dataset).pivot(method).agg(F.first(value)).orderBy(dataset)


def write_csv(df: DataFrame, path: str) -> None:
    """One file with header: for summaries, whose rows are few."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
