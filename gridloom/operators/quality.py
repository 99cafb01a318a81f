"""Checks of artifacts and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def require_columns(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """``df`` itself; ValueError if it lacks a column."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return df


def audit(df: DataFrame, name: str, date: str = "date", earliest: int = 2010) -> DataFrame:
    """name, n_rows, first and last date, date_trap (dates before ``earliest``), ids_are_short."""
    short = dict(df.dtypes).get("lat_id") in (None, "smallint")
    return df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.coalesce(F.min(F.year(date)) < earliest, F.lit(False)).alias("date_trap"), F.lit(short).alias("ids_are_short"))


def audit_path(spark, path: str, name: str) -> DataFrame:
    """``audit`` of a Parquet table that may be missing or unreadable: then n_rows is NULL."""
    try:
        return audit(spark.read.parquet(path), name)
    except AnalysisException:
        return spark.createDataFrame([(name,)], "name string").select("name", F.lit(None).cast("long").alias("n_rows"), *[F.lit(None).cast("date").alias(f"{x}_date") for x in ("first", "last")], F.lit(False).alias("date_trap"), F.lit(False).alias("ids_are_short"))


def validate(df: DataFrame, name: str, columns: Sequence[str], least: int) -> DataFrame:
    """name, n_rows, status: ok, empty, too few rows, missing columns, or columns without a value."""
    have = [c for c in columns if c in df.columns]
    missing = [c for c in columns if c not in df.columns]
    n = F.count(F.lit(1))
    blank = F.lit(False)
    for c in have:
        blank = blank | (F.count(c) == 0)
    status = F.when(F.lit(bool(missing)), F.lit("missing columns")).when(n == 0, F.lit("empty")).when(n < least, F.lit("too few rows")).when(blank, F.lit("columns without a value")).otherwise(F.lit("ok"))
    return df.agg(F.lit(name).alias("name"), n.alias("n_rows"), status.alias("status"))


def coverage(found: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n_expected, n_found and percent of the expected combinations that have rows."""
    joined = expected.select(*keys).distinct().join(found.select(*keys).distinct().withColumn("_f", F.lit(1)), [*keys], "left")
    return joined.agg(F.count(F.lit(1)).alias("n_expected"), F.count("_f").alias("n_found"), F.try_divide(F.count("_f") * 100.0, F.count(F.lit(1))).alias("pct"))


def unexpected_days(df: DataFrame, date: str = "date") -> DataFrame:
    """Days of the year in the data that start no eight-day period."""
    return df.select(F.dayofyear(date).alias("doy")).distinct().where((F.col("doy") - 1) % 8 != 0)


def out_of_range(df: DataFrame, c: str, low: float, high: float) -> DataFrame:
    """n_out and pct_out of the rows with a value."""
    out = F.count(F.when(~F.col(c).between(low, high), 1))
    return df.agg(out.alias("n_out"), F.try_divide(out * 100.0, F.count(c)).alias("pct_out"))
