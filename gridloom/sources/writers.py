"""Writers: partitioned tables, idempotent and resumable, CSV exports and small reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def write_table(df: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    """The table anew, whatever was there."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def replace_partitions(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Only the partitions that ``df`` has rows of are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def append(df: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def export_csv(df: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").option("header", True).partitionBy(*partitions).csv(path)


def unfinished(work: DataFrame, spark: SparkSession, path: str, keys: Sequence[str], measure: str, least: int = 1) -> DataFrame:
    """The rows of ``work`` whose key has fewer than ``least`` rows with the measure in the written table; all if there is none."""
    try:
        done = spark.read.parquet(path)
    except AnalysisException:
        return work
    if measure not in done.columns:
        return work
    good = done.where(F.col(measure).isNotNull() & ~F.isnan(measure)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return work.join(good.select(*keys), [*keys], "left_anti")


def finished_files(spark: SparkSession, path: str, measure: str, glob: str = "*.csv", least_bytes: int = 1000, first: int = 50) -> DataFrame:
    """path of the CSV result files below a folder that count as finished: of ``least_bytes`` at least, with the column of the
    measure, and with a number in it among the ``first`` rows. No folder or no files: no rows. Fields hold no quoted commas.
    """
    columns = "path string"
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    except AnalysisException:
        return spark.createDataFrame([], columns)
    lines = F.split(F.decode("content", "UTF-8"), "\r?\n", first + 2)
    peeked = files.where(F.col("length") >= least_bytes).select("path", lines.alias("lines")).select("path", F.split(F.get("lines", F.lit(0)), ",").alias("names"), F.slice("lines", 2, first).alias("rows"))
    at = F.array_position("names", measure).cast("int")
    value = lambda row: F.get(F.split(row, ","), at - 1).try_cast("double")
    return peeked.where((at > 0) & F.exists("rows", lambda row: F.coalesce(value(row) == value(row), F.lit(False)) & ~F.coalesce(F.isnan(value(row)), F.lit(False)))).select("path")


def unfinished_files(work: DataFrame, spark: SparkSession, path: str, file: Column, measure: str, **limits) -> DataFrame:
    """The rows of ``work`` whose file (a column: its name) isn't among ``finished_files``, compared by name."""
    done = finished_files(spark, path, measure, **limits).select(F.element_at(F.split("path", "/"), -1).alias("_done"))
    return work.join(done, file == F.col("_done"), "left_anti")


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A report of a small table; rows beyond ``most`` are told, not shown."""
    rows = df.limit(most + 1).collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows[:most]]
    return "\n".join([*lines, *(["", f"More than {most} rows."] if len(rows) > most else [])]) + "\n"


def put_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file in any store that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(content)
    finally:
        stream.close()
