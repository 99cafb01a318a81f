"""Queries whose order leaves ties: the first in the files counts, as for DuckDB with one thread."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from gridloom.operators import aggregates as A


def by_sql(name, table, files):
    con = duckdb.connect()
    con.sql(f"SET threads = 1; CREATE VIEW {table} AS FROM '{files}'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    return sorted(want.columns), sorted(tuple(map(str, r)) for r in want.project(", ".join(sorted(want.columns))).fetchall())


def by_spark(name, spark, folder):
    got = __spark_entry__.queries()[name](spark, str(folder))
    return sorted(got.columns), sorted(tuple(map(str, r)) for r in got.select(*sorted(got.columns)).collect())


def test_profile_summary_takes_the_first_of_equal_peaks(spark, tmp_path):
    # Equal |z| and window, other features: keys a multiple of 2001 * 2080 apart, sizes that keep family and mode.
    rows = spark.range(40).select((F.col("id") * (2001 * 2080) + 4 * 17).alias("p_partkey"), ((F.col("id") * 12) % 40 + 1).cast("int").alias("p_size"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert by_spark("A10_profile_summary", spark, tmp_path) == by_sql("A10_profile_summary", "part", f"{tmp_path}/part.parquet/*.parquet")


def test_first_per_key_takes_the_first_of_equal_lines(spark, tmp_path):
    # The file that comes first is the smaller one, which Spark reads last.
    lines = spark.range(2000).select((F.col("id") % 50).alias("l_orderkey"), (F.col("id") % 3).cast("int").alias("l_linenumber"), F.col("id").cast("double").alias("l_quantity"))
    (tmp_path / "lineitem.parquet").mkdir()
    for name, rows in (("a", lines.where("id < 150")), ("b", lines.where("id >= 150"))):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        next((tmp_path / name).glob("part-*.parquet")).rename(tmp_path / "lineitem.parquet" / f"{name}.parquet")
    assert by_spark("S5_first_per_key", spark, tmp_path) == by_sql("S5_first_per_key", "lineitem", f"{tmp_path}/lineitem.parquet/*.parquet")


def test_profile_summary_puts_missing_windows_last(spark):
    rows = spark.createDataFrame([("k", "MA", 0.5, None, "none"), ("k", "MA", -0.5, 3, "three"), ("k", "MA", 0.5, 7, "seven"), ("k", "LAG", 0.1, 1, "lag")], "g string, mode string, z double, window_value int, feature string")
    assert A.profile_summary(rows, ["g"]).first().peak_ma == "three"
