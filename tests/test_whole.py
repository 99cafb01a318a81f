"""Queries run over their whole tables and at their full sizes."""

from pyspark.sql import functions as F

import __spark_entry__
from gridloom import config as C
from gridloom.plans import standins


def test_results_have_a_row_for_every_part(spark, tmp_path):
    spark.range(1, 5001).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    got = standins.results(spark, str(tmp_path))
    assert got.count() == 5000
    assert got.agg(F.min("window"), F.max("window")).first() == (1, standins.RESULT_WINDOWS)


def test_validation_finds_the_short_table_at_any_size(spark, tmp_path):
    spark.range(1_000_001).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    got = {r.name: (r.n_rows, r.status) for r in __spark_entry__.queries()["Q2_validation"](spark, str(tmp_path)).collect()}
    assert got == {"good": (1_000_001, "ok"), "short": (1_000_001, "too few rows"), "wrong": (1_000_001, "missing columns"), "blank": (1_000_001, "columns without a value"), "none": (0, "empty")}


def test_surrogates_are_drawn_in_full_over_all_windows(spark):
    got = __spark_entry__.queries()["K12_surrogates"](spark, "/root/testdata/sf0.001").groupBy("target", "scenario", "bin_label", "kind").agg(F.countDistinct("surrogate_id").alias("draws"), F.countDistinct("window").alias("windows")).collect()
    assert {r.target for r in got} == {"y", "par"} and {r.bin_label for r in got} >= {"Optimum"}
    assert {(r.kind, r.draws, r.windows) for r in got} == {("observed", 1, len(C.MA_WINDOWS)), ("surrogate", C.SURROGATES, len(C.MA_WINDOWS))}
