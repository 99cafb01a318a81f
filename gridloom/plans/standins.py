"""Stand-ins of the analysis tables, drawn from the business tables, and the same in SQL.

points: observations with place, land cover and temperature; daily: the global series, every day; panel: a row for each
day and cell with flags; env: the panel's metrics by cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import aggregates as A


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Hidden columns of what was read from a table: the order of its rows in the files, for ties that an order leaves open.
FILE_ORDER = ("_metadata.file_path", "_metadata.row_index")


def points(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "lineitem").select(
        (c("l_orderkey") * 8 + c("l_linenumber")).alias("pid"), F.to_date("l_shipdate").alias("date"), (c("l_quantity") * 2.4 - 60.1).alias("lat"), ((c("l_partkey") * 37 % 3600) / 10.0 - 180).alias("lon"),
        (c("l_discount") * 3).alias("lai"), (c("l_quantity") * 2).alias("cloud"), (c("l_tax") * 1000).alias("aerosol"), c("l_quantity").alias("temp"), (c("l_extendedprice") / 1009).alias("y"),
    )


POINTS = """points AS (SELECT l_orderkey * 8 + l_linenumber AS pid, CAST(l_shipdate AS DATE) AS date, l_quantity * 2.4 - 60.1 AS lat, (l_partkey * 37 % 3600) / 10.0::DOUBLE - 180 AS lon,
    l_discount * 3 AS lai, l_quantity * 2 AS cloud, l_tax * 1000 AS aerosol, l_quantity AS temp, l_extendedprice / 1009 AS y FROM lineitem)"""


def raw_daily(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg((F.avg(price) / 1009).alias("sii_mean"), (F.max(price) / 1009).alias("sii_max"), (F.stddev_samp(price) / 1009).alias("sii_std"), (F.avg(F.when(F.col("o_orderpriority").startswith("1"), price)) / 1009).alias("f10_7_mean"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    return A.densified(raw_daily(spark, d))


DAILY = """d0 AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 1009 AS sii_mean, max(o_totalprice) / 1009 AS sii_max, stddev_samp(o_totalprice) / 1009 AS sii_std,
        avg(CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice END) / 1009 AS f10_7_mean FROM orders GROUP BY 1),
    cal AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d0),
    daily AS (SELECT date, sii_mean, sii_max, sii_std, f10_7_mean FROM cal LEFT JOIN d0 USING (date))"""


def panel(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_nationkey")
    bit = lambda m, b, other=0: F.when(k % m == 0, F.lit(b)).otherwise(F.lit(other))
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), k == F.col("n_nationkey"))
    keyed = joined.select(F.to_date("o_orderdate").alias("date"), (k * 50).cast("short").alias("lat_id"), (F.col("n_regionkey") * 50).cast("short").alias("lon_id"), (bit(3, 1) + bit(4, 2) + bit(5, 8) + bit(2, 32, 16)).cast("short").alias("region_flags"), "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return keyed.groupBy("date", "lat_id", "lon_id", "region_flags").agg((F.avg("l_extendedprice") / 1009).alias("y"), F.avg("l_quantity").alias("temp"), F.round(F.avg("l_discount") * 1e6).alias("par"), F.round(F.avg("l_tax") * 1e6).alias("vpd"), F.count(F.lit(1)).alias("n_obs"))


PANEL = """panel AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(c_nationkey * 50 AS SMALLINT) AS lat_id, CAST(n_regionkey * 50 AS SMALLINT) AS lon_id,
    CAST((CASE WHEN c_nationkey % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN c_nationkey % 4 = 0 THEN 2 ELSE 0 END) + (CASE WHEN c_nationkey % 5 = 0 THEN 8 ELSE 0 END) + (CASE WHEN c_nationkey % 2 = 0 THEN 32 ELSE 16 END) AS SMALLINT) AS region_flags,
    avg(l_extendedprice) / 1009 AS y, avg(l_quantity) AS temp, round(avg(l_discount) * 1e6) AS par, round(avg(l_tax) * 1e6) AS vpd, count(*) AS n_obs
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3, 4)"""

#: Scenarios and bins in SQL.
SCENARIO_ROWS = "scen AS (SELECT * FROM (VALUES ('Global_High_LAI', 32, 0), ('SAA_High_LAI', 33, 0), ('Control_North', 34, 0), ('Sahara_Barren', 24, 0)) t(scenario, required, forbidden))"
BIN_ID = "CASE WHEN temp IS NULL THEN NULL WHEN temp <= 7 THEN 0 WHEN temp <= 15 THEN 1 WHEN temp <= 25 THEN 2 WHEN temp <= 30 THEN 3 ELSE 4 END"
BIN_LABEL = f"['Cold', 'Cool', 'Optimum', 'Warm_Stress', 'Extreme_Heat'][1 + ({BIN_ID})]"


#: Windows of the results table.
RESULT_WINDOWS = 26


def results(spark: SparkSession, d: str) -> DataFrame:
    """A results table: target, scenario, bin_id, bin_label, omni_var, window, rho, p_adj (some missing), n_eff, n.

    A row for every part; windows are 1 to RESULT_WINDOWS, whatever the number of parts.
    """
    parts, c = table(spark, d, "part"), F.col
    window = (F.floor(c("p_partkey") / 80) % RESULT_WINDOWS + 1).cast("int")
    return parts.select(
        F.element_at(F.array(*map(F.lit, ("t740", "t757", "t771", "stress"))), (c("p_partkey") % 4 + 1).cast("int")).alias("target"), F.element_at(F.array(*map(F.lit, ("Global_High_LAI", "SAA_High_LAI", "Control_North", "Sahara_Barren"))), (F.floor(c("p_partkey") / 4) % 4 + 1).cast("int")).alias("scenario"),
        (F.floor(c("p_partkey") / 16) % 5).cast("int").alias("bin_id"), F.element_at(F.array(*map(F.lit, ("Cold", "Cool", "Optimum", "Warm_Stress", "Extreme_Heat"))), (F.floor(c("p_partkey") / 16) % 5 + 1).cast("int")).alias("bin_label"),
        F.concat(F.element_at(F.array(*map(F.lit, ("sii_mean", "par", "vpd", "f10_7_mean"))), (c("p_size") % 4 + 1).cast("int")), F.lit("_ma"), window.cast("string")).alias("omni_var"), window.alias("window"),
        ((c("p_partkey") * 7919 % 2001) / 1000.0 - 1).alias("rho"), F.when(c("p_partkey") % 17 != 0, (c("p_partkey") * 104729 % 10007) / 10007.0 * (c("p_partkey") * 31 % 7) / 6.0).alias("p_adj"), (c("p_size") * 3 + 2.5).alias("n_eff"), (c("p_size") * 5).cast("long").alias("n"),
    )


RESULTS = """results AS (SELECT ['t740', 't757', 't771', 'stress'][1 + p_partkey % 4] AS target, ['Global_High_LAI', 'SAA_High_LAI', 'Control_North', 'Sahara_Barren'][1 + (p_partkey // 4) % 4] AS scenario,
    CAST((p_partkey // 16) % 5 AS INTEGER) AS bin_id, ['Cold', 'Cool', 'Optimum', 'Warm_Stress', 'Extreme_Heat'][1 + (p_partkey // 16) % 5] AS bin_label,
    ['sii_mean', 'par', 'vpd', 'f10_7_mean'][1 + p_size % 4] || '_ma' || CAST((p_partkey // 80) % 26 + 1 AS VARCHAR) AS omni_var, CAST((p_partkey // 80) % 26 + 1 AS INTEGER) AS "window",
    (p_partkey * 7919 % 2001) / 1000.0::DOUBLE - 1 AS rho, CASE WHEN p_partkey % 17 <> 0 THEN (p_partkey * 104729 % 10007) / 10007.0::DOUBLE * (p_partkey * 31 % 7) / 6.0::DOUBLE END AS p_adj, p_size * 3 + 2.5::DOUBLE AS n_eff, CAST(p_size * 5 AS BIGINT) AS n
    FROM part)"""
