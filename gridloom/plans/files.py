"""Queries of readers and writers that need files of their own: written to the shared folder, then read back."""

from __future__ import annotations

import io
import zipfile

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import aggregates as A
from gridloom.operators import joins as J
from gridloom.plans.registry import query, scratch
from gridloom.plans.standins import POINTS, RESULTS, points, results, table
from gridloom.sources import netcdf, readers, writers

c = F.col


@query("SC1_zip_member", "SELECT n_name || ' ' || n_nationkey AS value FROM nation")
def _(spark, d):
    lines = [f"{r.n_name} {r.n_nationkey}" for r in table(spark, d, "nation").select("n_name", "n_nationkey").collect()]  # 25 nations
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as z:
        z.writestr("readme.txt", "short")
        z.writestr("records.dat", "\n".join(lines))
    path = scratch(spark, "archive") + "/records.zip"
    writers.put_bytes(spark, path, content.getvalue())
    return readers.zipped_lines(spark, path)


def grid_folder(spark, hours: int = 30):
    """NetCDF files: two variables, packed and with hours since a day; one that lacks them; and a NumPy archive of later hours."""
    path = scratch(spark, "grids")
    hour, lat, lon = np.arange(hours), np.arange(-4, 5) / 4, np.arange(-6, 7) / 4
    value = (hour[:, None, None] * 7 + np.arange(9)[:, None] * 3 + np.arange(13)) % 50
    early = slice(0, 24)
    axes = {"valid_time": (("valid_time",), hour[early].astype("i4"), {"units": "hours since 2001-01-01 00:00:00"}), "lat": (("lat",), lat, {}), "lon": (("lon",), lon, {})}
    own, sizes = ("valid_time", "lat", "lon"), {"valid_time": 24, "lat": 9, "lon": 13}
    packed = {"scale_factor": 0.1, "_FillValue": np.int16(-1)}
    first = netcdf.encoded(sizes, axes | {"t2m": (own, value[early].astype("f4"), {"units": "K"}), "tcc": (own, value[early].astype("i2"), packed)}, "valid_time")
    other = netcdf.encoded(sizes, axes | {"d2m": (own, value[early].astype("f8"), {})})
    content = io.BytesIO()
    np.savez(content, time=np.datetime64("2001-01-01T00", "s") + hour[24:].astype("timedelta64[h]"), latitude=lat, longitude=lon, t2m=value[24:] * 1.0, tcc=value[24:] / 10)
    for name, file in (("part-1.nc", first), ("part-2.nc", other), ("part-3.npz", content.getvalue())):
        writers.put_bytes(spark, f"{path}/{name}", file)
    return path


_grid = "g AS (SELECT TIMESTAMP '2001-01-01' + to_hours(CAST(h AS INTEGER)) AS time, (i - 4) / 4.0::DOUBLE AS latitude, (j - 6) / 4.0::DOUBLE AS longitude, CAST((h * 7 + i * 3 + j) % 50 AS DOUBLE) AS t2m, ((h * 7 + i * 3 + j) % 50) / 10.0::DOUBLE AS tcc FROM range(30) a(h), range(9) b(i), range(13) c(j))"


@query("SC3_grid_files", f"WITH {_grid} SELECT * FROM g")
def _(spark, d):
    return readers.grid_files(spark, grid_folder(spark), {"t2m": "t2m", "tcc": "tcc"}).drop("file").withColumn("tcc", F.round("tcc", 6))


@query("SC5_hourly_grid_to_days", f"WITH {_grid} SELECT CAST(time AS DATE) AS date, latitude, longitude, round(avg(t2m), 6) AS t2m FROM g WHERE latitude * 2 = floor(latitude * 2) AND longitude * 2 = floor(longitude * 2) GROUP BY 1, 2, 3")
def _(spark, d):
    hourly = readers.grid_files(spark, grid_folder(spark), {"t2m": "t2m"})
    return A.cell_means(J.regridded(hourly, "t2m", ["time"]).withColumn("date", F.to_date("time")), ["date", "latitude", "longitude"], ["t2m"]).withColumn("t2m", F.round("t2m", 6))


_swath = "CAST(i * 0.25 - 60 AS DOUBLE) AS latitude, CAST(i % 90 AS DOUBLE) AS longitude, CASE WHEN i % 7 <> 0 THEN i * 0.5::DOUBLE END AS sif"


@query("SC6_swath_files", f"SELECT CAST(TIMESTAMP '2014-09-06' + to_days(CAST(d AS INTEGER)) AS DATE) AS date, {_swath} FROM range(3) a(d), range(400) b(i) WHERE (i + d) % 3 = 0")
def _(spark, d):
    path, i = scratch(spark, "swaths"), np.arange(400)
    sif = np.where(i % 7, i * 0.5, -999999).astype("f4")
    for day in range(4):  # the last file has no flag
        flag = {0: "Quality_Flag", 1: "SimplyGoodOrBadQualityFlag", 2: "Quality_Flag"}.get(day, "other")
        points = {"Latitude": (i * 0.25 - 60).astype("f4"), "Longitude": (i % 90).astype("f4"), "Daily_SIF_740nm": sif, flag: ((i + day) % 3).astype("i1")}
        more = {"Daily_SIF_740nm": {"_FillValue": np.float32(-999999)}}
        writers.put_bytes(spark, f"{path}/swath_Lite_1409{6 + day:02d}_v1.nc", netcdf.encoded({"point": 400}, {k: (("point",), v, more.get(k, {})) for k, v in points.items()}))
    raw = readers.swath_files(spark, path, {"Latitude": "latitude", "Longitude": "longitude", "Daily_SIF_740nm": "sif"}, ("SimplyGoodOrBadQualityFlag", "Quality_Flag"))
    return readers.swath_points(raw).select("date", "latitude", "longitude", "sif")


query("SC7_full_read", "SELECT * FROM supplier")(lambda spark, d: table(spark, d, "supplier"))
query("SC10_probed_scan", f"WITH {POINTS} SELECT pid, temp FROM points WHERE date IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 50 = 0)")(lambda spark, d: J.restricted(points(spark, d), table(spark, d, "orders").where("o_orderkey % 50 = 0").select(F.to_date("o_orderdate").alias("date")).distinct(), ["date"]).select("pid", "temp"))
query("SC12_schema", "SELECT column_name AS name FROM (DESCRIBE SELECT * FROM lineitem)")(lambda spark, d: spark.createDataFrame([(n,) for n, _ in readers.introspect(table(spark, d, "lineitem"))], "name string"))


@query("SK1_table", f"WITH {POINTS} SELECT pid, temp FROM points")
def _(spark, d):
    path = scratch(spark, "table")
    writers.write_table(points(spark, d).select("pid", "temp"), path)
    return spark.read.parquet(path)


@query("SK3_partitioned_results", f"WITH {RESULTS} SELECT omni_var, rho, target, scenario FROM results")
def _(spark, d):
    path = scratch(spark, "partitioned")
    writers.write_table(results(spark, d).select("omni_var", "rho", "target", "scenario"), path, ["target", "scenario"])
    return spark.read.parquet(path)


@query("SK5_merged_batches", "SELECT c_custkey, c_nationkey FROM customer")
def _(spark, d):
    path, rows = scratch(spark, "batches"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    for i in range(3):
        writers.append(rows.where(c("c_custkey") % 3 == i), path)
    return spark.read.parquet(path)


@query("SK6_unfinished_files", "SELECT n_nationkey FROM nation WHERE n_nationkey % 5 <> 0")
def _(spark, d):
    """Of every five files one is whole; one is short, one lacks the measure, one has no number in it early, one is missing."""
    path, work = scratch(spark, "result-files"), table(spark, d, "nation").select("n_nationkey")
    for (k,) in work.collect():  # 25 nations
        name, value = ("t_sii", "1.5") if k % 5 != 2 else ("other", "1.5")
        rows = [value if k % 5 != 3 or i >= 50 else ("nan", "")[i % 2] for i in range(5 if k % 5 == 1 else 400)]
        if k % 5 != 4:
            writers.put_bytes(spark, f"{path}/grid_{k}.csv", "\n".join([f"bin,{name}", *(f"Cool,{r}" for r in rows)]).encode())
    return writers.unfinished_files(work, spark, path, F.concat(F.lit("grid_"), c("n_nationkey"), F.lit(".csv")), "t_sii")


@query("SK7_report", "SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region")
def _(spark, d):
    report = writers.markdown(table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), "Regions")
    return spark.createDataFrame([(x,) for x in report.splitlines()[4:]], "line string")
