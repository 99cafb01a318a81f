"""Queries of scalar functions, filters and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import config as C
from gridloom.functions import scalars as S
from gridloom.operators import aggregates as A
from gridloom.operators import joins as J
from gridloom.plans.registry import query, scratch
from gridloom.plans.standins import BIN_ID, BIN_LABEL, DAILY, POINTS, RESULTS, daily, panel, points, results, table
from gridloom.sources import readers, writers

c = F.col


def r6(x):
    return F.round(x, 6)


def _point(name: str, sql: str, **columns):
    """A query of expressions over the points."""
    body = ", ".join(f"{v} AS {k}" for k, v in zip(columns, sql.split(" ;; ")))
    query(name, f"WITH {POINTS} SELECT pid, {body} FROM points")(lambda spark, d: points(spark, d).select("pid", *[f().alias(k) for k, f in columns.items()]))


def _result(name: str, sql: str, **columns):
    """A query of expressions over the results."""
    body = ", ".join(f"{v} AS {k}" for k, v in zip(columns, sql.split(" ;; ")))
    query(name, f'WITH {RESULTS} SELECT target, scenario, bin_id, omni_var, rho, {body} FROM results')(lambda spark, d: results(spark, d).select("target", "scenario", "bin_id", "omni_var", "rho", *[f().alias(k) for k, f in columns.items()]))


_point("P1_sign_flip", "-y", sii=lambda: S.sign_flip(c("y")))
_point("P3_grid_snap", "round_even(lat / 0.5::DOUBLE, 0) * 0.5::DOUBLE ;; round_even(lon / 0.5::DOUBLE, 0) * 0.5::DOUBLE", lat_cell=lambda: S.grid_snap(c("lat")), lon_cell=lambda: S.grid_snap(c("lon")))
_point("P4_cell_id", "CAST(round_even(lat * 100, 0) AS SMALLINT) ;; CAST(round_even(lon * 100, 0) AS SMALLINT)", lat_id=lambda: S.cell_id(c("lat")), lon_id=lambda: S.cell_id(c("lon")))
_point("P5_period_start", "CAST(date_trunc('year', date) AS DATE) + CAST(((dayofyear(date) - 1) // 8) * 8 AS INTEGER)", period=lambda: S.period_start(c("date")))
_point("P6_wrap_longitude", "round(CASE WHEN lon + 270 >= 540 THEN lon - 270 - 90 + 180 - 180 WHEN lon + 270 + 180 >= 360 THEN lon + 270 - 360 ELSE lon + 270 END, 6)", lon_wrapped=lambda: r6(S.wrap_longitude(c("lon") + 270)))
_point("P7_to_celsius", "round(y - 273.15::DOUBLE, 6)", celsius=lambda: r6(S.to_celsius(c("y"))))
_point("P8_vapour_deficit", "round(greatest(0.6108 * exp(17.27 * temp / (temp + 237.3)) - 0.6108 * exp(17.27 * (temp - aerosol / 10 + 3) / (temp - aerosol / 10 + 3 + 237.3)), 0), 6)", vpd=lambda: r6(S.vapour_deficit(c("temp"), c("temp") - c("aerosol") / 10 + 3)))
_point("P9_par", "round(y * 1000 / 3600 * 0.45::DOUBLE, 4)", par=lambda: F.round(S.par(c("y") * 1000), 4))
_flags = "CAST((CASE WHEN lat BETWEEN -50 AND 0 AND lon BETWEEN -90 AND 10 THEN 1 ELSE 0 END) + (CASE WHEN (lat BETWEEN 25 AND 60 AND lon BETWEEN -130 AND -60) OR (lat BETWEEN 25 AND 60 AND lon BETWEEN -10 AND 140) THEN 2 ELSE 0 END) + (CASE WHEN abs(lat) > 60 THEN 4 ELSE 0 END) + (CASE WHEN lat BETWEEN 15 AND 30 AND lon BETWEEN -15 AND 35 THEN 8 ELSE 0 END) AS SMALLINT)"
_lai = "CAST(CASE WHEN lai >= 0.15 THEN 32 WHEN lai < 0.15 THEN 16 ELSE 0 END AS SMALLINT)"
_point("P11_region_flags", _flags, flags=lambda: S.region_flags(c("lat"), c("lon")))
_point("P12_lai_flags", _lai, flags=lambda: S.lai_flags(c("lai")))
_point("P14_temperature_bin", f"{BIN_ID} ;; {BIN_LABEL}", bin_id=lambda: S.bin_id(c("temp")), bin_label=lambda: S.bin_label(c("temp")))
_point("P16_guarded_ratio", "round(CASE WHEN lai > 0.001 THEN y / lai END, 6)", ratio=lambda: r6(S.guarded_ratio(c("y"), c("lai"))))
_fraction = "(year(date) + (dayofyear(date) - 1) / dayofyear(make_date(year(date), 12, 31))::DOUBLE)"
_point("P17_year_fraction", f"round({_fraction}, 6)", t_year=lambda: r6(S.year_fraction(c("date"))))
_point("P19_harmonics", f"round(cos(2 * pi() * {_fraction}), 6) ;; round(sin(2 * pi() * {_fraction}), 6)", cosine=lambda: r6(S.harmonics(S.year_fraction(c("date")))[0]), sine=lambda: r6(S.harmonics(S.year_fraction(c("date")))[1]))
_point("P20_amplitude_phase", "round(sqrt((lai - 0.1) * (lai - 0.1) + (y - 30) * (y - 30)), 6) ;; round(atan2(y - 30, lai - 0.1), 6)", amplitude=lambda: r6(S.amplitude(c("lai") - 0.1, c("y") - 30)), phase=lambda: r6(S.phase(c("lai") - 0.1, c("y") - 30)))
_point("P21_standardised", "round(y / (CASE WHEN lai > 0 THEN lai ELSE 1 END), 6)", z=lambda: r6(S.standardised(c("y"), c("lai"))))
_point("P33_cover_defaults", "coalesce(CASE WHEN cloud < 50 THEN cloud END, 999) ;; coalesce(CASE WHEN aerosol < 40 THEN aerosol END, 999) ;; coalesce(CASE WHEN lai > 0.1 THEN lai END, -1)", cloud=lambda: S.cover_defaults(F.when(c("cloud") < 50, c("cloud")), c("aerosol"), c("lai"))[0], aerosol=lambda: S.cover_defaults(c("cloud"), F.when(c("aerosol") < 40, c("aerosol")), c("lai"))[1], lai=lambda: S.cover_defaults(c("cloud"), c("aerosol"), F.when(c("lai") > 0.1, c("lai")))[2])
_point("P35_grid_index", "round(CAST(round_even(lat * 100, 0) AS SMALLINT) / 100.0::DOUBLE, 6) ;; CAST(greatest(least(trunc((lat + 90) / 0.5::DOUBLE), 360), 0) AS INTEGER) ;; CAST(greatest(least(trunc((lon + 180) / 0.5::DOUBLE), 720), 0) AS INTEGER)", lat_back=lambda: r6(S.coordinate(S.cell_id(c("lat")))), i=lambda: S.grid_index(c("lat"), -90, 361), j=lambda: S.grid_index(c("lon"), -180, 721))


@query("P2_record_time", f"WITH {POINTS}, k AS (SELECT pid, year(date) AS y, CAST(pid % 370 AS INTEGER) AS doy, CAST(pid % 26 AS INTEGER) AS h FROM points) SELECT pid, CASE WHEN doy BETWEEN 1 AND dayofyear(make_date(y, 12, 31)) AND h <= 23 THEN CAST(make_date(y, 1, 1) AS TIMESTAMP) + to_days(doy - 1) + to_hours(h) END AS time FROM k")
def _(spark, d):
    return points(spark, d).select("pid", S.timestamp_of(F.year("date"), (c("pid") % 370).cast("int"), (c("pid") % 26).cast("int")).alias("time"))


@query("P10_regrid", "WITH g AS (SELECT i / 4.0::DOUBLE AS lat, j / 4.0::DOUBLE AS lon, (i * 37 + j * 11) % 101 AS v FROM range(-8, 9) a(i), range(-10, 11) b(j) WHERE NOT (i = 2 AND j = 4)) SELECT lat AS latitude, lon AS longitude, CAST(v AS DOUBLE) AS v FROM g WHERE lat * 2 = floor(lat * 2) AND lon * 2 = floor(lon * 2)")
def _(spark, d):
    i, j = c("i"), c("j")
    grid = spark.range(-8, 9).withColumnRenamed("id", "i").crossJoin(spark.range(-10, 11).withColumnRenamed("id", "j")).where(~((i == 2) & (j == 4))).select((i / 4.0).alias("latitude"), (j / 4.0).alias("longitude"), (((i * 37 + j * 11) % 101).cast("double")).alias("v"))
    return J.regridded(grid.select("latitude", "longitude", "v"), "v", []).select("latitude", "longitude", "v")


@query("P13_scenario_mask", f"WITH {POINTS}, f AS (SELECT pid, CAST({_flags} + {_lai} AS INTEGER) AS flags FROM points), s AS (SELECT * FROM (VALUES ('Global_High_LAI', 32), ('SAA_High_LAI', 33), ('Control_North', 34), ('Sahara_Barren', 24)) t(scenario, required)) SELECT pid, scenario FROM f JOIN s ON flags & required = required")
def _(spark, d):
    flagged = points(spark, d).select("pid", S.region_flags(c("lat"), c("lon")).bitwiseOR(S.lai_flags(c("lai"))).alias("region_flags"))
    return J.by_scenario(flagged).select("pid", "scenario")


@query("P13_one_scenario", f"WITH {POINTS}, f AS (SELECT pid, CAST({_flags} + {_lai} AS INTEGER) AS flags FROM points) SELECT pid, flags & 34 = 34 AS control FROM f")
def _(spark, d):
    flags = S.region_flags(c("lat"), c("lon")).bitwiseOR(S.lai_flags(c("lai")))
    return points(spark, d).select("pid", S.in_scenario(flags, "Control_North").alias("control"))


@query("P15_quantile_bin", f"WITH {POINTS}, e AS (SELECT list_distinct(quantile_cont(y, {[i / 15 for i in range(16)]})) AS e FROM points), s AS (SELECT list_sort(e) AS e FROM e) SELECT pid, CAST(greatest(len(list_filter(s.e, lambda x: x < y)) - 1, 0) AS INTEGER) AS bin_id FROM points, s")
def _(spark, d):
    rows = points(spark, d)
    # Sixteen edges.
    found = A.exact_quantiles(rows, [], "y", [i / C.QUANTILE_BINS for i in range(C.QUANTILE_BINS + 1)], [f"q{i}" for i in range(C.QUANTILE_BINS + 1)], large=True).first()
    edges = sorted({e for e in found if e is not None} or {0.0})
    return rows.select("pid", S.bin_id(c("y"), tuple(edges[1:-1])).alias("bin_id"))


@query("P18_days_since_first", f"WITH {POINTS}, k AS (SELECT pid, temp, date, min(date) OVER (PARTITION BY temp) AS a, max(date) OVER (PARTITION BY temp) AS b FROM points) SELECT pid, CAST(date - a AS INTEGER) AS days, round((date - a) / nullif(b - a, 0)::DOUBLE, 6) AS t_norm FROM k")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("temp")
    rows = points(spark, d).withColumns({"a": F.min("date").over(w), "b": F.max("date").over(w)})
    days = F.datediff("date", "a")
    return rows.select("pid", days.alias("days"), r6(F.try_divide(days.cast("double"), F.datediff("b", "a").cast("double"))).alias("t_norm"))


_result("P22_feature_name", "CASE WHEN regexp_matches(omni_var, '_ma[0-9]+$') THEN 'MA' WHEN regexp_matches(omni_var, '_lag[0-9]+$') THEN 'LAG' END ;; CAST(regexp_extract(omni_var, '_(ma|lag)([0-9]+)$', 2) AS INTEGER) ;; CASE WHEN omni_var LIKE '%sii%' THEN 'SII' WHEN omni_var LIKE '%par%' THEN 'PAR' WHEN omni_var LIKE '%vpd%' THEN 'VPD' END", mode=lambda: S.feature_mode(c("omni_var")), win=lambda: S.feature_window(c("omni_var")), kind=lambda: S.variable_type(c("omni_var")))
_z = "atanh(greatest(least(rho, {0}), -{0}))"
_result("P23_fisher_z", f"round({_z.format('0.99')}, 6) ;; round({_z.format('0.999')}, 6) ;; round(CASE WHEN abs(rho) < 1 THEN atanh(rho) END, 6)", z=lambda: r6(S.fisher_z(c("rho"))), z999=lambda: r6(S.fisher_z(c("rho"), 0.999)), z_open=lambda: r6(S.fisher_z(c("rho"), None)))
_result("P24_fisher_interval", f"round(tanh({_z.format('0.99')} - 1.96 / sqrt(greatest(n_eff - 3, 1))), 6) ;; round(tanh({_z.format('0.99')} + 1.96 / sqrt(greatest(n_eff - 3, 1))), 6)", ci_lower=lambda: r6(S.fisher_interval(c("rho"), c("n_eff"))[0]), ci_upper=lambda: r6(S.fisher_interval(c("rho"), c("n_eff"))[1]))
_result("P27_floored_p", "CASE WHEN p_adj > 0 THEN p_adj ELSE 1e-16 END", p=lambda: S.floored_p(c("p_adj")))
_steps = "CASE WHEN p_adj IS NULL THEN 0 WHEN p_adj <= 1e-16 THEN 1 WHEN p_adj <= 1e-8 THEN 0.8 WHEN p_adj <= 1e-4 THEN 0.6 WHEN p_adj <= 1e-2 THEN 0.4 ELSE 0.15 END::DOUBLE"
_result("P28_opacity_steps", _steps, opacity=lambda: S.opacity_steps(c("p_adj")))
_result("P30_p_text", "CASE WHEN p_adj IS NULL THEN '' WHEN p_adj < 1e-16 THEN 'p<1e-16' WHEN p_adj < 0.001 THEN printf('p=%.1fe%d', p_adj / pow(10, floor(log10(p_adj))), CAST(floor(log10(p_adj)) AS INTEGER)) ELSE printf('p=%.3f', p_adj) END", text=lambda: S.p_text(c("p_adj")))
_result("P31_pretty_bin", "CASE bin_id WHEN 0 THEN '≤ 7°C' WHEN 1 THEN '7 - 15°C' WHEN 2 THEN '> 30°C' ELSE 'other bin' END", label=lambda: S.pretty_bin(F.element_at(F.array(*map(F.lit, ("min_to_7", "7_to_15", "above_30", "other_bin", "other_bin"))), c("bin_id") + 1)))
_result("P32_bin_centre", "[3.0, 11.0, 20.0, 27.5, 32.5][bin_id + 1]::DOUBLE", centre=lambda: F.element_at(F.array(*map(F.lit, S.bin_centres())), c("bin_id") + 1))


@query("P25_fisher_difference", f"WITH {RESULTS}, k AS (SELECT scenario, bin_id, omni_var, avg(rho) AS rho FROM results GROUP BY ALL), a AS (SELECT bin_id, omni_var, {_z.format('0.999')} AS z FROM k WHERE scenario = 'Global_High_LAI'), b AS (SELECT bin_id, omni_var, {_z.format('0.999')} AS z FROM k WHERE scenario = 'Control_North') SELECT bin_id, omni_var, round(a.z - b.z, 6) AS delta_z FROM a JOIN b USING (bin_id, omni_var)")
def _(spark, d):
    from gridloom.operators.screening import fisher_difference

    means = results(spark, d).groupBy("scenario", "bin_id", "omni_var").agg(F.avg("rho").alias("rho"))
    return fisher_difference(means, "Global_High_LAI", "Control_North", ("bin_id", "omni_var")).withColumn("delta_z", r6("delta_z"))


@query("P26_p_values")
def _(spark, d):
    from gridloom.functions import distributions as D

    return results(spark, d).select("target", "rho", "n_eff", *[r6(f(c("rho"), c("n_eff"))).alias(n) for n, f in (("p_spatial", D.p_spatial), ("p_screening", D.p_screening), ("p_mechanism", D.p_mechanism))])


@query("P29_opacity_log", f"WITH {RESULTS}, m AS (SELECT *, log10(min(CASE WHEN p_adj > 0 THEN p_adj END) OVER ()) AS lo, min(CASE WHEN p_adj > 0 THEN p_adj END) OVER () AS v FROM results) SELECT target, omni_var, rho, round(CASE WHEN p_adj > 0 THEN 1 - (log10(least(greatest(p_adj, v), 0.05)) - lo) / (log10(0.05) - lo + 1e-12) * 0.85 ELSE 0 END, 6) AS opacity FROM m")
def _(spark, d):
    rows = results(spark, d)
    smallest = F.broadcast(rows.where("p_adj > 0").agg(F.min("p_adj").alias("v")))  # one row
    return rows.crossJoin(smallest).select("target", "omni_var", "rho", r6(S.opacity_log(c("p_adj"), c("v"))).alias("opacity"))


@query("P34_truncated_date", "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS date FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("date"))


@query("P36_colour_limits", f"WITH {RESULTS} SELECT target, bin_id, CASE WHEN min(rho) >= 0 THEN 'positive' WHEN max(rho) <= 0 THEN 'negative' ELSE 'both' END AS scheme, round(CASE WHEN min(rho) >= 0 THEN 0 WHEN max(rho) <= 0 THEN min(rho) * 1.05 ELSE -greatest(abs(min(rho)), abs(max(rho))) * 1.05 END, 6) AS lower, round(CASE WHEN min(rho) >= 0 THEN max(rho) * 1.05 WHEN max(rho) <= 0 THEN 0 ELSE greatest(abs(min(rho)), abs(max(rho))) * 1.05 END, 6) AS upper FROM results GROUP BY ALL")
def _(spark, d):
    ends = results(spark, d).groupBy("target", "bin_id").agg(F.min("rho").alias("a"), F.max("rho").alias("b"))
    scheme, lower, upper = S.colour_limits(c("a"), c("b"))
    return ends.select("target", "bin_id", scheme.alias("scheme"), r6(lower).alias("lower"), r6(upper).alias("upper"))


@query("P37_wide_names", f"WITH {RESULTS} SELECT target AS metric, bin_label AS bin, scenario AS mask, max(rho) AS t_sii_MA, CAST(max(n) AS BIGINT) AS n_MA, CAST(NULL AS DOUBLE) AS t_sii_LAG, CAST(NULL AS BIGINT) AS n_LAG FROM results GROUP BY ALL")
def _(spark, d):
    from gridloom.operators.screening import meta_wide

    best = results(spark, d).groupBy(c("target").alias("metric"), c("bin_label").alias("bin"), c("scenario").alias("mask")).agg(F.max("rho").alias("t_sii"), F.max("n").alias("n"))
    return meta_wide(best.withColumn("mode", F.lit("MA")))


@query("P38_feature_order", f"WITH {RESULTS}, f AS (SELECT DISTINCT omni_var FROM results) SELECT omni_var, CAST(row_number() OVER (ORDER BY CAST(regexp_extract(omni_var, '_ma([0-9]+)$', 1) AS INTEGER), omni_var) AS INTEGER) AS place FROM f")
def _(spark, d):
    from pyspark.sql import Window

    names = results(spark, d).select("omni_var").distinct()  # feature names: some hundreds
    rank = F.when(S.feature_mode(c("omni_var")) == "LAG", F.lit(0)).otherwise(F.lit(1))
    return names.select("omni_var", F.row_number().over(Window.orderBy(rank, S.feature_window(c("omni_var")), "omni_var")).alias("place"))


# --- filters -------------------------------------------------------------------------------------

query("F1_lowest_valid", f"WITH {POINTS} SELECT pid, CASE WHEN y > 2 THEN y END AS dst FROM points WHERE (CASE WHEN y > 2 THEN -y * 100 END) IS NULL OR -y * 100 > -2000")(lambda spark, d: points(spark, d).withColumn("dst", F.when(c("y") > 2, c("y"))).where(c("dst").isNull() | (-c("dst") * 100 > -2000)).select("pid", "dst"))
query("F2_drop_missing", f"WITH {DAILY} SELECT date, round(f10_7_mean, 6) AS f10_7_mean FROM daily WHERE sii_mean IS NOT NULL AND f10_7_mean IS NOT NULL")(lambda spark, d: daily(spark, d).dropna(subset=["sii_mean", "f10_7_mean"]).select("date", r6("f10_7_mean").alias("f10_7_mean")))
query("F3_covered", f"WITH {POINTS} SELECT pid FROM points WHERE cloud < 60 AND aerosol < 50 AND lai >= 0.01")(lambda spark, d: J.covered(points(spark, d).withColumn("has_cover", F.lit(True))).select("pid"))
query("F4_quality_zero", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 4 = 0")(lambda spark, d: table(spark, d, "lineitem").where(c("l_linenumber") % 4 == 0).select("l_orderkey", "l_linenumber"))
query("F5_least_rows", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 600")(lambda spark, d: table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 600"))
query("F6_finite", f"WITH {POINTS} SELECT pid FROM points WHERE lai > 0 AND isfinite(y / lai)")(lambda spark, d: points(spark, d).where(S.null_if_nan(F.try_divide("y", "lai")).isNotNull()).select("pid"))
query("F7_variable_family", f"WITH {RESULTS} SELECT target, omni_var, rho FROM results WHERE regexp_matches(omni_var, '^sii_mean_ma[0-9]+$')")(lambda spark, d: results(spark, d).where(c("omni_var").rlike(r"^sii_mean_ma\d+$")).select("target", "omni_var", "rho"))
query("F8_year_slice", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")(lambda spark, d: table(spark, d, "orders").where((c("o_orderdate") >= F.to_timestamp_ntz(F.lit("1997-01-01"))) & (c("o_orderdate") < F.to_timestamp_ntz(F.lit("1998-01-01")))).select("o_orderkey"))
query("F9_window_band", f'WITH {RESULTS} SELECT target, omni_var, rho FROM results WHERE "window" BETWEEN 20 AND 30')(lambda spark, d: results(spark, d).where(c("window").between(C.BAND_LOW, C.BAND_HIGH)).select("target", "omni_var", "rho"))


# --- sources and sinks ---------------------------------------------------------------------------


@query("SC2_records", "SELECT CAST(make_date(year(o_orderdate), 1, 1) AS TIMESTAMP) + to_days(CAST(o_orderkey % 365 AS INTEGER)) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS time, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey % 90 AS DOUBLE) END AS kp, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(-(o_orderkey % 400) AS DOUBLE) END AS dst, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_custkey % 300 AS DOUBLE) END AS f10_7, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 400 AS DOUBLE) END AS sii FROM orders WHERE o_orderkey % 5 <> 0")
def _(spark, d):
    k, cu = c("o_orderkey"), c("o_custkey")
    filler = lambda n: [F.lit("0")] * n
    kp, dst, f10 = F.when(k % 7 == 0, F.lit(99)).otherwise(cu % 90), F.when(k % 11 == 0, F.lit(99999)).otherwise(-(k % 400)), F.when(k % 13 == 0, F.lit("999.9")).otherwise((cu % 300).cast("string"))
    tokens = [F.year("o_orderdate"), k % 365 + 1, k % 24, *filler(35), kp, *filler(1), dst, *filler(9), f10]
    line = F.concat_ws("  ", *[t.cast("string") for t in tokens])
    return readers.parse_records(table(spark, d, "orders").select(F.when(k % 5 == 0, F.lit("too short")).otherwise(F.concat(F.lit(" "), line)).alias("value")))


@query("SC4_merged_months", "SELECT l_shipdate AS time, l_suppkey / 4.0::DOUBLE AS latitude, CASE WHEN l_partkey % 360 >= 180 THEN l_partkey % 360 - 360 ELSE l_partkey % 360 END AS longitude, max(l_quantity) AS t2m, max(l_tax) AS tcc FROM lineitem GROUP BY l_shipdate, l_suppkey, l_partkey % 360")
def _(spark, d):
    rows = table(spark, d, "lineitem").groupBy(c("l_shipdate").alias("time"), (c("l_suppkey") / 4.0).alias("latitude"), (c("l_partkey") % 360).alias("longitude")).agg(F.max("l_quantity").alias("t2m"), F.max("l_tax").alias("tcc"))
    versions = rows.select("*", F.explode(F.array(F.lit(1), F.lit(5))).alias("expver")).withColumn("t2m", F.when((c("expver") == 5) | (c("latitude") * 4 % 2 == 0), c("t2m")))
    return readers.merged_months({"t2m": versions.drop("tcc"), "tcc": rows.drop("t2m")})


@query("SC6_swath_points", f"WITH {POINTS} SELECT pid, date FROM points WHERE pid % 3 = 0")
def _(spark, d):
    rows = points(spark, d).select("pid", F.concat(F.lit("/data/swath_lite_"), F.date_format("date", "yyMMdd"), F.lit("_v1.nc4")).alias("file"), (c("pid") % 3).alias("quality"))
    return readers.swath_points(rows).select("pid", "date")


query("SC8_projected_scan", "SELECT l_orderkey, l_quantity FROM lineitem")(lambda spark, d: table(spark, d, "lineitem").select("l_orderkey", "l_quantity"))


@query("SC9_date_range_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
def _(spark, d):
    return readers.table_between(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"], F.to_timestamp_ntz(F.lit("1996-01-01")), F.to_timestamp_ntz(F.lit("1996-12-31")), "l_shipdate")


@query("SC11_result_files", f"WITH {RESULTS} SELECT omni_var, rho, 'sif_stress_index' AS target, scenario FROM results WHERE target = 'stress'")
def _(spark, d):
    path = scratch(spark, "result-files")
    rows = results(spark, d).where("target = 'stress'").select("scenario", "omni_var", "rho")
    for (name,) in rows.select("scenario").distinct().collect():  # four scenarios
        own = rows.where(c("scenario") == name).select("omni_var", "rho").coalesce(1)
        own.write.option("header", True).csv(f"{path}/parts/{name}")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for i, status in enumerate(store.globStatus(fs.Path(f"{path}/parts/*/part-*.csv"))):
        name = status.getPath().getParent().getName()
        store.mkdirs(fs.Path(f"{path}/named"))
        store.rename(status.getPath(), fs.Path(f"{path}/named/spearman_{'sif_stress_index' if i < 99 else 'x'}_{name}.csv"))
    return readers.result_files(spark, f"{path}/named/*.csv", "omni_var string, rho double", ["sif_stress_index", "sif_740nm"])


@query("SC13_epoch_guess", "SELECT event_id, ts AS by_seconds, ts AS by_millis, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS by_days FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def _(spark, d):
    seconds = F.unix_seconds(c("ts").cast("timestamp"))
    guess = lambda x, largest: S.epoch_guess(x, F.lit(largest)).cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", guess(seconds, 1_700_000_000).alias("by_seconds"), guess(seconds * 1000, 1_700_000_000_000).alias("by_millis"), guess(F.floor(seconds / 86400), 20_000).alias("by_days"))


query("SC14_file_pattern", "SELECT r_regionkey, r_name FROM region")(lambda spark, d: spark.read.option("pathGlobFilter", "regio*.parquet").option("recursiveFileLookup", True).parquet(d).select("r_regionkey", "r_name"))


@query("SK2_append", "SELECT n_nationkey, n_regionkey FROM nation")
def _(spark, d):
    path, rows = scratch(spark, "appended"), table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    for half in (0, 1):
        writers.append(rows.where(c("n_nationkey") % 2 == half), path, ["n_regionkey"])
    return spark.read.parquet(path).select("n_nationkey", c("n_regionkey").cast("int").alias("n_regionkey"))


@query("SK4_replaced_partitions", "SELECT n_nationkey + CASE WHEN n_regionkey = 1 THEN 100 ELSE 0 END AS n_nationkey, n_regionkey FROM nation")
def _(spark, d):
    path, rows = scratch(spark, "replaced"), table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    writers.write_table(rows, path, ["n_regionkey"])
    writers.replace_partitions(rows.where("n_regionkey = 1").withColumn("n_nationkey", c("n_nationkey") + 100), path, ["n_regionkey"])
    return spark.read.parquet(path).select("n_nationkey", c("n_regionkey").cast("int").alias("n_regionkey"))


@query("SK6_unfinished", "SELECT n_nationkey FROM nation WHERE n_nationkey % 3 <> 0")
def _(spark, d):
    path, work = scratch(spark, "resumed"), table(spark, d, "nation").select("n_nationkey")
    writers.write_table(work.where(c("n_nationkey") % 3 == 0).withColumn("t_sii", F.lit(1.0)), path)
    return writers.unfinished(work, spark, path, ["n_nationkey"], "t_sii")


@query("SK8_csv_export", f"WITH {RESULTS} SELECT omni_var, rho, target FROM results")
def _(spark, d):
    path = scratch(spark, "exported")
    writers.export_csv(results(spark, d).select("omni_var", "rho", "target"), path, ["target"])
    return spark.read.option("header", True).schema("omni_var string, rho double, target string").csv(path)
