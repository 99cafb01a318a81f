"""Queries of windows, joins, set operations and quality checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom import config as C
from gridloom.functions import scalars as S
from gridloom.operators import aggregates as A
from gridloom.operators import correlation as K
from gridloom.operators import joins as J
from gridloom.operators import quality as Q
from gridloom.operators import windows as W
from gridloom.plans.registry import query
from gridloom.plans.standins import BIN_ID, DAILY, FILE_ORDER, PANEL, POINTS, RESULTS, SCENARIO_ROWS, daily, panel, points, results, table

c = F.col


def r6(x):
    return F.round(x, 6)


# --- windows -------------------------------------------------------------------------------------

query("W1_ma_prior", f"WITH {DAILY} SELECT date, " + ", ".join(f"round(avg(sii_mean) OVER (ORDER BY date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 6) AS ma{w}" for w in (1, 7, 28, 90)) + " FROM daily")(
    lambda spark, d: daily(spark, d).select("date", *[r6(W.ma_prior("sii_mean", w)).alias(f"ma{w}") for w in (1, 7, 28, 90)])
)
query("W1_many_windows", f"WITH {DAILY} SELECT date, " + ", ".join(f"round(avg(sii_mean) OVER (ORDER BY date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 3) AS sii_mean_ma{w}" for w in C.MA_WINDOWS) + " FROM daily")(
    lambda spark, d: W.many_trailing(daily(spark, d), "sii_mean", C.MA_WINDOWS, [], prior=True).select("date", *[F.round(f"sii_mean_ma{w}", 3).alias(f"sii_mean_ma{w}") for w in C.MA_WINDOWS])
)
_m = "avg(sii_mean) OVER (ORDER BY date ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
query("W2_smoothed_lags", f"WITH {DAILY}, s AS (SELECT date, {_m} AS m FROM daily) SELECT date, " + ", ".join(f"round(lag(m, {k}) OVER (ORDER BY date), 6) AS sii_mean_lag{k}" for k in C.LAGS) + " FROM s")(
    lambda spark, d: W.lag_smoothed(daily(spark, d), "sii_mean", C.LAGS).select("date", *[r6(f"sii_mean_lag{k}").alias(f"sii_mean_lag{k}") for k in C.LAGS])
)
query("W3_difference", f"WITH {DAILY} SELECT date, round(sii_mean - lag(sii_mean) OVER (ORDER BY date), 6) AS diff FROM daily")(lambda spark, d: daily(spark, d).select("date", r6(W.difference("sii_mean")).alias("diff")))
query("W4_ma_trailing", f"WITH {PANEL} SELECT date, lat_id, lon_id, " + ", ".join(f"round(avg(par) OVER (PARTITION BY lat_id, lon_id ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 6) AS par_ma{w}" for w in (1, 5, 28, 90)) + " FROM panel")(
    lambda spark, d: W.many_trailing(panel(spark, d), "par", (1, 5, 28, 90), ["lat_id", "lon_id"]).select("date", "lat_id", "lon_id", *[r6(f"par_ma{w}").alias(f"par_ma{w}") for w in (1, 5, 28, 90)])
)
query("W5_context_ma", f"WITH {PANEL} SELECT date, lat_id, round(avg(temp) OVER (PARTITION BY lat_id, lon_id ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS temp_ma10 FROM panel")(
    lambda spark, d: panel(spark, d).select("date", "lat_id", r6(W.ma_trailing("temp", 10, ["lat_id", "lon_id"])).alias("temp_ma10"))
)
query("W6_ma_strict", f"WITH {DAILY} SELECT date, round(CASE WHEN count(f10_7_mean) OVER w = 7 THEN avg(f10_7_mean) OVER w END, 6) AS ma7 FROM daily WINDOW w AS (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)")(
    lambda spark, d: daily(spark, d).select("date", r6(W.ma_strict("f10_7_mean", 7)).alias("ma7"))
)
query("W7_ordinal_rank", f"WITH {PANEL} SELECT date, lat_id, lon_id, CAST(row_number() OVER (PARTITION BY lat_id ORDER BY n_obs, date, lon_id) AS INTEGER) AS r FROM panel")(
    lambda spark, d: panel(spark, d).select("date", "lat_id", "lon_id", W.ordinal_rank("n_obs", ["lat_id"], ["date", "lon_id"]).alias("r"))
)
query("W8_average_rank", f"WITH {PANEL} SELECT date, lat_id, lon_id, rank() OVER (PARTITION BY lat_id ORDER BY n_obs) + (count(*) OVER (PARTITION BY lat_id, n_obs) - 1) / 2::DOUBLE AS r FROM panel")(
    lambda spark, d: panel(spark, d).select("date", "lat_id", "lon_id", W.average_rank("n_obs", ["lat_id"]).alias("r"))
)


@query("W9_rank_gaussian")
def _(spark, d):
    return K.rank_gaussian(panel(spark, d), ["y"], ["lat_id"]).select("date", "lat_id", "lon_id", r6("y_g").alias("y_g"))


_acf = "round(covar_pop(CASE WHEN l IS NOT NULL THEN y END, l) / nullif(sqrt(var_pop(CASE WHEN l IS NOT NULL THEN y END) * var_pop(CASE WHEN y IS NOT NULL THEN l END)), 0), 6)"


@query("W10_autocorrelation", f"WITH {PANEL}, k AS (SELECT unnest([1, 2, 7, 30]) AS lag), p AS (SELECT lat_id, lag AS k, y, row_number() OVER (PARTITION BY lat_id, lag ORDER BY date, lon_id) AS n FROM panel, k), l AS (SELECT a.lat_id, a.k, a.y, b.y AS l FROM p a JOIN p b ON a.lat_id = b.lat_id AND a.k = b.k AND b.n = a.n - a.k) SELECT lat_id, 'y' AS \"column\", k AS lag, {_acf} AS r FROM l GROUP BY lat_id, k")
def _(spark, d):
    return K.autocorrelation(panel(spark, d), ["y"], [1, 2, 7, 30], ["lat_id"], ["date", "lon_id"]).withColumn("r", r6("r"))


@query("W11_lag1", f"WITH {PANEL}, p AS (SELECT lat_id, y, lag(y) OVER (PARTITION BY lat_id ORDER BY date, lon_id) AS l FROM panel) SELECT lat_id, {_acf} AS r FROM p GROUP BY lat_id")
def _(spark, d):
    return K.autocorrelation(panel(spark, d), ["y"], [1], ["lat_id"], ["date", "lon_id"]).select("lat_id", r6("r").alias("r"))


@query("W12_acf", f"WITH {DAILY}, x AS (SELECT row_number() OVER (ORDER BY date) AS n, sii_mean - avg(sii_mean) OVER () AS x FROM daily WHERE sii_mean IS NOT NULL), k AS (SELECT unnest(range(0, 91)) AS lag) SELECT CAST(lag AS INTEGER) AS lag, round(sum(a.x * b.x) / (SELECT sum(x * x) FROM x), 6) AS r FROM k, x a JOIN x b ON b.n = a.n - lag GROUP BY lag")
def _(spark, d):
    return K.acf_global_mean(daily(spark, d), "sii_mean", 90).withColumn("r", r6("r"))


_grid = f'{RESULTS}, g AS (SELECT "window" AS win, bin_id, avg(rho) AS rho FROM results WHERE target = \'t740\' GROUP BY ALL)'


@query("W13_local_peaks", f"WITH {_grid} SELECT a.win, a.bin_id, round(a.rho, 6) AS rho, a.rho = max(b.rho) AND a.rho > 0 AS is_max, a.rho = min(b.rho) AND a.rho < 0 AS is_min FROM g a JOIN g b ON abs(a.win - b.win) <= 1 AND abs(a.bin_id - b.bin_id) <= 1 GROUP BY a.win, a.bin_id, a.rho")
def _(spark, d):
    grid = results(spark, d).where("target = 't740'").groupBy(c("window").alias("win"), "bin_id").agg(F.avg("rho").alias("rho"))
    return W.local_peaks(grid, "win", "bin_id", "rho").withColumn("rho", r6("rho"))


@query("W14_bh_fdr", f"WITH {RESULTS}, k AS (SELECT *, row_number() OVER (PARTITION BY target, bin_id ORDER BY p_adj) AS r, count(*) OVER (PARTITION BY target, bin_id) AS m FROM results WHERE p_adj IS NOT NULL) SELECT target, bin_id, scenario, omni_var, round(least(greatest(min(m / r::DOUBLE * p_adj) OVER (PARTITION BY target, bin_id ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 1), 6) AS p_fdr FROM k UNION ALL SELECT target, bin_id, scenario, omni_var, NULL FROM results WHERE p_adj IS NULL")
def _(spark, d):
    return W.bh_fdr(results(spark, d), "p_adj", ["target", "bin_id"]).select("target", "bin_id", "scenario", "omni_var", r6("p_fdr").alias("p_fdr"))


@query("W15_segment_midpoints", f"WITH {_grid}, s AS (SELECT bin_id, (win + lead(win) OVER (PARTITION BY bin_id ORDER BY win)) / 2::DOUBLE AS mid, (rho + lead(rho) OVER (PARTITION BY bin_id ORDER BY win)) / 2 AS v FROM g) SELECT bin_id, mid, round(v, 6) AS mid_value FROM s WHERE mid IS NOT NULL")
def _(spark, d):
    grid = results(spark, d).where("target = 't740'").groupBy(c("window").alias("win"), "bin_id").agg(F.avg("rho").alias("rho"))
    return W.segment_midpoints(grid, "win", "rho", ["bin_id"]).withColumn("mid_value", r6("mid_value"))


# --- joins ---------------------------------------------------------------------------------------


def cover(spark, d):
    """Land cover by eight-day period and coarse cell."""
    return points(spark, d).select(S.period_start(c("date")).alias("date"), (c("pid") % 40).alias("cell"), "cloud", "aerosol", "lai").groupBy("date", "cell").agg(F.max("cloud").alias("cloud"), F.min("aerosol").alias("aerosol"), F.avg("lai").alias("lai")).where("cell < 30")


_period = "CAST(date_trunc('year', date) AS DATE) + CAST(((dayofyear(date) - 1) // 8) * 8 AS INTEGER)"
_cover = f"{POINTS}, cover AS (SELECT {_period} AS period, pid % 40 AS cell, max(cloud) AS cloud, min(aerosol) AS aerosol, avg(lai) AS lai FROM points WHERE pid % 40 < 30 GROUP BY 1, 2)"


@query("J1_land_cover", f"WITH {_cover} SELECT pid, round(c.lai, 6) AS lai, c.cell IS NOT NULL AS has_cover FROM points p LEFT JOIN cover c ON c.period = {_period.replace('date)', 'p.date)')} AND c.cell = p.pid % 40")
def _(spark, d):
    own = points(spark, d).select("pid", "date", (c("pid") % 40).alias("cell"))
    return J.with_land_cover(own, cover(spark, d), ["cell"]).select("pid", r6("lai").alias("lai"), "has_cover")


@query("J2_dilation", "WITH g AS (SELECT p_size * 2 AS i, CAST(p_partkey % 60 * 2 AS INTEGER) AS j, max(p_retailprice) AS v FROM part GROUP BY ALL), o AS (SELECT * FROM (VALUES (0,0,0),(1,-1,-1),(2,-1,0),(3,-1,1),(4,0,-1),(5,0,1),(6,1,-1),(7,1,0),(8,1,1)) t(pr, di, dj)), s AS (SELECT i + di AS i, j + dj AS j, v, pr FROM g, o) SELECT i, j, arg_min(v, pr) AS v FROM s GROUP BY ALL")
def _(spark, d):
    grid = table(spark, d, "part").groupBy((c("p_size") * 2).alias("i"), (c("p_partkey") % 60 * 2).cast("int").alias("j")).agg(F.max("p_retailprice").alias("v"))
    return J.dilated(grid, ["i", "j"], "i", "j", 1)


def flags(spark, d):
    return panel(spark, d).select("date", "lat_id", "lon_id", "region_flags").where(c("lat_id") < 1000)


query("J3_universe", f"WITH {PANEL} SELECT date, lat_id, lon_id, round(y, 6) AS y, region_flags FROM panel WHERE lat_id < 1000")(lambda spark, d: J.universe(panel(spark, d).drop("region_flags"), flags(spark, d)).select("date", "lat_id", "lon_id", r6("y").alias("y"), "region_flags"))
query("J4_env_panel", f"WITH {PANEL}, e AS (SELECT date, lat_id, lon_id, par FROM panel WHERE par > 4) SELECT date, lat_id, lon_id, round(y, 6) AS y, round(e.par, 6) AS par FROM panel JOIN e USING (date, lat_id, lon_id)")(lambda spark, d: panel(spark, d).select("date", "lat_id", "lon_id", r6("y").alias("y")).join(panel(spark, d).where("par > 4").select("date", "lat_id", "lon_id", r6("par").alias("par")), ["date", "lat_id", "lon_id"]))
query("J5_global_series", f"WITH {PANEL}, {DAILY} SELECT date, lat_id, lon_id, round(sii_mean, 6) AS sii_mean FROM panel JOIN daily USING (date)")(lambda spark, d: panel(spark, d).join(J.broadcast_daily(daily(spark, d)), "date").select("date", "lat_id", "lon_id", r6("sii_mean").alias("sii_mean")))
query("J6_flags_left", f"WITH {PANEL}, f AS (SELECT date, lat_id, lon_id, region_flags FROM panel WHERE lat_id < 1000) SELECT date, lat_id, lon_id, f.region_flags FROM (SELECT date, lat_id, lon_id FROM panel) LEFT JOIN f USING (date, lat_id, lon_id)")(lambda spark, d: panel(spark, d).select("date", "lat_id", "lon_id").join(flags(spark, d), ["date", "lat_id", "lon_id"], "left"))
query("J7_restricted", f"WITH {PANEL} SELECT date, lat_id, lon_id, n_obs FROM panel WHERE lat_id < 1000")(lambda spark, d: J.restricted(panel(spark, d), flags(spark, d)).select("date", "lat_id", "lon_id", "n_obs"))
query("J8_means_and_counts", f"WITH {POINTS} SELECT date, round(avg(y), 6) AS y, count(*) AS n FROM points GROUP BY date")(lambda spark, d: A.cell_means(points(spark, d), ["date"], ["y"], "n").withColumn("y", r6("y")))


@query("J9_skeleton", f"WITH {RESULTS}, k AS (SELECT t, b, s FROM (SELECT unnest(['t740', 't757']) AS t), (SELECT unnest(['Cold', 'Cool', 'Frozen']) AS b), (SELECT unnest(['Global_High_LAI', 'Nowhere']) AS s)), m AS (SELECT target, bin_label, scenario, max(rho) AS rho FROM results GROUP BY ALL) SELECT t AS target, b AS bin_label, s AS scenario, rho FROM k LEFT JOIN m ON target = t AND bin_label = b AND scenario = s")
def _(spark, d):
    frame = J.skeleton(spark, target=["t740", "t757"], bin_label=["Cold", "Cool", "Frozen"], scenario=["Global_High_LAI", "Nowhere"])
    best = results(spark, d).groupBy("target", "bin_label", "scenario").agg(F.max("rho").alias("rho"))
    return frame.join(best, ["target", "bin_label", "scenario"], "left")


query("J10_attached_bins", f"WITH {PANEL} SELECT date, lat_id, lon_id, {BIN_ID} AS bin_id FROM panel")(lambda spark, d: panel(spark, d).select("date", "lat_id", "lon_id", S.bin_id(c("temp")).alias("bin_id")))


@query("J12_observed_and_summary", f"WITH {_grid}, s AS (SELECT win, median(rho) AS mid FROM g WHERE bin_id > 0 GROUP BY win) SELECT win, round(rho, 6) AS rho, round(mid, 6) AS mid FROM g JOIN s USING (win) WHERE bin_id = 0")
def _(spark, d):
    grid = results(spark, d).where("target = 't740'").groupBy(c("window").alias("win"), "bin_id").agg(F.avg("rho").alias("rho"))
    return grid.where("bin_id = 0").join(grid.where("bin_id > 0").groupBy("win").agg(r6(F.median("rho")).alias("mid")), "win").select("win", r6("rho").alias("rho"), "mid")


# --- order, sets ---------------------------------------------------------------------------------

query("S1_sorted", f"WITH {RESULTS} SELECT target, scenario, bin_id, omni_var, rho FROM results ORDER BY target, scenario, bin_id, omni_var, rho")(lambda spark, d: results(spark, d).select("target", "scenario", "bin_id", "omni_var", "rho").orderBy("target", "scenario", "bin_id", "omni_var", "rho"))


@query("S2_fixed_order", f"WITH {RESULTS}, o AS (SELECT unnest(['Cold', 'Cool', 'Optimum', 'Warm_Stress', 'Extreme_Heat']) AS bin_label, unnest([0, 1, 2, 3, 4]) AS place) SELECT bin_label, place, count(rho) AS n FROM o LEFT JOIN results USING (bin_label) GROUP BY ALL ORDER BY place")
def _(spark, d):
    order = spark.createDataFrame([*zip(C.BIN_LABELS, range(5))], "bin_label string, place int")
    return F.broadcast(order).join(results(spark, d), "bin_label", "left").groupBy("bin_label", "place").agg(F.count("rho").alias("n")).orderBy("place")


query("S3_largest_days", f"WITH {DAILY} SELECT date, round(sii_max, 6) AS sii_max FROM daily WHERE sii_max IS NOT NULL ORDER BY sii_max DESC, date LIMIT 5")(lambda spark, d: daily(spark, d).where("sii_max is not null").orderBy(c("sii_max").desc(), "date").limit(5).select("date", r6("sii_max").alias("sii_max")))
query("S4_head", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5")(lambda spark, d: table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").limit(5))
query("S5_first_per_key", "SELECT l_orderkey, arg_min(l_linenumber, l_linenumber) AS l_linenumber, arg_min(l_quantity, l_linenumber) AS l_quantity FROM lineitem GROUP BY 1")(lambda spark, d: J.first_per_key(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", *FILE_ORDER]).select("l_orderkey", "l_linenumber", "l_quantity"))
query("U1_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")(lambda spark, d: table(spark, d, "customer").select(c("c_nationkey").alias("k")).unionByName(table(spark, d, "supplier").select(c("s_nationkey").alias("k"))))
query("U2_difference", f"WITH {POINTS} SELECT date FROM points EXCEPT SELECT CAST(o_orderdate AS DATE) FROM orders")(lambda spark, d: points(spark, d).select("date").distinct().join(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")), "date", "left_anti"))
query("U3_product", "SELECT r_name, n_name FROM region, nation")(lambda spark, d: table(spark, d, "nation").select("n_name").crossJoin(F.broadcast(table(spark, d, "region").select("r_name"))))


# --- quality -------------------------------------------------------------------------------------

query("Q1_audit", f"WITH {PANEL} SELECT 'panel' AS name, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, min(year(date)) < 2010 AS date_trap, true AS ids_are_short FROM panel")(lambda spark, d: Q.audit(panel(spark, d), "panel"))


@query("Q2_validation", "WITH k AS (SELECT count(*) AS n FROM part) SELECT name, CAST(share * n AS INTEGER) AS n_rows, status FROM k, (VALUES ('good', 1, 'ok'), ('short', 1, 'too few rows'), ('wrong', 1, 'missing columns'), ('blank', 1, 'columns without a value'), ('none', 0, 'empty')) t(name, share, status)")
def _(spark, d):
    r = results(spark, d)
    more = r.count() + 1  # than there are, whatever the size: the SQL's short table is always short
    checks = [Q.validate(r, "good", ["rho", "p_adj"], 10), Q.validate(r, "short", ["rho"], more), Q.validate(r, "wrong", ["rho", "t"], 10), Q.validate(r.withColumn("t", F.lit(None)), "blank", ["t"], 10), Q.validate(r.limit(0), "none", ["rho"], 1)]
    out = checks[0]
    for x in checks[1:]:
        out = out.unionByName(x)
    return out.withColumn("n_rows", c("n_rows").cast("int"))


@query("Q3_coverage", f"WITH {RESULTS}, k AS (SELECT DISTINCT target, scenario FROM results WHERE rho > 0.99) SELECT CAST(16 AS BIGINT) AS n_expected, count(*) AS n_found, count(*) * 100 / 16::DOUBLE AS pct FROM k")
def _(spark, d):
    expected = J.skeleton(spark, target=["t740", "t757", "t771", "stress"], scenario=[s for s, _, _ in C.SCENARIOS])
    return Q.coverage(results(spark, d).where("rho > 0.99"), expected, ["target", "scenario"])


query("Q4_required_columns", f"WITH {RESULTS} SELECT target, rho FROM results")(lambda spark, d: Q.require_columns(results(spark, d), ["target", "rho"], "results").select("target", "rho"))


# --- aggregates ----------------------------------------------------------------------------------


@query("A1_resampled", "WITH e AS (SELECT CAST(ts AS DATE) AS date, value FROM events WHERE dayofweek(ts) <> 3), s AS (SELECT date, avg(value) AS m, max(value) AS x, stddev_samp(value) AS s FROM e GROUP BY 1), cal AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM s) SELECT date, round(m, 6) AS value_mean, round(x, 6) AS value_max, round(s, 6) AS value_std FROM cal LEFT JOIN s USING (date)")
def _(spark, d):
    rows = table(spark, d, "events").where(F.dayofweek("ts") != 4).select("ts", "value")
    return A.resampled(rows, "ts", {"value": ("mean", "max", "std")}).select("date", *[r6(f"value_{x}").alias(f"value_{x}") for x in ("mean", "max", "std")])


query("A2_densified", f"WITH {PANEL}, b AS (SELECT lat_id, min(date) AS a, max(date) AS z FROM panel GROUP BY 1), k AS (SELECT lat_id, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM b) SELECT k.lat_id, k.date, round(y, 6) AS y FROM k LEFT JOIN panel p ON p.lat_id = k.lat_id AND p.date = k.date")(lambda spark, d: A.densified(panel(spark, d).select("lat_id", "date", r6("y").alias("y")), "date", ["lat_id"]))
query("A3_cell_means", f"WITH {POINTS} SELECT date, CAST(round_even(lat / 5, 0) AS SMALLINT) AS i, round(avg(lai), 6) AS lai, round(avg(cloud), 6) AS cloud FROM points GROUP BY 1, 2")(lambda spark, d: A.cell_means(points(spark, d).withColumn("i", F.rint(c("lat") / 5).cast("short")), ["date", "i"], ["lai", "cloud"]).select("date", "i", r6("lai").alias("lai"), r6("cloud").alias("cloud")))


def _grid_points(spark, d):
    """Values on a quarter-degree grid by day."""
    return table(spark, d, "events").select(F.to_date("ts").alias("date"), (F.pmod(c("user_id"), F.lit(9)) / 4.0).alias("latitude"), (F.pmod(c("event_id"), F.lit(7)) / 4.0).alias("longitude"), "value")


_gp = "g AS (SELECT CAST(ts AS DATE) AS date, (user_id % 9) / 4.0::DOUBLE AS latitude, (event_id % 7) / 4.0::DOUBLE AS longitude, value FROM events)"
_node = "latitude * 2 = floor(latitude * 2) AND longitude * 2 = floor(longitude * 2)"
query("A4_mean_then_regrid", f"WITH {_gp} SELECT date, latitude, longitude, round(avg(value), 6) AS value FROM g WHERE {_node} GROUP BY 1, 2, 3")(lambda spark, d: J.regridded(A.cell_means(_grid_points(spark, d), ["date", "latitude", "longitude"], ["value"]), "value", ["date"]).withColumn("value", r6("value")))


@query("A5_regrid_then_mean", f"WITH {_gp}, h AS (SELECT date, latitude, longitude, avg(value) AS value FROM g GROUP BY 1, 2, 3) SELECT latitude, longitude, round(avg(value), 6) AS value FROM h WHERE {_node} GROUP BY 1, 2")
def _(spark, d):
    hourly = A.cell_means(_grid_points(spark, d), ["date", "latitude", "longitude"], ["value"])
    return A.cell_means(J.regridded(hourly, "value", ["date"]), ["latitude", "longitude"], ["value"]).select("latitude", "longitude", r6("value").alias("value"))


query("A6_daily_cells", f"WITH {POINTS} SELECT date, pid % 20 AS cell, round(avg(y), 6) AS y, round(avg(lai), 6) AS lai, count(*) AS n FROM points GROUP BY 1, 2")(lambda spark, d: A.cell_means(points(spark, d).withColumn("cell", c("pid") % 20), ["date", "cell"], ["y", "lai"], "n").select("date", "cell", r6("y").alias("y"), r6("lai").alias("lai"), "n"))


@query("A7_means_of_means", f"WITH {POINTS}, f AS (SELECT date, pid % 20 AS cell, pid % 3 AS part, avg(y) AS y, count(*) AS n FROM points GROUP BY 1, 2, 3) SELECT date, cell, round(avg(y), 6) AS y, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY 1, 2")
def _(spark, d):
    first = A.cell_means(points(spark, d).withColumns({"cell": c("pid") % 20, "part": c("pid") % 3}), ["date", "cell", "part"], ["y"], "n")
    return first.groupBy("date", "cell").agg(r6(F.avg("y")).alias("y"), F.sum("n").alias("n"))


query("A8_global_daily_mean", f"WITH {PANEL} SELECT date, round(avg(y), 6) AS y, round(avg(par), 6) AS par FROM panel GROUP BY date")(lambda spark, d: A.cell_means(panel(spark, d), ["date"], ["y", "par"]).select("date", r6("y").alias("y"), r6("par").alias("par")))
query("A9_trend_summary", f"WITH {RESULTS} SELECT target, bin_label, omni_var, round(avg(rho), 6) AS mean_rho, round(median(rho), 6) AS median_rho, count(scenario) AS n_scenarios, round(avg(CASE WHEN p_adj < 0.05 THEN 1 ELSE 0 END) * 100, 6) AS perc_sig FROM results GROUP BY ALL")(lambda spark, d: A.trend_summary(results(spark, d), ["target", "bin_label", "omni_var"]).withColumns({x: r6(x) for x in ("mean_rho", "median_rho", "perc_sig")}))


def profile_rows(spark, d):
    """Screening profiles: two families, two modes, windows."""
    r = results(spark, d)
    return r.select("target", "scenario", "bin_id", F.when(c("omni_var").startswith("sii"), "SII").otherwise(F.lit("F10.7")).alias("family"), F.when(c("n") % 2 == 0, "MA").otherwise(F.lit("LAG")).alias("mode"), c("window").alias("window_value"), F.concat("omni_var", F.lit("/"), c("n").cast("string"), F.lit("/"), "scenario").alias("feature"), F.when(F.abs("rho") < 0.97, F.atanh("rho")).alias("z"), F.struct(*FILE_ORDER).alias("place"))


_profiles = f"{RESULTS}, prof AS (SELECT target, scenario, bin_id, CASE WHEN omni_var LIKE 'sii%' THEN 'SII' ELSE 'F10.7' END AS family, CASE WHEN n % 2 = 0 THEN 'MA' ELSE 'LAG' END AS mode, \"window\" AS window_value, omni_var || '/' || n || '/' || scenario AS feature, CASE WHEN abs(rho) < 0.97 THEN atanh(rho) END AS z FROM results)"
_side = "round(avg(abs(z)) FILTER (mode = '{m}'), 6) AS auc_abs_z_{l}, round(max(abs(z)) FILTER (mode = '{m}'), 6) AS peak_abs_z_{l}, first(feature ORDER BY abs(z) DESC, window_value) FILTER (mode = '{m}' AND z IS NOT NULL) AS peak_{l}"
_summary = f"{_profiles}, summ AS (SELECT target, scenario, bin_id, family, avg(abs(z)) FILTER (mode = 'MA') AS auc_abs_z_ma, avg(abs(z)) FILTER (mode = 'LAG') AS auc_abs_z_lag FROM prof GROUP BY ALL)"


@query("A10_profile_summary", f"WITH {_profiles} SELECT target, family, {_side.format(m='MA', l='ma')}, {_side.format(m='LAG', l='lag')}, round(avg(abs(z)) FILTER (mode = 'MA') - avg(abs(z)) FILTER (mode = 'LAG'), 6) AS delta_acc FROM prof GROUP BY target, family")
def _(spark, d):
    out = A.profile_summary(profile_rows(spark, d), ["target", "family"], ["place"])
    return out.withColumns({x: r6(x) for x in out.columns if x.startswith(("auc", "peak_abs", "delta"))})


def overview(spark, d):
    return A.family_overview(A.profile_summary(profile_rows(spark, d), ["target", "scenario", "bin_id", "family"]), ["target", "scenario", "bin_id"])


_over = f"""{_summary}, ov AS (SELECT target, scenario, bin_id, max(auc_abs_z_ma) FILTER (family = 'SII') AS sii_auc_ma, max(auc_abs_z_lag) FILTER (family = 'SII') AS sii_auc_lag, max(auc_abs_z_ma - auc_abs_z_lag) FILTER (family = 'SII') AS sii_delta_acc,
    max(auc_abs_z_ma) FILTER (family = 'F10.7') AS f_auc_ma, max(auc_abs_z_lag) FILTER (family = 'F10.7') AS f_auc_lag, max(auc_abs_z_ma - auc_abs_z_lag) FILTER (family = 'F10.7') AS f_delta_acc FROM summ GROUP BY ALL)"""
_overview_columns = ["sii_auc_ma", "sii_auc_lag", "sii_delta_acc", "f_auc_ma", "f_auc_lag", "f_delta_acc"]


@query("A11_family_overview", f"WITH {_over} SELECT target, scenario, bin_id, {', '.join(f'round({x}, 6) AS {x}' for x in _overview_columns)}, round(sii_delta_acc - f_delta_acc, 6) AS delta_acc_diff, round(sii_auc_ma / f_auc_ma, 6) AS auc_ma_ratio FROM ov")
def _(spark, d):
    return overview(spark, d).withColumns({x: r6(x) for x in [*_overview_columns, "delta_acc_diff", "auc_ma_ratio"]})


def pair_rows(spark, d):
    return results(spark, d).select("target", "scenario", "bin_id", F.when(c("n") % 2 == 0, "MA").otherwise(F.lit("LAG")).alias("mode"), F.when(c("rho") > 0.2, "SII").when(c("rho") < 0.1, "F10.7").alias("winner"))


_pairs = f"{RESULTS}, pr AS (SELECT target, scenario, bin_id, CASE WHEN n % 2 = 0 THEN 'MA' ELSE 'LAG' END AS mode, CASE WHEN rho > 0.2 THEN 1 ELSE 0 END AS w FROM results), wr AS (SELECT target, scenario, bin_id, CASE WHEN grouping(mode) = 1 THEN 'ALL' ELSE mode END AS mode, count(*) AS n_windows, avg(w) AS p_sii_win FROM pr GROUP BY GROUPING SETS ((target, scenario, bin_id, mode), (target, scenario, bin_id)))"
query("A12_win_rates", f"WITH {_pairs} SELECT target, scenario, bin_id, mode, n_windows, round(p_sii_win, 6) AS p_sii_win FROM wr")(lambda spark, d: A.win_rates(pair_rows(spark, d), ["target", "scenario", "bin_id"]).withColumn("p_sii_win", r6("p_sii_win")))


def global_rows(spark, d):
    return A.global_overview(overview(spark, d), A.win_rates(pair_rows(spark, d), ["target", "scenario", "bin_id"]), ["target", "scenario"])


_diff, _ratio = "sii_delta_acc - f_delta_acc", "sii_auc_ma / f_auc_ma"
query("A13_global_overview", f"WITH {_over} SELECT target, scenario, count(DISTINCT bin_id) AS n_bins, round(avg({_diff}), 6) AS delta_acc_diff_mean, round(median({_diff}), 6) AS delta_acc_diff_median, round(avg({_ratio}), 6) AS auc_ma_ratio_mean, round(median({_ratio}), 6) AS auc_ma_ratio_median FROM ov GROUP BY ALL")(lambda spark, d: global_rows(spark, d).select("target", "scenario", "n_bins", *[r6(x).alias(x) for x in ("delta_acc_diff_mean", "delta_acc_diff_median", "auc_ma_ratio_mean", "auc_ma_ratio_median")]))
query("A14_weighted_win_rate", f"WITH {_pairs} SELECT target, scenario, round(sum(p_sii_win * n_windows) / sum(n_windows), 6) AS p_sii_win_weighted, CAST(sum(n_windows) AS BIGINT) AS n_windows_total FROM wr WHERE mode = 'ALL' GROUP BY ALL")(lambda spark, d: global_rows(spark, d).select("target", "scenario", r6("p_sii_win_weighted").alias("p_sii_win_weighted"), "n_windows_total"))
query("J13_overview_with_rates", f"WITH {_over}, pr AS (SELECT target, scenario, bin_id, CASE WHEN rho > 0.2 THEN 1 ELSE 0 END AS w FROM results), w AS (SELECT target, scenario, avg(w) AS p FROM pr GROUP BY ALL), o AS (SELECT target, scenario, count(DISTINCT bin_id) AS n_bins FROM ov GROUP BY ALL) SELECT target, scenario, n_bins, round(p, 6) AS p_sii_win_weighted FROM o LEFT JOIN w USING (target, scenario)")(lambda spark, d: global_rows(spark, d).select("target", "scenario", "n_bins", r6("p_sii_win_weighted").alias("p_sii_win_weighted")))
query("A16_best_row", f'WITH {RESULTS} SELECT target, bin_label, first(omni_var ORDER BY abs(rho) DESC, "window", scenario) AS omni_var, first(rho ORDER BY abs(rho) DESC, "window", scenario) AS rho FROM results GROUP BY ALL')(lambda spark, d: A.best_row(results(spark, d), ["target", "bin_label"], F.abs("rho"), ["window", "scenario"]).select("target", "bin_label", "omni_var", "rho"))


@query("A17_strength_matrix", f'WITH {RESULTS} SELECT bin_label, ' + ", ".join(f'CASE WHEN count(rho) FILTER ("window" = {w}) >= 10 THEN round(median(abs(rho)) FILTER ("window" = {w}), 6) END AS "w{w}"' for w in (1, 5, 20, 26)) + " FROM results GROUP BY bin_label")
def _(spark, d):
    matrix = A.strength_matrix(results(spark, d), 10, "bin_label", "window", "rho", (1, 5, 20, 26))
    return matrix.select("bin_label", *[r6(c(str(w))).alias(f"w{w}") for w in (1, 5, 20, 26)])


query("A18_global_scale", f'WITH {RESULTS}, m AS (SELECT median(abs(rho)) AS m, count(*) AS n FROM results GROUP BY bin_label, "window", scenario) SELECT round(max(m), 6) AS scale FROM m')(lambda spark, d: results(spark, d).groupBy("bin_label", "window", "scenario").agg(F.median(F.abs("rho")).alias("m")).agg(r6(F.max("m")).alias("scale")))


_drivers = f"{RESULTS}, dr AS (SELECT bin_label, \"window\", CASE WHEN omni_var LIKE '%sii%' THEN 'SII' WHEN omni_var LIKE '%par%' THEN 'PAR' WHEN omni_var LIKE '%vpd%' THEN 'VPD' END AS driver, rho, p_adj FROM results), w AS (SELECT DISTINCT bin_label, \"window\" FROM dr WHERE driver IS NOT NULL), k AS (SELECT unnest(['SII', 'PAR', 'VPD']) AS driver, unnest([0, 1, 2]) AS place), st AS (SELECT w.bin_label, w.\"window\", k.driver, place, coalesce(abs(avg(rho)), 0) AS rho_abs, coalesce(avg(p_adj), 1) AS p_adj FROM w CROSS JOIN k LEFT JOIN dr ON dr.bin_label = w.bin_label AND dr.\"window\" = w.\"window\" AND dr.driver = k.driver GROUP BY ALL)"


def driver_rows(spark, d):
    return A.driver_stack(results(spark, d).withColumn("driver", S.variable_type(c("omni_var"))).where("driver is not null"), ["bin_label"])


query("A19_driver_pivot", f'WITH {_drivers} SELECT bin_label, "window", driver, round(rho_abs, 6) AS rho_abs, round(p_adj, 6) AS p_adj FROM st')(lambda spark, d: driver_rows(spark, d).select("bin_label", "window", "driver", r6("rho_abs").alias("rho_abs"), r6("p_adj").alias("p_adj")))
query("A20_driver_stack", f'WITH {_drivers} SELECT bin_label, "window", driver, round(coalesce(sum(rho_abs) OVER (PARTITION BY bin_label, "window" ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS base FROM st')(lambda spark, d: driver_rows(spark, d).select("bin_label", "window", "driver", r6("base").alias("base")))
_qs = (0.025, 0.25, 0.5, 0.75, 0.975)
query("A21_exact_quantiles", f'WITH {RESULTS} SELECT "window", ' + ", ".join(f"round(quantile_cont(rho, {q}), 6) AS q{i}" for i, q in enumerate(_qs)) + ' FROM results GROUP BY "window"')(lambda spark, d: A.exact_quantiles(results(spark, d), ["window"], "rho", _qs, [f"q{i}" for i in range(5)]).withColumns({f"q{i}": r6(f"q{i}") for i in range(5)}))


@query("A22_surrogate_summary", f"WITH {RESULTS}, k AS (SELECT rho, scenario = 'Global_High_LAI' AND bin_id = 0 AND omni_var = 'sii_mean_ma1' AS o FROM results), o AS (SELECT max(rho) FILTER (o) AS observed FROM k) SELECT 'rho' AS metric, round(max(observed), 6) AS observed, count(*) FILTER (NOT o) AS n_surrogates, round(avg(rho) FILTER (NOT o), 6) AS surrogate_mean, round(stddev_samp(rho) FILTER (NOT o), 6) AS surrogate_std, round(quantile_cont(rho, 0.025) FILTER (NOT o), 6) AS surrogate_q025, round(quantile_cont(rho, 0.5) FILTER (NOT o), 6) AS surrogate_q500, round(quantile_cont(rho, 0.975) FILTER (NOT o), 6) AS surrogate_q975, round((1 + count(*) FILTER (NOT o AND abs(rho) >= abs(observed))) / (count(*) FILTER (NOT o) + 1)::DOUBLE, 6) AS p_empirical FROM k, o")
def _(spark, d):
    from gridloom.operators.models import surrogate_summary

    observed = (c("scenario") == "Global_High_LAI") & (c("bin_id") == 0) & (c("omni_var") == "sii_mean_ma1")
    out = surrogate_summary(results(spark, d).select(F.when(observed, "observed").otherwise(F.lit("surrogate")).alias("kind"), "rho"), "rho", True)
    return out.withColumns({x: r6(x) for x in out.columns if x not in ("metric", "n_surrogates")})


_band = f'{RESULTS}, sp AS (SELECT target, bin_id, "window" AS win, avg(rho) AS rho FROM results GROUP BY ALL), b AS (SELECT target, bin_id, win, rho, (win - lag(win) OVER w) * (rho + lag(rho) OVER w) / 2 AS t FROM sp WHERE win BETWEEN 20 AND 25 WINDOW w AS (PARTITION BY target, bin_id ORDER BY win))'
query("A23_band_metrics", f"WITH {_band} SELECT target, bin_id, round(coalesce(sum(t), 0), 6) AS signed_auc, round(max(abs(rho)), 6) AS max_abs_rho, round(avg(rho), 6) AS mean_rho FROM b GROUP BY ALL")(lambda spark, d: A.band_metrics(results(spark, d).groupBy("target", "bin_id", "window").agg(F.avg("rho").alias("rho")), ["target", "bin_id"], 20, 25).withColumns({x: r6(x) for x in ("signed_auc", "max_abs_rho", "mean_rho")}))
query("A24_scenario_cells", f"WITH {PANEL}, {SCENARIO_ROWS}, k AS (SELECT DISTINCT lat_id, lon_id, region_flags FROM panel) SELECT scenario, count(*) AS n_cells, round(count(*) * 100 / (361 * 721)::DOUBLE, 6) AS pct FROM k JOIN scen ON region_flags & required = required GROUP BY scenario")(lambda spark, d: J.by_scenario(panel(spark, d).select("lat_id", "lon_id", "region_flags").distinct()).groupBy("scenario").agg(F.count(F.lit(1)).alias("n_cells"), r6(F.count(F.lit(1)) * 100 / F.lit(361.0 * 721)).alias("pct")))


@query("A25_moments", f"WITH {DAILY} SELECT count(sii_mean) AS n, round(avg(sii_mean), 6) AS mean, round(stddev_samp(sii_mean), 6) AS std, round(min(sii_mean), 6) AS least, round(quantile_cont(sii_mean, 0.25), 6) AS q1, round(median(sii_mean), 6) AS q2, round(quantile_cont(sii_mean, 0.75), 6) AS q3, round(max(sii_mean), 6) AS largest, round(skewness(sii_mean), 6) AS skewness, round(kurtosis(sii_mean), 6) AS kurtosis FROM daily")
def _(spark, d):
    out = A.moments(daily(spark, d), "sii_mean")
    return out.select("n", *[r6(x).alias(x) for x in ("mean", "std", "least")], *[r6(c("quartiles")[i]).alias(f"q{i + 1}") for i in range(3)], *[r6(x).alias(x) for x in ("largest", "skewness", "kurtosis")])


@query("A26_normality", f"WITH {DAILY}, c AS (SELECT sii_mean - avg(sii_mean) OVER () AS v FROM daily WHERE sii_mean IS NOT NULL), m AS (SELECT count(*)::DOUBLE AS n, avg(v ** 3) / avg(v * v) ** 1.5 AS skew, avg(v ** 4) / avg(v * v) ** 2 - 3 AS kurt FROM c), s AS (SELECT *, skew * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2, (kurt + 6 / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b1 FROM m), a AS (SELECT *, 6 + 8 / b1 * (2 / b1 + sqrt(1 + 4 / (b1 * b1))) AS a FROM s), z AS (SELECT asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(w2) / 2) AS zs, (1 - 2 / (9 * a) - sign(1 + x * sqrt(2 / (a - 4))) * cbrt(abs((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4)))))) / sqrt(2 / (9 * a)) AS zk FROM a) SELECT round(zs * zs + zk * zk, 6) AS k2, round(exp(-(zs * zs + zk * zk) / 2), 9) AS p FROM z")
def _(spark, d):
    return A.normality(daily(spark, d), "sii_mean").select(r6("k2").alias("k2"), F.round("p", 9).alias("p"))


query("A27_exceedance", f"WITH {DAILY}, t AS (SELECT unnest([30.0, 50.0, 100.0, 200.0, 300.0])::DOUBLE AS threshold) SELECT threshold, count(*) FILTER (sii_max > threshold) AS n_over, round(count(*) FILTER (sii_max > threshold) * 100 / count(sii_max)::DOUBLE, 6) AS pct_over FROM daily, t GROUP BY threshold")(lambda spark, d: A.exceedance(daily(spark, d), "sii_max", (30, 50, 100, 200, 300)).withColumn("pct_over", r6("pct_over")))
query("A28_annual_exceedance", f"WITH {DAILY} SELECT CAST(year(date) AS INTEGER) AS year, count(*) FILTER (sii_max > 200) AS n_over FROM daily GROUP BY 1")(lambda spark, d: A.exceedance(daily(spark, d).withColumn("year", F.year("date")), "sii_max", (200,), ["year"]).select("year", "n_over"))
query("A29_coverage_variation", f"WITH {PANEL}, k AS (SELECT date, count(*) AS n FROM panel GROUP BY 1) SELECT round(avg(n), 6) AS mean_rows, round(stddev_samp(n) / avg(n), 6) AS cv_rows FROM k")(lambda spark, d: A.coverage_variation(panel(spark, d)).withColumns({x: r6(x) for x in ("mean_rows", "cv_rows")}))
query("A30_unexpected_days", f"WITH {POINTS} SELECT DISTINCT CAST(dayofyear(date) AS INTEGER) AS doy FROM points WHERE (dayofyear(date) - 1) % 8 <> 0")(lambda spark, d: Q.unexpected_days(points(spark, d)))
query("A31_mean_by_range", f"WITH {POINTS} SELECT CASE WHEN cloud <= 0 THEN NULL WHEN cloud <= 1 THEN 0 WHEN cloud <= 2 THEN 1 WHEN cloud <= 5 THEN 2 WHEN cloud <= 10 THEN 3 WHEN cloud <= 100 THEN 4 END AS bin_id, round(avg(lai), 6) AS lai FROM points WHERE cloud > 0 AND cloud <= 100 GROUP BY 1")(lambda spark, d: points(spark, d).where((c("cloud") > 0) & (c("cloud") <= 100)).groupBy(S.bin_id(c("cloud"), (1.0, 2.0, 5.0, 10.0)).alias("bin_id")).agg(r6(F.avg("lai")).alias("lai")))
query("A32_out_of_range", f"WITH {POINTS} SELECT count(*) FILTER (NOT cloud BETWEEN 10 AND 90) AS n_out, round(count(*) FILTER (NOT cloud BETWEEN 10 AND 90) * 100 / count(cloud)::DOUBLE, 6) AS pct_out FROM points")(lambda spark, d: Q.out_of_range(points(spark, d), "cloud", 10, 90).withColumn("pct_out", r6("pct_out")))
query("A33_rows_per_cell", f"WITH {PANEL} SELECT lat_id, lon_id, count(*) AS n FROM panel GROUP BY 1, 2")(lambda spark, d: panel(spark, d).groupBy("lat_id", "lon_id").agg(F.count(F.lit(1)).alias("n")))
query("A34_distinct_years", f"WITH {PANEL} SELECT lat_id, count(DISTINCT year(date)) AS n_years FROM panel GROUP BY 1")(lambda spark, d: panel(spark, d).groupBy("lat_id").agg(F.countDistinct(F.year("date")).alias("n_years")))
query("A35_histogram", f"WITH {DAILY}, e AS (SELECT min(sii_mean) AS lo, max(sii_mean) AS hi, count(sii_mean) AS n, CAST(least(24, greatest(12, floor(sqrt(count(sii_mean)) * 1.8))) AS INTEGER) AS b FROM daily), k AS (SELECT CAST(unnest(range(0, (SELECT b FROM e))) AS INTEGER) AS bin), p AS (SELECT CAST(least(floor((sii_mean - lo) / ((hi - lo) / b)), b - 1) AS INTEGER) AS bin FROM daily, e WHERE sii_mean IS NOT NULL) SELECT k.bin, round(max(lo + k.bin * (hi - lo) / b), 6) AS lower, count(p.bin) AS n, round(count(p.bin) / max(e.n * (hi - lo) / b), 6) AS density FROM k CROSS JOIN e LEFT JOIN p ON p.bin = k.bin GROUP BY k.bin")(lambda spark, d: A.histogram(daily(spark, d), "sii_mean").select("bin", r6("lower").alias("lower"), c("n").cast("long").alias("n"), r6("density").alias("density")))


@query("A36_unpivoted", f'WITH {RESULTS} SELECT "window", bin_id AS bin, bin_label, round(avg(rho), 6) AS rho FROM results GROUP BY ALL')
def _(spark, d):
    wide = results(spark, d).groupBy("window").pivot("bin_id", [0, 1, 2, 3, 4]).agg(F.avg("rho"))
    named = wide.withColumnsRenamed({str(i): f"rho_bin_{i}_{n}" for i, n in enumerate(C.BIN_LABELS)})
    return A.unpivoted(named, ["window"], "rho_bin_", "rho").where("rho is not null").withColumn("rho", r6("rho"))


_panels = f"{RESULTS}, pn AS (SELECT scenario, bin_id, omni_var, rho, 'A' AS panel FROM results WHERE target = 't740' AND omni_var LIKE 'sii%')"


@query("A37_panels_with_overlay", f"WITH {_panels}, f AS (SELECT scenario, bin_id, omni_var, rho, max(CASE WHEN bin_id = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY scenario) AS h FROM results WHERE target = 't740' AND omni_var LIKE 'f10%') SELECT * FROM pn UNION ALL SELECT scenario || '_overlay', bin_id, omni_var, rho, 'A' FROM f WHERE bin_id = h")
def _(spark, d):
    own = results(spark, d).where("target = 't740'").select("scenario", "bin_id", "omni_var", "rho")
    return A.overlay(own.where("omni_var like 'sii%'").withColumn("panel", F.lit("A")), own.where("omni_var like 'f10%'"), "A")


@query("A38_attribution", f"WITH {RESULTS}, k AS (SELECT scenario, bin_id, omni_var, rho, n_eff, atanh(greatest(least(rho, 0.99), -0.99)) AS z FROM results WHERE omni_var LIKE 'f10%' OR (omni_var LIKE 'sii%' AND bin_id = 2)) SELECT scenario, bin_id, omni_var, rho, round(tanh(z - 1.96 / sqrt(greatest(n_eff - 3, 1))), 6) AS ci_lower, round(tanh(z + 1.96 / sqrt(greatest(n_eff - 3, 1))), 6) AS ci_upper FROM k")
def _(spark, d):
    r = results(spark, d)
    lower, upper = S.fisher_interval(c("rho"), c("n_eff"))
    return r.where("omni_var like 'f10%'").unionByName(r.where("omni_var like 'sii%' and bin_id = 2")).select("scenario", "bin_id", "omni_var", "rho", r6(lower).alias("ci_lower"), r6(upper).alias("ci_upper"))


query("A39_bin_sizes", f"WITH {RESULTS} SELECT target, bin_id, max(n) AS n FROM results GROUP BY ALL")(lambda spark, d: results(spark, d).groupBy("target", "bin_id").agg(F.max("n").alias("n")))
