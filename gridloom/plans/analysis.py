"""Queries of the statistical kernels and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import config as C
from gridloom.operators import aggregates as A
from gridloom.operators import correlation as K
from gridloom.operators import joins as J
from gridloom.operators import models as M
from gridloom.operators import screening as SC
from gridloom.operators import windows as W
from gridloom.plans.registry import query
from gridloom.plans.standins import BIN_ID, BIN_LABEL, DAILY, PANEL, RESULTS, SCENARIO_ROWS, daily, panel, points, results

c = F.col


def r6(x):
    return F.round(x, 6)


#: Windows of the grid search, of every family.
WINDOWS = (*range(1, 29),)


def features(spark, d, windows=C.MA_WINDOWS, lags=C.LAGS):
    """The daily series with trailing means and lags of both drivers."""
    out = daily(spark, d).select("date", "sii_mean", "f10_7_mean")
    for base in ("sii_mean", "f10_7_mean"):
        out = W.lag_smoothed(out, base, lags)
        out = out.withColumns({f"{base}_ma{w}": W.ma_prior(base, w) for w in windows})
    # Rounded, as equal means have to tie whatever the order of their sums.
    return out.withColumns({x: F.round(x, 9) for x in out.columns[1:]})


_features = f"{DAILY}, sm AS (SELECT *, " + ", ".join(f"avg({b}) OVER (ORDER BY date ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS {b}_m" for b in ("sii_mean", "f10_7_mean")) + " FROM daily), feat AS (SELECT date, round(sii_mean, 9) AS sii_mean, round(f10_7_mean, 9) AS f10_7_mean, " + ", ".join(
    [f"round(lag({b}_m, {k}) OVER (ORDER BY date), 9) AS {b}_lag{k}" for b in ("sii_mean", "f10_7_mean") for k in C.LAGS] + [f"round(avg({b}) OVER (ORDER BY date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 9) AS {b}_ma{w}" for b in ("sii_mean", "f10_7_mean") for w in C.MA_WINDOWS]
) + " FROM sm)"
NAMES = [f"{b}_{x}" for b in ("sii_mean", "f10_7_mean") for x in (*[f"ma{w}" for w in C.MA_WINDOWS], *[f"lag{k}" for k in C.LAGS])]
_kind = f"{PANEL}, pb AS (SELECT *, {BIN_ID} AS bin_id, {BIN_LABEL} AS bin_label FROM panel)"


def binned_panel(spark, d):
    return SC.binned(panel(spark, d), "temp")


def stratified(spark, d):
    """The panel by scenario and bin with the drivers' features."""
    return J.by_scenario(binned_panel(spark, d)).join(J.broadcast_daily(features(spark, d)), "date")


_stratified = f"{_kind}, {_features}, {SCENARIO_ROWS}, str AS (SELECT scenario, pb.*, feat.* EXCLUDE (date) FROM pb JOIN scen ON region_flags & required = required JOIN feat ON feat.date = pb.date)"
_structs = ", ".join(f"{{'feature': '{n}', 'x': {n}}}" for n in NAMES)
_long = f"{_stratified}, lg AS (SELECT scenario, bin_id, date, lat_id, lon_id, y, unnest([{_structs}]) AS u FROM str), long AS MATERIALIZED (SELECT scenario, bin_id, date, lat_id, lon_id, y, u.feature AS feature, u.x AS x FROM lg WHERE u.x IS NOT NULL AND y IS NOT NULL)"
_keys = "scenario, bin_id, feature"


def corr_sql(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(sqrt(var_pop({x}) * var_pop({y})), 0)"


def avg_rank_sql(x: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2::DOUBLE"


_ranked = f"{_long}, rk AS (SELECT {_keys}, x, y, {avg_rank_sql('x', _keys)} AS rx, {avg_rank_sql('y', _keys)} AS ry, lag(x) OVER o AS lx, lag(y) OVER o AS ly FROM long WINDOW o AS (PARTITION BY {_keys} ORDER BY date, lat_id, lon_id))"
_r1 = lambda v: f"greatest(least(coalesce(covar_pop(CASE WHEN l{v} IS NOT NULL THEN {v} END, l{v}) / nullif(sqrt(var_pop(CASE WHEN l{v} IS NOT NULL THEN {v} END) * var_pop(l{v})), 0), NULL), 0.99), -0.99)"
_product = f"CASE WHEN count(*) < 5 THEN 0 ELSE {_r1('x')} * {_r1('y')} END"
_profile = f"{_ranked}, pro AS (SELECT {_keys}, count(*) AS n, {corr_sql('rx', 'ry')} AS rho, {_product} AS pr FROM rk GROUP BY ALL HAVING count(*) >= 50)"


@query("entry_stratified_rank_correlation", f"WITH {_ranked} SELECT {_keys}, count(*) AS n, round({corr_sql('rx', 'ry')}, 6) AS rho FROM rk GROUP BY ALL HAVING count(*) >= 50")
def stratified_rank_correlation(spark, d):
    """The flagship: rank correlation of every driver feature with the target by scenario and bin, all in one plan."""
    return profile_rows(spark, d).select("scenario", "bin_id", "feature", "n", r6("rho").alias("rho"))


_frac = "(year(date) + (dayofyear(date) - 1) / dayofyear(make_date(year(date), 12, 31))::DOUBLE)"
_cs = "cos(2 * pi() * {0}) AS co, sin(2 * pi() * {0}) AS si".format(_frac)
_trend = (
    f"{PANEL}, h0 AS (SELECT lat_id, lon_id, date, y, {_cs}, min(date) OVER g AS d0, max(date) OVER g AS d1, count(*) OVER g AS n FROM panel WHERE y IS NOT NULL WINDOW g AS (PARTITION BY lat_id, lon_id)), "
    "h AS (SELECT *, coalesce(date_diff('day', d0, date) / nullif(date_diff('day', d0, d1), 0)::DOUBLE, 0) AS t FROM h0 WHERE n >= 40), "
    "v AS (SELECT lat_id, lon_id, count(*) AS n, avg(y) AS my, avg(t) AS mt, avg(co) AS mc, avg(si) AS ms, covar_pop(t, t) AS aa, covar_pop(co, co) AS bb, covar_pop(si, si) AS ee, covar_pop(t, co) AS ab, covar_pop(t, si) AS ae, covar_pop(co, si) AS be, covar_pop(t, y) AS ay, covar_pop(co, y) AS bq, covar_pop(si, y) AS ey FROM h GROUP BY 1, 2), "
    "vi AS (SELECT *, bb * ee - be * be AS i11, ae * be - ab * ee AS i12, ab * be - ae * bb AS i13, aa * ee - ae * ae AS i22, ab * ae - aa * be AS i23, aa * bb - ab * ab AS i33 FROM v), vd AS (SELECT *, aa * i11 + ab * i12 + ae * i13 AS det FROM vi), "
    "vb AS (SELECT *, (i11 * ay + i12 * bq + i13 * ey) / det AS b1, (i12 * ay + i22 * bq + i23 * ey) / det AS b2, (i13 * ay + i23 * bq + i33 * ey) / det AS b3 FROM vd), "
    "ve AS (SELECT lat_id, lon_id, h.y, vb.n, my, mt, mc, ms, b1, b2, b3, h.y - (my + b1 * (t - mt) + b2 * (co - mc) + b3 * (si - ms)) AS e FROM h JOIN vb USING (lat_id, lon_id))"
)


@query("K1_harmonic_parameters", f"WITH {_trend} SELECT lat_id, lon_id, round(max(my - b1 * mt - b2 * mc - b3 * ms), 5) AS alpha0, round(max(b1), 5) AS alpha_t, round(max(b2), 5) AS beta_cos, round(max(b3), 5) AS beta_sin, round(sqrt(max(b2) ** 2 + max(b3) ** 2), 5) AS amplitude, round(atan2(max(b3), max(b2)), 5) AS phase, round(stddev_pop(e), 5) AS sigma, round(1 - sum(e * e) / (var_pop(y) * count(*)), 5) AS r_squared, max(n) AS n_obs FROM ve GROUP BY 1, 2")
def _(spark, d):
    parameters, _ = M.harmonic_fit(panel(spark, d), "y", ["lat_id", "lon_id"])
    return parameters.select("lat_id", "lon_id", *[F.round(x, 5).alias(x) for x in parameters.columns[2:-1]], "n_obs")


_cc, _ss, _cos_sin, _cy, _sy = "covar_pop(co, co)", "covar_pop(si, si)", "covar_pop(co, si)", "covar_pop(co, y)", "covar_pop(si, y)"
_det = f"({_cc} * {_ss} - {_cos_sin} * {_cos_sin})"
_harm = f"{PANEL}, h AS (SELECT lat_id, lon_id, date, y, {_cs} FROM panel), b AS (SELECT lat_id, lon_id, count(*) AS n, ({_cy} * {_ss} - {_sy} * {_cos_sin}) / {_det} AS bc, ({_sy} * {_cc} - {_cy} * {_cos_sin}) / {_det} AS bs, avg(y) AS my, avg(co) AS mc, avg(si) AS ms FROM h GROUP BY 1, 2 HAVING count(*) >= 40)"


@query("K2_harmonic_without_trend", f"WITH {_harm}, e AS (SELECT lat_id, lon_id, y, my - bc * mc - bs * ms AS a, bc, bs, n, y - (my + bc * (co - mc) + bs * (si - ms)) AS e FROM h JOIN b USING (lat_id, lon_id)) SELECT lat_id, lon_id, round(max(a), 5) AS alpha0, round(max(bc), 5) AS beta_cos, round(max(bs), 5) AS beta_sin, round(sqrt(max(bc) ** 2 + max(bs) ** 2), 5) AS amplitude, round(stddev_pop(e), 5) AS sigma, round(1 - sum(e * e) / (var_pop(y) * count(*)), 5) AS r_squared, max(n) AS n_obs FROM e GROUP BY 1, 2")
def _(spark, d):
    parameters, _ = M.harmonic_fit(panel(spark, d), "y", ["lat_id", "lon_id"], trend=False)
    return parameters.select("lat_id", "lon_id", *[F.round(x, 5).alias(x) for x in ("alpha0", "beta_cos", "beta_sin", "amplitude", "sigma", "r_squared")], "n_obs")


@query("K1_harmonic_residuals", f"WITH {_harm}, ends AS (SELECT lat_id, lon_id, min(date) AS a, max(date) AS z FROM h GROUP BY 1, 2), days AS (SELECT lat_id, lon_id, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM ends JOIN b USING (lat_id, lon_id)), e AS (SELECT lat_id, lon_id, date, y - (my + bc * (co - mc) + bs * (si - ms)) AS e FROM h JOIN b USING (lat_id, lon_id)), s AS (SELECT lat_id, lon_id, stddev_pop(e) AS s FROM e GROUP BY 1, 2) SELECT lat_id, lon_id, date, round(e, 5) AS residual, round(e / s, 5) AS std_residual FROM days JOIN s USING (lat_id, lon_id) LEFT JOIN e USING (lat_id, lon_id, date)")
def _(spark, d):
    _, residuals = M.harmonic_fit(panel(spark, d), "y", ["lat_id", "lon_id"], trend=False)
    return residuals.select("lat_id", "lon_id", "date", F.round("residual", 5).alias("residual"), F.round("std_residual", 5).alias("std_residual"))


@query("K3_spearman_ordinal", f"WITH {_long}, o AS (SELECT {_keys}, row_number() OVER (PARTITION BY {_keys} ORDER BY x, lat_id, lon_id, date) AS rx, row_number() OVER (PARTITION BY {_keys} ORDER BY y, lat_id, lon_id, date) AS ry FROM long) SELECT {_keys}, count(*) AS n, round({corr_sql('rx', 'ry')}, 6) AS rho FROM o GROUP BY ALL")
def _(spark, d):
    long = SC.melted(stratified(spark, d), NAMES, ["scenario", "bin_id", "date", "lat_id", "lon_id", "y"])
    return K.spearman_ordinal(long, "x", "y", ["scenario", "bin_id", "feature"], ["lat_id", "lon_id", "date"]).withColumn("rho", r6("rho"))


@query("K4_neff_full", f"WITH {PANEL}, {DAILY}, j AS (SELECT lat_id, date, y, sii_mean AS x FROM panel JOIN daily USING (date) WHERE sii_mean IS NOT NULL), r AS (SELECT lat_id, {avg_rank_sql('x', 'lat_id')} AS x, {avg_rank_sql('y', 'lat_id')} AS y, row_number() OVER (PARTITION BY lat_id ORDER BY date) AS i, count(*) OVER (PARTITION BY lat_id) AS n FROM j), k AS (SELECT unnest(range(1, 61)) AS k), p AS (SELECT a.lat_id, k, a.n, greatest(least({corr_sql('a.x', 'b.x')}, 0.99), -0.99) * greatest(least({corr_sql('a.y', 'b.y')}, 0.99), -0.99) AS p FROM r a, k, r b WHERE b.lat_id = a.lat_id AND b.i = a.i - k AND k <= greatest(a.n - 2, 1) GROUP BY a.lat_id, k, a.n) SELECT lat_id, n, round(greatest(2, n / greatest(1 + 2 * sum(p), 0.001)), 4) AS n_eff, round(greatest(2, n / greatest(1 + 2 * sum(p), 0.001)) / n, 6) AS neff_factor FROM p GROUP BY lat_id, n")
def _(spark, d):
    joined = panel(spark, d).join(J.broadcast_daily(daily(spark, d).select("date", c("sii_mean").alias("x"))), "date").where("x is not null")
    ranked = K.average_ranks(joined, ["x", "y"], ["lat_id"]).select("lat_id", "date", c("x_rank").alias("x"), c("y_rank").alias("y"))
    return K.neff_full(ranked, "x", "y", ["lat_id"], ["date"]).select("lat_id", "n", F.round("n_eff", 4).alias("n_eff"), r6("neff_factor").alias("neff_factor"))


def strata_rows(spark, d):
    return J.by_scenario(binned_panel(spark, d))


def profile_rows(spark, d):
    families = {"SII": [n for n in NAMES if n.startswith("sii")], "F10.7": [n for n in NAMES if n.startswith("f10")]}
    return SC.daily_profiles(strata_rows(spark, d), features(spark, d), families, "y", ["scenario", "bin_id"])


@query("K5_neff_lag1", f"WITH {_profile} SELECT {_keys}, n, round(greatest(2, n * (1 - pr) / (1 + pr)), 4) AS n_eff FROM pro")
def _(spark, d):
    return profile_rows(spark, d).select("scenario", "bin_id", "feature", "n", F.round("n_eff", 4).alias("n_eff"))


@query("K6_neff_residual", f"WITH {_kind}, l AS (SELECT bin_id, y, lag(y) OVER (PARTITION BY bin_id ORDER BY lat_id, lon_id, date) AS ly FROM pb), r AS (SELECT bin_id, count(*) AS n, coalesce(covar_pop(CASE WHEN ly IS NOT NULL THEN y END, ly) / nullif(sqrt(var_pop(CASE WHEN ly IS NOT NULL THEN y END) * var_pop(ly)), 0), 0.5) AS r FROM l GROUP BY 1) SELECT bin_id, n, round(CASE WHEN n > 10 THEN n * (1 - r) / (1 + r) ELSE n END, 4) AS n_eff FROM r")
def _(spark, d):
    return K.neff_residual(binned_panel(spark, d), "y", ["bin_id"], ["lat_id", "lon_id", "date"]).select("bin_id", "n", F.round("n_eff", 4).alias("n_eff"))


@query("K7_spearman_with_neff", f"WITH {_profile} SELECT {_keys}, n, round(rho, 6) AS rho, round(greatest(2, n * (1 - pr) / (1 + pr)), 4) AS n_eff, round(CASE WHEN abs(rho) < 1 THEN atanh(rho) END, 6) AS z FROM pro")
def _(spark, d):
    return profile_rows(spark, d).select("scenario", "bin_id", "feature", "n", r6("rho").alias("rho"), F.round("n_eff", 4).alias("n_eff"), r6("z").alias("z"))


@query("K7_p_values")
def _(spark, d):
    return profile_rows(spark, d).select("scenario", "bin_id", "feature", r6("p_adj").alias("p_adj"))


_b1, _b2 = "(r1 - r12 * r2) / (1 - r12 * r12)", "(r2 - r12 * r1) / (1 - r12 * r12)"
_se = f"sqrt(greatest(1e-12, 1 - (({_b1}) * r1 + ({_b2}) * r2)) / greatest(1, n - 3) / (1 - r12 * r12))"


@query("K8_pair_regression", f"WITH {_kind}, r AS (SELECT bin_id, count(*) AS n, {corr_sql('par', 'vpd')} AS r12, {corr_sql('par', 'y')} AS r1, {corr_sql('vpd', 'y')} AS r2 FROM pb GROUP BY 1 HAVING count(*) > 20) SELECT bin_id, n, round({_b1}, 6) AS beta1, round({_b2}, 6) AS beta2, round(({_b1}) / {_se}, 5) AS t1, round(({_b2}) / {_se}, 5) AS t2 FROM r")
def _(spark, d):
    out = K.pair_regression(binned_panel(spark, d), "y", "par", "vpd", ["bin_id"], F.count(F.lit(1)).cast("double")).where("n > 20")
    return out.select("bin_id", "n", r6("beta1").alias("beta1"), r6("beta2").alias("beta2"), F.round("t1", 5).alias("t1"), F.round("t2", 5).alias("t2"))


@query("K9_winner", f"WITH {_kind}, r AS (SELECT lat_id, count(*) AS n, {corr_sql('par', 'vpd')} AS r12, {corr_sql('par', 'y')} AS r1, {corr_sql('vpd', 'y')} AS r2 FROM pb GROUP BY 1 HAVING count(*) > 20) SELECT lat_id, CASE WHEN abs(({_b1}) / {_se}) > abs(({_b2}) / {_se}) THEN 'SII' ELSE 'F10.7' END AS winner FROM r")
def _(spark, d):
    return K.pair_regression(binned_panel(spark, d), "y", "par", "vpd", ["lat_id"], F.count(F.lit(1)).cast("double")).where("n > 20").select("lat_id", "winner")


def pair_rows(spark, d):
    modes = [("MA", w, f"ma{w}") for w in C.MA_WINDOWS] + [("LAG", k, f"lag{k}") for k in C.LAGS]
    twins = {(m, w): (f"sii_mean_{x}", f"f10_7_mean_{x}") for m, w, x in modes}
    return SC.daily_pairs(strata_rows(spark, d), features(spark, d), twins, "y", ["scenario", "bin_id"])


@query("K10_marker_profiles", f"WITH {_profile} SELECT scenario, bin_id, CASE WHEN feature LIKE 'sii%' THEN 'SII' ELSE 'F10.7' END AS family, feature, CASE WHEN feature LIKE '%_ma%' THEN 'MA' ELSE 'LAG' END AS mode, CAST(regexp_extract(feature, '_(ma|lag)([0-9]+)$', 2) AS INTEGER) AS window_value, n, round(rho, 6) AS rho FROM pro")
def _(spark, d):
    return profile_rows(spark, d).select("scenario", "bin_id", "family", "feature", "mode", "window_value", "n", r6("rho").alias("rho"))


@query("K10_marker_pairs")
def _(spark, d):
    out = pair_rows(spark, d)
    return out.select("scenario", "bin_id", "mode", "window_value", "n", *[F.round(x, 5).alias(x) for x in ("n_eff_used", "beta1", "beta2", "t1", "t2")], "winner")


def env_panel(spark, d, windows=WINDOWS, lags=()):
    """The binned panel with trailing means of its metrics by cell and of the driver.

    The panel's metrics are whole numbers, so their sums are exact in any order and equal means tie.
    """
    out = panel(spark, d)
    for m in ("par", "vpd"):
        out = W.many_trailing(out, m, windows, ["lat_id", "lon_id"])
    return SC.binned(out, "temp").join(J.broadcast_daily(features(spark, d, windows, lags)), "date")


def models(spark, d):
    """Grid search by scenario and bin: a model for every triple of windows."""
    strata = J.by_scenario(env_panel(spark, d)).withColumn("target", F.lit("y"))
    families = {"sii": {w: f"sii_mean_ma{w}" for w in WINDOWS}, "par": {w: f"par_ma{w}" for w in WINDOWS}, "vpd": {w: f"vpd_ma{w}" for w in WINDOWS}}
    by = ["target", "scenario", "bin_label"]
    n_eff = K.neff_residual(strata, "y", by, ["lat_id", "lon_id", "date"]).where("n >= 50")
    return M.grid_search(strata, "y", families, by, n_eff).where("n_eff is not null")


_env_ma = ", ".join(f"avg({m}) OVER (PARTITION BY lat_id, lon_id ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS {m}_ma{w}" for m in ("par", "vpd") for w in C.MA_WINDOWS)
_grid_values = ", ".join(["{'f': 'y', 'w': 0, 'v': y}"] + [f"{{'f': '{f}', 'w': {w}, 'v': {c_}_ma{w}}}" for f, c_ in (("a", "sii_mean"), ("b", "par"), ("e", "vpd")) for w in WINDOWS])
_grid_pairs = {"aa": "a a", "bb": "b b", "ee": "e e", "ab": "a b", "ae": "a e", "be": "b e", "ay": "a y", "bq": "b y", "ey": "e y"}
_grid_window = {"a": "aa.w1", "b": "bb.w1", "e": "ee.w1", "y": "0"}
_grid = (
    f"{PANEL}, {_features}, {SCENARIO_ROWS}, ev AS (SELECT *, {BIN_LABEL} AS bin_label, {_env_ma} FROM panel), es AS (SELECT scenario, ev.*, feat.* EXCLUDE (date) FROM ev JOIN scen ON region_flags & required = required JOIN feat ON feat.date = ev.date), "
    "el AS (SELECT scenario, bin_label, y, lag(y) OVER (PARTITION BY scenario, bin_label ORDER BY lat_id, lon_id, date) AS ly FROM es), er AS (SELECT scenario, bin_label, count(*) AS n, coalesce(covar_pop(CASE WHEN ly IS NOT NULL THEN y END, ly) / nullif(sqrt(var_pop(CASE WHEN ly IS NOT NULL THEN y END) * var_pop(ly)), 0), 0.5) AS r FROM el GROUP BY ALL), "
    "ne AS (SELECT scenario, bin_label, CASE WHEN n > 10 THEN n * (1 - r) / (1 + r) ELSE n END AS n_eff FROM er WHERE n >= 50), "
    "gs AS (SELECT row_number() OVER () AS rid, * FROM es WHERE " + " AND ".join(f"sii_mean_ma{w} IS NOT NULL" for w in WINDOWS) + f"), gu AS (SELECT rid, scenario, bin_label, unnest([{_grid_values}]) AS u FROM gs), gl AS MATERIALIZED (SELECT rid, scenario, bin_label, u.f AS f, u.w AS w, u.v AS v FROM gu), "
    "cv AS MATERIALIZED (SELECT p.scenario, p.bin_label, p.f || q.f AS ff, p.w AS w1, q.w AS w2, covar_pop(p.v, q.v) * count(*) AS c, count(*) AS n FROM gl p JOIN gl q USING (rid) WHERE p.f < q.f OR (p.f = q.f AND p.w = q.w) GROUP BY ALL HAVING count(*) >= 60), "
    "gk AS (SELECT scenario, bin_label, aa.w1 AS sw, bb.w1 AS pw, ee.w1 AS vw, aa.n, " + ", ".join(f"{k}.c AS {k}" for k in [*_grid_pairs, "yy"]) + " FROM (SELECT * FROM cv WHERE ff = 'aa') aa "
    + " ".join(f"JOIN (SELECT * FROM cv WHERE ff = '{k}') {k} USING (scenario, bin_label)" if k in ("bb", "ee", "yy") else f"JOIN (SELECT * FROM cv WHERE ff = '{_grid_pairs[k].replace(' ', '')}') {k} ON {k}.scenario = aa.scenario AND {k}.bin_label = aa.bin_label AND {k}.w1 = {_grid_window[_grid_pairs[k][0]]} AND {k}.w2 = {_grid_window[_grid_pairs[k][-1]]}" for k in ("bb", "ee", "yy", "ab", "ae", "be", "ay", "bq", "ey"))
    + "), gi AS (SELECT *, bb * ee - be * be AS i11, ae * be - ab * ee AS i12, ab * be - ae * bb AS i13, aa * ee - ae * ae AS i22, ab * ae - aa * be AS i23, aa * bb - ab * ab AS i33 FROM gk), gd AS (SELECT *, aa * i11 + ab * i12 + ae * i13 AS det FROM gi), "
    "gb AS (SELECT *, (i11 * ay + i12 * bq + i13 * ey) / det AS b1, (i12 * ay + i22 * bq + i23 * ey) / det AS b2, (i13 * ay + i23 * bq + i33 * ey) / det AS b3 FROM gd), gr AS (SELECT *, greatest(yy - b1 * ay - b2 * bq - b3 * ey, 0) AS rss FROM gb JOIN ne USING (scenario, bin_label))"
)


@query("K11_grid_search", f"WITH {_grid} SELECT scenario, bin_label, sw AS sii_window, pw AS par_window, vw AS vpd_window, n, round(b1, 5) AS beta_sii FROM gr")
def _(spark, d):
    return models(spark, d).where("n >= 60").select("scenario", "bin_label", "sii_window", "par_window", "vpd_window", "n", F.round("beta_sii", 5).alias("beta_sii"))


_t = lambda b, i: f"round({b} / sqrt({i} / det * rss / greatest(1, n - 4)), 3)"


@query("K11_grid_statistics", f"WITH {_grid} SELECT scenario, bin_label, sw AS sii_window, pw AS par_window, vw AS vpd_window, round(rss, 0) AS rss, round(n_eff, 3) AS n_eff, {_t('b1', 'i11')} AS t_sii, {_t('b2', 'i22')} AS t_par, {_t('b3', 'i33')} AS t_vpd FROM gr")
def _(spark, d):
    out = models(spark, d).where("n >= 60")
    return out.select("scenario", "bin_label", "sii_window", "par_window", "vpd_window", F.round("rss", 0).alias("rss"), *[F.round(x, 3).alias(x) for x in ("n_eff", "t_sii", "t_par", "t_vpd")])


@query("K11_p_values")
def _(spark, d):
    return models(spark, d).select("scenario", "bin_label", "sii_window", "par_window", "vpd_window", *[F.round(x, 5).alias(x) for x in ("p_sii", "p_par", "p_vpd")])


@query("A16_meta_table")
def _(spark, d):
    return SC.meta_table(spark, models(spark, d), ["y"], C.BIN_LABELS, [s for s, _, _ in C.SCENARIOS]).select("metric", "bin", "mask", "mode", "sii_step", "par_step", "vpd_step", F.round("t_sii", 5).alias("t_sii"))


TESTED = ("target", "scenario", "bin_label")


def spectra(spark, d, draws=C.SURROGATES, windows=C.MA_WINDOWS):
    """Spectra of two targets by scenario and bin; strata with too few rows have none."""
    strata = J.by_scenario(binned_panel(spark, d)).where(c("scenario").isin(*C.SURROGATE_SCENARIOS) & c("bin_label").isNotNull())
    targets = F.array(*[F.struct(F.lit(t).alias("target"), c(t).cast("double").alias("residual")) for t in ("y", "par")])
    residuals = strata.select("date", "scenario", "bin_label", F.inline(targets))
    return M.surrogate_spectra(spark, residuals, daily(spark, d).select("date", "sii_mean"), "sii_mean", windows, draws, by=TESTED, least=C.SURROGATE_LEAST)


_tested = "target, scenario, bin_label"
_sur = f"{_kind}, {DAILY}, {SCENARIO_ROWS}, st AS (SELECT * FROM pb JOIN scen ON region_flags & required = required WHERE scenario IN {C.SURROGATE_SCENARIOS}), res AS (SELECT 'y' AS target, scenario, bin_label, date, y FROM st UNION ALL SELECT 'par', scenario, bin_label, date, par FROM st), days AS (SELECT {_tested}, date, sii_mean AS x, row_number() OVER (PARTITION BY {_tested} ORDER BY date) AS i FROM (SELECT DISTINCT {_tested}, date FROM res WHERE y IS NOT NULL) JOIN daily USING (date) WHERE sii_mean IS NOT NULL)"
_left = max(C.MA_WINDOWS)


@query("K12_surrogates")
def _(spark, d):
    return spectra(spark, d).withColumn("rho", r6("rho"))


@query(
    "J11_observed_spectrum",
    f"WITH {_sur}, ma AS (SELECT {_tested}, date, i, unnest([" + ", ".join(f"{{'win': {w}, 'm': avg(x) OVER (PARTITION BY {_tested} ORDER BY i ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)}}" for w in C.MA_WINDOWS) + f"]) AS u FROM days), u AS (SELECT {_tested}, u.win AS win, round(u.m, 9) AS m, y FROM ma JOIN res USING ({_tested}, date) WHERE i > {_left} AND y IS NOT NULL), "
    f"k AS (SELECT {_tested}, win, " + avg_rank_sql("m", f"{_tested}, win") + " AS a, " + avg_rank_sql("y", f"{_tested}, win") + f" AS b FROM u) SELECT {_tested}, CAST(win AS INTEGER) AS \"window\", round(" + corr_sql("a", "b") + f", 6) AS rho FROM k GROUP BY {_tested}, win HAVING count(*) >= {C.SURROGATE_LEAST}",
)
def _(spark, d):
    return spectra(spark, d, 0).select(*TESTED, "window", r6("rho").alias("rho"))


@query("A22_surrogate_tests")
def _(spark, d):
    metrics = A.band_metrics(spectra(spark, d), [*TESTED, "kind", "surrogate_id"], C.BAND_LOW, C.BAND_HIGH)
    # The largest |rho| is never negative, so that its one-sided test is the two-sided one.
    values = metrics.select(*TESTED, "kind", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), c(m).alias("value")) for m in ("signed_auc", "max_abs_rho", "mean_rho")])))
    out = M.surrogate_summary(values, "value", True, (*TESTED, "measure")).drop("metric").withColumnRenamed("measure", "metric")
    return out.withColumns({x: r6(x) for x in out.columns if x not in (*TESTED, "metric", "n_surrogates")})


@query("K13_spearman_average", f"WITH {PANEL}, r AS (SELECT lat_id, {avg_rank_sql('par', 'lat_id')} AS a, {avg_rank_sql('y', 'lat_id')} AS b FROM panel) SELECT lat_id, count(*) AS n, round({corr_sql('a', 'b')}, 6) AS rho FROM r GROUP BY 1")
def _(spark, d):
    return K.spearman(panel(spark, d), "par", "y", ["lat_id"]).select("lat_id", "n", r6("rho").alias("rho"))


_mk = "scenario, bin_id, parameter_1, win"
_mech = f"{PANEL}, {_features}, {SCENARIO_ROWS}, ev AS (SELECT *, {BIN_ID} AS bin_id, {_env_ma} FROM panel), ml AS (" + " UNION ALL ".join(f"SELECT scenario, bin_id, '{m}_ma{w}' AS parameter_1, {w} AS win, ev.date, lat_id, lon_id, sii_mean_ma{w} AS x, {m}_ma{w} AS y FROM ev JOIN scen ON region_flags & required = required JOIN feat ON feat.date = ev.date WHERE sii_mean_ma{w} IS NOT NULL" for m in ("par", "vpd") for w in C.MA_WINDOWS) + f"), mr AS (SELECT {_mk}, x, y, {avg_rank_sql('x', _mk)} AS rx, {avg_rank_sql('y', _mk)} AS ry, lag(x) OVER o AS lx, lag(y) OVER o AS ly FROM ml WINDOW o AS (PARTITION BY {_mk} ORDER BY date, lat_id, lon_id)), ms AS (SELECT {_mk}, count(*) AS n, {corr_sql('rx', 'ry')} AS rho, {_product} AS pr FROM mr GROUP BY ALL HAVING count(*) >= 100), mz AS (SELECT *, greatest(2, n * (1 - pr) / (1 + pr)) AS e, atanh(greatest(least(rho, 0.99), -0.99)) AS z FROM ms)"


@query("K14_mechanism", f'WITH {_mech} SELECT scenario, parameter_1, CAST(win AS INTEGER) AS "window", round(tanh(sum(z * greatest(e - 3, 1)) / sum(greatest(e - 3, 1))), 6) AS spearman_r, round(sum(e), 3) AS n_eff_total FROM mz GROUP BY scenario, parameter_1, win')
def _(spark, d):
    out = SC.mechanism(env_panel(spark, d, C.MA_WINDOWS), C.MA_WINDOWS, "sii_mean", ["par", "vpd"])
    return out.select("scenario", "parameter_1", "window", r6("spearman_r").alias("spearman_r"), F.round("n_eff_total", 3).alias("n_eff_total"))


@query("A15_fisher_meta", f"WITH {RESULTS}, k AS (SELECT scenario, omni_var, atanh(greatest(least(rho, 0.99), -0.99)) AS z, greatest(n_eff - 3, 1) AS w, n_eff FROM results) SELECT scenario, omni_var, round(tanh(sum(z * w) / sum(w)), 6) AS spearman_r, round(sum(n_eff), 6) AS n_eff_total FROM k GROUP BY ALL")
def _(spark, d):
    return K.fisher_meta(results(spark, d), ["scenario", "omni_var"]).select("scenario", "omni_var", r6("spearman_r").alias("spearman_r"), r6("n_eff_total").alias("n_eff_total"))


@query("K15_global_screening", f"WITH {PANEL}, {DAILY}, m AS (SELECT date, round(avg(y), 7) AS y, round(avg(par), 7) AS par FROM panel GROUP BY 1), j AS (SELECT date, y, par, sii_mean AS x FROM m JOIN daily USING (date)), l AS (SELECT 'y' AS target, y, x FROM j UNION ALL SELECT 'par', par, x FROM j), r AS (SELECT target, {avg_rank_sql('x', 'target')} AS a, {avg_rank_sql('y', 'target')} AS b FROM l) SELECT target, round({corr_sql('a', 'b')}, 6) AS spearman_r, count(*) AS n FROM r GROUP BY 1")
def _(spark, d):
    return SC.global_screening(A.cell_means(panel(spark, d), ["date"], ["y", "par"]).withColumns({x: F.round(x, 7) for x in ("y", "par")}), daily(spark, d), ["y", "par"], "sii_mean").select("target", r6("spearman_r").alias("spearman_r"), "n")


@query("ST_daily_stream", "SELECT CAST(ts AS DATE) AS date, event_type, round(avg(value), 6) AS mean, round(max(value), 6) AS largest, count(value) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    """The streaming daily means, run over the table until it is drained; final days and open ones."""
    from gridloom.plans.registry import scratch
    from gridloom.streaming.daily import daily_stats

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    path = scratch(spark, "stream")
    days = daily_stats(stream.withColumn("ts", c("ts").cast("timestamp")), "ts", "value", "event_type")

    def keep(batch, i):
        batch.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{path}/days")

    run = days.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.parquet(f"{path}/days")
    last = out.groupBy("date", "event_type").agg(F.max("batch").alias("batch"))
    return out.join(last, ["date", "event_type", "batch"]).select("date", "event_type", r6("mean").alias("mean"), r6("largest").alias("largest"), "n")


@query("ST_carried_tail", "WITH o AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS key, round(avg(o_totalprice), 6) AS value FROM orders GROUP BY 1, 2) SELECT key, date, value, round(avg(value) OVER (PARTITION BY key ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 3) AS ma FROM o")
def _(spark, d):
    """Trailing means over micro-batches of a year each, with the tail of a key's days carried from batch to batch."""
    from gridloom.plans.registry import scratch
    from gridloom.streaming.daily import trailing_mean

    path = scratch(spark, "tails")
    schema = "key string, date date, value double"
    days = spark.read.parquet(f"{d}/orders.parquet").groupBy(c("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("date")).agg(r6(F.avg("o_totalprice")).alias("value"))
    days.withColumn("year", F.year("date")).repartition("year").write.partitionBy("year").parquet(f"{path}/days")
    years = sorted(r.year for r in spark.read.parquet(f"{path}/days").select("year").distinct().collect())  # a few
    for year in years:  # one year arrives after the other
        spark.read.schema(schema).parquet(f"{path}/days/year={year}").coalesce(1).write.mode("append").parquet(f"{path}/arrived")
        stream = trailing_mean(spark.readStream.schema(schema).parquet(f"{path}/arrived"), "key", 7)
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/means").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    if not years:
        return spark.createDataFrame([], f"{schema}, ma double")
    return spark.read.parquet(f"{path}/means").withColumn("ma", F.round("ma", 3))
