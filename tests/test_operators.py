"""Operators against independent NumPy and pandas statements, and properties that hold for any input."""

import datetime as dt
import io
import math
import zipfile
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom import config as C
from gridloom.functions import distributions as D
from gridloom.functions import scalars as S
from gridloom.operators import aggregates as A
from gridloom.operators import correlation as K
from gridloom.operators import joins as J
from gridloom.operators import models as M
from gridloom.operators import quality as Q
from gridloom.operators import screening as SC
from gridloom.operators import windows as W
from gridloom.sources import netcdf, readers, writers
from gridloom.streaming import daily as ST


def days(n, start=dt.date(2001, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


# --- distributions -------------------------------------------------------------------------------


def test_t_of_one_and_two_degrees_has_closed_forms():
    t = np.array([0.0, 0.3, 1.0, 2.5, 40.0])
    assert np.allclose(D.t_two_sided(t, 1.0), 1 - 2 * np.arctan(t) / np.pi, rtol=1e-12)
    assert np.allclose(D.t_two_sided(t, 2.0), 1 - t / np.sqrt(2 + t * t), rtol=1e-9, atol=1e-14)
    assert np.allclose(D.t_two_sided(t, 4.0), 1 - t / np.sqrt(4 + t * t) * (1 + 2 / (4 + t * t)), rtol=1e-9, atol=1e-14)


@settings(max_examples=60, deadline=None)
@given(st.floats(0, 50), st.floats(0.5, 5000))
def test_t_is_a_probability_and_falls_with_t(t, df):
    p, q = D.t_two_sided(np.array([t, t + 0.5]), np.array([df, df]))
    assert 0 <= q <= p <= 1


def test_large_degrees_approach_the_normal():
    assert np.allclose(D.t_two_sided(np.array([1.0, 1.959964]), 1e7), [math.erfc(1 / math.sqrt(2)), 0.05], atol=1e-6)


@settings(max_examples=60, deadline=None)
@given(st.floats(1e-12, 1 - 1e-12))
def test_normal_quantile_inverts(p):
    assert abs(0.5 * math.erfc(-D.normal_quantile(np.array([p]))[0] / math.sqrt(2)) - p) < 1e-12 + 1e-9 * p


def test_three_conventions_of_p(spark):
    rows = spark.createDataFrame([(1.0, 50.0), (0.3, 2.0), (0.3, 50.0), (None, 9.0)], "r double, n double")
    got = rows.select(*[f(F.col("r"), F.col("n")) for f in (D.p_spatial, D.p_screening, D.p_mechanism)]).collect()
    assert tuple(got[0]) == (0.0, 0.0, 0.0) and got[1][0] is None and got[1][1] == 1.0 and got[1][2] == 1.0
    assert len({round(x, 12) for x in got[2]}) == 1 and got[3][0] is None and got[3][1] is None


# --- scalars -------------------------------------------------------------------------------------


def test_missing_and_half_values(spark):
    rows = spark.createDataFrame([(0.25, float("nan")), (0.75, None), (1.25, float("inf"))], "x double, y double")
    got = S.nan_to_null(rows).select(S.grid_snap(F.col("x")), "y", S.bin_id(F.col("y")), S.lai_flags(F.col("y")), S.vapour_deficit(F.col("x"), F.col("y"))).collect()
    assert [r[0] for r in got] == [0.0, 1.0, 1.0] and all(r[1] is None and r[2] is None and r[3] == 0 and r[4] is None for r in got)


def test_bins_close_on_the_right(spark):
    got = spark.createDataFrame([(x,) for x in (7.0, 7.01, 15.0, 25.0, 30.0, 30.5)], "t double").select(S.bin_label(F.col("t"))).collect()
    assert [r[0] for r in got] == ["Cold", "Cool", "Cool", "Optimum", "Warm_Stress", "Extreme_Heat"]


def test_period_starts_and_impossible_times(spark):
    rows = spark.createDataFrame([(dt.date(2004, 12, 31),), (dt.date(2005, 12, 31),), (dt.date(2005, 1, 9),)], "d date")
    assert [r[0].timetuple().tm_yday for r in rows.select(S.period_start(F.col("d"))).collect()] == [361, 361, 9]
    times = spark.createDataFrame([(2003, 366, 1), (2004, 366, 1), (2003, 1, 24)], "y int, d int, h int").select(S.timestamp_of(F.col("y"), F.col("d"), F.col("h"))).collect()
    assert times[0][0] is None and times[1][0] == dt.datetime(2004, 12, 31, 1) and times[2][0] is None


@settings(max_examples=10, deadline=None)
@given(st.integers(0, 63), st.integers(0, 63))
def test_more_bits_meet_no_fewer_scenarios(spark, a, b):
    rows = spark.createDataFrame([(a,), (a | b,)], "f int")
    met = [[r[i] for i in range(4)] for r in rows.select(*[S.in_scenario(F.col("f"), n) for n, _, _ in C.SCENARIOS]).collect()]
    assert all(y or not x for x, y in zip(*met))
    with pytest.raises(KeyError):
        S.in_scenario(F.col("f"), "Atlantis")


def test_million_fix_of_epochs(spark):
    row = spark.createDataFrame([(1_500_000,)], "x long").select(S.epoch_guess(F.col("x"), F.lit(1_600_000))).first()
    assert row[0].timestamp() == 1_500_000_000


# --- windows -------------------------------------------------------------------------------------


def test_means_equal_pandas(spark):
    rng = np.random.default_rng(0)
    x = pd.Series(rng.normal(size=120)).mask(rng.random(120) < 0.2)
    rows = spark.createDataFrame([(d, "a", None if math.isnan(v) else float(v)) for d, v in zip(days(120), x)], "date date, cell string, x double")
    got = W.many_trailing(rows, "x", (1, 7, 30), ["cell"], prior=True).withColumns({"p": W.ma_prior("x", 7, ["cell"]), "s": W.ma_strict("x", 7, ["cell"])}).orderBy("date").toPandas()
    for w in (1, 7, 30):
        assert np.allclose(got[f"x_ma{w}"].to_numpy(float), x.shift(1).rolling(w, min_periods=1).mean(), equal_nan=True)
    assert np.allclose(got["p"].to_numpy(float), x.shift(1).rolling(7, min_periods=1).mean(), equal_nan=True)
    assert np.allclose(got["s"].to_numpy(float), x.shift(1).rolling(7).mean(), equal_nan=True)


def test_ranks_sum_up(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(int(v), i) for i, v in enumerate(rng.integers(0, 9, 80))], "x int, i int").withColumn("g", F.lit(1))
    for rank in (W.average_rank("x", ["g"]), W.ordinal_rank("x", ["g"], ["i"])):
        assert rows.select(rank.alias("r")).agg(F.sum("r")).first()[0] == 80 * 81 / 2


def test_q_values_rise_with_p_and_are_no_smaller(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(None if v > 0.95 else float(v),) for v in rng.random(60)], "p double").withColumn("g", F.lit(1))
    got = W.bh_fdr(rows, "p", ["g"]).orderBy("p").collect()
    known = [(r.p, r.p_fdr) for r in got if r.p is not None]
    assert all(q >= p for p, q in known) and [q for _, q in known] == sorted(q for _, q in known)
    assert all(r.p_fdr is None for r in got if r.p is None)


# --- joins and aggregates ------------------------------------------------------------------------


def test_dilation_never_overrides_a_cell_that_is_there(spark):
    grid = spark.createDataFrame([(0, 0, 1.0), (50, 0, 2.0), (200, 200, 3.0)], "lat_id int, lon_id int, v double")
    got = {(r.lat_id, r.lon_id): r.v for r in J.dilated(grid, ["lat_id", "lon_id"]).collect()}
    assert got[0, 0] == 1.0 and got[50, 0] == 2.0 and got[200, 200] == 3.0 and len(got) == 12 + 9
    assert got[0, 50] == 2.0 or got[0, 50] == 1.0


def test_regrid_needs_all_corners(spark):
    nodes = [(float(i), float(j), float(10 * i + j)) for i in range(-3, 4) for j in range(-3, 4) if (i, j) != (1, 1)]
    got = {(r.latitude, r.longitude): r.v for r in J.regridded(spark.createDataFrame(nodes, "latitude double, longitude double, v double"), "v", [], resolution=1.5, source_step=1.0).collect()}
    assert got[0.0, 0.0] == 0.0 and got[-1.5, -1.5] == pytest.approx(-16.5) and got[1.5, 1.5] is None


def test_moments_equal_pandas(spark):
    x = pd.Series(np.random.default_rng(3).gamma(2, size=200))
    row = A.moments(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").first()
    assert row.skewness == pytest.approx(x.skew()) and row.kurtosis == pytest.approx(x.kurt()) and row.std == pytest.approx(x.std())
    flat = A.moments(spark.createDataFrame([(1.0,)] * 5, "x double"), "x").first()
    assert flat.skewness is None and flat.kurtosis is None


def test_histogram_holds_every_value(spark):
    rows = spark.createDataFrame([(float(v),) for v in [*range(100), 99]], "x double")
    got = A.histogram(rows, "x", 10).orderBy("bin").collect()
    assert [r.n for r in got] == [int(v) for v in np.histogram([*range(100), 99], 10)[0]]
    assert sum(r.n for r in A.histogram(rows, "x").collect()) == 101


# --- correlation ---------------------------------------------------------------------------------


def test_full_neff_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x, y = np.cumsum(rng.normal(size=90)), np.cumsum(rng.normal(size=90))
    rows = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "g int, i int, x double, y double")
    got = K.neff_full(rows, "x", "y", ["g"], ["i"], most=20).first()
    total = sum(np.clip(np.corrcoef(x[:-k], x[k:])[0, 1], -0.99, 0.99) * np.clip(np.corrcoef(y[:-k], y[k:])[0, 1], -0.99, 0.99) for k in range(1, 21))
    assert got.n_eff == pytest.approx(max(2.0, 90 / max(1 + 2 * total, 1e-3)))


def test_no_variance_gives_null(spark):
    rows = spark.createDataFrame([(1, 1.0, float(i)) for i in range(9)], "g int, x double, y double")
    assert K.spearman(rows, "x", "y", ["g"]).first().rho is None
    pair = K.pair_solution(spark.createDataFrame([(1.0, 0.4, 0.4, 50.0)], "r12 double, r1 double, r2 double, n_eff_used double")).first()
    assert pair.t1 is None and pair.winner is None


def test_two_predictors_equal_least_squares(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=60), rng.normal(size=60)
    y = 0.5 * a - 0.2 * b + rng.normal(size=60)
    rows = spark.createDataFrame([(1, *map(float, r)) for r in zip(y, a, b)], "g int, y double, a double, b double")
    got = K.pair_regression(rows, "y", "a", "b", ["g"], F.count(F.lit(1)).cast("double")).first()
    z = lambda v: (v - v.mean()) / v.std()
    beta = np.linalg.lstsq(np.c_[z(a), z(b)], z(y), rcond=None)[0]
    assert (got.beta1, got.beta2) == (pytest.approx(beta[0]), pytest.approx(beta[1]))


# --- models --------------------------------------------------------------------------------------


def test_harmonic_fit_equals_least_squares(spark):
    rng = np.random.default_rng(6)
    rows = [(c, d, float(3 + c + math.cos(i / 58) + rng.normal())) for c in (1, 2) for i, d in enumerate(days(500)) if rng.random() < 0.5] + [(3, d, 1.0) for d in days(20)]
    parameters, residuals = M.harmonic_fit(spark.createDataFrame(rows, "cell int, date date, y double"), "y", ["cell"])
    got = {r.cell: r for r in parameters.collect()}
    assert set(got) == {1, 2}
    for cell in (1, 2):
        own = [(d, y) for c, d, y in rows if c == cell]
        first, span = own[0][0], (own[-1][0] - own[0][0]).days
        frac = np.array([d.year + (d.timetuple().tm_yday - 1) / (366 if d.year % 4 == 0 else 365) for d, _ in own])
        x = np.c_[np.ones(len(own)), [(d - first).days / span for d, _ in own], np.cos(2 * np.pi * frac), np.sin(2 * np.pi * frac)]
        y = np.array([v for _, v in own])
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        e = y - x @ beta
        r = got[cell]
        assert np.allclose([r.alpha0, r.alpha_t, r.beta_cos, r.beta_sin, r.sigma, r.r_squared], [*beta, e.std(), 1 - (e @ e) / ((y - y.mean()) @ (y - y.mean()))], atol=1e-6)
        dense = residuals.where(F.col("cell") == cell).orderBy("date").collect()
        assert len(dense) == span + 1 and np.allclose([q.residual for q in dense if q.residual is not None], e, atol=1e-6)


def test_grid_search_equals_least_squares(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 6)) + 50
    y = x @ rng.normal(size=6) + rng.normal(size=80)
    names = ["a1", "a2", "b1", "b2", "c1", "c2"]
    rows = spark.createDataFrame([("g", *map(float, r), float(v)) for r, v in zip(x, y)] + [("g", None, *[1.0] * 6)], "k string, " + ", ".join(f"{n} double" for n in names) + ", y double")
    n_eff = spark.createDataFrame([("g", 60.0)], "k string, n_eff double")
    got = M.grid_search(rows, "y", {f: {1: f"{f}1", 2: f"{f}2"} for f in "abc"}, ["k"], n_eff).collect()
    assert len(got) == 8 and all(r.n == 80 for r in got)
    for r in got:
        design = np.c_[x[:, [r.a_window - 1, r.b_window + 1, r.c_window + 3]], np.ones(80)]
        beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
        se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss[0] / 76)
        assert np.allclose([r.beta_a, r.beta_b, r.beta_c, r.rss], [*beta[:3], rss[0]], rtol=1e-6)
        assert np.allclose([r.t_a, r.t_b, r.t_c], (beta / se)[:3], rtol=1e-5)
        assert r.p_a == pytest.approx(float(D.t_two_sided(r.t_a, 56.0)))


def test_collinear_models_are_left_out(spark):
    rows = spark.createDataFrame([("g", float(i), float(i), float(i * i), float(i % 5)) for i in range(30)], "k string, a double, b double, c double, y double")
    n_eff = spark.createDataFrame([("g", 30.0)], "k string, n_eff double")
    assert M.grid_search(rows, "y", {n: {1: n} for n in "abc"}, ["k"], n_eff).count() == 0


def test_surrogates_keep_values_and_differ(spark):
    orders = M.year_orders([2001, 2002, 2003], 30)
    assert all(sorted(o) == [2001, 2002, 2003] and o != [2001, 2002, 2003] for o in orders)
    assert orders == M.year_orders([2001, 2002, 2003], 30)
    with pytest.raises(ValueError, match="three years"):
        M.year_orders([2001, 2002], 1)
    rng = np.random.default_rng(8)
    series = spark.createDataFrame([(d, float(v)) for d, v in zip(days(1095), rng.normal(size=1095))], "date date, x double")
    residuals = series.select("date", (F.col("x") * 0 + F.rand(1)).alias("residual"))
    got = M.surrogate_spectra(spark, residuals, series, "x", [3, 5], draws=4).toPandas()
    assert len(got) == 10 and got["rho"].between(-1, 1).all()
    own = pd.DataFrame(residuals.orderBy("date").collect(), columns=["date", "r"])
    own["m"] = pd.Series([r.x for r in series.orderBy("date").collect()]).shift(1).rolling(5).mean()
    cut = own.iloc[5:]
    want = cut["r"].rank().corr(cut["m"].rank())
    assert got[(got["kind"] == "observed") & (got["window"] == 5)]["rho"].iloc[0] == pytest.approx(want, abs=1e-9)


def test_average_ranks_of_weighted_days():
    x, n = np.array([3.0, 1.0, 3.0]), np.array([2.0, 1.0, 3.0])
    full = pd.Series(np.repeat(x, n.astype(int))).rank().to_numpy()
    assert np.allclose(np.repeat(M.average_ranks_weighted(x, n), n.astype(int)), full)


# --- sources, sinks, quality, streams ------------------------------------------------------------


def test_zip_member_and_records(spark, tmp_path):
    good = " ".join(["2001", "1", "5", *["0"] * 35, "23", "0", "-40", *["0"] * 9, "120.5"])
    lines = [good, good.replace("23", "99", 1).replace("-40", "99999"), "1899 " + good[5:], " ".join(good.split()[:50]), good.replace("2001 1 5", "2001 366 5"), good.replace("23", "x", 1)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("small.txt", "x")
        z.writestr("big.dat", ("\n".join(lines)).encode() + b"\n\xff")
    raw = readers.zipped_lines(spark, str(tmp_path / "a.zip"))
    assert raw.count() == 6
    got = readers.parse_records(raw).orderBy("dst").collect()
    assert [(r.kp, r.dst, r.sii, r.f10_7) for r in got] == [(None, None, None, 120.5), (23.0, -40.0, 40.0, 120.5)]


def test_grid_files(spark, tmp_path):
    t = np.array(["2001-01-01T00", "2001-01-01T01"], "datetime64[s]")
    v = np.arange(12, dtype=float).reshape(2, 2, 3)
    v[0, 0, 0] = np.nan
    for name, arrays in (("a.npz", {"time": t, "latitude": [0.0, 0.25], "longitude": [1.0, 2.0, 3.0], "t2m": v}), ("b.npz", {"time": t, "latitude": [0.0], "longitude": [1.0], "d2m": v})):
        buffer = io.BytesIO()
        np.savez(buffer, **arrays)
        (tmp_path / name).write_bytes(buffer.getvalue())
    got = readers.grid_files(spark, str(tmp_path), {"t2m": "temp"}, "*.npz").collect()
    assert len(got) == 12 and sum(r.temp is None for r in got) == 1
    assert {(r.time, r.latitude, r.longitude): r.temp for r in got}[dt.datetime(2001, 1, 1, 1), 0.25, 3.0] == 11.0


def test_netcdf_bytes_of_the_format_description():
    # One dimension of 5, one variable of short integers: 3 1 4 1 5.
    raw = b"CDF\1" + bytes(4) + bytes([0, 0, 0, 10, 0, 0, 0, 1, 0, 0, 0, 3]) + b"dim\0" + bytes([0, 0, 0, 5]) + bytes(8) + bytes([0, 0, 0, 11, 0, 0, 0, 1, 0, 0, 0, 2]) + b"vx\0\0"
    raw += bytes([0, 0, 0, 1, 0, 0, 0, 0]) + bytes(8) + bytes([0, 0, 0, 3, 0, 0, 0, 12, 0, 0, 0, 80]) + bytes([0, 3, 0, 1, 0, 4, 0, 1, 0, 5, 128, 1])
    found = netcdf.classic(raw)
    assert found["vx"].dimensions == ("dim",) and found["vx"].values.tolist() == [3, 1, 4, 1, 5]


@pytest.mark.parametrize("record", [None, "t"])
@pytest.mark.parametrize("extra", [False, True])
def test_netcdf_round_trip(record, extra):
    a = np.arange(15, dtype="i2").reshape(5, 3)
    variables = {"x": (("x",), np.array([1.5, 2.5, 3.5]), {}), "a": (("t", "x"), a, {"scale_factor": 0.5, "_FillValue": np.int16(7), "note": "odd é"})}
    if extra:
        variables |= {"b": (("t",), np.arange(5, dtype="i1"), {"valid_min": np.int8(1)}), "word": (("t", "x"), np.full((5, 3), b"q"), {})}
    found = netcdf.classic(netcdf.encoded({"t": 5, "x": 3}, variables, record))
    assert all((found[k].values == v).all() and found[k].dimensions == d for k, (d, v, _) in variables.items())
    assert found["a"].attributes["note"] == "odd é"
    want = a * 0.5
    want[2, 1] = np.nan
    np.testing.assert_array_equal(found["a"].numbers(), want)
    if extra:
        assert np.isnan(found["b"].numbers()[0]) and found["b"].numbers()[1:].tolist() == [1, 2, 3, 4]


def test_netcdf_times():
    at = lambda units, v, **more: netcdf.Variable(("t",), np.array(v), {"units": units, **more}).times().tolist()
    assert at("hours since 1900-01-01 00:00:00.0", [0, 1]) == [dt.datetime(1900, 1, 1), dt.datetime(1900, 1, 1, 1)]
    assert at("days since 2000-1-2", [0.5, np.nan]) == [dt.datetime(2000, 1, 2, 12), None]
    assert at("Seconds since 1970-01-01T00:00:00Z", [86400]) == [dt.datetime(1970, 1, 2)]
    assert netcdf.Variable(("t",), np.array([60])).times().tolist() == [dt.datetime(1970, 1, 1, 0, 1)]
    for units, more in (("months since 2000-01-01", {}), ("hours", {}), ("days since 2000-01-01", {"calendar": "360_day"})):
        with pytest.raises(ValueError, match="aren't known"):
            at(units, [1], **more)


def test_grid_files_of_netcdf(spark, tmp_path):
    t, lat, lon = (("valid_time",), np.array([1, 2], "i4"), {"units": "days since 2001-01-01"}), (("lat",), np.array([0.0, 0.5]), {}), (("lon",), np.array([1.0, 2.0, 3.0]), {})
    versions = (("expver",), np.array([1, 5], "i4"), {})
    v = np.arange(24, dtype="f8").reshape(3, 2, 2, 2)  # lon, valid_time, expver, lat
    v[0, 0, 0, 0] = -9
    sizes = {"lon": 3, "valid_time": 2, "expver": 2, "lat": 2, "one": 1}
    axes = {"valid_time": t, "lat": lat, "lon": lon, "expver": versions}
    (tmp_path / "a.nc").write_bytes(netcdf.encoded(sizes, axes | {"t2m": (("lon", "valid_time", "expver", "lat"), v, {"missing_value": np.array([-9.0])}), "land": (("one", "lat", "lon"), np.arange(6, dtype="i2").reshape(1, 2, 3), {})}))
    (tmp_path / "b.nc").write_bytes(netcdf.encoded({"lat": 2}, {"lat": lat}))
    got = {(r.time.day, r.expver, r.latitude, r.longitude): (r.temp, r.land) for r in readers.grid_files(spark, str(tmp_path), {"t2m": "temp", "land": "land"}, extra=["expver"]).collect()}
    want = {(i + 2, e, 0.5 * j, k + 1.0): (None if v[k, i, n, j] == -9 else v[k, i, n, j], 3.0 * j + k) for k in range(3) for i in range(2) for n, e in enumerate((1.0, 5.0)) for j in range(2)}
    assert got == want
    with pytest.raises(Exception, match="lies over expver"):
        readers.grid_files(spark, str(tmp_path), {"t2m": "temp"}).collect()


def test_env_variables(spark):
    raw = spark.createDataFrame([(1, 0.0, 0.0, 293.15, 294.15, 7200.0, 0.5)], "time int, latitude double, longitude double, t2m double, d2m double, ssrd double, tcc double")
    row = readers.env_variables(raw).first()
    assert (row.temp_c, row.vpd, row.par) == (pytest.approx(20.0), 0.0, pytest.approx(0.9))


def test_swath_names_that_are_no_dates_go(spark):
    rows = spark.createDataFrame([("/a/swath_lite_990131_x.nc", 0), ("/a/swath_lite_xx_x.nc", 0), ("/a/swath.nc", 0), ("/a/swath_lite_140131_x.nc", 1)], "file string, quality int")
    assert [r.date for r in readers.swath_points(rows).collect()] == [dt.date(1999, 1, 31)]


def test_reports_and_resume(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    assert "| 1 |  |" in writers.markdown(df, "T") and "More than 1 rows" in writers.markdown(df, "T", 1)
    assert writers.unfinished(df, spark, str(tmp_path / "none"), ["a"], "t").count() == 2
    assert Q.audit_path(spark, str(tmp_path / "none"), "x").first().n_rows is None
    with pytest.raises(ValueError, match="lacks z"):
        Q.require_columns(df, ["z"], "x")


@pytest.mark.parametrize("large", [False, True])
def test_quantiles_of_groups_with_ties_nulls_and_nothing(spark, large):
    rng = np.random.default_rng(5)
    rows = [(k, float(v)) for k, n in (("a", 500), (None, 41), ("one", 1)) for v in rng.integers(-30, 30, n)] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    q, names = [0.0, 0.025, 0.5, 0.9, 1.0], list("uvwxy")
    got = {r.k: r[1:] for r in A.exact_quantiles(df, ["k"], "v", q, names, large).collect()}
    assert set(got) == {"a", None, "one", "none"} and got["none"] == (None,) * 5
    for key in ("a", None, "one"):
        np.testing.assert_allclose(got[key], np.quantile([v for k, v in rows if k == key and v is not None], q), atol=1e-9)
    whole = A.exact_quantiles(df, [], "v", q, names, large).collect()
    np.testing.assert_allclose(whole[0], np.quantile([v for _, v in rows if v is not None], q), atol=1e-9)
    assert [tuple(r) for r in A.exact_quantiles(df.where("false"), [], "v", q, names, large).collect()] == [(None,) * 5]


def test_finished_files(spark, tmp_path):
    body = lambda name, values: "\r\n".join([f"a,{name}", *(f"x,{v}" for v in values)])
    whole = ["nan"] * 49 + ["-1e3"] + ["1"] * 400
    for name, text in (("good", body("t", whole)), ("late", body("t", ["", "nan", "?"] * 17 + whole[50:])), ("short", body("t", [1])), ("other", body("u", whole)), ("ragged", body("t", [1]).replace("x,1", "x") + "\n" * 2000)):
        (tmp_path / f"{name}.csv").write_text(text)
    assert [r.path.rsplit("/", 1)[1] for r in writers.finished_files(spark, str(tmp_path), "t").collect()] == ["good.csv"]
    assert writers.finished_files(spark, str(tmp_path / "none"), "t").count() == 0


def test_trailing_mean_carries_its_tail_across_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "key string, date date, value double"
    values = {"a": [1.0, 2.0, 6.0, 7.0], "b": [5.0, 5.0, 8.0, 2.0]}
    for part in range(2):
        spark.createDataFrame([(k, days(4)[i], v[i]) for k, v in values.items() for i in (2 * part, 2 * part + 1)], schema).coalesce(1).write.mode("append").parquet(source)
        run = ST.trailing_mean(spark.readStream.schema(schema).parquet(source), "key", 3).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
    got = {(r.key, r.date): r.ma for r in spark.read.parquet(out).collect()}
    for k, v in values.items():
        want = pd.Series(v).rolling(3, min_periods=1).mean()
        assert [got[k, d] for d in days(4)] == pytest.approx(list(want))


def test_bits_of_scenarios_and_counts(spark):
    rows = spark.createDataFrame([(f,) for f in (32, 33, 34, 24, 0)], "region_flags int")
    assert Counter(r.scenario for r in J.by_scenario(rows).collect()) == {"Global_High_LAI": 3, "SAA_High_LAI": 1, "Control_North": 1, "Sahara_Barren": 1}


# --- screening of daily features -----------------------------------------------------------------


def screened_panel(spark, seed=5, n_days=70, gaps=True):
    """Rows of two strata with ties in y, and a daily series whose features are missing on different days."""
    rng = np.random.default_rng(seed)
    rows = [(d, int(rng.integers(0, 4)), i, g, None if rng.random() < 0.05 else float(rng.integers(0, 30))) for d in days(n_days) for g in ("a", "b") for i in range(int(rng.integers(0, 5)))]
    panel = spark.createDataFrame(rows, "date date, lat_id int, lon_id int, stratum string, y double").dropDuplicates(["date", "lat_id", "lon_id", "stratum"])
    series = [(d, *(None if gaps and (i < k * 5 or (k == 2 and i % 9 == 0)) else float(np.round(rng.normal(), 1)) for k in range(4))) for i, d in enumerate(days(n_days))]
    return panel, spark.createDataFrame(series, "date date, s_ma1 double, s_ma2 double, f_ma1 double, f_ma2 double")


def as_rows(df, keys):
    return {tuple(r[k] for k in keys): {c: r[c] for c in df.columns if c not in keys} for r in df.collect()}


def test_daily_screening_equals_screening_of_rows(spark):
    panel, series = screened_panel(spark)
    families = {"SII": ["s_ma1", "s_ma2"], "F10.7": ["f_ma1", "f_ma2"]}
    want = as_rows(SC.profiles(panel.join(series, "date"), families, "y", ["stratum"], least=20), ["stratum", "feature"])
    got = as_rows(SC.daily_profiles(panel, series, families, "y", ["stratum"], least=20), ["stratum", "feature"])
    assert set(got) == set(want) and len(want) == 8
    for k, w in want.items():
        assert (got[k]["n"], got[k]["family"], got[k]["mode"], got[k]["window_value"]) == (w["n"], w["family"], w["mode"], w["window_value"])
        assert np.allclose([got[k][c] for c in ("rho", "n_eff", "p_adj", "z")], [w[c] for c in ("rho", "n_eff", "p_adj", "z")], rtol=1e-9)


def test_daily_pairs_equal_pairs_of_rows(spark):
    panel, series = screened_panel(spark, 6)
    twins = {("MA", 1): ("s_ma1", "f_ma1"), ("MA", 2): ("s_ma2", "f_ma2")}
    keys = ["stratum", "mode", "window_value"]
    want, got = (as_rows(x, keys) for x in (SC.pairs(panel.join(series, "date"), twins, "y", ["stratum"], least=20), SC.daily_pairs(panel, series, twins, "y", ["stratum"], least=20)))
    assert set(got) == set(want) and len(want) == 4
    for k, w in want.items():
        assert got[k]["winner"] == w["winner"] and got[k]["n"] == w["n"]
        assert np.allclose([got[k][c] for c in ("n_eff_used", "beta1", "beta2", "t1", "t2")], [w[c] for c in ("n_eff_used", "beta1", "beta2", "t1", "t2")], rtol=1e-8)


def test_daily_screening_of_nothing_and_of_constants(spark):
    panel, series = screened_panel(spark, 7, 30, gaps=False)
    families = {"SII": ["s_ma1", "s_ma2"]}
    assert SC.daily_profiles(panel.limit(0), series, families, "y", ["stratum"], least=1).collect() == []
    flat = SC.daily_profiles(panel.where("y is not null").withColumn("y", F.lit(3.0)), series, families, "y", ["stratum"], least=1).collect()
    assert len(flat) == 4 and all(r.rho is None and r.n_eff == 2.0 and r.z is None and r.p_adj is None for r in flat)


def test_ranked_values_equal_average_ranks(spark):
    rng = np.random.default_rng(8)
    values = pd.Series(rng.integers(0, 400, 3000) / 7)
    rows = spark.createDataFrame([(1, float(v)) for v in values], "k int, _y double")
    got = W.ranked_values(rows.groupBy("k", "_y").agg(F.count(F.lit(1)).alias("_c")), ["k"], ["k"]).toPandas().set_index("_y")
    want = pd.DataFrame({"y": values, "r": values.rank()}).drop_duplicates().set_index("y")
    assert np.allclose(got["_r"].sort_index(), want["r"].sort_index()) and (got["_n"] == 3000).all()


def test_grid_search_equals_least_squares(spark):
    rng = np.random.default_rng(9)
    n = 200
    x = {f"{f}{w}": rng.normal(size=n) + 100 * (f == "a") for f in "abc" for w in (1, 2)}
    y = 2 * x["a1"] - x["b2"] + 0.5 * x["c1"] + rng.normal(size=n)
    names = [*x]
    rows = [("g", float(y[i]) if i % 50 else None, *(float("nan") if i == 7 and c == "b1" else float(x[c][i]) for c in names)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, y double, " + ", ".join(f"{c} double" for c in names)).repartition(5)
    n_eff = spark.createDataFrame([("g", 90.0)], "k string, n_eff double")
    got = M.grid_search(df, "y", {f: {w: f"{f}{w}" for w in (1, 2)} for f in "abc"}, ["k"], n_eff).collect()
    use = np.array([i for i in range(n) if i % 50 and i != 7])
    assert len(got) == 8
    for r in got:
        design = np.column_stack([x[f"a{r.a_window}"], x[f"b{r.b_window}"], x[f"c{r.c_window}"], np.ones(n)])[use]
        beta, rss, *_ = np.linalg.lstsq(design, y[use], rcond=None)
        se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss[0] / (len(use) - 4))
        assert r.n == len(use) and r.rss == pytest.approx(rss[0])
        assert np.allclose([r.beta_a, r.beta_b, r.beta_c], beta[:3]) and np.allclose([r.t_a, r.t_b, r.t_c], (beta / se)[:3])
        assert np.allclose([r.p_a, r.p_b, r.p_c], D.t_two_sided(np.abs(beta / se)[:3], 86.0))
