"""Rank correlations of a row-level target with many features of one daily series, from sums by day.

A feature has one value a day, so a target's rows count only through each day's number of rows and sums: of their
ranks, of their values and of products of neighbours in order. Rows are never multiplied by features. Where features
are missing on different days, the target is ranked anew for each set of days (a class of features), over distinct
values with their counts. Ranks come from buckets of values, so no task has to sort a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import distributions as D
from gridloom.operators import windows as W
from gridloom.operators.models import average_ranks_weighted

SCREENED = "feature string, n long, rho double, n_eff double, p_adj double, z double"
PAIRED = "mode string, window_value int, n long, n_eff_used double, r12 double, r1 double, r2 double"


class Series:
    """Features of a daily series on the driver: a row a day, some thousands of days at most."""

    def __init__(self, daily: DataFrame, names: Sequence[str]):
        pdf = daily.select("date", *names).where(F.col("date").isNotNull()).orderBy("date").toPandas()
        self.dates, self.names = [*pdf["date"]], [*names]
        self.place = {d: i for i, d in enumerate(self.dates)}
        self.values = {n: pdf[n].to_numpy(float) for n in names}
        masks = {n: ~np.isnan(x) for n, x in self.values.items()}
        kinds = {m.tobytes(): m for m in masks.values()}
        number = {k: i for i, k in enumerate(kinds)}
        self.class_of, self.masks = {n: number[m.tobytes()] for n, m in masks.items()}, [*kinds.values()]

    def days(self, spark) -> DataFrame:
        """date, classes: the classes whose features are known on the day."""
        rows = [(d, [c for c, m in enumerate(self.masks) if m[i]]) for i, d in enumerate(self.dates)]
        return spark.createDataFrame(rows, "date date, classes array<int>")


def _sums(rows: DataFrame, y: str, by: Sequence[str], order: Sequence[str], series: Series, gauss: bool) -> tuple[DataFrame, DataFrame]:
    """(by day: n, sums, first and last value in order; by class and day: sums of ranks, and of their normal quantiles)."""
    known = rows.where(F.col(y).isNotNull() & F.col("date").isNotNull()).select(*by, "date", *[c for c in order if c != "date"], F.col(y).cast("double").alias("_y"))
    inside = [c for c in order if c != "date"]
    lagged = known.withColumn("_l", F.lag("_y").over(Window.partitionBy(*by, "date").orderBy(*inside)))
    place = F.struct(*inside)
    days = lagged.groupBy(*by, "date").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("q"), F.coalesce(F.sum(F.col("_y") * F.col("_l")), F.lit(0.0)).alias("p"), F.min_by("_y", place).alias("first"), F.max_by("_y", place).alias("last"))
    spark, keys = rows.sparkSession, [*by, "_class"]
    cells = known.groupBy(*by, "date", "_y").agg(F.count(F.lit(1)).alias("_c"))
    # The days of the series: a row a day.
    spread = cells.join(F.broadcast(series.days(spark)), "date").select(*by, "date", "_y", "_c", F.explode("classes").alias("_class"))
    ranked = W.ranked_values(spread.groupBy(*keys, "_y").agg(F.sum("_c").alias("_c")), keys, by)
    if gauss:
        ranked = ranked.withColumn("_g", D.quantile_of_normal((F.col("_r") - 0.5) / F.col("_n")))
    measures = ["_r"] + ["_g"] * gauss
    sums = [x for m in measures for x in (F.sum(F.col("_c") * F.col(m)).alias(f"s{m}"), F.sum(F.col("_c") * F.col(m) * F.col(m)).alias(f"q{m}"))]
    by_class = spread.join(ranked, [*keys, "_y"]).groupBy(*keys, "date").agg(*sums)
    # Names of their own, as both sides come from the same rows and are grouped together.
    return days, by_class.select(*[F.col(k).alias(f"_by_{k}") for k in by], "_class", F.col("date").alias("day"), *[F.col(x) for x in by_class.columns[len(keys) + 1 :]])


def _clip(r: float) -> float:
    return float(np.clip(r, -0.99, 0.99))  # NaN stays


def _corr(xy: float, x: float, y: float, xx: float, yy: float, n: float) -> float:
    """Correlation from sums over n pairs; NaN without variance."""
    a, b = xx - x * x / n, yy - y * y / n
    return (xy - x * y / n) / np.sqrt(a * b) if n > 0 and a > 1e-12 * abs(xx) and b > 1e-12 * abs(yy) else np.nan


class _Group:
    """The sums of one group, aligned with the days of the series."""

    def __init__(self, days: pd.DataFrame, sums: pd.DataFrame, series: Series):
        self.series = series
        at = np.array([series.place.get(d, -1) for d in days["date"]], int)
        days, at = days[at >= 0], at[at >= 0]
        self.days = {}
        for c in ("n", "s", "q", "p", "first", "last"):
            self.days[c] = np.zeros(len(series.dates))
            self.days[c][at] = days[c].to_numpy(float)
        self.by_class = {}
        for number, part in sums.groupby("_class"):
            place = np.array([series.place[d] for d in part["day"]], int)
            self.by_class[int(number)] = {c: np.bincount(place, part[c].to_numpy(float), len(series.dates)) for c in part.columns if c[:2] in ("s_", "q_")}

    def used(self, number: int) -> np.ndarray:
        """Days of a class on which the group has rows, in order."""
        return np.flatnonzero(self.series.masks[number] & (self.days["n"] > 0))

    def y_lag1(self, use: np.ndarray) -> float:
        n, s, q, p, first, last = (self.days[c][use] for c in ("n", "s", "q", "p", "first", "last"))
        total = p.sum() + (first[1:] * last[:-1]).sum()
        return _corr(total, s.sum() - first[0], s.sum() - last[-1], q.sum() - first[0] ** 2, q.sum() - last[-1] ** 2, n.sum() - 1)

    def x_lag1(self, x: np.ndarray, n: np.ndarray) -> float:
        x = x - (x * n).sum() / n.sum()
        total = ((n - 1) * x * x).sum() + (x[1:] * x[:-1]).sum()
        s, q = (n * x).sum(), (n * x * x).sum()
        return _corr(total, s - x[0], s - x[-1], q - x[0] ** 2, q - x[-1] ** 2, n.sum() - 1)

    def with_day_values(self, v: np.ndarray, number: int, use: np.ndarray, measure: str) -> float:
        """Correlation of a value a day with the target's ranks, or their quantiles."""
        n, sums = self.days["n"][use], self.by_class[number]
        s = sums[f"s{measure}"][use]
        return _corr((v * s).sum(), (v * n).sum(), s.sum(), (v * v * n).sum(), sums[f"q{measure}"][use].sum(), n.sum())

    def n_eff(self, x: np.ndarray, use: np.ndarray, y_lag1: float) -> float:
        n = self.days["n"][use]
        if n.sum() < 5:
            return max(2.0, n.sum())
        product = _clip(self.x_lag1(x, n)) * _clip(y_lag1)
        return 2.0 if np.isnan(product) else max(2.0, n.sum() * (1 - product) / (1 + product))


def _keyed(schema: str, df: DataFrame, by: Sequence[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in by) + ", " + schema


def screening(rows: DataFrame, y: str, by: Sequence[str], order: Sequence[str], daily: DataFrame, names: Sequence[str], least: int = 50) -> DataFrame:
    """by, feature, n, rho (average ranks), n_eff (lag-1 autocorrelations in ``order``; 0 below five rows), p_adj and z of each
    feature of ``daily`` with y, over the rows that have both; groups of fewer than ``least`` such rows go."""
    series = Series(daily, names)
    days, sums = _sums(rows, y, by, order, series, gauss=False)

    def run(key: tuple, days: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        group, out, known = _Group(days, sums, series), [], {}
        for name in series.names:
            number = series.class_of[name]
            if number not in known:
                use = group.used(number)
                known[number] = use, group.y_lag1(use) if len(use) else np.nan
            use, y_lag1 = known[number]
            n = group.days["n"][use]
            if n.sum() < max(1, least):
                continue
            x = series.values[name][use]
            rho = group.with_day_values(average_ranks_weighted(x, n), number, use, "_r")
            out.append((*key, name, int(n.sum()), rho, group.n_eff(x, use, y_lag1)))
        got = pd.DataFrame(out, columns=[*by, "feature", "n", "rho", "n_eff"])
        rho, n_eff = got["rho"].to_numpy(float), got["n_eff"].to_numpy(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(np.abs(rho) >= 1, np.inf, np.abs(rho) * np.sqrt(np.maximum(n_eff - 2, 0) / (1 - rho * rho)))
            got["z"] = np.where(np.abs(rho) < 1, np.arctanh(rho), np.nan)
        got["p_adj"] = D.t_two_sided(np.where(np.isnan(rho), np.nan, t), np.maximum(n_eff - 2, 1.0)) if len(got) else []
        return got.astype(object).where(got.notna(), None)[[*by, "feature", "n", "rho", "n_eff", "p_adj", "z"]]

    return days.groupBy(*by).cogroup(sums.groupBy(*[f"_by_{k}" for k in by])).applyInPandas(run, _keyed(SCREENED, rows, by))


def pairs(rows: DataFrame, y: str, by: Sequence[str], order: Sequence[str], daily: DataFrame, twins: dict[tuple[str, int], tuple[str, str]], least: int = 50) -> DataFrame:
    """by, mode, window_value, n, n_eff_used, r12, r1, r2: correlations of the normal quantiles of ranks of y and two features
    that are known on the same days; days on which one of them is missing don't count. n_eff_used is the smaller one's, 5 at least."""
    both = daily.select("date", *[F.when(F.col(b).isNotNull(), F.col(a)).alias(f"{m}|{w}|1") for (m, w), (a, b) in twins.items()], *[F.when(F.col(a).isNotNull(), F.col(b)).alias(f"{m}|{w}|2") for (m, w), (a, b) in twins.items()])
    series = Series(both, both.columns[1:])
    days, sums = _sums(rows, y, by, order, series, gauss=True)

    def run(key: tuple, days: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        group, out = _Group(days, sums, series), []
        for mode, window in twins:
            names = [f"{mode}|{window}|{i}" for i in (1, 2)]
            number = series.class_of[names[0]]
            use = group.used(number)
            n = group.days["n"][use]
            if n.sum() < max(1, least):
                continue
            x = [series.values[name][use] for name in names]
            y_lag1 = group.y_lag1(use)
            g = [D.normal_quantile((average_ranks_weighted(v, n) - 0.5) / n.sum()) for v in x]
            r12 = _corr((g[0] * g[1] * n).sum(), (g[0] * n).sum(), (g[1] * n).sum(), (g[0] ** 2 * n).sum(), (g[1] ** 2 * n).sum(), n.sum())
            r1, r2 = (group.with_day_values(v, number, use, "_g") for v in g)
            out.append((*key, mode, window, int(n.sum()), max(5.0, min(group.n_eff(v, use, y_lag1) for v in x)), *np.nan_to_num([r12, r1, r2]).tolist()))
        return pd.DataFrame(out, columns=[*by, "mode", "window_value", "n", "n_eff_used", "r12", "r1", "r2"])

    return days.groupBy(*by).cogroup(sums.groupBy(*[f"_by_{k}" for k in by])).applyInPandas(run, _keyed(PAIRED, rows, by))
