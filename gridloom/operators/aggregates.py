"""Aggregations: daily series, panels, summaries, pivots, histograms and moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.windows import ranked_values


def calendar(df: DataFrame, date: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """Every day from the first to the last of each series."""
    ends = df.groupBy(*by).agg(F.min(date).alias("_a"), F.max(date).alias("_b")).where("_a is not null")
    return ends.select(*by, F.explode(F.sequence("_a", "_b")).alias(date))


def densified(df: DataFrame, date: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """``df`` with a row of NULLs for every day that a series lacks."""
    return calendar(df, date, by).join(df, [*by, date], "left")


def resampled(hourly: DataFrame, ts: str, stats: dict[str, Sequence[str]]) -> DataFrame:
    """Daily mean, max or std (n - 1) of columns, named column_stat; days without rows are NULL rows."""
    made = {"mean": F.avg, "max": F.max, "std": F.stddev_samp}
    daily = hourly.groupBy(F.to_date(ts).alias("date")).agg(*[made[s](c).alias(f"{c}_{s}") for c, each in stats.items() for s in each])
    return densified(daily)


def cell_means(df: DataFrame, keys: Sequence[str], columns: Sequence[str], count: str | None = None) -> DataFrame:
    """Means of the columns by key, and the number of rows."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns], *([F.count(F.lit(1)).alias(count)] if count else []))


def trend_summary(results: DataFrame, by: Sequence[str], rho: str = "rho", p: str = "p_adj", scenario: str = "scenario") -> DataFrame:
    """Mean and median rho, number of scenarios, percent significant (a missing p isn't)."""
    significant = F.coalesce((F.col(p) < 0.05).cast("int"), F.lit(0))
    return results.groupBy(*by).agg(F.avg(rho).alias("mean_rho"), F.median(rho).alias("median_rho"), F.count(scenario).alias("n_scenarios"), (F.avg(significant) * 100).alias("perc_sig"))


def profile_summary(profiles: DataFrame, by: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """Mean and largest |z| of each mode, the feature of the largest (the first in window order, then in that of ``ties``), and MA less LAG."""
    out = []
    z = F.abs(F.when(~F.isnan("z") & (F.abs("z") < float("inf")), F.col("z")))
    for mode in ("MA", "LAG"):
        own = F.when(F.col("mode") == mode, z)
        out += [F.avg(own).alias(f"auc_abs_z_{mode.lower()}"), F.max(own).alias(f"peak_abs_z_{mode.lower()}"), F.min_by("feature", F.when(own.isNotNull(), F.struct(-own, F.isnull("window_value"), "window_value", *ties))).alias(f"peak_{mode.lower()}")]
    return profiles.groupBy(*by).agg(*out).withColumn("delta_acc", F.col("auc_abs_z_ma") - F.col("auc_abs_z_lag"))


def family_overview(summary: DataFrame, by: Sequence[str], first: str = "SII", second: str = "F10.7") -> DataFrame:
    """The two families' measures side by side, their difference and ratio."""
    own = lambda c, f: F.first(F.when(F.col("family") == f, F.col(c)), ignorenulls=True)
    wide = summary.groupBy(*by).agg(*[own(c, f).alias(f"{n}_{s}") for n, f in (("sii", first), ("f", second)) for c, s in (("auc_abs_z_ma", "auc_ma"), ("auc_abs_z_lag", "auc_lag"), ("delta_acc", "delta_acc"))])
    return wide.withColumns({"delta_acc_diff": F.col("sii_delta_acc") - F.col("f_delta_acc"), "auc_ma_ratio": F.try_divide("sii_auc_ma", "f_auc_ma")})


def win_rates(pairs: DataFrame, by: Sequence[str], winner: str = "winner", side: str = "SII") -> DataFrame:
    """Share of windows a side wins, by mode and over all modes (mode ALL); no winner is a loss."""
    won = F.coalesce((F.col(winner) == side).cast("double"), F.lit(0.0))
    return pairs.withColumn("_w", won).groupingSets([[*map(F.col, (*by, "mode"))], [*map(F.col, by)]], *by, "mode").agg(F.count(F.lit(1)).alias("n_windows"), F.avg("_w").alias("p_sii_win"), F.grouping("mode").alias("_g")).withColumn("mode", F.when(F.col("_g") == 1, F.lit("ALL")).otherwise(F.col("mode"))).drop("_g")


def global_overview(overview: DataFrame, rates: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bins, mean and median of difference and ratio, and the win rate weighted by windows."""
    base = overview.groupBy(*by).agg(F.countDistinct("bin_id").alias("n_bins"), *[f(c).alias(f"{c}_{n}") for c in ("delta_acc_diff", "auc_ma_ratio") for n, f in (("mean", F.avg), ("median", F.median))])
    weighted = rates.where("mode = 'ALL'").groupBy(*by).agg(F.try_divide(F.sum(F.col("p_sii_win") * F.col("n_windows")), F.sum("n_windows")).alias("p_sii_win_weighted"), F.sum("n_windows").alias("n_windows_total"))
    return base.join(weighted, [*by], "left")


def best_row(df: DataFrame, by: Sequence[str], measure: Column, ties: Sequence[str]) -> DataFrame:
    """The row of the largest measure; the first in the order of ``ties``; rows without measure don't count."""
    order = Window.partitionBy(*by).orderBy(measure.desc(), *ties)
    return df.where(measure.isNotNull()).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def strength_matrix(models: DataFrame, least: int = 10, row: str = "bin_label", column: str = "sii_window", t: str = "t_sii", columns: Sequence | None = None) -> DataFrame:
    """Median |t| with a row per bin and a column per window; NULL where fewer than ``least`` models are."""
    cells = models.where(F.col(t).isNotNull()).groupBy(row, column).agg(F.median(F.abs(t)).alias("_m"), F.count(F.lit(1)).alias("_n")).withColumn("_m", F.when(F.col("_n") >= least, F.col("_m")))
    return cells.groupBy(row).pivot(column, list(columns) if columns else None).agg(F.first("_m"))


def driver_stack(results: DataFrame, by: Sequence[str], drivers: Sequence[str] = ("SII", "PAR", "VPD")) -> DataFrame:
    """|mean rho| and mean p of each driver and window, and where its bar starts in the stack; a driver that a window lacks has 0 and 1."""
    stacked = results.groupBy(*by, "window").agg(*[F.coalesce(F.abs(F.avg(F.when(F.col("driver") == d, F.col("rho")))), F.lit(0.0)).alias(f"r{i}") for i, d in enumerate(drivers)], *[F.coalesce(F.avg(F.when(F.col("driver") == d, F.col("p_adj"))), F.lit(1.0)).alias(f"p{i}") for i, d in enumerate(drivers)])
    rows = F.array(*[F.struct(F.lit(d).alias("driver"), F.col(f"r{i}").alias("rho_abs"), F.col(f"p{i}").alias("p_adj"), sum((F.col(f"r{j}") for j in range(i)), F.lit(0.0)).alias("base")) for i, d in enumerate(drivers)])
    return stacked.select(*by, "window", F.inline(rows))


def band_metrics(spectrum: DataFrame, by: Sequence[str], low: int, high: int) -> DataFrame:
    """Trapezoid area, largest |rho| and mean rho over the windows of the band."""
    over = Window.partitionBy(*by).orderBy("window")
    band = spectrum.where(F.col("window").between(low, high)).withColumn("_t", (F.col("window") - F.lag("window").over(over)) * (F.col("rho") + F.lag("rho").over(over)) / 2)
    return band.groupBy(*by).agg(F.coalesce(F.sum("_t"), F.lit(0.0)).alias("signed_auc"), F.max(F.abs("rho")).alias("max_abs_rho"), F.avg("rho").alias("mean_rho"))


def exact_quantiles(df: DataFrame, by: Sequence[str], c: str, q: Sequence[float], names: Sequence[str], large: bool = False) -> DataFrame:
    """Quantiles with linear interpolation, NULL for groups without values; NULLs don't count.

    One aggregation, in which a task holds a group's distinct values. ``large`` is the way for groups that no task can hold, with the same result:
    distinct values are counted and placed by ranks in buckets of their group, and each quantile lies between the two values whose places enclose it.
    """
    if not large:
        return df.groupBy(*by).agg(F.percentile(c, F.array(*map(F.lit, q))).alias("_q")).select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    keyed = df.select(F.struct(*by) if by else F.struct(F.lit(0).alias("_all")), F.col(c).cast("double")).toDF("_key", "_y")
    values = keyed.groupBy("_key", "_y").agg(F.count(F.lit(1)).alias("_c")).where("_y is not null")
    ranked = ranked_values(values, ["_key"], ["_key"]).join(values, ["_key", "_y"])
    last = F.col("_r") + (F.col("_c") - 1) / 2 - 1  # places from 0
    first = F.col("_r") - (F.col("_c") - 1) / 2 - 1
    at = [(F.col("_n") - 1) * float(p) for p in q]
    held = lambda place: F.max(F.when(place.between(first, last), F.col("_y")))
    found = ranked.groupBy("_key").agg(F.max("_n").alias("_n"), *[f(p).alias(f"_{n}{i}") for i, p in enumerate(at) for n, f in (("lo", lambda p: held(F.floor(p))), ("hi", lambda p: held(F.ceil(p))))])
    place = lambda i, p: F.when(F.floor(p) == F.ceil(p), F.col(f"_lo{i}")).otherwise((F.ceil(p) - p) * F.col(f"_lo{i}") + (p - F.floor(p)) * F.col(f"_hi{i}"))
    out = found.select("_key", *[place(i, p).alias(n) for i, (p, n) in enumerate(zip(at, names))])
    groups = keyed.select("_key").distinct() if by else df.sparkSession.range(1).select(F.struct(F.lit(0).alias("_all")).alias("_key"))
    return groups.join(out, ["_key"], "left").select(*[F.col("_key")[k].alias(k) for k in by], *names)


def moments(df: DataFrame, c: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, std (n - 1), least, quartiles, largest, and the bias-corrected skewness and kurtosis."""
    n, x = F.count(c).cast("double"), F.col(c)
    flat = F.when(F.stddev_pop(c) > 0, F.lit(1))
    skew, kurt = F.skewness(x) * F.sqrt(n * (n - 1)), F.kurtosis(x)
    return df.groupBy(*by).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("least"), F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("quartiles"), F.max(c).alias("largest"),
        F.when(flat.isNotNull(), F.try_divide(skew, n - 2)).alias("skewness"), F.when(flat.isNotNull(), F.try_divide(((n + 1) * kurt + 6) * (n - 1), (n - 2) * (n - 3))).alias("kurtosis"),
    )


def normality(df: DataFrame, c: str, by: Sequence[str] = ()) -> DataFrame:
    """by, k2, p: D'Agostino's K2 of a column and its p, by the transforms of D'Agostino (skewness) and Anscombe and Glynn (kurtosis).

    NULL for fewer than eight values, for which the transforms aren't made, and without variance.
    """
    spread = F.stddev_pop(c) > 0
    sums = df.groupBy(*by).agg(F.count(c).cast("double").alias("n"), F.when(spread, F.skewness(c)).alias("skew"), F.when(spread, F.kurtosis(c)).alias("kurt")).withColumns({"skew": F.when(F.col("n") >= 8, F.col("skew")), "kurt": F.when(F.col("n") >= 8, F.col("kurt"))})
    n = F.col("n")
    steps = [
        ("y", F.col("skew") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))),
        ("b2", 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))),
        ("w2", F.sqrt(2 * (F.col("b2") - 1)) - 1),
        ("zs", F.asinh(F.col("y") / F.sqrt(2 / (F.col("w2") - 1))) / F.sqrt(F.log("w2") / 2)),
        ("x", (F.col("kurt") + 6 / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))),
        ("b1", 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))),
        ("a", 6 + 8 / F.col("b1") * (2 / F.col("b1") + F.sqrt(1 + 4 / (F.col("b1") * F.col("b1"))))),
        ("d", 1 + F.col("x") * F.sqrt(2 / (F.col("a") - 4))),
        ("zk", (1 - 2 / (9 * F.col("a")) - F.signum("d") * F.cbrt(F.abs((1 - 2 / F.col("a")) / F.col("d")))) / F.sqrt(2 / (9 * F.col("a")))),
        ("k2", F.col("zs") * F.col("zs") + F.col("zk") * F.col("zk")),
        ("p", F.exp(-F.col("k2") / 2)),
    ]
    out = sums.withColumns({"n": F.when(n >= 8, n)})
    for name, value in steps:
        out = out.withColumn(name, value)
    return out.select(*by, "k2", "p")


def exceedance(df: DataFrame, c: str, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """How many rows exceed each threshold, and the percentage of rows with a value."""
    summed = df.groupBy(*by).agg(F.count(c).alias("_n"), *[F.count(F.when(F.col(c) > t, 1)).alias(f"_t{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_t{i}").alias("n_over"), F.try_divide(F.col(f"_t{i}") * 100.0, F.col("_n")).alias("pct_over")) for i, t in enumerate(thresholds)])
    return summed.select(*by, F.inline(rows))


def coverage_variation(df: DataFrame, date: str = "date") -> DataFrame:
    """Mean rows a date and their coefficient of variation."""
    return df.groupBy(date).agg(F.count(F.lit(1)).alias("_n")).agg(F.avg("_n").alias("mean_rows"), F.try_divide(F.stddev_samp("_n"), F.avg("_n")).alias("cv_rows"))


def histogram(df: DataFrame, c: str, bins: int | None = None) -> DataFrame:
    """Counts and densities in bins of equal width, the last closed; without ``bins`` their number follows from the rows."""
    ends = df.where(F.col(c).isNotNull()).agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"), F.count(c).alias("_n"))
    number = F.lit(bins) if bins else F.least(F.lit(24), F.greatest(F.lit(12), F.floor(F.sqrt("_n") * 1.8).cast("int")))
    ends = F.broadcast(ends.withColumn("_b", number))  # one row
    width = (F.col("_hi") - F.col("_lo")) / F.col("_b")
    placed = df.where(F.col(c).isNotNull()).crossJoin(ends).withColumn("bin", F.least(F.coalesce(F.floor(F.try_divide(F.col(c) - F.col("_lo"), width)).cast("int"), F.lit(0)), F.col("_b") - 1))
    counted = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("_c"))
    full = ends.select("*", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("bin"))
    n = F.coalesce("_c", F.lit(0))
    return full.join(counted, "bin", "left").select("bin", (F.col("_lo") + F.col("bin") * width).alias("lower"), n.alias("n"), F.try_divide(n.cast("double"), F.col("_n") * width).alias("density"))


def unpivoted(wide: DataFrame, keys: Sequence[str], prefix: str, value: str) -> DataFrame:
    """Columns prefix{i}_{name} as rows: keys, bin (i), bin_label (name), value."""
    columns = [c for c in wide.columns if c.startswith(prefix)]
    long = wide.unpivot([*keys], columns, "_c", value)
    return long.select(*keys, F.regexp_extract("_c", rf"^{prefix}(\d+)_", 1).cast("int").alias("bin"), F.regexp_extract("_c", rf"^{prefix}\d+_(.*)$", 1).alias("bin_label"), value)


def overlay(panels: DataFrame, second: DataFrame, panel: str, wanted: int = 1) -> DataFrame:
    """The panels, and of the second driver one bin: ``wanted`` if it has rows, else bin 0, marked as an overlay."""
    has = F.max((F.col("bin_id") == wanted).cast("int")).over(Window.partitionBy("scenario"))
    one = second.withColumn("_h", has).where(F.col("bin_id") == F.when(F.col("_h") == 1, F.lit(wanted)).otherwise(F.lit(0))).drop("_h")
    return panels.unionByName(one.withColumns({"panel": F.lit(panel), "scenario": F.concat("scenario", F.lit("_overlay"))}), allowMissingColumns=True)
