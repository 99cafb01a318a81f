"""Marker screening, mechanism check and global screening, all groups in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import distributions as D
from gridloom.functions import scalars as S
from gridloom.operators import aggregates as A
from gridloom.operators import correlation as K
from gridloom.operators import daily_screening as DS
from gridloom.operators import joins as J

ORDER = ("date", "lat_id", "lon_id")


def binned(panel: DataFrame, temperature: str) -> DataFrame:
    """``panel`` with bin_id and bin_label; rows without a bin go."""
    t = F.col(temperature)
    return panel.withColumns({"bin_id": S.bin_id(t), "bin_label": S.bin_label(t)}).where(F.col("bin_id").isNotNull())


def melted(panel: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """A row for each row and feature: feature, mode, window_value, x."""
    long = panel.unpivot([*keep], [*features], "feature", "x")
    return long.withColumns({"mode": S.feature_mode(F.col("feature")), "window_value": S.feature_window(F.col("feature"))})


def profiles(panel: DataFrame, families: dict[str, Sequence[str]], y: str, by: Sequence[str], least: int = 50) -> DataFrame:
    """by, family, feature, mode, window_value, n, rho, n_eff, p_adj, z; groups of fewer than ``least`` rows go."""
    family = {f: name for name, fs in families.items() for f in fs}
    long = melted(panel, [*family], [*by, *ORDER, y])
    named = long.withColumn("family", F.element_at(F.create_map(*[F.lit(v) for kv in family.items() for v in kv]), F.col("feature")))
    return K.screening(named, "x", y, [*by, "family", "feature", "mode", "window_value"], ORDER).where(F.col("n") >= least)


def daily_profiles(panel: DataFrame, daily: DataFrame, families: dict[str, Sequence[str]], y: str, by: Sequence[str], least: int = 50) -> DataFrame:
    """``profiles`` of features that have one value a day: ``panel`` is not multiplied by them."""
    family = {f: name for name, fs in families.items() for f in fs}
    got = DS.screening(panel, y, by, ORDER, daily, [*family], least)
    named = F.element_at(F.create_map(*[F.lit(v) for kv in family.items() for v in kv]), F.col("feature"))
    return got.withColumns({"family": named, "mode": S.feature_mode(F.col("feature")), "window_value": S.feature_window(F.col("feature"))})


def daily_pairs(panel: DataFrame, daily: DataFrame, twins: dict[tuple[str, int], tuple[str, str]], y: str, by: Sequence[str], least: int = 50) -> DataFrame:
    """``pairs`` of features that have one value a day."""
    return K.pair_solution(DS.pairs(panel, y, by, ORDER, daily, twins, least))


def pairs(panel: DataFrame, twins: dict[tuple[str, int], tuple[str, str]], y: str, by: Sequence[str], least: int = 50) -> DataFrame:
    """by, mode, window_value, n, n_eff_used, betas, t and winner of the two families' features of equal mode and window.

    n_eff_used: the smaller n_eff of the two features, 5 at least.
    """
    rows = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(w).alias("window_value"), F.col(a).alias("x1"), F.col(b).alias("x2")) for (m, w), (a, b) in twins.items()])
    keys = [*by, "mode", "window_value"]
    long = panel.select(*by, *ORDER, y, F.inline(rows)).dropna(subset=["x1", "x2", y])
    single = [K.screening(long, x, y, keys, ORDER).select(*keys, F.col("n_eff").alias(f"_{x}")) for x in ("x1", "x2")]
    n_eff = single[0].join(single[1], keys).select(*keys, F.greatest(F.lit(5.0), F.least("_x1", "_x2")).alias("_e"))
    gauss = K.rank_gaussian(long, [y, "x1", "x2"], keys).join(n_eff, keys)
    out = K.pair_regression(gauss, f"{y}_g", "x1_g", "x2_g", keys, F.first("_e"))
    return out.where(F.col("n") >= least)


def mechanism(panel: DataFrame, windows: Sequence[int], driver: str, metrics: Sequence[str], least: int = 100) -> DataFrame:
    """scenario, parameter_1, window, spearman_r, p_value, n_eff_total: driver against each metric at equal windows, bins joined by Fisher z."""
    rows = F.array(*[F.struct(F.lit(f"{m}_ma{w}").alias("parameter_1"), F.lit(w).alias("window"), F.col(f"{driver}_ma{w}").alias("x"), F.col(f"{m}_ma{w}").alias("y")) for w in windows for m in metrics])
    by = ["scenario", "bin_id", "parameter_1", "window"]
    each = K.screening(J.by_scenario(panel).select("scenario", "bin_id", *ORDER, F.inline(rows)), "x", "y", by, ORDER, D.p_mechanism)
    return K.fisher_meta(each.where(F.col("n") >= least), ["scenario", "parameter_1", "window"])


def global_screening(panel: DataFrame, daily: DataFrame, targets: Sequence[str], driver: str) -> DataFrame:
    """target, spearman_r, p_value, n: the global daily mean of each target against the driver; n counts days before missing ones go."""
    means = panel.groupBy("date").agg(*[F.avg(t).alias(t) for t in targets]).join(J.broadcast_daily(daily.select("date", driver)), "date")
    long = means.unpivot(["date", driver], [*targets], "target", "y")
    n = long.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    rho = K.spearman(long, driver, "y", ["target"]).select("target", F.col("rho").alias("spearman_r"), F.col("n").alias("_n"))
    joined = n.join(rho, "target", "left")
    return joined.withColumn("p_value", D.p_spatial(F.col("spearman_r"), F.col("_n").cast("double"))).select("target", "spearman_r", "p_value", "n")


def meta_table(spark, models: DataFrame, targets: Sequence[str], bins: Sequence[str], scenarios: Sequence[str]) -> DataFrame:
    """The best model (largest |t_sii|, first in window order) of every target, bin and scenario; combinations without one have NULLs."""
    best = A.best_row(models, ["target", "scenario", "bin_label"], F.abs("t_sii"), ["sii_window", "par_window", "vpd_window"])
    frame = J.skeleton(spark, metric=targets, bin=bins, mask=scenarios, mode=["MA"])
    named = best.select(F.col("target").alias("metric"), F.col("bin_label").alias("bin"), F.col("scenario").alias("mask"), F.col("sii_window").alias("sii_step"), F.col("par_window").alias("par_step"), F.col("vpd_window").alias("vpd_step"), "beta_sii", "t_sii", "p_sii", "n_eff", "n", "t_par", "t_vpd")
    return frame.join(named, ["metric", "bin", "mask"], "left")


def meta_wide(meta: DataFrame) -> DataFrame:
    """The measures of ``meta`` as _MA columns, with _LAG twins of NULLs, without the mode."""
    measures = [c for c in meta.columns if c not in ("metric", "bin", "mask", "mode")]
    return meta.withColumnsRenamed({c: f"{c}_MA" for c in measures}).withColumns({f"{c}_LAG": F.lit(None).cast(meta.schema[c].dataType) for c in measures}).drop("mode")


def fisher_difference(results: DataFrame, first: str, second: str, keys: Sequence[str] = ("bin_id", "window")) -> DataFrame:
    """delta_z of two scenarios at equal bin and window; correlations are cut at 0.999."""
    side = lambda s, n: results.where(F.col("scenario") == s).select(*keys, S.fisher_z(F.col("rho"), 0.999).alias(n))
    return side(first, "_a").join(side(second, "_b"), [*keys]).select(*keys, (F.col("_a") - F.col("_b")).alias("delta_z"))
