"""Rank correlations, effective sample sizes and the two-predictor regression, from grouped sums.

Inputs are long: a row for each observation and variable, ``by`` names the groups. Correlations are NULL where a
side has no variance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom import config as C
from gridloom.functions import distributions as D
from gridloom.functions import scalars as S
from gridloom.operators import windows as W


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation of the rows where both are known; NULL without variance (``corr`` itself raises there)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def average_ranks(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``df`` with c_rank for every column: average ranks within ``by``."""
    return df.withColumns({f"{c}_rank": W.average_rank(c, by) for c in columns})


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """rho and n by group, ties with average ranks, rows with both values only."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return average_ranks(known, [x, y], by).groupBy(*by).agg(safe_corr(F.col(f"{x}_rank"), F.col(f"{y}_rank")).alias("rho"), F.count(F.lit(1)).alias("n"))


def spearman_ordinal(df: DataFrame, x: str, y: str, by: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """rho and n by group with ordinal ranks: equal values follow the pinned order of ``ties``."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = known.withColumns({"_x": W.ordinal_rank(x, by, ties), "_y": W.ordinal_rank(y, by, ties)})
    return ranked.groupBy(*by).agg(safe_corr(F.col("_x"), F.col("_y")).alias("rho"), F.count(F.lit(1)).alias("n"))


def autocorrelation(df: DataFrame, columns: Sequence[str], lags: Sequence[int], by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """by, column, lag, r: correlation of a column's rows with those ``lag`` rows before (means of head and tail apart)."""
    lagged = _lagged(df, columns, lags, by, order)
    wide = lagged.groupBy(*by, "lag").agg(*[safe_corr(F.col(c), F.col(f"_then.{c}")).alias(f"_{c}") for c in columns])
    return wide.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col("lag"), F.col(f"_{c}").alias("r")) for c in columns])))


def _lagged(df: DataFrame, columns: Sequence[str], lags: Sequence[int], by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A row for each row and lag that the group has: the columns now and, in ``_then``, lag rows before.

    Each row holds the values before it up to the longest lag, and is aggregated by lag before any shuffle.
    """
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(-max(lags), -1)
    held = df.select(*by, *columns, F.reverse(F.collect_list(F.struct(*columns)).over(before)).alias("_before"))
    spread = held.select(*by, *columns, F.posexplode("_before").alias("_k", "_then")).withColumn("lag", F.col("_k") + 1)
    return spread if len(lags) == max(lags) else spread.where(F.col("lag").isin([*lags]))


def acf_global_mean(series: DataFrame, c: str, lags: int, order: Sequence[str] = ("date",), by: Sequence[str] = ()) -> DataFrame:
    """lag and r from 0 on, with one mean for the whole series."""
    over = Window.partitionBy(*by).orderBy(*order)
    centred = series.where(F.col(c).isNotNull()).withColumn("_x", F.col(c) - F.avg(c).over(Window.partitionBy(*by)))
    sums = centred.select(*by, "_x", *[F.lag("_x", k).over(over).alias(f"_{k}") for k in range(1, lags + 1)]).groupBy(*by).agg(F.sum(F.col("_x") * F.col("_x")).alias("_s"), *[F.coalesce(F.sum(F.col("_x") * F.col(f"_{k}")), F.lit(0.0)).alias(f"_{k}") for k in range(1, lags + 1)])
    return sums.select(*by, F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"_{k}") if k else F.col("_s"), F.col("_s")).alias("r")) for k in range(lags + 1)])))


def neff_full(ranked: DataFrame, x: str, y: str, by: Sequence[str], order: Sequence[str], most: int = C.NEFF_MAX_LAG) -> DataFrame:
    """n, n_eff and neff_factor: n / max(1 + 2 sum of r_x(k) r_y(k), 0.001), 2 at least, k up to min(most, n - 2), r cut at 0.99."""
    n = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    lagged = _lagged(ranked, [x, y], range(1, most + 1), by, order)
    r = lagged.groupBy(*by, "lag").agg(*[S.clipped(safe_corr(F.col(c), F.col(f"_then.{c}")), 0.99).alias(a) for c, a in ((x, "_x"), (y, "_y"))])
    used = F.when(F.col("lag") <= F.greatest(F.col("n") - 2, F.lit(1)), F.col("_x") * F.col("_y"))
    summed = n.join(r, [*by], "left").groupBy(*by, "n").agg(F.coalesce(F.sum(used), F.lit(0.0)).alias("_s"))
    n_eff = F.greatest(F.lit(2.0), F.col("n") / F.greatest(1 + 2 * F.col("_s"), F.lit(1e-3)))
    return summed.select(*by, "n", n_eff.alias("n_eff")).withColumn("neff_factor", F.col("n_eff") / F.col("n"))


def lag1(c: str, by: Sequence[str], order: Sequence[str]) -> Column:
    return F.lag(c).over(Window.partitionBy(*by).orderBy(*order))


def screening(df: DataFrame, x: str, y: str, by: Sequence[str], order: Sequence[str], p_value=D.p_screening) -> DataFrame:
    """rho (average ranks), n, n_eff (lag-1 autocorrelations of the raw values; 0 below five rows), p_adj and Fisher z."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(known, [x, y], by).withColumns({"_x1": lag1(x, by, order), "_y1": lag1(y, by, order)})
    r1 = lambda c: F.when(F.count(F.lit(1)) < 5, F.lit(0.0)).otherwise(S.clipped(safe_corr(F.col(c), F.col("_x1" if c == x else "_y1")), 0.99))
    out = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col(f"{x}_rank"), F.col(f"{y}_rank")).alias("rho"), (r1(x) * r1(y)).alias("_p"))
    out = out.withColumn("n_eff", F.greatest(F.lit(2.0), F.col("n") * F.try_divide(1 - F.col("_p"), 1 + F.col("_p")))).drop("_p")
    return out.withColumns({"p_adj": p_value(F.col("rho"), F.col("n_eff")), "z": S.fisher_z(F.col("rho"), None)})


def neff_residual(df: DataFrame, c: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """n and n_eff from the lag-1 autocorrelation of one column, 0.5 if it has none; n itself up to 10 rows; no upper bound."""
    lagged = df.where(F.col(c).isNotNull()).withColumn("_l", lag1(c, by, order))
    r = F.coalesce(safe_corr(F.col(c), F.col("_l")), F.lit(0.5))
    n = F.count(F.lit(1))
    return lagged.groupBy(*by).agg(n.alias("n"), F.when(n > 10, F.try_divide(n * (1 - r), 1 + r)).otherwise(n.cast("double")).alias("n_eff"))


def rank_gaussian(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``df`` with c_g: normal quantiles of (average rank - 0.5) / n within ``by``."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumns({f"{c}_g": D.quantile_of_normal((W.average_rank(c, by) - 0.5) / n) for c in columns})


def pair_regression(df: DataFrame, y: str, x1: str, x2: str, by: Sequence[str], n_eff: Column) -> DataFrame:
    """beta1, beta2, t1, t2 and winner of the standardised regression of y on two predictors, from three correlations.

    ``n_eff`` is an aggregate of the group. Near collinearity leaves t NULL; then there is no winner.
    """
    r = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(safe_corr(F.col(a), F.col(b)), F.lit(0.0)).alias(k) for k, a, b in (("r12", x1, x2), ("r1", x1, y), ("r2", x2, y))], n_eff.alias("n_eff_used"))
    return pair_solution(r)


def pair_solution(r: DataFrame) -> DataFrame:
    """Betas, t and winner from columns r12, r1, r2 and n_eff_used."""
    det = 1 - F.col("r12") * F.col("r12")
    safe = F.greatest(det, F.lit(1e-12))
    b1, b2 = (F.col("r1") - F.col("r12") * F.col("r2")) / safe, (F.col("r2") - F.col("r12") * F.col("r1")) / safe
    out = r.withColumns({"beta1": b1, "beta2": b2})
    left = F.greatest(F.lit(1e-12), 1 - (F.col("beta1") * F.col("r1") + F.col("beta2") * F.col("r2")))
    se = F.when(det > 1e-12, F.sqrt(left / F.greatest(F.lit(1.0), F.col("n_eff_used") - 3) / safe))
    out = out.withColumns({"t1": F.col("beta1") / se, "t2": F.col("beta2") / se})
    return out.withColumn("winner", F.when(F.abs("t1") > F.abs("t2"), F.lit("SII")).when(F.col("t2").isNotNull(), F.lit("F10.7")))


def fisher_meta(results: DataFrame, by: Sequence[str], rho: str = "rho", n_eff: str = "n_eff") -> DataFrame:
    """Correlations joined by Fisher z weighted with max(n_eff - 3, 1), and the p of the sum of n_eff."""
    w = F.greatest(F.col(n_eff) - 3, F.lit(1.0))
    z = F.when(F.col(rho).isNotNull(), S.fisher_z(F.col(rho), 0.99) * w)
    joined = results.groupBy(*by).agg(F.tanh(F.try_divide(F.sum(z), F.sum(w))).alias("spearman_r"), F.sum(n_eff).alias("n_eff_total"))
    return joined.withColumn("p_value", D.p_mechanism(F.col("spearman_r"), F.col("n_eff_total")))
