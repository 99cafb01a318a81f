"""Regression models: harmonic trend per cell, exhaustive grid of window triples, permutation surrogates."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom import config as C
from gridloom.functions import scalars as S
from gridloom.functions.distributions import t_two_sided
from gridloom.operators import windows as W


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _least_squares(gram: pd.Series, right: pd.Series) -> pd.Series:
    """Minimum-norm solutions of many small normal equations (row-major)."""
    b = np.stack([np.asarray(x, float) for x in right]) if len(right) else np.empty((0, 1))
    a = np.stack([np.asarray(x, float).reshape(b.shape[1], -1) for x in gram]) if len(gram) else np.empty((0, 1, 1))
    return pd.Series([*np.einsum("nij,nj->ni", np.linalg.pinv(a, rcond=1e-12, hermitian=True), b)])


def harmonic_fit(observed: DataFrame, y: str, by: Sequence[str], trend: bool = True, least: int = C.MIN_OBSERVATIONS, date: str = "date") -> tuple[DataFrame, DataFrame]:
    """(parameters per group, residuals on each group's full calendar) of y ~ 1 [+ t] + cos + sin.

    t runs from 0 to 1 over a group's days. Groups with fewer than ``least`` values are left out. One pass sums the
    products of the design per group, the small systems are solved, a second pass projects. sigma and the
    residuals' deviation are over n; R2 is 0 without variance.
    """
    group = Window.partitionBy(*by)
    known = observed.where(F.col(y).isNotNull() & F.col(date).isNotNull()).select(*by, date, F.col(y).cast("double").alias("_y"))
    known = known.withColumns({"_n": F.count(F.lit(1)).over(group), "_first": F.min(date).over(group), "_span": F.datediff(F.max(date).over(group), F.min(date).over(group))}).where(F.col("_n") >= least)
    cosine, sine = S.harmonics(S.year_fraction(F.col(date)))
    t = F.coalesce(F.try_divide(F.datediff(date, "_first").cast("double"), F.col("_span").cast("double")), F.lit(0.0))
    names = ["_1", *(["_t"] if trend else []), "_c", "_s"]
    design = known.withColumns({"_1": F.lit(1.0), "_t": t, "_c": cosine, "_s": sine})
    products = [F.sum(F.col(a) * F.col(b)) for a in names for b in names]
    sums = design.groupBy(*by, "_first", "_span").agg(F.array(*products).alias("_g"), F.array(*[F.sum(F.col(a) * F.col("_y")) for a in names]).alias("_b"), F.count(F.lit(1)).alias("n_obs"))
    solved = sums.withColumn("_beta", _least_squares("_g", "_b")).drop("_g", "_b")
    beta = {n: F.col("_beta")[i] for i, n in enumerate(names)}
    fitted = sum((beta[n] * F.col(n) for n in names[1:]), beta["_1"])
    errors = design.drop("_first", "_span").join(solved, [*by]).withColumn("_e", F.col("_y") - fitted)
    quality = errors.groupBy(*by).agg(F.stddev_pop("_e").alias("sigma"), F.sum(F.col("_e") * F.col("_e")).alias("_sse"), (F.var_pop("_y") * F.count(F.lit(1))).alias("_sst"))
    parameters = solved.join(quality, [*by]).select(
        *by, beta["_1"].alias("alpha0"), (beta["_t"] if trend else F.lit(0.0)).alias("alpha_t"), beta["_c"].alias("beta_cos"), beta["_s"].alias("beta_sin"), S.amplitude(beta["_c"], beta["_s"]).alias("amplitude"), S.phase(beta["_c"], beta["_s"]).alias("phase"),
        "sigma", F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst")).otherwise(F.lit(0.0)).alias("r_squared"), "n_obs",
    )
    days = solved.select(*by, F.explode(F.sequence("_first", F.expr("date_add(_first, _span)"))).alias(date))
    dense = days.join(errors.select(*by, date, F.col("_e").alias("residual")), [*by, date], "left").join(quality.select(*by, "sigma"), [*by])
    return parameters, dense.withColumn("std_residual", S.standardised(F.col("residual"), F.col("sigma"))).drop("sigma")


def _merged(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, products about the means) of two sets of rows together."""
    n, off = a[0] + b[0], b[1] - a[1]
    return n, a[1] + off * (b[0] / n), a[2] + b[2] + np.outer(off, off) * (a[0] * b[0] / n)


def grid_search(df: DataFrame, y: str, families: dict[str, dict[int, str]], by: Sequence[str], n_eff: DataFrame) -> DataFrame:
    """Every regression y ~ a_w1 + b_w2 + c_w3 + 1 with one window from each of three families, per group.

    The data are read once: partitions sum the cross products of all columns about their own means, the sums are merged
    about the group's, and each model is a 3 x 3 part of the group's matrix. Rows with a missing value in any column don't count; near-singular models
    are left out. t uses n - 4 degrees of freedom, p uses max(1, n_eff - 4), n_eff from the table given.
    """
    columns = [y, *(c for f in families.values() for c in f.values())]
    held = df.select(*by, F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"))
    keys = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in by)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, tuple] = {}
        kinds = None
        for batch in batches:
            kinds = [c.type for c in batch.columns[:-1]]
            x = batch.column(len(by)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(columns))
            finite = ~np.isnan(x).any(axis=1)
            group: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(c.to_pylist() for c in batch.columns[:-1]))):
                if finite[i]:
                    group.setdefault(key, []).append(i)
            for key, at in group.items():
                mean = x[at].mean(axis=0)
                centred = x[at] - mean
                part = len(at), mean, centred.T @ centred
                sums[key] = _merged(sums[key], part) if key in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([*(pa.array(k, t) for k, t in zip(zip(*sums), kinds)), pa.array([n for n, _, _ in sums.values()], pa.int64()), pa.array([m for _, m, _ in sums.values()], pa.list_(pa.float64())), pa.array([g.ravel() for _, _, g in sums.values()], pa.list_(pa.float64()))], [*by, "n", "mean", "gram"])

    names = [*families]
    windows = [*itertools.product(*(f for f in families.values()))]
    place = {c: i for i, c in enumerate(columns)}
    models = np.array([[place[families[f][w]] for f, w in zip(names, ws)] for ws in windows])

    def solve(key: tuple, parts: pa.Table) -> pa.Table:
        n, _, gram = functools.reduce(_merged, [(n, m.values.to_numpy(), g.values.to_numpy().reshape(len(columns), -1)) for n, m, g in zip(parts["n"].to_pylist(), parts["mean"], parts["gram"])])
        a, b = gram[models[:, :, None], models[:, None, :]], gram[models, 0]
        scale = np.sqrt(np.maximum(np.einsum("nii->ni", a), 1e-300))
        corr = a / scale[:, :, None] / scale[:, None, :]
        good = (np.linalg.det(corr) > 1e-12) & (n > 4)
        corr, scale, b, chosen = corr[good], scale[good], b[good], np.array(windows).reshape(-1, len(names))[good]
        inverse = np.linalg.inv(corr) / scale[:, :, None] / scale[:, None, :]
        beta = np.einsum("nij,nj->ni", inverse, b)
        rss = np.maximum(gram[0, 0] - np.einsum("ni,ni->n", beta, b), 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = beta / np.sqrt(np.einsum("nii->ni", inverse) * (rss / max(1, n - 4))[:, None])
        out = {k: pa.array([v.as_py()] * len(beta), v.type) for k, v in zip(by, key)} | {f"{f}_window": pa.array(chosen[:, i], pa.int32()) for i, f in enumerate(names)}
        n_eff = parts["n_eff"][0].as_py()
        out |= {"n": pa.array([n] * len(beta), pa.int64()), "n_eff": pa.array([n_eff] * len(beta), pa.float64()), "rss": pa.array(rss)}
        for i, f in enumerate(names):
            p = t_two_sided(np.abs(t[:, i]), max(1.0, n_eff - 4)) if n_eff is not None else np.full(len(t), np.nan)
            out |= {f"beta_{f}": pa.array(beta[:, i]), f"t_{f}": pa.array(t[:, i]), f"p_{f}": pa.array(p, from_pandas=True)}
        return pa.table(out)

    grams = held.mapInArrow(partial, f"{keys}, n long, mean array<double>, gram array<double>")
    schema = f"{keys}, " + ", ".join(f"{f}_window int" for f in names) + ", n long, n_eff double, rss double, " + ", ".join(f"beta_{f} double, t_{f} double, p_{f} double" for f in names)
    sized = grams.join(n_eff.select(*by, "n_eff"), [*by], "left")
    return sized.groupBy(*by).applyInArrow(solve, schema)


def year_orders(years: Sequence[int], draws: int, seed: int = C.SURROGATE_SEED) -> list[list[int]]:
    """Orders of whole years, drawn one after the other; an identical order is drawn again, 20 times at most."""
    if len(years) < 3:
        raise ValueError("fewer than three years can't be permuted")
    rng, own = np.random.default_rng(seed), np.array(sorted(years))
    moved = lambda: next((o for o in (rng.permutation(own) for _ in range(21)) if (o != own).any()), own)
    return [moved().tolist() for _ in range(draws)]


def average_ranks_weighted(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Average ranks of values that stand for n rows each."""
    values, where = np.unique(x, return_inverse=True)
    total = np.bincount(where, n, len(values))
    before = np.r_[0.0, np.cumsum(total)[:-1]]
    return (before + (total + 1) / 2)[where]


def surrogate_spectra(spark: SparkSession, residuals: DataFrame, daily: DataFrame, base: str, windows: Sequence[int], draws: int = C.SURROGATES, seed: int = C.SURROGATE_SEED, by: Sequence[str] = (), least: int = 1) -> DataFrame:
    """by, kind, surrogate_id, window, rho: rank correlation of a group's residuals with the base's strict trailing means, for the
    series as it is (observed, id -1) and with its years permuted.

    The series has one value a day, so residuals count only through each day's number of rows and sum of ranks; that is
    one aggregation of the data, whatever the draws and groups. Means run over the group's own days; days without
    all windows are left out before ranking, for all draws alike. Groups with fewer than three years, or fewer than ``least`` rows
    left, give no rows. Groups with the same years have the same orders. ``by`` names few groups (targets, scenarios, bins): the driver holds a
    row for each of their days.
    """
    skipped, group = max(windows), F.struct(*by) if by else F.lit(0)
    # Kept, as five steps below read it: the residuals are computed once.
    own = residuals.where(F.col("residual").isNotNull()).groupBy(group.alias("_key"), "date", F.col("residual").alias("_y")).agg(F.count(F.lit(1)).alias("_c")).persist()
    series = daily.where(F.col(base).isNotNull()).select("date", F.col(base).cast("double").alias("x"))
    days = own.select("_key", "date").distinct().join(F.broadcast(series), "date").withColumn("_i", F.row_number().over(Window.partitionBy("_key").orderBy("date")))
    used = days.where(F.col("_i") > skipped).select("_key", "date")
    cells = own.join(F.broadcast(used), ["_key", "date"])
    ranks = W.ranked_values(cells.groupBy("_key", "_y").agg(F.sum("_c").alias("_c")), ["_key"], ["_key"])
    r, times = F.col("_r"), F.col("_c")
    sums = cells.join(ranks, ["_key", "_y"]).groupBy("_key", "date").agg(F.sum("_c").alias("n"), F.sum(r * times).alias("s"), F.sum(r * r * times).alias("q"))
    # Some thousand days a group: the only table that the driver holds.
    names = [f"_k{i}" for i in range(len(by))]
    held = days.join(sums, ["_key", "date"], "left").select(*[F.col("_key")[c].alias(k) for c, k in zip(by, names)], F.lit(0).alias("_all"), F.year("date").alias("year"), "x", "n", "s", "q").orderBy(*names, "date").toPandas()
    own.unpersist()
    groups = []
    for (*key, _), g in held.groupby([*names, "_all"], sort=False, dropna=False):
        n, s, q = (g[c].iloc[skipped:].to_numpy(float) for c in "nsq")
        if g["year"].nunique() >= 3 and n.sum() >= least:
            blocks = {int(y): v["x"].to_numpy() for y, v in g.groupby("year")}
            groups.append((key, blocks, [sorted(blocks), *year_orders([*blocks], draws, seed)], n, s, q.sum() - s.sum() ** 2 / n.sum()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for at, i in (divmod(int(v), draws + 1) for v in pdf["id"]):
                key, blocks, orders, n, s, y_ss = groups[at]
                total = n.sum()
                running = np.r_[0.0, np.cumsum(np.concatenate([blocks[y] for y in orders[i]]))]
                for w in windows:
                    mean = (running[skipped:-1] - running[skipped - w : -1 - w]) / w
                    r = average_ranks_weighted(np.round(mean, 9), n)
                    cov, x_ss = (r * s).sum() - (r * n).sum() * s.sum() / total, (r * r * n).sum() - (r * n).sum() ** 2 / total
                    rows.append((*key, "surrogate" if i else "observed", i - 1, w, cov / np.sqrt(x_ss * y_ss) if x_ss > 0 and y_ss > 0 else None))
            yield pd.DataFrame(rows, columns=[*by, "kind", "surrogate_id", "window", "rho"])

    work = len(groups) * (draws + 1)
    tasks = max(1, min(work, 4 * spark.sparkContext.defaultParallelism))
    keys = "".join(f"{c} {residuals.schema[c].dataType.simpleString()}, " for c in by)
    return spark.range(work, numPartitions=tasks).mapInPandas(run, f"{keys}kind string, surrogate_id long, window int, rho double")


def surrogate_summary(metrics: DataFrame, metric: str, two_sided: bool, by: Sequence[str] = ()) -> DataFrame:
    """by, metric, the observed value, and mean, std (n - 1), quantiles and Monte-Carlo p of the surrogates' values."""
    own, drawn = F.when(F.col("kind") == "observed", F.col(metric)), F.when(F.col("kind") == "surrogate", F.col(metric))
    # A group of ``by`` has a row for each draw and stays in one task; without groups the one observed value goes to all rows.
    observed = metrics.withColumn("observed", F.max(own).over(Window.partitionBy(*by))) if by else metrics.join(F.broadcast(metrics.agg(F.max(own).alias("observed"))))
    beyond: Column = F.abs(drawn) >= F.abs("observed") if two_sided else drawn >= F.col("observed")
    summed = observed.groupBy(*by).agg(F.max("observed").alias("observed"), F.count(drawn).alias("n_surrogates"), F.avg(drawn).alias("surrogate_mean"), F.stddev_samp(drawn).alias("surrogate_std"), F.percentile(drawn, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("_q"), F.sum(beyond.cast("int")).alias("_k"))
    return summed.select(*by, F.lit(metric).alias("metric"), "observed", "n_surrogates", "surrogate_mean", "surrogate_std", *[F.col("_q")[i].alias(f"surrogate_{n}") for i, n in enumerate(("q025", "q500", "q975"))], F.try_divide(1.0 + F.col("_k"), F.col("n_surrogates") + 1).alias("p_empirical"))
