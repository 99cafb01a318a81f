"""Window operators. ``by`` always names the partition; a series without one must be short (a global daily series)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Buckets of a group's values that are ranked apart.
BUCKETS = 32


def _over(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*order)


def ma_prior(c: str, w: int, by: Sequence[str] = (), order: Sequence[str] = ("date",)) -> Column:
    """Mean of the w rows before this one; of fewer at the start, NULL at the very start."""
    return F.avg(c).over(_over(by, order).rowsBetween(-w, -1))


def ma_trailing(c: str, w: int, by: Sequence[str], order: Sequence[str] = ("date",)) -> Column:
    """Mean of this row and the w - 1 before it."""
    return F.avg(c).over(_over(by, order).rowsBetween(-(w - 1), 0))


def ma_strict(c: str, w: int, by: Sequence[str] = (), order: Sequence[str] = ("date",)) -> Column:
    """Mean of the w rows before this one, NULL unless all w are there and known."""
    frame = _over(by, order).rowsBetween(-w, -1)
    return F.when(F.count(c).over(frame) == w, F.avg(c).over(frame))


def many_trailing(df: DataFrame, c: str, windows: Sequence[int], by: Sequence[str], order: Sequence[str] = ("date",), prior: bool = False) -> DataFrame:
    """``df`` with c_ma{w} for every window, from running sums: one sort, work in proportion to rows and windows
    whatever the windows' lengths. ``prior`` leaves this row out."""
    over = _over(by, order)
    value = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    running = df.withColumns({"_s": F.sum(value).over(over.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.count(c).over(over.rowsBetween(Window.unboundedPreceding, 0))})
    last = 1 if prior else 0
    at = lambda name, k: F.lag(name, k, 0).over(over) if k else F.col(name)
    means = {f"{c}_ma{w}": F.try_divide(at("_s", last) - at("_s", w + last), (at("_n", last) - at("_n", w + last)).cast("double")) for w in windows}
    return running.withColumns(means).drop("_s", "_n")


def lag_smoothed(df: DataFrame, c: str, lags: Sequence[int], smooth: int = 3, by: Sequence[str] = (), order: Sequence[str] = ("date",)) -> DataFrame:
    """``df`` with c_lag{l}: the centred mean of ``smooth`` rows, l rows ago."""
    over, half = _over(by, order), smooth // 2
    smoothed = df.withColumn("_m", F.avg(c).over(over.rowsBetween(-half, half)))
    return smoothed.withColumns({f"{c}_lag{k}": F.lag("_m", k).over(over) for k in lags}).drop("_m")


def difference(c: str, by: Sequence[str] = (), order: Sequence[str] = ("date",)) -> Column:
    return F.col(c) - F.lag(c).over(_over(by, order))


def ordinal_rank(c: str, by: Sequence[str], ties: Sequence[str]) -> Column:
    """Ranks from 1 without ties; equal values follow the order of ``ties``."""
    return F.row_number().over(_over(by, [c, *ties]))


def average_rank(c: str, by: Sequence[str]) -> Column:
    """Ranks from 1; equal values share the mean of theirs."""
    return F.rank().over(_over(by, [c])) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2


def ranked_values(values: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``values`` (keys, _y, _c: distinct values with counts) with _r, the average rank, and _n, the group's count.

    Values are dealt into buckets by quantiles of their group by ``by`` (some of ``keys``) and ranked there, so that no task
    has to sort a whole group; what lies in the buckets before is added.
    """
    cuts = values.groupBy(*by).agg(F.percentile_approx("_y", F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)]), F.lit(1000)).alias("_cuts"))
    bucketed = values.join(cuts, [*by]).withColumn("_b", F.size(F.filter("_cuts", lambda x: x < F.col("_y")))).drop("_cuts")
    sums = bucketed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_all"))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_all").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*keys, "_b", before.alias("_base"), F.sum("_all").over(group).alias("_n"))
    inner = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return bucketed.withColumn("_i", inner).join(sums, [*keys, "_b"]).withColumn("_r", F.col("_base") + F.col("_i") + (F.col("_c") + 1) / 2).select(*keys, "_y", "_r", "_n")


def bh_fdr(df: DataFrame, p: str, by: Sequence[str], out: str = "p_fdr") -> DataFrame:
    """``df`` with Benjamini-Hochberg q-values within ``by``; a NULL p has a NULL q and doesn't count."""
    known = F.col(p).isNotNull()
    group = Window.partitionBy(*by, known)
    ranked = df.withColumns({"_r": F.row_number().over(group.orderBy(p)), "_m": F.count(F.lit(1)).over(group)})
    step_up = F.min(F.col("_m") / F.col("_r") * F.col(p)).over(group.orderBy("_r").rowsBetween(0, Window.unboundedFollowing))
    return ranked.withColumn(out, F.when(known, F.least(F.greatest(step_up, F.lit(0.0)), F.lit(1.0)))).drop("_r", "_m")


def local_peaks(grid: DataFrame, row: str, column: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``grid`` with is_max and is_min: largest and above 0, or smallest and below 0, of its 3 x 3 neighbourhood.

    Every cell is sent to its nine neighbours and aggregated there; NULL cells are neither.
    """
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    sent = grid.select(*by, row, column, value, F.explode(steps).alias("s")).select(*by, (F.col(row) + F.col("s.i")).alias(row), (F.col(column) + F.col("s.j")).alias(column), F.col(value).alias("_v"))
    around = sent.groupBy(*by, row, column).agg(F.max("_v").alias("_hi"), F.min("_v").alias("_lo"))
    v = F.col(value)
    return grid.join(around, [*by, row, column]).withColumns({"is_max": F.coalesce((v == F.col("_hi")) & (v > 0), F.lit(False)), "is_min": F.coalesce((v == F.col("_lo")) & (v < 0), F.lit(False))}).drop("_hi", "_lo")


def segment_midpoints(df: DataFrame, x: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Between each row and the next: the mean x and the mean value."""
    over = _over(by, [x])
    return df.select(*by, ((F.col(x) + F.lead(x).over(over)) / 2).alias("mid"), ((F.col(value) + F.lead(value).over(over)) / 2).alias("mid_value")).where("mid is not null")
