"""Joins of panels, land-cover grids, flags and the global daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom import config as C
from gridloom.functions import scalars as S

CELL = ("lat_id", "lon_id")
KEYS = ("date", *CELL)


def broadcast_daily(daily: DataFrame) -> DataFrame:
    """A global daily series as the small side of a join: one row a day, a few thousand days at most."""
    return F.broadcast(daily)


def dilated(grid: DataFrame, keys: Sequence[str], rows: str = "lat_id", columns: str = "lon_id", step: int = C.CELL_STEP) -> DataFrame:
    """``grid`` spread to the 3 x 3 neighbourhood: a cell takes its own values, else those of the first neighbour
    that has some, from the lowest row offset up and there from the lowest column offset up.

    One aggregation: every row goes to nine cells with its place in that order.
    """
    offsets = [(0, 0), *((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0))]
    steps = F.array(*[F.struct(F.lit(n).alias("place"), F.lit(i * step).alias("i"), F.lit(j * step).alias("j")) for n, (i, j) in enumerate(offsets)])
    others = [c for c in grid.columns if c not in (*keys, rows, columns)]
    rest = [k for k in keys if k not in (rows, columns)]
    spread = grid.select(*rest, (F.col(rows)).alias("_r"), F.col(columns).alias("_c"), F.struct(*others).alias("_v"), F.explode(steps).alias("_s"))
    moved = spread.select(*rest, (F.col("_r") + F.col("_s.i")).cast(grid.schema[rows].dataType).alias(rows), (F.col("_c") + F.col("_s.j")).cast(grid.schema[columns].dataType).alias(columns), "_v", F.col("_s.place").alias("_p"))
    best = moved.groupBy(*rest, rows, columns).agg(F.min_by("_v", "_p").alias("_v"))
    return best.select(*rest, rows, columns, *[F.col(f"_v.{c}").alias(c) for c in others])


def with_land_cover(points: DataFrame, cover: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Points with the land cover of their eight-day period; points without any keep NULLs and has_cover false."""
    keyed = points.withColumn("period", S.period_start(F.col("date")))
    side = cover.withColumnRenamed("date", "period").withColumn("has_cover", F.lit(True))
    return keyed.join(side, ["period", *keys], "left").withColumn("has_cover", F.coalesce("has_cover", F.lit(False)))


def covered(points: DataFrame) -> DataFrame:
    """Rows with land cover that passes the cloud, aerosol and leaf thresholds."""
    cloud, aerosol, lai = S.cover_defaults(F.col("cloud"), F.col("aerosol"), F.col("lai"))
    return points.where(F.col("has_cover") & (cloud < C.CLOUD_MOST) & (aerosol < C.AEROSOL_MOST) & (lai >= C.LAI_LEAST))


def universe(residuals: DataFrame, flags: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Residuals that have flags, with them."""
    return residuals.join(flags, [*keys])


def by_scenario(panel: DataFrame, flags: str = "region_flags") -> DataFrame:
    """A row for each scenario that a row's flags meet, all scenarios in one pass (a 4-row dimension)."""
    scenarios = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(r).alias("required"), F.lit(f).alias("forbidden")) for n, r, f in C.SCENARIOS])
    met = F.filter(scenarios, lambda s: S.has_bits(F.col(flags), s["required"], s["forbidden"]))
    return panel.select("*", F.explode(met).alias("_s")).select(*panel.columns, F.col("_s.scenario").alias("scenario"))


def restricted(rows: DataFrame, keys: DataFrame, on: Sequence[str] = KEYS) -> DataFrame:
    """The rows whose key is among ``keys``, each once."""
    return rows.join(keys.select(*on), [*on], "left_semi")


def skeleton(spark, **dimensions: Sequence) -> DataFrame:
    """All combinations of a few short lists."""
    first, *rest = [spark.createDataFrame([(v,) for v in values], [name]) for name, values in dimensions.items()]
    for d in rest:
        first = first.crossJoin(F.broadcast(d))
    return first


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row of each key: the first in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def regridded(grid: DataFrame, value: str, by: Sequence[str], resolution: float = C.RESOLUTION, source_step: float = 0.25) -> DataFrame:
    """``value`` at the nodes of the target grid by bilinear weights of the enclosing source nodes.

    Every source node adds its weighted value to the target nodes less than a source step away; a target
    node lacking a corner with weight is NULL, and left out if it has none. Longitudes at +180 have no source.
    """
    per = resolution / source_step
    row, column = F.rint((F.col("latitude") + 90) / source_step), F.rint((F.col("longitude") + 180) / source_step)
    near = lambda x: F.array_distinct(F.array(F.floor(x / per), F.ceil(x / per)))
    placed = grid.select(*by, F.col(value).alias("_v"), row.alias("_r"), column.alias("_c"))
    spread = placed.withColumn("_i", F.explode(near(F.col("_r")))).withColumn("_j", F.explode(near(F.col("_c"))))
    weight = (1 - F.abs(F.col("_r") - F.col("_i") * per)) * (1 - F.abs(F.col("_c") - F.col("_j") * per))
    touching = spread.withColumn("_w", weight).where((F.abs(F.col("_r") - F.col("_i") * per) < 1) & (F.abs(F.col("_c") - F.col("_j") * per) < 1) & (F.col("_w") > 0))
    summed = touching.groupBy(*by, "_i", "_j").agg(F.sum(F.col("_v") * F.col("_w")).alias("_s"), F.sum(F.when(F.col("_v").isNotNull(), F.col("_w"))).alias("_t"))
    return summed.select(*by, (F.col("_i") * resolution - 90).alias("latitude"), (F.col("_j") * resolution - 180).alias("longitude"), F.when(F.col("_t") > 1 - 1e-9, F.col("_s")).alias(value))
