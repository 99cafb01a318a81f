"""Scalar expressions: columns in, a column out, evaluated by Spark alone.

Missing values are NULL throughout; ``null_if_nan`` brings floating-point tables to that. Results are NULL where an
input is, unless said otherwise. Divisions and parses never raise under ANSI mode.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import config as C


def null_if_nan(c: Column) -> Column:
    """NULL for NaN and the infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """``df`` with non-finite values of its floating-point columns as NULL."""
    return df.withColumns({c: null_if_nan(F.col(c)) for c, kind in df.dtypes if kind in ("float", "double")})


def sign_flip(c: Column) -> Column:
    return -c


def timestamp_of(year: Column, day_of_year: Column, hour: Column) -> Column:
    """The hour of a day of a year; NULL if there is no such hour or day."""
    first = F.make_date(year, F.lit(1), F.lit(1))
    last = F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))
    valid = day_of_year.between(1, last) & hour.between(0, 23)
    return F.when(valid, F.timestamp_add("HOUR", hour.cast("int"), F.date_add(first, (day_of_year - 1).cast("int")).cast("timestamp_ntz")))


def grid_snap(x: Column, resolution: float = C.RESOLUTION) -> Column:
    """The nearest multiple of the resolution; halves go to the even one."""
    return F.rint(x / resolution) * resolution


def cell_id(degrees: Column) -> Column:
    return F.rint(degrees * 100).cast("short")


def period_start(day: Column) -> Column:
    """The first day of the eight-day period of the year that holds the day."""
    return F.date_add(F.trunc(day, "year"), (F.floor((F.dayofyear(day) - 1) / 8) * 8).cast("int"))


def wrap_longitude(lon: Column) -> Column:
    """-180 up to, not including, 180."""
    return F.pmod(lon + 180, F.lit(360)) - 180


def to_celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def saturation_pressure(celsius: Column) -> Column:
    """kPa, after Tetens."""
    return 0.6108 * F.exp(17.27 * celsius / (celsius + 237.3))


def vapour_deficit(temperature: Column, dew_point: Column) -> Column:
    """kPa, not below 0; NULL if either input is."""
    raw = saturation_pressure(temperature) - saturation_pressure(dew_point)
    return F.when(raw.isNotNull(), F.greatest(raw, F.lit(0.0)))


def par(radiation: Column) -> Column:
    """W/m2 of the useful part of an hour's radiation in J/m2."""
    return radiation / 3600 * 0.45


def in_box(lat: Column, lon: Column, box: C.Box) -> Column:
    return lat.between(box.south, box.north) & lon.between(box.west, box.east)


def _bits(*pairs: tuple[int, Column]) -> Column:
    """The OR of the bits whose condition holds; a NULL condition doesn't."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, F.lit(b)).otherwise(F.lit(0)) for b, c in pairs])


def region_flags(lat: Column, lon: Column) -> Column:
    control = in_box(lat, lon, C.BOX_CONTROL_WEST) | in_box(lat, lon, C.BOX_CONTROL_EAST)
    return _bits((C.SAA, in_box(lat, lon, C.BOX_SAA)), (C.CONTROL_NORTH, control), (C.POLAR, F.abs(lat) > C.POLAR_LATITUDE), (C.SAHARA, in_box(lat, lon, C.BOX_SAHARA))).cast("short")


def lai_flags(lai: Column) -> Column:
    """HIGH_LAI from the threshold on, LOW_LAI below, no bit if missing."""
    known = null_if_nan(lai)
    return _bits((C.HIGH_LAI, known >= C.LAI_VEGETATION), (C.LOW_LAI, known < C.LAI_VEGETATION)).cast("short")


def has_bits(flags: Column, required: Column | int, forbidden: Column | int = 0) -> Column:
    r, f = (x if isinstance(x, Column) else F.lit(x) for x in (required, forbidden))
    return (flags.cast("int").bitwiseAND(r) == r) & (flags.cast("int").bitwiseAND(f) == 0)


def in_scenario(flags: Column, scenario: str) -> Column:
    """Whether flags meet the scenario's bits; KeyError for an unknown scenario."""
    bits = {name: (required, forbidden) for name, required, forbidden in C.SCENARIOS}
    return has_bits(flags, *bits[scenario])


def bin_id(t: Column, edges: tuple[float, ...] = C.BIN_EDGES) -> Column:
    """Number of the right-closed bin; NULL for NULL."""
    out = F.when(t.isNull(), F.lit(None).cast("int"))
    for i, edge in enumerate(edges):
        out = out.when(t <= edge, F.lit(i))
    return out.otherwise(F.lit(len(edges)))


def bin_label(t: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in C.BIN_LABELS]), bin_id(t) + 1)


def guarded_ratio(a: Column, b: Column, least: float = C.RATIO_LEAST) -> Column:
    """a / b where b exceeds ``least``; NULL elsewhere and where the result isn't finite."""
    return F.when(b > least, null_if_nan(F.try_divide(a.cast("double"), b.cast("double"))))


def year_fraction(day: Column) -> Column:
    """The year and how much of it is over."""
    days = F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31)))
    return F.year(day) + (F.dayofyear(day) - 1) / days


def harmonics(fraction: Column) -> tuple[Column, Column]:
    """Cosine and sine of the yearly cycle."""
    return F.cos(2 * math.pi * fraction), F.sin(2 * math.pi * fraction)


def amplitude(cosine: Column, sine: Column) -> Column:
    return F.sqrt(cosine * cosine + sine * sine)


def phase(cosine: Column, sine: Column) -> Column:
    return F.atan2(sine, cosine)


def standardised(residual: Column, deviation: Column) -> Column:
    """The residual over its deviation, or over 1 if that is 0."""
    return residual / F.when(deviation > 0, deviation).otherwise(F.lit(1.0))


def feature_mode(name: Column) -> Column:
    """MA or LAG after the name's ending; NULL for others."""
    return F.when(name.rlike(r"_ma\d+$"), F.lit("MA")).when(name.rlike(r"_lag\d+$"), F.lit("LAG"))


def feature_window(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"_(?:ma|lag)(\d+)$", 1), F.lit("")).try_cast("int")


def variable_type(name: Column) -> Column:
    """SII, PAR or VPD by the first of these that the lower-case name holds."""
    low = F.lower(name)
    return F.when(low.contains("sii"), F.lit("SII")).when(low.contains("par"), F.lit("PAR")).when(low.contains("vpd"), F.lit("VPD"))


def clipped(x: Column, most: float) -> Column:
    """Between -most and most; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(most)), F.lit(-most)))


def fisher_z(r: Column, clip: float | None = 0.99) -> Column:
    """atanh of r, clipped first; without a clip NULL where |r| is 1 or more."""
    return F.atanh(clipped(r, clip)) if clip else F.when(F.abs(r) < 1, F.atanh(r))


def fisher_interval(r: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % interval of a correlation of n values."""
    z, half = fisher_z(r), 1.96 / F.sqrt(F.greatest(n - 3, F.lit(1)))
    return F.tanh(z - half), F.tanh(z + half)


def floored_p(p: Column) -> Column:
    """p, or the floor where it is missing, not finite or not positive."""
    return F.coalesce(F.when((p > 0) & ~F.isnan(p) & (p < float("inf")), p), F.lit(C.P_FLOOR))


def opacity_steps(p: Column) -> Column:
    """The opacity of the first level that p doesn't exceed, the last one beyond; 0 for a missing p."""
    out = F.when(p.isNull() | F.isnan(p), F.lit(0.0))
    for level, opacity in C.P_OPACITY:
        out = out.when(p <= level, F.lit(opacity))
    return out.otherwise(F.lit(C.P_OPACITY[-1][1]))


def opacity_log(p: Column, smallest: Column, largest: float = 0.05) -> Column:
    """From 1 at ``smallest`` down to 0.15 at ``largest``, linear in log p; 0 for a missing or non-positive p."""
    lo, inside = F.log10(smallest), F.least(F.greatest(p, smallest), F.lit(largest))
    share = (F.log10(inside) - lo) / (math.log10(largest) - lo + 1e-12)
    return F.when(p > 0, 1 - share * 0.85).otherwise(F.lit(0.0))


def p_text(p: Column) -> Column:
    """A printable p: empty if missing, a bound if it underflows, else three decimals or a power of ten."""
    power = F.floor(F.log10(F.when(p > 0, p).otherwise(F.lit(1.0)))).cast("int")
    small = F.format_string("p=%.1fe%d", p / F.pow(F.lit(10.0), power), power)
    return F.when(p.isNull(), F.lit("")).when(p < C.P_FLOOR, F.lit("p<1e-16")).when(p < 0.001, small).otherwise(F.format_string("p=%.3f", p))


def pretty_bin(raw: Column) -> Column:
    """Readable names of bins called min_to_x, above_x or x_to_y."""
    end = F.element_at(F.split(raw, "_"), -1)
    ends = F.split(raw, "_to_")
    return F.when(raw.contains("min_to"), F.concat(F.lit("≤ "), end, F.lit("°C"))).when(raw.contains("above"), F.concat(F.lit("> "), end, F.lit("°C"))).when(raw.contains("_to_"), F.concat(ends[0], F.lit(" - "), ends[1], F.lit("°C"))).otherwise(F.replace(raw, F.lit("_"), F.lit(" ")))


def bin_centres(edges: tuple[float, ...] = C.BIN_EDGES) -> list[float]:
    """Centres of the bins; open ends are as wide as the bins beside them."""
    full = [2 * edges[0] - edges[1], *edges, 2 * edges[-1] - edges[-2]]
    return [(a + b) / 2 for a, b in zip(full, full[1:])]


def cover_defaults(cloud: Column, aerosol: Column, lai: Column) -> tuple[Column, Column, Column]:
    """Values that fail every threshold in place of missing ones."""
    return F.coalesce(cloud, F.lit(999.0)), F.coalesce(aerosol, F.lit(999.0)), F.coalesce(lai, F.lit(-1.0))


def coordinate(cell: Column) -> Column:
    return cell / 100.0


def grid_index(degrees: Column, origin: float, count: int, resolution: float = C.RESOLUTION) -> Column:
    """Index on a grid that starts at ``origin``, cut to the grid."""
    return F.greatest(F.least(((degrees - origin) / resolution).cast("int"), F.lit(count - 1)), F.lit(0))


def colour_limits(lowest: Column, highest: Column) -> tuple[Column, Column, Column]:
    """(scheme, lower and upper limit) after the signs of the data: one side from 0, or both sides alike; 5 % margin."""
    most = F.greatest(F.abs(lowest), F.abs(highest)) * 1.05
    scheme = F.when(lowest.isNull(), F.lit("both")).when(lowest >= 0, F.lit("positive")).when(highest <= 0, F.lit("negative")).otherwise(F.lit("both"))
    lower = F.when(lowest.isNull(), F.lit(-1.0)).when(lowest >= 0, F.lit(0.0)).when(highest <= 0, F.when(lowest < 0, lowest * 1.05).otherwise(F.lit(-0.01))).otherwise(-most)
    upper = F.when(lowest.isNull(), F.lit(1.0)).when(lowest >= 0, F.when(highest > 0, highest * 1.05).otherwise(F.lit(0.01))).when(highest <= 0, F.lit(0.0)).otherwise(most)
    return scheme, lower, upper


def epoch_guess(x: Column, largest: Column) -> Column:
    """The moment that a number stands for, by the size of the column's largest: days, seconds, milliseconds or
    nanoseconds since 1970, and seconds that lost three digits twice (millions of milliseconds)."""
    n = x.cast("long")
    return (
        F.when(largest.between(1_000_001, 4_999_999), F.timestamp_millis(n * 1_000_000))
        .when(largest < 100_000, F.timestamp_seconds(n * 86_400))
        .when(largest < 500_000_000_000, F.timestamp_seconds(n))
        .when(largest < 500_000_000_000_000, F.timestamp_millis(n))
        .otherwise(F.timestamp_micros(F.floor(n / 1000)))
    )
