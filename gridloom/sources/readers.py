"""Readers. Every table leaves here with NULLs for missing values."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.sources import netcdf

#: Places of the fields of a record, and what stands for missing there.
FIELDS, YEAR, DAY, HOUR, KP, DST, F10 = 51, 0, 1, 2, 38, 40, 50
FILL_KP, FILL_DST, FILL_F10 = 99, 99999, 999.9


def zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of the largest member of each zip archive, bytes that aren't UTF-8 left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z, z.open(max(z.infolist(), key=lambda i: i.file_size)) as member:
                    lines = []
                    for line in io.TextIOWrapper(member, "utf-8", errors="ignore"):
                        lines.append(line.rstrip("\r\n"))
                        if len(lines) == 50_000:
                            yield pa.RecordBatch.from_arrays([pa.array(lines)], ["value"])
                            lines = []
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string")


def parse_records(lines: DataFrame, value: str = "value") -> DataFrame:
    """time, kp, dst, f10_7 and sii (-dst) of white-space records; malformed ones and impossible times go."""
    # Generators keep the optimiser from putting the split into every condition below.
    parts = lines.select(F.explode(F.array(F.split(F.trim(F.col(value)), r"\s+"))).alias("p")).where(F.size("p") >= FIELDS)
    number = lambda i: F.try_element_at("p", F.lit(i + 1)).try_cast("double")
    raw = parts.select(F.inline(F.array(F.struct(*[number(i).alias(n) for i, n in ((YEAR, "y"), (DAY, "d"), (HOUR, "h"), (KP, "kp"), (DST, "dst"), (F10, "f10_7"))]))))
    valid = raw.where(F.col("y").between(1900, 2100) & F.col("d").isNotNull() & F.col("h").isNotNull() & F.col("kp").isNotNull() & F.col("dst").isNotNull() & F.col("f10_7").isNotNull())
    timed = valid.select(S.timestamp_of(F.col("y").cast("int"), F.col("d").cast("int"), F.col("h").cast("int")).alias("time"), F.nullif("kp", F.lit(float(FILL_KP))).alias("kp"), F.nullif("dst", F.lit(float(FILL_DST))).alias("dst"), F.nullif("f10_7", F.lit(FILL_F10)).alias("f10_7"))
    return timed.where(F.col("time").isNotNull()).withColumn("sii", S.sign_flip(F.col("dst")))


def _array_files(spark: SparkSession, path: str, glob: str | None, rows, schema: str) -> DataFrame:
    """``rows`` (name, variables) -> record batches of every array file below the path; a file is one row of a task."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                yield from rows(name.as_py(), netcdf.opened(content.as_py()))

    return files.mapInArrow(run, schema)


def grid_files(spark: SparkSession, path: str, variables: dict[str, str], glob: str | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """file, time, latitude, longitude, the extra dimensions' values and the variables (renamed) of gridded array files, flattened.

    NetCDF (``sources.netcdf``) or NumPy archives; coordinates may be named lat, lon and valid_time. Variables lie over
    these three in any order, and over ``extra`` (say expver); other dimensions must have length 1. Fill values are NULL, scaled values
    unpacked, times decoded by their units. A file that lacks a variable or a coordinate gives no rows.
    """
    places = (("time", "valid_time", "date"), ("latitude", "lat"), ("longitude", "lon"))
    names = ["file", "time", "latitude", "longitude", *extra, *variables.values()]

    def rows(name: str, found: dict) -> Iterator[pa.RecordBatch]:
        axes = [next((n for n in known if n in found), None) for known in places]
        if None in axes or not all(v in found for v in (*variables, *extra)):
            return
        order = [axes[0], *extra, *axes[1:]]

        def cube(v: netcdf.Variable) -> np.ndarray:
            """Its values over ``order``; what it lacks of that has length 1."""
            free = [d for d in v.dimensions if d not in order]
            if any(v.values.shape[v.dimensions.index(d)] != 1 for d in free):
                raise ValueError(f"{name}: a variable lies over {', '.join(free)}, too")
            kept = [d for d in v.dimensions if d in order]
            values = v.numbers().reshape([n for d, n in zip(v.dimensions, v.values.shape) if d in order])
            values = values.transpose([kept.index(d) for d in order if d in kept])
            return values.reshape([values.shape[[d for d in order if d in kept].index(d)] if d in kept else 1 for d in order])

        cubes = [cube(found[v]) for v in variables]
        coordinates = [np.atleast_1d(found[a].times() if i == 0 else found[a].numbers()) for i, a in enumerate(order)]
        shape = tuple(map(len, coordinates))
        for i in np.ndindex(*shape[: 1 + len(extra)]):  # one step of time at a time
            n, flat = shape[-2] * shape[-1], lambda a: np.broadcast_to(a, shape)[i].ravel()  # noqa: E731, B023
            steps = [pa.array(np.full(n, coordinates[k][i[k]]), from_pandas=True) for k in range(1 + len(extra))]
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), steps[0], pa.array(np.repeat(coordinates[-2], shape[-1])), pa.array(np.tile(coordinates[-1], shape[-2])), *steps[1:], *(pa.array(flat(c), from_pandas=True) for c in cubes)], names)

    return _array_files(spark, path, glob, rows, "file string, time timestamp_ntz, " + ", ".join(f"{v} double" for v in names[2:]))


def swath_files(spark: SparkSession, path: str, variables: dict[str, str], quality: Sequence[str], glob: str | None = None) -> DataFrame:
    """file, quality and the variables (renamed) of the points of swath files, whatever the variables' shape.

    quality is the first of the named flags that a file has. A file without one, without a variable, or with variables of different sizes gives no
    rows. ``swath_points`` takes the date from the name and keeps the good points.
    """
    names = ["file", "quality", *variables.values()]

    def rows(name: str, found: dict) -> Iterator[pa.RecordBatch]:
        flag = next((q for q in quality if q in found), None)
        if flag is None or not all(v in found for v in variables) or len({found[v].values.size for v in (flag, *variables)}) > 1:
            return
        columns = [found[v].numbers().ravel() for v in (flag, *variables)]
        for at in range(0, len(columns[0]), 50_000):
            part = [c[at : at + 50_000] for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(part[0])), *(pa.array(c, from_pandas=True) for c in part)], names)

    return _array_files(spark, path, glob, rows, "file string, " + ", ".join(f"{v} double" for v in names[1:]))


def merged_months(frames: dict[str, DataFrame], keys: Sequence[str] = ("time", "latitude", "longitude")) -> DataFrame:
    """Variables of several files joined on time and place; of two versions of a value (expver 1, 5) the first known; longitudes wrapped."""
    out = None
    for name, df in frames.items():
        if "expver" in df.columns:
            df = df.groupBy(*keys).agg(F.coalesce(*[F.max(F.when(F.col("expver") == v, F.col(name))) for v in (1, 5)]).alias(name))
        df = df.select(*keys, name)
        out = df if out is None else out.join(df, [*keys])
    return out.withColumn("longitude", S.wrap_longitude(F.col("longitude")))


def env_variables(raw: DataFrame) -> DataFrame:
    """temp_c, vpd, par and tcc from t2m, d2m (kelvin), ssrd and tcc."""
    t, d = S.to_celsius(F.col("t2m")), S.to_celsius(F.col("d2m"))
    return raw.select("time", "latitude", "longitude", t.alias("temp_c"), S.vapour_deficit(t, d).alias("vpd"), S.par(F.col("ssrd")).alias("par"), "tcc")


def swath_points(raw: DataFrame, file: str = "file", quality: Sequence[str] = ("quality",)) -> DataFrame:
    """Rows whose known quality flag (the first given column that the table has) is 0, with the date from the third part of the file's name (yymmdd)."""
    flag = next((q for q in quality if q in raw.columns), None)
    token = F.try_element_at(F.split(F.element_at(F.split(file, "/"), -1), "_"), F.lit(3))
    century = F.when(F.substring(token, 1, 2) >= "69", F.lit("19")).otherwise(F.lit("20"))  # two-digit years from 69 on are of the last century
    named = raw.withColumn("date", F.try_to_date(F.concat(century, token), "yyyyMMdd"))
    return (named.where(F.col(flag) == 0) if flag else named).where(F.col("date").isNotNull())


def table_between(spark: SparkSession, path: str, columns: Sequence[str], first, last, date: str = "date") -> DataFrame:
    """The columns of a Parquet table's rows between two dates; both reach the scan."""
    return spark.read.parquet(path).where(F.col(date).between(first, last)).select(*columns)


def result_files(spark: SparkSession, path: str, schema: str, targets: Sequence[str], prefix: str = "spearman_") -> DataFrame:
    """CSV results of many files, with the target by the longest known name that follows the prefix in the file's name, and the
    scenario after it; files of unknown targets give no rows."""
    rows = spark.read.schema(schema).option("header", True).csv(path).withColumn("_f", F.col("_metadata.file_name"))
    known = "|".join(sorted(targets, key=len, reverse=True))
    pattern = rf"^{prefix}({known})_(.+)\.csv$"
    named = rows.withColumns({"target": F.regexp_extract("_f", pattern, 1), "scenario": F.regexp_extract("_f", pattern, 2)})
    return named.where(F.col("target") != "").drop("_f")


def introspect(df: DataFrame) -> list[tuple[str, str]]:
    """Names and types of the columns, without reading rows."""
    return df.dtypes
