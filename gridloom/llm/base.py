"""Shared helpers: reading tables and finding the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no checkpoint folder and runs on a single machine.
OWN_FOLDER = "/tmp/checkpoints/gridloom"
#: What ``clean`` removes: paths below the shared folder, and tables of the catalog, of this process.
_paths: list[str] = []
_names: list[str] = []
#: A group is hot, see ``with_group``, from this share of all rows on.
HOT_GROUPS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, made the checkpoint folder if the session has none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named or OWN_FOLDER)
    return named or OWN_FOLDER


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_table(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table below the shared folder."""
    _paths.append(f"{shared_folder(spark).rstrip('/')}/gridloom-{name}-{uuid.uuid4().hex}")
    return _paths[-1]


def catalogued(name: str) -> str:
    """``name``, of a table in the catalog that ``clean`` drops."""
    _names.append(name)
    return name


def clean(spark: SparkSession) -> None:
    """Remove all that operators have written so far; results that aren't written yet are lost with it."""
    while _names:
        spark.sql(f"DROP TABLE IF EXISTS {_names.pop()}")
    while _paths:
        drop_table(spark, _paths.pop())


@atexit.register
def _clean_at_exit() -> None:
    """What a session that still runs at the end of the process has left over."""
    with contextlib.suppress(Exception):
        if (spark := SparkSession.getActiveSession()) and (_paths or _names):
            clean(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    path = new_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_group(rows: DataFrame, groups: DataFrame, key: str, values: str | tuple[str, ...], spread: Column) -> DataFrame:
    """``rows`` with the ``values`` of their group by ``key``, null where it has none; ``groups`` is a table (read twice).

    Groups have their number of rows in ``rows``. Those of more than one in HOT_GROUPS of all rows, which are fewer than
    HOT_GROUPS, are broadcast; their rows, and those without key, are spread by ``spread`` and meet nothing in the shuffle.
    """
    values = (values,) if isinstance(values, str) else values
    total = groups.agg(F.sum("rows")).first()[0] or 0
    hot = groups.where(F.col("rows") * HOT_GROUPS > total).select(F.col(key).alias("_hot"), F.struct(*values).alias("_of_hot"))
    cold = groups.where(F.col("rows") * HOT_GROUPS <= total).select(F.col(key).alias("_cold"), F.struct(*values).alias("_of_cold"))
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    alone = F.when(F.col("_hot").isNull(), F.col(key))
    met = met.withColumns({"_alone": alone, "_spread": F.when(alone.isNull(), spread)})
    met = met.join(cold.withColumn("_none", F.lit(None).cast("long")), F.col("_alone").eqNullSafe(F.col("_cold")) & F.col("_spread").eqNullSafe(F.col("_none")), "left")
    found = [F.coalesce(F.col(f"_of_hot.{v}"), F.col(f"_of_cold.{v}")).alias(v) for v in values]
    return met.select(*rows.columns, *found)


class Memo:
    """A bounded memo of two generations: when the young one is full it becomes the old one, and what is asked for
    again moves back. So frequent keys stay, and at most twice ``size`` entries are held."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys) -> list:
        """The keys that have to be made, each once; those of the old generation move to the young one."""
        young, old, out = self.young, self.old, []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    young[k] = None
                    out.append(k)
        return out

    def turn(self) -> dict:
        """The young generation, for direct reading until the next turn."""
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        return self.young


def trim() -> None:
    """Give memory that a task has freed back to the system, as workers are used again."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: What this worker holds beyond a task, see ``held``.
_held: list = []


def held(make):
    """``make``, whose last result the worker keeps beyond a task, until a task of another operator calls ``forget``."""
    _held.append(functools.lru_cache(maxsize=1)(make))
    return _held[-1]


def forget() -> None:
    """At the start of a task: drop what other operators have left in this worker, which is used again by all of them."""
    if any(x.cache_info().currsize for x in _held):
        for x in _held:
            x.cache_clear()
        trim()


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and checkpoints of steps that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a written table that no later step reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
