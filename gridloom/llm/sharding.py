"""Sharding by sampled splitters, under the law that shard sizes in bytes are near equal.

Size-weighted key samples give quantile boundaries; records are range-partitioned by
``xxhash64(text)``, so equal texts lie in one range; overfull ranges are subdivided with fresh samples
drawn inside them; a range that is overfull with a single text is subdivided by ``xxhash64(id)``.
The ranges, whose exact sizes are then known, are dealt to the shards largest first, each to the
shard that has least. The driver holds boundaries and range sizes only: some thousands of
numbers whatever the input.

Nulls: a null text has size 16 and the checksum of no bytes; a null id sorts first. Empty table:
no rows. Repeated rows are rows of their own. Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.base import cut

#: Ranges that a shard has on average; samples drawn for each range in a round of sampling.
RANGES_PER_SHARD, SAMPLES_PER_RANGE, OVERHEAD = 32, 8, 16
#: A range of one text is subdivided when it exceeds this share of a shard.
SINGLE_TEXT_SHARE = 0.25
#: Rounds of subdivision; each cuts an overfull range into parts of about the wanted size.
ROUNDS = 8


def _weighted_sample(rows: DataFrame, n: int, seed: int, total: int) -> list:
    """n rows or a few less, drawn without replacement with probability in proportion to size.

    Keys are exponential with the size as rate; rows of ``total`` bytes have about 2 n keys up to the bound, so
    that is what comes together from all tasks, however many they are.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), "t", "h"), F.lit(1 << 52)) + 1) / float((1 << 52) + 2)
    keyed = rows.select("h", "t", (-F.log(u) / F.col("size")).alias("k"))
    return keyed.where(F.col("k") <= 2 * n / max(1, total)).orderBy("k", "h", "t").limit(n).collect()


def _quantiles(values: list[int], parts: int) -> list[int]:
    """Boundaries that cut the sorted sample in ``parts``; a value that fills a part by itself gets
    a boundary on each side, so that it stands alone."""
    values = sorted(values)
    step = max(1, len(values) // max(1, parts))
    picked = values[step::step]
    alone = {v for v, w in zip(picked, picked[1:]) if v == w}
    return sorted({*picked, *(v + 1 for v in alone if v < (1 << 63) - 1)})


class Splitters:
    """Boundaries on h, and for single hot values of h boundaries on t."""

    def __init__(self, bounds: list[int], hot: dict[int, list[int]]):
        self.bounds, self.hot = np.array(sorted(set(bounds)), np.int64), hot
        self.first = {h: len(self.bounds) + 1 + i for h, i in zip(hot, np.cumsum([0, *map(len, hot.values())]))}

    def of(self, h: np.ndarray, t: np.ndarray) -> np.ndarray:
        out = np.searchsorted(self.bounds, h, side="right").astype(np.int64)
        for value, cuts in self.hot.items():
            at = h == value
            if at.any():
                inner = np.searchsorted(np.array(cuts, np.int64), t[at], side="right")
                out[at] = np.where(inner == 0, out[at], self.first[value] + inner - 1)
        return out

    def column(self) -> Column:
        @F.pandas_udf("long")
        def range_of(h: pd.Series, t: pd.Series) -> pd.Series:
            return pd.Series(self.of(h.to_numpy(), t.to_numpy()))

        return range_of("h", "t")


def _sizes(rows: DataFrame, splitters: Splitters) -> list:
    grouped = rows.groupBy(splitters.column().alias("range"))
    return grouped.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")).collect()


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: id, size, text_crc32, shard, slot; sizes of shards near equal."""
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = cut(docs.select(F.col(id_col).alias(id_col), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("h"), F.xxhash64(F.col(id_col)).alias("t")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = n_shards * RANGES_PER_SHARD
    limit, single = 2 * total / ranges, SINGLE_TEXT_SHARE * total / n_shards
    splitters = Splitters(_quantiles([r.h for r in _weighted_sample(rows, ranges * SAMPLES_PER_RANGE, 0, total)], ranges), {})
    for seed in range(1, ROUNDS + 1):
        sizes = _sizes(rows, splitters)
        over = {r.range: r for r in sizes if r.bytes > (limit if r.lo < r.hi else single) and r.n > 1}
        over = {k: r for k, r in over.items() if r.lo < r.hi or r.lo not in splitters.hot}
        if not over:
            break
        bounds, hot = [*map(int, splitters.bounds)], dict(splitters.hot)
        inside = rows.where(splitters.column().isin([*over]))
        drawn: dict[int, list] = {k: [] for k in over}
        sample = _weighted_sample(inside, ranges * SAMPLES_PER_RANGE, seed, sum(r.bytes for r in over.values()))
        for k, s in zip(splitters.of(*(np.array([s[c] for s in sample], np.int64) for c in "ht")), sample):
            drawn[k].append(s)
        for k, r in over.items():
            if r.lo < r.hi:
                bounds += [*_quantiles([s.h for s in drawn[k]], int(2 * r.bytes // limit) + 1), r.lo + 1]
            else:
                hot[r.lo] = [q for q in _quantiles([s.t for s in drawn[k]], int(2 * r.bytes // single) + 1)]
        splitters = Splitters(bounds, hot)
    else:
        sizes = _sizes(rows, splitters)
    heap, dealt, used = [(0, s) for s in range(n_shards)], [], [0] * n_shards
    for r in sorted(sizes, key=lambda r: (-r.bytes, r.range)):
        load, shard = heapq.heappop(heap)
        dealt.append((r.range, shard, used[shard]))
        used[shard] += r.n
        heapq.heappush(heap, (load + r.bytes, shard))
    # At most a few thousand ranges, whatever the input: bounded by n_shards * RANGES_PER_SHARD * 2 and the hot cuts.
    plan = rows.sparkSession.createDataFrame(dealt, "range long, shard int, first long")
    numbered = rows.withColumn("range", splitters.column()).withColumn("rank", F.row_number().over(Window.partitionBy("range").orderBy("h", "t", id_col)))
    return numbered.join(F.broadcast(plan), "range").select(id_col, "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - 1).alias("slot"), F.col("range"))
