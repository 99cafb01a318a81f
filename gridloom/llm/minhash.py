"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 32-bit universe make the whole signature: ``_sigma`` breaks up the structure of the
data once, ``_pi`` is read circularly shifted by one more place for each coordinate. Documents with
equal shingle sets form a class; only one document of a class goes on. Classes that share a band
are candidates. Their full sets are compared in rounds: first each class with the leader of one of
its bands, then, between components not yet joined, with other leaders, and at last every pair that
shares a band, lies in different components and is not ruled out by set sizes: buckets are dealt in blocks, which are
compared inside a task without emitting their pairs. Only the leaders' rounds look at a sketch of one bit a coordinate
(at DEVIATIONS standard deviations); what it leaves out there is compared in the last round. As links inside a component change nothing,
the components are those of all linked candidates, without all pairs of a group of copies.

Number and length of bands follow from the threshold, so that a pair at the threshold shares no band
with a probability below ``MISS``. Nulls, empty texts and texts without words have no set and no links;
a null id keeps its row, has a null component and is linked with nothing; texts are whole; repeated rows
each get their row; an id with several texts stands for all of them, and is compared by the set with the least digest among those
of which it is the smallest id; other columns are not read (``keep_one`` keeps them); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.base import cut, drop_table, forget, new_table, release, trim, with_group, written
from gridloom.llm.components import joined

#: Chance that a pair at the threshold shares no band; most coordinates; bits of the sketch; standard deviations it may be off.
MISS, COORDINATES, SKETCH_BITS, DEVIATIONS = 1e-6, 352, 384, 4.75
#: Entries of a worker's memo of word hashes, emptied when full; shingles hashed in one flat array.
MEMO, FLAT = 300_000, 1 << 16
#: Rounds with leaders before all remaining pairs; members of a block of a bucket.
LEADER_ROUNDS, BLOCK = 2, 512
LONGS = SKETCH_BITS // 64
#: Up to so many ids of candidates, their texts are picked by a broadcast of the ids; beyond, by a shuffle.
BROADCAST_IDS = 500_000
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def bands_for(threshold: Fraction) -> tuple[int, int]:
    """(bands, rows of a band): the longest bands that stay within COORDINATES and MISS."""
    rows = 1
    needed = lambda r: math.ceil(math.log(MISS) / math.log1p(-(float(threshold) ** r)))
    while (rows + 1) * needed(rows + 1) <= COORDINATES:
        rows += 1
    return needed(rows), rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M2
    x = (x ^ (x >> np.uint64(32))) * M2
    return x ^ (x >> np.uint64(32))


def _sigma(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit universe."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _pi(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Another one, in place."""
    np.multiply(x, np.uint32(0x7FEB352D), out=x)
    np.right_shift(x, np.uint32(15), out=spare)
    np.bitwise_xor(x, spare, out=x)
    return np.multiply(x, np.uint32(0x846CA68B), out=x)


class Shingler:
    """Sets of word shingles as sorted distinct 64-bit hashes."""

    def __init__(self, k: int):
        self.k, self.memo = k, {}

    def set_of(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []  # bytes: ASCII letters and ASCII white space only
        if not words:
            return np.empty(0, np.uint64)
        memo = self.memo
        try:
            hashes = np.array([memo[w] for w in words], np.uint64)
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            memo |= {w: xxhash.xxh3_64_intdigest(w) for w in words}
            hashes = np.array([memo[w] for w in words], np.uint64)
        k = min(self.k, len(words))
        n = len(words) - k + 1
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = _mix(out * M1 + hashes[i : i + n])
        return np.unique(out)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """A row of circulant MinHash coordinates for each set, none of which is empty."""
    out = np.empty((coordinates, len(sets)), np.uint32)
    begin = 0
    while begin < len(sets):
        end, held = begin, 0
        while end < len(sets) and (end == begin or held + len(sets[end]) <= FLAT):
            held += len(sets[end])
            end += 1
        base = _sigma(np.concatenate(sets[begin:end]).astype(np.uint32))
        starts = np.cumsum([0, *map(len, sets[begin : end - 1])])
        now, spare = np.empty_like(base), np.empty_like(base)
        for c in range(coordinates):
            np.subtract(base, np.uint32(c), out=now)  # the shift, modulo the universe
            out[c, begin:end] = np.minimum.reduceat(_pi(now, spare), starts)
        begin = end
    return out.T


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of every band, which holds the number of the band."""
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
    shaped = signature[:, : bands * rows].reshape(len(signature), bands, rows).astype(np.uint64)
    for r in range(rows):
        out = _mix(out * M1 + shaped[:, :, r])
    return out.view(np.int64)


def sketch(signature: np.ndarray) -> np.ndarray:
    """One bit of each of SKETCH_BITS coordinates, as 64-bit integers."""
    bits = np.zeros((len(signature), SKETCH_BITS), np.uint8)
    n = min(SKETCH_BITS, signature.shape[1])
    bits[:, :n] = signature[:, :n] & 1
    return np.packbits(bits, axis=1).view(np.int64)


SKETCH = [f"s{i}" for i in range(LONGS)]
SIGNED = "id long, n_shingles long, digest binary, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH)


def _sign(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shingler = Shingler(k)
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                sets = [shingler.set_of(t) for t in batch.column(1).to_pylist()]
                full = [j for j, s in enumerate(sets) if len(s)]
                keys, bits = [None] * len(sets), np.zeros((len(sets), LONGS), np.int64)
                if full:
                    signature = signatures([sets[j] for j in full], bands * rows)
                    for j, row in zip(full, band_keys(signature, bands, rows)):
                        keys[j] = row
                    bits[full] = sketch(signature)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets]), pa.array(keys, pa.list_(pa.int64())), *(pa.array(bits[:, c]) for c in range(LONGS))], [c.split()[0] for c in SIGNED.split(", ")])
        del shingler
        trim()

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shingler = Shingler(k)
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                sets = [shingler.set_of(t).tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(x) for x in sets]), pa.array(sets)], ["id", "digest", "members"])
        del shingler
        trim()

    return run


def _linked(a: np.ndarray, b: np.ndarray, threshold: Fraction) -> bool:
    """Whether two full sets reach the threshold."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return threshold.denominator * common >= threshold.numerator * (len(both) - common)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [_linked(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), threshold) for a, b in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(linked, pa.bool_()))

    left = sets.select(F.col("id").alias("u"), F.col("members").alias("a"))
    right = sets.select(F.col("id").alias("v"), F.col("members").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _most_differing(threshold: Fraction, coordinates: int) -> int:
    """Bits of the sketch that may differ at the threshold, DEVIATIONS from the mean."""
    n, equal = min(SKETCH_BITS, coordinates), (1 + float(threshold)) / 2
    return math.floor(n * (1 - equal) + DEVIATIONS * math.sqrt(n * equal * (1 - equal))) + 1


def _possible(a: str, b: str, threshold: Fraction, coordinates: int):
    """Whether sizes and sketches leave a pair possible (sizes exactly; sketches at DEVIATIONS)."""
    differ = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH), F.lit(0))
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (small * threshold.denominator >= large * threshold.numerator) & (differ <= _most_differing(threshold, coordinates))


def _blocks(open_members: DataFrame) -> DataFrame:
    """key, one, other, id, comp: for every bucket, its members once for each pair of blocks that has to be compared.

    A component of BLOCK members or more of a bucket has blocks of its own, the other members share some; two blocks of
    one component aren't compared. Blocks are dealt by a hash, so no task has to hold a bucket.
    """
    counts = open_members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    small = counts.where(F.col("c") < BLOCK).groupBy("key").agg(F.sum("c").alias("few"))
    sized = open_members.join(counts.where(F.col("c") >= BLOCK), ["key", "comp"], "left").join(small, "key", "left")
    own = F.when(F.col("c").isNotNull(), F.col("comp"))
    parts = F.ceil(F.coalesce("c", "few") / BLOCK)
    dealt = sized.select("key", "id", "comp", F.struct(own.alias("big"), F.pmod(F.xxhash64("id"), parts).alias("part")).alias("block"))
    blocks = dealt.select("key", "block").distinct()
    pairs = blocks.withColumnRenamed("block", "one").join(blocks.withColumnRenamed("block", "other"), "key")
    pairs = pairs.where((F.col("one") <= F.col("other")) & (F.col("one.big").isNull() | ~F.col("one.big").eqNullSafe(F.col("other.big"))))
    columns = ["key", "one", "other", "id", "comp", "left"]
    first = dealt.withColumnRenamed("block", "one").join(pairs, ["key", "one"]).withColumn("left", F.lit(True)).select(columns)
    second = dealt.withColumnRenamed("block", "other").join(pairs.where(F.col("one") != F.col("other")), ["key", "other"]).withColumn("left", F.lit(False)).select(columns)
    return first.unionByName(second)


def _compare(threshold: Fraction):
    """Links between members of a pair of blocks; a pair is looked at in the first bucket that it shares."""
    up, down = threshold.numerator, threshold.denominator

    def pairs_of(key: int, rows: list[tuple]) -> Iterator[tuple[int, int]]:
        ids, comps, left, sizes, bands, members = zip(*rows)
        comps, left, sizes = np.array(comps), np.array(left), np.array(sizes)
        whole = left.all()
        for i in np.flatnonzero(left):
            rest = np.arange(i + 1, len(rows)) if whole else np.flatnonzero(~left)
            rest = rest[comps[rest] != comps[i]]
            rest = rest[down * np.minimum(sizes[rest], sizes[i]) >= up * np.maximum(sizes[rest], sizes[i])]
            for j in rest:
                if min(set(bands[i]) & set(bands[j])) == key and _linked(np.frombuffer(members[i], np.uint64), np.frombuffer(members[j], np.uint64), threshold):
                    yield max(ids[i], ids[j]), min(ids[i], ids[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for key, one, other, *row in zip(*(c.to_pylist() for c in batch.columns)):
                now = (key, one["big"], one["part"], other["big"], other["part"])
                if now != group:
                    if len(rows) > 1:
                        found += pairs_of(group[0], rows)
                    group, rows = now, []
                rows.append(tuple(row))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["u", "v"])
        if len(rows) > 1 and (found := [*pairs_of(group[0], rows)]):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["u", "v"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, threshold: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept, class_id of every row. class_id: the smallest id with the same set."""
    bands, rows = bands_for(threshold)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = written(texts.mapInArrow(_sign(k, bands, rows), SIGNED), "minhash")
    ids = signed.select("id", "n_shingles", "digest")
    reps = cut(ids.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0)).groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows")))
    own = reps.groupBy("id").agg(F.min("digest").alias("digest"))
    classes = signed.join(own.hint("shuffle_hash"), ["digest", "id"], "left_semi")
    keyed = classes.select("id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    members = cut(keyed.join(shared, "key").distinct())
    needed = cut(members.select("id").distinct().join(own, "id"))
    few = needed.count() <= BROADCAST_IDS
    pick = F.broadcast(needed) if few else needed.hint("shuffle_hash")
    sets_path = new_table(docs.sparkSession, "shingle-sets")
    found = texts.join(pick, "id", "left_semi").mapInArrow(_sets(k), "id long, digest binary, members binary")
    found.join(pick, ["id", "digest"], "left_semi").drop("digest").dropDuplicates(["id"]).write.parquet(sets_path)
    sets = docs.sparkSession.read.schema("id long, members binary").parquet(sets_path)
    traits = cut(signed.select("id", F.col("n_shingles").alias("n"), "bands", "digest", *SKETCH).join(pick, ["id", "digest"], "left_semi").drop("digest").dropDuplicates(["id"]))
    release(docs.sparkSession)

    links, open_members = None, members.withColumn("comp", F.col("id"))
    for turn in range(LEADER_ROUNDS + 1):
        # Buckets that hold more than one component; the rest can't change anything.
        spread = open_members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        open_members = cut(open_members.join(spread, "key"))
        if turn == LEADER_ROUNDS:
            blocks = _blocks(open_members).join(sets, "id").join(traits, "id").select("key", "one", "other", "id", "comp", "left", "n", "bands", "members")
            parts = max(1, open_members.count() // 1024, docs.sparkSession.sparkContext.defaultParallelism)
            found = blocks.repartition(parts, "key", "one", "other").sortWithinPartitions("key", "one", "other").mapInArrow(_compare(threshold), "u long, v long")
        else:
            # First the smallest id, which most of a group of copies share bands with; then others.
            drawn = F.xxhash64(F.lit(turn), "id") if turn else F.col("id")
            leaders = open_members.groupBy("key").agg(F.min(drawn).alias("drawn"))
            leaders = open_members.withColumn("drawn", drawn).join(leaders, ["key", "drawn"]).select("key", F.col("id").alias("other"), F.col("comp").alias("other_comp"))
            votes = open_members.join(leaders, "key").where(F.col("comp") != F.col("other_comp")).groupBy("id", "other").agg(F.count(F.lit(1)).alias("c"))
            side = lambda name, at: traits.select(F.col("id").alias(at), F.struct("n", *SKETCH).alias(name))
            votes = votes.join(side("a", "id"), "id").join(side("b", "other"), "other").where(_possible("a", "b", threshold, bands * rows))
            best = votes.groupBy("id").agg((F.max(F.struct("c", "other")) if turn else F.min(F.struct(F.col("other").alias("other")))).alias("best"))
            found = _verified(best.select(F.greatest("id", "best.other").alias("u"), F.least("id", "best.other").alias("v")).distinct(), sets, threshold)
        links = joined(links, found)
        label = links.select(F.col("u").alias("id"), F.col("v").alias("now"))
        open_members = open_members.drop("comp").join(label, "id", "left").withColumn("comp", F.coalesce("now", "id")).drop("now")
        release(docs.sparkSession)
    drop_table(docs.sparkSession, sets_path)
    groups = reps.withColumnRenamed("id", "rep").join(links.select(F.col("u").alias("rep"), F.col("v").alias("top")), "rep", "left")
    # A row without set has no class to be joined with; where all such rows lay together, there would be a hot key.
    keyed_rows = ids.withColumn("digest", F.when(F.col("n_shingles") > 0, F.col("digest")))
    rows_ = with_group(keyed_rows, cut(groups), "digest", ("rep", "top"), F.xxhash64("id"))
    rows_ = rows_.withColumn("class_id", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id"))).withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("top", "rep", "id")))
    return rows_.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"), "class_id")


def keep_one(docs: DataFrame, k: int = 5, threshold: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all their columns; rows without id stay."""
    out = near_duplicates(docs, k, threshold, id_col, text_col).where(~F.col("kept")).select(F.col(id_col)).distinct()
    return docs.join(out, id_col, "left_anti")
