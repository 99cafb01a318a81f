"""Chroma audio fingerprints for a media column, and their alignment.

A recording (PCM WAV bytes) is cut into overlapping frames; the power of each frame's spectrum is summed by
pitch class. Filters compare areas of the smoothed and normalised pitch-class image, read off its integral
image; their answers, two Gray-coded bits each, are packed into an integer for every position. Two
recordings are aligned by the histogram of offsets of equal integers, to which every occurrence adds, and told
alike by the share of bits that differ where they overlap, at the offset of most votes that passes.

Recordings with equal fingerprints form a class; only one of each class is searched for and in. Recordings lie in
parts that aren't moved again, each block of queries is sent to every part; inside a task equal integers are paired
piece by piece, runs of one integer as a whole, without emitting the pairs.

Nulls, empty or unreadable media have no fingerprint, no class and match nothing; a recording shorter than the
filters is padded with silence; null ids keep their row and match nothing; repeated rows each get their row; of an
id with several recordings the one with the least digest is searched for and in;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.base import cut, trim, with_group, written

#: Samples of a frame and between frames; frames over which filters reach; frames that are smoothed over.
FRAME, HOP, WIDTH, SMOOTH = 256, 64, 8, 3
#: Frequencies that count, as shares of the sample rate; what two areas' log ratio must pass for the outer codes.
LOW, HIGH, OUTER = 1 / 40, 1 / 2.2, 0.1
#: What a match needs: votes for an offset, share of bits that may differ, positions of overlap (fewer are alike by chance,
#: so shorter recordings have a class but no matches), share of the shorter recording that has to lie in the overlap.
VOTES, MOST_ERRORS, OVERLAP, SHARE = 2, 0.1, 8, 0.5
#: Integers of a block of recordings or queries; most blocks of a part; votes held at once.
BLOCK, BLOCKS_A_PART, PAIRS = 1 << 18, 8, 1 << 20


def filters() -> list[tuple[int, int, int, int]]:
    """16 filters (kind, lowest pitch class, classes, frames): four kinds at four places, by rule."""
    return [(i % 4, (5 * (i // 4) + 3 * (i % 4)) % 12, (4, 6, 4, 6)[i // 4], (2, 4, 6, 8)[(i + i // 4) % 4]) for i in range(16)]


def read_wav(data: bytes | None) -> np.ndarray | None:
    """Mono samples between -1 and 1 of 8- or 16-bit PCM; None if the bytes aren't such a recording or hold no sample."""
    if not data or len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, channels, bits, samples = 12, 0, 0, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            kind, channels, _, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if kind != 1 or bits not in (8, 16) or not channels:
                return None
        elif name == b"data" and channels:
            usable = len(body) - len(body) % (channels * bits // 8)
            raw = np.frombuffer(body[:usable], np.uint8 if bits == 8 else "<i2").astype(np.float32)
            samples = ((raw - 128) / 128 if bits == 8 else raw / 32768).reshape(-1, channels).mean(axis=1)
        at += 8 + size + size % 2
    return samples if samples is not None and len(samples) else None


def wav_of(samples: bytes, rate: int = 2048) -> bytes:
    """An 8-bit mono recording of these samples."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def _pitch_classes() -> np.ndarray:
    """(spectrum bins x 12) one where a bin belongs to a pitch class; a class is a twelfth of an octave."""
    share = np.arange(FRAME // 2 + 1) / FRAME
    out = np.zeros((len(share), 12), np.float32)
    inside = np.flatnonzero((share >= LOW) & (share <= HIGH))
    out[inside, np.rint(12 * np.log2(share[inside] / LOW)).astype(int) % 12] = 1
    return out


_CLASSES, _WINDOW, _FILTERS = _pitch_classes(), np.hanning(FRAME).astype(np.float32), filters()


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """A 32-bit integer for every position of the filters."""
    least = FRAME + HOP * (WIDTH + SMOOTH - 2)
    if len(samples) < least:
        samples = np.r_[samples, np.zeros(least - len(samples), np.float32)]
    n = 1 + (len(samples) - FRAME) // HOP
    frames = np.lib.stride_tricks.as_strided(samples, (n, FRAME), (samples.strides[0] * HOP, samples.strides[0]))
    chroma = np.concatenate([np.abs(np.fft.rfft(frames[i : i + 4096] * _WINDOW)) ** 2 @ _CLASSES for i in range(0, n, 4096)])
    total = np.cumsum(np.r_[np.zeros((1, 12)), chroma], axis=0)
    smooth = total[SMOOTH:] - total[:-SMOOTH]
    smooth /= np.linalg.norm(smooth, axis=1, keepdims=True) + 1e-6
    # The integral image; pitch classes go round, so they are laid out twice.
    integral = np.pad(np.cumsum(np.cumsum(np.hstack([smooth, smooth]), axis=0), axis=1), ((1, 0), (1, 0)))
    m = len(smooth) - WIDTH + 1

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return integral[t1 : t1 + m, y1] - integral[t0 : t0 + m, y1] - integral[t1 : t1 + m, y0] + integral[t0 : t0 + m, y0]

    out = np.zeros(m, np.uint32)
    for kind, y, h, w in _FILTERS:
        whole, hm, wm = area(0, w, y, y + h), h // 2, w // 2
        if kind == 0:  # low against high classes
            part = area(0, w, y, y + hm)
        elif kind == 1:  # earlier against later frames
            part = area(0, wm, y, y + h)
        elif kind == 2:  # the diagonal quarters against the others
            part = area(0, wm, y, y + hm) + area(wm, w, y + hm, y + h)
        else:  # the middle third of the classes against the outer ones
            part = area(0, w, y + h // 3, y + h - h // 3)
        answer = np.log((0.01 + part) / (0.01 + whole - part))
        code = (answer > -OUTER).astype(np.uint32) + (answer > 0) + (answer > OUTER)
        out = out << np.uint32(2) | code ^ (code >> np.uint32(1))
    return out


def aligned(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """(positions of overlap, bits that differ) where position i of b meets position i + offset of a."""
    lo, hi = max(0, offset), min(len(a), len(b) + offset)
    if hi <= lo:
        return 0, 0
    return hi - lo, int(np.bitwise_count(a[lo:hi] ^ b[lo - offset : hi - offset]).sum())


class Runs:
    """Runs of one integer in recordings, in order: integer, recording, place of the first, length."""

    def __init__(self, prints: list[np.ndarray]):
        self.prints, sizes = prints, np.array([*map(len, prints)], np.int64)
        flat = np.concatenate([*prints, np.empty(0, np.uint32)]).astype(np.uint32)
        of, place = np.repeat(np.arange(len(prints)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])][: len(flat)])
        self.key, self.of, self.at, self.length = flat[first], of[first], place[first], np.diff(np.r_[first, len(flat)])

    def by_key(self) -> tuple[np.ndarray, ...]:
        order = np.argsort(self.key, kind="stable")
        return self.key[order], self.of[order], self.at[order], self.length[order]


def _pieces(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (row, x) with lo[row] <= x < hi[row], at most PAIRS at once, rows in order."""
    n = hi - lo
    total = np.cumsum(n)
    for begin in range(0, int(total[-1]) if len(total) else 0, PAIRS):
        number = np.arange(begin, min(begin + PAIRS, int(total[-1])))
        row = np.searchsorted(total, number, "right")
        yield row, lo[row] + number - (total[row] - n[row])


def _summed(code: np.ndarray, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code, kind="stable")
    code, votes = code[order], votes[order]
    new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
    return code[new], np.add.reduceat(votes, new) if len(new) else votes


def histograms(queries: Runs, recordings: Runs) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(recording, query, offset, votes) of all offsets at which a recording and a query hold an equal integer.

    Every occurrence votes. Two runs of one integer give a trapezoid of votes, added as a whole.
    """
    key, of, at, length = queries.by_key()
    lo, hi = np.searchsorted(key, recordings.key, "left"), np.searchsorted(key, recordings.key, "right")
    some = np.flatnonzero(hi > lo)
    n, longest = len(queries.prints), max(map(len, recordings.prints), default=0)
    span = longest + max(map(len, queries.prints), default=0) + 1
    code, votes = np.empty(0, np.int64), np.empty(0, np.int64)

    def parts(code: np.ndarray, votes: np.ndarray):
        pair = code // span
        return pair // n, pair % n, code % span - longest, votes

    for row, x in _pieces(lo[some], hi[some]):
        row = some[row]
        a, b = length[x], recordings.length[row]
        least = at[x] - recordings.at[row] - (b - 1)
        base = (recordings.of[row] * n + of[x]) * span + longest + least
        for which, step in _pieces(np.zeros(len(x), np.int64), a + b - 1):
            height = np.minimum(np.minimum(step + 1, (a + b - 1)[which] - step), np.minimum(a, b)[which])
            code, votes = _summed(np.r_[code, base[which] + step], np.r_[votes, height])
            done = np.searchsorted(code, int(recordings.of[row[which[-1]]]) * n * span)  # all of earlier recordings
            if done:
                yield parts(code[:done], votes[:done])
                code, votes = code[done:], votes[done:]
    if len(code):
        yield parts(code, votes)


def alike(a: np.ndarray, b: np.ndarray, overlap: int, errors: int) -> bool:
    return overlap >= max(OVERLAP, SHARE * min(len(a), len(b))) and errors <= MOST_ERRORS * 32 * overlap


def matches(queries: Runs, recordings: Runs) -> list[tuple[int, int, int, int, int]]:
    """(query, recording, offset, overlap, differing bits) of all alike pairs.

    Offsets with VOTES votes are tried, those with more first and then the smaller, and the first that passes counts.
    """
    out = []
    for r, q, shift, votes in histograms(queries, recordings):
        enough = votes >= VOTES
        r, q, shift, votes = r[enough], q[enough], shift[enough], votes[enough]
        order = np.lexsort((shift, -votes, q, r))
        passed = None
        for i, j, offset in zip(r[order].tolist(), q[order].tolist(), shift[order].tolist()):
            if passed == (i, j):
                continue
            a, b = queries.prints[j], recordings.prints[i]
            overlap, errors = aligned(a, b, offset)
            if alike(a, b, overlap, errors):
                out.append((j, i, offset, overlap, errors))
                passed = (i, j)
    return out


PRINTS = "id long, n long, crc long, print binary"


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, 64):
            batch = whole.slice(i, 64)
            samples = [read_wav(x) for x in batch.column(1).to_pylist()]
            prints = [None if s is None else fingerprint(s).astype("<u4").tobytes() for s in samples]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p or b"") // 4 for p in prints], pa.int64()), pa.array([None if p is None else zlib.crc32(p) for p in prints], pa.int64()), pa.array(prints, pa.binary())], ["id", "n", "crc", "print"])
    trim()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, prints, held = [], [], 0

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([prints], pa.list_(pa.binary()))], ["ids", "prints"])

    for batch in batches:
        for i, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            prints.append(p)
            held += len(p) // 4
            if held >= BLOCK:
                yield block()
                ids, prints, held = [], [], 0
    if ids:
        yield block()


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by part, in each the blocks of recordings first and then those of queries."""
    part, held = None, []
    for batch in batches:
        for now, asks, ids, prints in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if now != part:
                part, held = now, []
            block = ids, Runs([np.frombuffer(p, "<u4") for p in prints])
            if not asks:
                held.append(block)
                continue
            q_ids, queries = block
            for r_ids, recordings in held:
                found = [(q_ids[q], r_ids[r], o, n, e) for q, r, o, n, e in matches(queries, recordings) if q_ids[q] != r_ids[r]]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["query", "id", "offset", "overlap", "errors"])


def fingerprint_and_align(media: DataFrame, is_query: Callable[[Column], Column], id_col: str, media_col: str) -> DataFrame:
    """A row per row of ``media``: id, n_positions, print_crc32, class_id (smallest id with the same fingerprint),
    n_matches (classes of query recordings that it is alike to, its own class left out) and, of the best of them
    (least share of differing bits, then larger overlap, then smaller id), match_id, offset, overlap, bit_errors."""
    prints = written(media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(_prints, PRINTS), "fingerprints")
    digests = cut(prints.select("id", "n", "crc", F.unhex(F.sha2("print", 256)).alias("digest")))
    groups = cut(digests.where(F.col("id").isNotNull() & F.col("digest").isNotNull()).groupBy("digest").agg(F.min("id").alias("class_id"), F.max(is_query(F.col("id"))).alias("asked"), F.count(F.lit(1)).alias("rows")))
    own = groups.groupBy(F.col("class_id").alias("id")).agg(F.min_by(F.struct("digest", "asked"), "digest").alias("own")).select("id", "own.*")
    one = cut(prints.withColumn("digest", F.unhex(F.sha2("print", 256))).join(own, ["id", "digest"]).select("id", "print", "n", "asked").dropDuplicates(["id"]))
    total, asked_total = one.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("asked"), F.col("n"))), F.lit(0))).first()
    shaped = lambda rows, n: rows.select("id", "print").repartition(max(1, -(-n // BLOCK))).mapInArrow(_blocks, "ids array<long>, prints array<binary>")
    blocks = -(-total // BLOCK)
    parts = max(1, -(-blocks // BLOCKS_A_PART), min(blocks, 2 * media.sparkSession.sparkContext.defaultParallelism))
    data = shaped(one, total).select((F.monotonically_increasing_id() % parts).cast("int").alias("part"), F.lit(False).alias("asks"), "ids", "prints")
    asked = shaped(one.where("asked"), asked_total).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("asks"), "ids", "prints")
    pairs = data.unionByName(asked).repartitionById(parts, "part").sortWithinPartitions("part", "asks")
    found = pairs.mapInArrow(_search, "query long, id long, offset long, overlap long, errors long")
    best = found.groupBy("id").agg(F.count(F.lit(1)).alias("n_matches"), F.min(F.struct((F.col("errors") / (32 * F.col("overlap"))).alias("share"), -F.col("overlap"), "query", "offset", "overlap", "errors")).alias("best"))
    rows = with_group(digests, groups, "digest", "class_id", F.xxhash64("id", "n", "crc"))
    rows = rows.withColumn("class_id", F.when(F.col("id").isNotNull(), F.col("class_id")))
    matched = groups.join(best.withColumnRenamed("id", "class_id"), "class_id").select("class_id", "n_matches", "best", "rows").groupBy("class_id").agg(F.first("n_matches").alias("n_matches"), F.first("best").alias("best"), F.sum("rows").alias("rows"))
    joined = with_group(rows, cut(matched), "class_id", ("n_matches", "best"), F.xxhash64("id", "n", "crc"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_positions"), F.col("crc").alias("print_crc32"), "class_id", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.col("best.query").alias("match_id"), F.col("best.offset").alias("offset"), F.col("best.overlap").alias("overlap"), F.col("best.errors").alias("bit_errors"))


def recordings_of(docs: DataFrame, text_col: str = "text") -> Column:
    """A media column for tables without one: the UTF-8 bytes of the whole text as the samples of a recording."""

    @F.pandas_udf("binary")
    def rendered(texts):
        return texts.map(lambda t: None if t is None else wav_of(t.encode()))

    return rendered(F.col(text_col))
