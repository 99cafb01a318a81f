"""A Katz backoff language model: Good-Turing discounted counts and exactly normalised backoff weights.

The model has words, pairs of words and a start mark. Counts come from all training documents, in four
steps whose tables lie in the shared folder:

1. ``tokens``: documents are gathered into chunks of a bounded number of tokens, bucketed by chunk;
2. ``words``: every chunk sends each word's count once to the word's bucket. The bucket keeps the
   unigram table, gives each known word a number, and answers every chunk with counts and numbers;
3. ``pairs``: every chunk sends each of its distinct pairs once to the bucket of the pair's history (a history
   is spread over a bucket more for every ``HOT_TOKENS`` of its tokens). The bucket keeps the bigram table and answers
   with the pair's count and, for the history, how many of its followers occur 1 to 5 times and how much
   unigram probability its followers have; what the buckets of a spread history know is summed and joined to
   the chunks that have it;
4. scoring: every chunk looks its tokens up in its answers, backing off from pair to word to unknown word.

So a pair is shuffled once for each chunk that has it, however often it occurs, and no task holds more than a
chunk or a bucket. The driver sees a few sums only.

Discounts: Good-Turing counts r* for r up to 5, see ``good_turing``; after Katz, discounts are in proportion to
1 - r*/r and take away as much as occurs once. A history whose followers leave no mass
keeps back one count. Unknown words share the mass that unigram discounts leave, equally among as many
words as occur once. Every distribution sums to one.

Nulls and empty texts are the end token alone; a null id counts as the empty text for the split (so it is held out)
and keeps its row; texts are whole; repeated rows are documents of their own; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.base import catalogued, new_table, release

#: Tokens of a chunk; tokens of a bucket on average; counts that are discounted.
CHUNK, BUCKET, CUTOFF = 1_000_000, 1_500_000, 5
#: Tokens of a history for each bucket that it is spread over.
HOT_TOKENS = 100_000
#: Counts of counts are kept one by one up to CUTOFF + 1, and by powers of two for the line that smooths them.
POWERS, STEEPNESS, LEAST_DISCOUNT = 48, -2.0, 0.05
#: Not words, as words hold no space; the number of the start mark as a history.
END, START = b" end", 0


def pack(a: np.ndarray) -> bytes:
    """Non-negative integers as compressed planes of bytes."""
    a = np.ascontiguousarray(a, "<u8")
    width = 4 if not len(a) or int(a.max()) < 1 << 32 else 8
    planes = a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(b[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{b[0]}").ravel().astype(np.int64)


def is_held_out(doc_id: object) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


TOKENS = "chunk long, ids array<long>, held array<boolean>, lengths array<int>, n_tokens long, stream binary, hashes binary, counts binary"


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of documents; words by local number, local words by hash with their training counts."""
    names = [c.split()[0] for c in TOKENS.split(", ")]
    vocab: dict[bytes, int] = {END: 0}
    docs: list[tuple[int | None, bool, np.ndarray]] = []
    held, made = 0, 0

    def chunk() -> pa.RecordBatch:
        nonlocal vocab, docs, held, made
        stream = np.concatenate([d for _, _, d in docs]).astype(np.int64)
        lengths = [len(d) for _, _, d in docs]
        train = np.repeat([not h for _, h, _ in docs], lengths)
        counts = np.bincount(stream[train], minlength=len(vocab))
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in vocab], "<u8")
        number = TaskContext.get().partitionId() << 32 | made
        row = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([[i for i, _, _ in docs]], pa.list_(pa.int64())), pa.array([[h for _, h, _ in docs]], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int32())), pa.array([len(stream)], pa.int64()), pa.array([pack(stream)]), pa.array([hashes.tobytes()]), pa.array([pack(counts)])], names)
        vocab, docs, held, made = {END: 0}, [], 0, made + 1
        return row

    for whole in batches:
        for i in range(0, whole.num_rows, 256):
            batch = whole.slice(i, 256)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.encode().lower().split() if text else []
                try:
                    numbers = [vocab[w] for w in words]
                except KeyError:
                    numbers = [vocab.setdefault(w, len(vocab)) for w in words]
                numbers.append(0)
                docs.append((doc_id, is_held_out(doc_id), np.array(numbers, np.int32)))
                held += len(numbers)
                if held >= CHUNK:
                    yield chunk()
    if docs:
        yield chunk()


def _by_bucket(bucket: np.ndarray, n: int) -> list[np.ndarray]:
    """Positions of each bucket, in order."""
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.cumsum(np.bincount(bucket, minlength=n))[:-1])


def _ask_words(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, hashes, counts in zip(*(batch.column(c).to_pylist() for c in range(3))):
                hashes, counts = np.frombuffer(hashes, "<u8"), unpack(counts)
                at = _by_bucket((hashes % np.uint64(n)).astype(np.int64), n)
                rows = [(b, chunk, hashes[p].tobytes(), pack(counts[p])) for b, p in enumerate(at) if len(p)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows])], ["bucket", "chunk", "hashes", "counts"])

    return run


#: kind answer: what a chunk gets (of pairs, with the spread histories among its own as numbers); kind table: the n-grams and counts of a bucket; kind sums: counts of counts; kind hot: partial sums of spread histories.
KEPT = "bucket int, chunk long, a binary, b binary, c binary, d binary, numbers array<double>, kind string"


def _kept(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.string()]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in KEPT.split(", ")])


def counts_of_counts(total: np.ndarray) -> list[float]:
    """How many n-grams occur 1 .. CUTOFF + 1 times, then how many from 2^i up to 2^(i + 1)."""
    total = total[total > 0]
    return [float(np.count_nonzero(total == r)) for r in range(1, CUTOFF + 2)] + np.bincount(np.log2(total).astype(int), minlength=POWERS).astype(float).tolist()


def _count_words(n: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        chunks, hashes, counts = (table.column(c).to_pylist() for c in ("chunk", "hashes", "counts"))
        keys, where = np.unique(np.concatenate([np.frombuffer(h, "<u8") for h in hashes]), return_inverse=True)
        total = np.bincount(where, np.concatenate([unpack(c) for c in counts])).astype(np.int64)
        number = np.empty(len(keys), np.int64)
        number[np.argsort(-total, kind="stable")] = 1 + bucket + n * np.arange(len(keys))
        number[total == 0] = 0
        out, begin = [], 0
        for chunk, h in zip(chunks, hashes):
            at = where[begin : begin + len(h) // 8]
            begin += len(at)
            out.append((bucket, chunk, pack(number[at]), pack(total[at]), None, None, None, "answer"))
        known = total > 0
        out.append((bucket, None, keys[known].tobytes(), pack(number[known]), pack(total[known]), None, None, "table"))
        out.append((bucket, None, None, None, None, None, [float(total.sum()), float(known.sum()), *counts_of_counts(total)], "sums"))
        return _kept(out)

    return run


def steepness(powers: list[float]) -> float:
    """Slope of the line through log(n-grams that occur r times) over log r, from numbers by powers of two of r.

    Powers weigh as many as n-grams they hold. With fewer than two powers, or a line not falling faster than 1 / r (whose
    Good-Turing counts would not lie below r), Zipf's -2 takes its place.
    """
    n, at = np.array(powers), np.arange(len(powers))
    some = n > 0
    if some.sum() < 2:
        return STEEPNESS
    low = 2.0 ** at[some]
    x, y, w = np.log(low * (2 * low - 1)) / 2, np.log(n[some] / low), n[some]
    x, y = x - np.average(x, weights=w), y - np.average(y, weights=w)
    slope = float((w * x * y).sum() / (w * x * x).sum())
    return slope if slope < -1 else STEEPNESS


def good_turing(counts: list[float]) -> tuple[np.ndarray, int]:
    """(r* for r = 0 .. CUTOFF, how many of them are plain) from ``counts_of_counts``; r*_0 is not used.

    After Gale and Sampson: the plain estimate (r + 1) n_{r+1} / n_r for r = 1, 2, ..., as long as it lies above the
    one before and below r; from the first that doesn't, the estimate by the fitted line, r (1 + 1/r)^(slope + 1).
    """
    n, slope, stars, plain = counts[: CUTOFF + 1], steepness(counts[CUTOFF + 1 :]), np.zeros(CUTOFF + 1), 0
    for r in range(1, CUTOFF + 1):
        star = (r + 1) * n[r] / n[r - 1] if n[r - 1] else 0.0
        if plain == r - 1 and stars[r - 1] < star < r:
            stars[r], plain = star, r
        else:
            stars[r] = r * (1 + 1 / r) ** (slope + 1)
    return stars, plain


def discounts(counts: list[float]) -> np.ndarray:
    """d_0 .. d_CUTOFF from ``counts_of_counts`` (d_0 is not used).

    1 - d_r is in proportion to 1 - r*/r, and all discounts together take the count n_1 away, as Katz has it; less
    where a discount would fall below LEAST_DISCOUNT. Without n-grams that occur once nothing is taken.
    """
    r, n = np.arange(1, CUTOFF + 1), np.array(counts[:CUTOFF])
    lost = 1 - good_turing(counts)[0][1:] / r
    all_lost = float((lost * r * n).sum())
    scale = min(n[0] / all_lost, (1 - LEAST_DISCOUNT) / lost.max()) if all_lost > 0 else 0.0
    return np.r_[1.0, 1 - scale * lost]


class Unigrams:
    """Discounted word probabilities; what discounts leave is shared by unknown words."""

    def __init__(self, sums: list[float]):
        self.n, self.v, self.counts = sums[0], sums[1], sums[2:]  # counts as ``counts_of_counts`` gives them
        self.d = discounts(self.counts)
        kept = sum((1 - self.d[r]) * r * self.counts[r - 1] for r in range(1, CUTOFF + 1))
        self.over = self.n if kept > 0 or not self.n else self.n + 1  # without discounted words, one count is kept back
        left = kept / self.over if kept > 0 else 1 / self.over if self.n else 1.0
        self.unknown = left / max(1.0, self.counts[0])

    def probability(self, count: np.ndarray) -> np.ndarray:
        d = np.where(count > CUTOFF, 1.0, self.d[np.minimum(count, CUTOFF)])
        return np.where(count > 0, d * count / max(self.over, 1), self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.n + 0.1 * (self.v + 1)))


class Chunk:
    """A chunk with its words' answers: numbers and counts of all tokens, and its distinct known pairs."""

    def __init__(self, hashes: bytes, answers: list, stream: bytes, lengths: list[int], held: list[bool], buckets: int, starts: float, spread_from: int):
        hashes = np.frombuffer(hashes, "<u8")
        number, count = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        at = _by_bucket((hashes % np.uint64(buckets)).astype(np.int64), buckets)
        for a in answers:
            number[at[a["bucket"]]], count[at[a["bucket"]]] = unpack(a["a"]), unpack(a["b"])
        local = unpack(stream)
        self.count, self.lengths = count[local], np.array(lengths)
        first = np.r_[0, np.cumsum(self.lengths)[:-1]]
        # Local numbers of pairs; two more of them stand for the start mark and for any unknown word.
        start, unknown, width = len(hashes), len(hashes) + 1, len(hashes) + 2
        number, word_count = np.r_[number, START, 0], np.r_[count, int(starts), 0]
        history = np.r_[0, local[:-1]]
        history[first] = start
        self.of = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.known = (history == start) | (word_count[history] > 0)  # the history is
        pairs, self.pair_of = np.unique((history * width + np.where(self.count > 0, local, unknown))[self.known], return_inverse=True)
        train = ~np.array(held, bool)[self.of][self.known]
        self.trained = np.bincount(self.pair_of[train], minlength=len(pairs))
        h, w = pairs // width, pairs % width
        self.history, self.word, self.history_count, self.follower_count = number[h], number[w], word_count[h], word_count[w]
        self.spread = 1 + self.history_count // spread_from


    def by_bucket(self, n: int) -> list[np.ndarray]:
        """Pairs of each of n buckets, by history and word. A spread history has as many buckets in a row as it is spread over."""
        part = (_mixed(self.word) >> np.uint64(8)) % self.spread.astype(np.uint64)
        bucket = (((_mixed(self.history) >> np.uint64(8)) % np.uint64(n) + part) % np.uint64(n)).astype(np.int64)
        return [p[np.lexsort((self.word[p], self.history[p]))] for p in _by_bucket(bucket, n)]


def _ask_pairs(words: int, buckets: int, starts: float, spread_from: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, hashes, stream, lengths, held, answers = (batch.column(c)[row].as_py() for c in range(6))
                c = Chunk(hashes, answers, stream, lengths, held, words, starts, spread_from)
                for b, p in enumerate(c.by_bucket(buckets)):
                    if len(p):
                        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([chunk], pa.int64()), *(pa.array([pack(x[p])]) for x in (c.history, c.word, c.trained, c.follower_count)), pa.array([pack(c.spread[p] > 1)])], ["bucket", "chunk", "history", "word", "trained", "followers", "hot"])

    return run


def _count_pairs(unigrams: Unigrams):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        chunks = table.column("chunk").to_pylist()
        history, word, trained, followers, hot = ([unpack(x.as_py()) for x in table.column(c)] for c in ("history", "word", "trained", "followers", "hot"))
        sizes = [*map(len, history)]
        histories, h = np.unique(np.concatenate(history), return_inverse=True)
        words, w = np.unique(np.concatenate(word), return_inverse=True)
        pairs, first, where = np.unique(h * len(words) + w, return_index=True, return_inverse=True)
        total = np.bincount(where, np.concatenate(trained)).astype(np.int64)
        of, seen = h[first], total > 0
        mass = np.bincount(of[seen], unigrams.probability(np.concatenate(followers)[first][seen]), len(histories))
        rare = np.stack([np.bincount(of[total == r], minlength=len(histories)) for r in range(1, CUTOFF + 1)])
        is_hot = np.zeros(len(histories), bool)
        is_hot[h[np.concatenate(hot) > 0]] = True
        out, begin = [], 0
        for chunk, size in zip(chunks, sizes):
            at = slice(begin, begin + size)
            begin += size
            # Weights are asked for by pairs that training hasn't; of other histories only whether a follower is rare.
            mine, asked = np.unique(h[at]), total[where[at]]
            backed = np.unique(h[at][asked == 0])
            out.append((bucket, chunk, pack(asked), pack(rare[:, mine].any(axis=0)), mass[backed].astype("<f8").tobytes(), pack(rare[:, backed].ravel()), histories[mine[is_hot[mine]]].astype(float).tolist(), "answer"))
        for i in np.flatnonzero(is_hot):
            out.append((bucket, None, None, None, None, None, [float(histories[i]), mass[i], *map(float, rare[:, i])], "hot"))
        out.append((bucket, None, pack(histories[of[seen]]), pack(words[w[first][seen]]), pack(total[seen]), None, None, "table"))
        out.append((bucket, None, None, None, None, None, counts_of_counts(total), "sums"))
        return _kept(out)

    return run


def backoff(count: np.ndarray, rare: np.ndarray, mass: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what counts are divided by, backoff weight) of histories with a count, from their followers' counts of counts and unigram mass."""
    kept = sum((1 - d[r]) * r * rare[r - 1] for r in range(1, CUTOFF + 1))
    over = np.where(kept > 0, count, count + 1.0)
    return over, np.where(kept > 0, kept, 1.0) / over / (1 - mass)


def _score(words: int, buckets: int, unigrams: Unigrams, d: np.ndarray, starts: float, spread_from: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                _, hashes, stream, lengths, held, answers, ids, found, hot = (batch.column(c)[row].as_py() for c in range(9))
                c = Chunk(hashes, answers, stream, lengths, held, words, starts, spread_from)
                sums_of = {int(x["history"]): np.array(x["sums"]) for x in hot or []}
                probability = unigrams.probability(c.count)
                at = c.by_bucket(buckets)
                total, over, weight = np.zeros(len(c.history), np.int64), np.ones(len(c.history)), np.ones(len(c.history))
                count = c.history_count
                for a in found or []:
                    p = at[a["bucket"]]
                    total[p] = unpack(a["a"])
                    own, h = np.unique(c.history[p], return_inverse=True)
                    some, backed = unpack(a["b"]) > 0, np.unique(h[total[p] == 0])
                    rare, mass = np.zeros((CUTOFF, len(own))), np.zeros(len(own))
                    rare[:, backed], mass[backed] = unpack(a["d"]).reshape(CUTOFF, len(backed)), np.frombuffer(a["c"], "<f8")
                    for i in np.flatnonzero(np.isin(own, [*sums_of])):
                        rare[:, i], mass[i] = sums_of[int(own[i])][1:], sums_of[int(own[i])][0]
                        some[i] = rare[:, i].any()
                    over[p] = np.where(some[h] & (d[1] < 1), count[p], count[p] + 1.0)
                    weight[p] = backoff(count[p], rare[:, h], mass[h], d)[1]
                discounted = np.where(total > CUTOFF, 1.0, d[np.minimum(total, CUTOFF)]) * total / over
                pair, known = c.pair_of, c.known
                probability[known] = np.where(total[pair] > 0, discounted[pair], weight[pair] * probability[known])
                sums = lambda x: np.bincount(c.of, x, len(c.lengths))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(c.lengths.astype(np.int64)), pa.array(sums(c.count > 0).astype(np.int64)), pa.array([int(unigrams.n)] * len(ids), pa.int64()), pa.array(sums(unigrams.base(c.count))), pa.array(sums(np.log10(probability)))], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


class KatzModel:
    """The model of a corpus, learned from its training documents; its tables lie below ``path``."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.spark: SparkSession = docs.sparkSession
        self.id_col, self.path = id_col, new_table(self.spark, "katz")
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        # As many buckets as a shuffle has partitions at least: answers are then dealt like the chunks, which needn't move.
        buckets = max(1, texts.rdd.getNumPartitions(), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.tokens = self._bucketed(texts.mapInArrow(_tokenize, TOKENS), buckets)
        train = F.size(F.filter("held", lambda x: ~x))
        total, self.starts = self.tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum(train), F.lit(0))).first()
        self.buckets = max(1, -(-total // BUCKET))
        self.words = self._kept("words", self.tokens.select("chunk", "hashes", "counts").mapInArrow(_ask_words(self.buckets), "bucket int, chunk long, hashes binary, counts binary"), _count_words(self.buckets))
        self.unigrams = Unigrams(self._sums(self.words, CUTOFF + 3 + POWERS))
        asked = self._with_answers().mapInArrow(_ask_pairs(self.buckets, self.buckets, float(self.starts), HOT_TOKENS), "bucket int, chunk long, history binary, word binary, trained binary, followers binary, hot binary")
        self.pairs = self._kept("pairs", asked, _count_pairs(self.unigrams))
        self.d = discounts(self._sums(self.pairs, CUTOFF + 1 + POWERS))

    def _bucketed(self, tokens: DataFrame, n: int) -> DataFrame:
        """Bucketed by chunk, so that answers come to the chunks and the chunks stay where they are."""
        name = catalogued("gridloom_tokens_" + self.path.rpartition("-")[2])
        tokens.write.bucketBy(n, "chunk").option("path", f"{self.path}/tokens").saveAsTable(name)
        return self.spark.table(name)

    def _kept(self, name: str, asked: DataFrame, count) -> DataFrame:
        asked.groupBy("bucket").applyInArrow(count, KEPT).write.partitionBy("kind").parquet(f"{self.path}/{name}")
        release(self.spark)
        return self.spark.read.schema(KEPT).parquet(f"{self.path}/{name}")

    def _sums(self, kept: DataFrame, n: int) -> list[float]:
        row = kept.where(F.col("kind") == "sums").agg(*[F.sum(F.col("numbers")[i]).alias(f"x{i}") for i in range(n)]).first()
        return [x or 0.0 for x in row]

    def _answers(self, kept: DataFrame, name: str) -> DataFrame:
        return kept.where(F.col("kind") == "answer").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "a", "b", "c", "d")).alias(name))

    def _hot(self) -> DataFrame:
        """chunk, hot: what is known of the spread histories of a chunk."""
        sums = self.pairs.where(F.col("kind") == "hot").groupBy(F.col("numbers")[0].alias("history")).agg(F.array(*[F.sum(F.col("numbers")[i]) for i in range(1, CUTOFF + 2)]).alias("sums"))
        asked = self.pairs.where(F.col("kind") == "answer").select("chunk", F.explode("numbers").alias("history")).distinct()
        return asked.join(sums, "history").groupBy("chunk").agg(F.collect_list(F.struct("history", "sums")).alias("hot"))

    def _with_answers(self) -> DataFrame:
        return self.tokens.join(self._answers(self.words, "answers"), "chunk").select("chunk", "hashes", "stream", "lengths", "held", "answers", "ids")

    def score(self) -> DataFrame:
        """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document of the corpus."""
        asked = self._with_answers().join(self._answers(self.pairs, "found"), "chunk", "left").join(self._hot(), "chunk", "left").select("chunk", "hashes", "stream", "lengths", "held", "answers", "ids", "found", "hot")
        run = _score(self.buckets, self.buckets, self.unigrams, self.d, float(self.starts), HOT_TOKENS)
        return asked.mapInArrow(run, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", self.id_col)
