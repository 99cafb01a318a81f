"""Toxicity by a classifier chain.

Categories are predicted in a fixed order. Each has a logistic model over the text's features and the
log-odds of all earlier categories; while training, those are out-of-fold predictions, so that a later
model never sees an earlier one's answer to a row that taught it. Features are words and the starts of
words (stems with varying endings are then found in words never seen), each once for being there and
once more for being there twice.

The categories come from the labels: low quality (where labels have that column), two kinds of toxic texts, and toxic. The
kinds are the two sides of the direction in which the telling features of toxic texts differ most; a text's side is
judged by the direction and the median of the other folds' toxic texts, so it isn't among those that drew the line.

Training uses at most ``TRAIN_ROWS`` labelled rows, those with the smallest hash of their id, and of their features
``FEATURES`` for toxic and ``QUALITY_FEATURES`` for low quality, the most telling ones by log-likelihood ratio, be they
commoner or rarer in such texts; scoring reads every whole text.

Nulls and empty texts have no features and get the base rate, never a rejection by themselves; labels that are null or
whose document is missing teach nothing; with no row, or one class only, a category's probability
is its rate in training, and without positive labels nothing is toxic. An id with several labels has the largest, one
with several texts teaches by the smallest of them. A null id keeps its row; repeated rows
each get their row; other columns are not read (``reject`` keeps them).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.base import cut, forget, trim

#: Bounds of training, whatever the input.
TRAIN_ROWS, FEATURES, QUALITY_FEATURES, FOLDS, STEPS, PENALTY = 4000, 768, 256, 5, 240, 0.5
#: Lengths of the starts of words; least rows that a feature is in; probability from which a text is toxic.
STARTS, LEAST_ROWS, TOXIC_FROM = (4, 5, 6, 7), 3, 0.5
#: Entries of a worker's memo of words without model features, emptied when full.
MEMO = 300_000
WORD = re.compile(r"[^\W\d_]+")
CATEGORIES = ("low_quality", "kind_1", "kind_2", "toxic")


def word_features(word: str) -> list[int]:
    """Signed 64-bit hashes of a word's features."""
    named = [f"{word[:n]}-" for n in STARTS if len(word) >= n] + [word]
    return [xxhash.xxh3_64_intdigest(x.encode()) - (1 << 63) for x in named]


def text_features(text: str | None) -> list[int]:
    """Hashes of all features of a text; that of being there twice is the hash's complement."""
    once: Counter[int] = Counter()
    for word, n in Counter(WORD.findall(text.lower()) if text else ()).items():
        for f in word_features(word):
            once[f] += n
    return [*once, *(~f for f, n in once.items() if n > 1)]


class Logistic:
    """Weights and intercept of a logistic model, or a constant rate where one class is all there is."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.w, rate = np.zeros(x.shape[1]), float(y.mean()) if len(y) else 0.0
        self.constant = rate in (0.0, 1.0)
        self.b = 30.0 * (2 * rate - 1) if self.constant else float(np.log(rate / (1 - rate)))
        if self.constant:
            return
        # Accelerated gradient steps; the curvature is at most |x|^2 / 4 and the penalty.
        v = np.zeros(x.shape[1] + 1)
        z, last = np.r_[self.w, self.b], np.r_[self.w, self.b]
        u = np.ones(x.shape[1], x.dtype)
        for _ in range(12):
            u = x.T @ (x @ u)
            u /= np.linalg.norm(u) or 1.0
        step = 1 / (0.25 * (np.linalg.norm(x @ u) ** 2 + len(y)) + PENALTY)
        for t in range(1, STEPS + 1):
            error = self.sigmoid(x @ z[:-1].astype(x.dtype) + z[-1]) - y
            new = z - step * np.r_[x.T @ error.astype(x.dtype) + PENALTY * z[:-1], error.sum()]
            z, last, v = new + (t - 1) / (t + 2) * (new - last), new, z
        self.w, self.b = last[:-1], float(last[-1])

    @staticmethod
    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.w + self.b, -30, 30)


class Chain:
    """A logistic model for each category in order, fed with the log-odds of those before it."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, fold: np.ndarray):
        self.models: list[Logistic] = []
        for j in range(labels.shape[1]):
            y = labels[:, j]
            self.models.append(Logistic(x, y))
            if j + 1 < labels.shape[1]:
                out = np.zeros(len(y))
                for f in range(FOLDS):
                    held = fold == f
                    if held.any():
                        out[held] = Logistic(x[~held], y[~held]).odds(x[held]) if (~held).any() else 0.0
                x = np.hstack([x, (out[:, None] / 10).astype(x.dtype)])

    def tables(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights of features (n x categories), of earlier categories, and intercepts."""
        width = len(self.models)
        fed = np.zeros((width, width))
        for j, m in enumerate(self.models):
            fed[:j, j] = m.w[n:] / 10
        return np.stack([m.w[:n] for m in self.models], axis=1), fed, np.array([m.b for m in self.models])


def predict(score: np.ndarray, fed: np.ndarray, intercept: np.ndarray) -> np.ndarray:
    """Probabilities of the categories, from sums of feature weights (rows x categories)."""
    odds = np.zeros_like(score)
    for j in range(score.shape[1]):
        odds[:, j] = np.clip(score[:, j] + odds[:, :j] @ fed[:j, j] + intercept[j], -30, 30)
    return Logistic.sigmoid(odds)


def kinds(x: np.ndarray, toxic: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """(rows x 2) which of two kinds a toxic row is of, by its side of the main direction of the other folds' toxic rows."""
    out = np.zeros((len(x), 2))

    def line(rows: np.ndarray) -> tuple[np.ndarray, float]:
        centred = rows - rows.mean(axis=0)
        v = np.ones(x.shape[1]) / max(1, x.shape[1]) ** 0.5
        for _ in range(30):
            v = centred.T @ (centred @ v)
            v /= np.linalg.norm(v) or 1.0
        return v, float(np.median(rows @ v))

    own = toxic > 0
    if own.sum() < 2 * FOLDS:
        out[own, 0] = 1.0
        return out
    whole, _ = line(x[own])
    for f in range(FOLDS):
        held = own & (fold == f)
        if held.any() and (own & ~held).any():
            v, median = line(x[own & ~held])
            sign = 1.0 if v @ whole >= 0 else -1.0
            side = sign * (x[held] @ v - median) > 0
            out[held] = np.stack([side, ~side], axis=1)
        else:
            out[held, 0] = 1.0
    return out


def _telling(sample: DataFrame, label: str, n: int, positive: float, most: int) -> list[int]:
    """The features of the largest log-likelihood ratio for a label; ``most`` at most come to the driver."""
    if not 0 < positive < n or most <= 0:
        return []
    counted = sample.select(F.explode("features").alias("f"), F.col(label).alias("y")).groupBy("f").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("p")).where((F.col("c") >= LEAST_ROWS) & (F.col("c") < n))
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0))
    c, p, rate = F.col("c"), F.col("p"), positive / n
    ratio = term(p, c * rate) + term(c - p, c * (1 - rate)) + term(positive - p, (n - c) * rate) + term((n - c) - (positive - p), (n - c) * (1 - rate))
    return [r.f for r in counted.orderBy(ratio.desc(), "f").limit(most).select("f").collect()]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", quality_col: str = "quality"):
    """({feature hash: row of weights}, weights of earlier categories, intercepts), from a bounded sample."""
    low = F.when(F.col(quality_col).isNotNull(), (F.col(quality_col) <= 0).cast("double")).otherwise(F.lit(0.0)) if quality_col in labels.columns else F.lit(0.0)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y"), low.alias("low")).where(F.col("id").isNotNull() & F.col("y").isNotNull()).groupBy("id").agg((F.max("y") > 0).cast("double").alias("toxic"), F.max("low").alias("low"))
    # At most TRAIN_ROWS ids: small whatever the input. Labels without a document may take places, none is made up for.
    chosen = cut(known.orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    labelled = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("low").alias("low")).select("id", "text", "toxic", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for i in range(0, whole.num_rows, 128):
                b = whole.slice(i, 128)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array([text_features(t) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["id", "toxic", "low", "features"])

    kind = labelled.schema["id"].dataType.simpleString()
    sample = cut(labelled.mapInArrow(run, f"id {kind}, toxic double, low double, features array<long>"))
    n, toxic, low = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0.0)), F.coalesce(F.sum("low"), F.lit(0.0))).first()
    found = _telling(sample, "toxic", n, toxic, FEATURES)
    place = {f: i for i, f in enumerate(dict.fromkeys([*found, *_telling(sample, "low", n, low, QUALITY_FEATURES)]))}
    wanted = F.array(*[F.lit(f) for f in place]) if place else F.array().cast("array<long>")
    # Bounded: TRAIN_ROWS rows with FEATURES and QUALITY_FEATURES features at most.
    got = sorted(sample.select("id", "toxic", "low", F.array_intersect("features", wanted).alias("features")).collect(), key=lambda r: r.id)
    x, y = np.zeros((len(got), len(place)), np.float32), np.array([r.toxic for r in got])
    for i, r in enumerate(got):
        x[i, [place[f] for f in r.features]] = 1.0
    fold = np.array([xxhash.xxh3_64_intdigest(str(r.id).encode()) % FOLDS for r in got], int)
    of_kind = kinds(x[:, : len(found)], y, fold)
    categories = np.column_stack([np.array([r.low for r in got]), of_kind, y]) if got else np.zeros((0, len(CATEGORIES)))
    weights, fed, intercept = Chain(x, categories, fold).tables(len(place))
    return {f: weights[i] for f, i in place.items()}, fed, intercept


class Scorer:
    """Sums of feature weights of whole texts."""

    def __init__(self, weights: dict[int, np.ndarray]):
        self.weights, self.memo = weights, {}

    def of_word(self, word: str) -> tuple[int, ...]:
        return tuple(f for f in word_features(word) if f in self.weights or ~f in self.weights)

    def score(self, text: str | None) -> np.ndarray | float:
        words = WORD.findall(text.lower()) if text else []
        memo = self.memo
        try:
            hits = [w for w in words if memo[w]]
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            memo |= {w: self.of_word(w) for w in set(words) if w not in memo}
            hits = [w for w in words if memo[w]]
        counts: Counter[int] = Counter()
        for w in hits:
            counts.update(memo[w])
        found = [self.weights[f] for f in counts if f in self.weights] + [self.weights[~f] for f, n in counts.items() if n > 1 and ~f in self.weights]
        return np.sum(found, axis=0) if found else 0.0


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, a probability for each of CATEGORIES, and whether the text is toxic, for every row."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))  # bounded by FEATURES
    names = ["id", *(f"p_{c}" for c in CATEGORIES), "is_toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        weights, fed, intercept = model.value
        scorer = Scorer(weights)
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                sums = np.zeros((b.num_rows, len(CATEGORIES)))
                for j, t in enumerate(b.column(1).to_pylist()):
                    sums[j] = scorer.score(t)
                p = predict(sums, fed, intercept).round(6)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, c]) for c in range(len(CATEGORIES))), pa.array(p[:, -1] >= TOXIC_FROM)], names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{n} double" for n in names[1:-1]) + ", is_toxic boolean"
    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "is_toxic": "toxic"})


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))

    @F.pandas_udf("boolean")
    def is_toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        weights, fed, intercept = model.value
        scorer = Scorer(weights)  # one for a task, with its memo
        for texts in batches:
            sums = np.zeros((len(texts), len(CATEGORIES)))
            for j, t in enumerate(texts):
                sums[j] = scorer.score(t)
            yield pd.Series(predict(sums, fed, intercept)[:, -1].round(6) >= TOXIC_FROM)
        del scorer
        trim()

    return docs.where(~is_toxic(F.col(text_col)))
