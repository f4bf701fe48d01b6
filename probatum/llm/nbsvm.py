"""Quality classifier: n-gram indicators scaled by class log-count ratios, and a linear hinge-loss model on them.

Features are hashed into a table of fixed size: n-grams of bytes, n-grams of the text's
shape (runs of lower case, upper case, digits, blanks and other characters), patterns of
equal neighbouring words, and the text's length class.  The class counts behind the ratios
cover all training rows; the hinge-loss model is fitted on a bounded sample of them by dual
coordinate descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from probatum.llm.shared import fresh, id_remainder
from probatum.operators.scale import lookup_join

#: size of the feature table; byte and shape n-grams up to these lengths
FEATURES, BYTE_GRAMS, SHAPE_GRAMS = 1 << 18, 3, 5
#: the model is fitted on so many labelled rows at most, half of them to each class where there are as many
SAMPLE = 8000
ALPHA, COST, EPOCHS, MIX = 1.0, 1.0, 12, 0.25

_SHIFT = np.uint64(64 - 18)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[ord("a"):ord("z") + 1] = _CLASS[128:] = ord("a")  # letters beyond ASCII count as lower case
_CLASS[ord("A"):ord("Z") + 1] = ord("A")
_CLASS[ord("0"):ord("9") + 1] = ord("0")


def _slots(codes: np.ndarray, kind: int) -> np.ndarray:
    mixed = (codes ^ np.uint64(kind << 56)) * _SPREAD
    return (((mixed ^ (mixed >> np.uint64(29))) * _SPREAD) >> _SHIFT).astype(np.int32)


def _grams(symbols: np.ndarray, most: int, kind: int) -> list[np.ndarray]:
    out, codes = [], np.zeros(len(symbols), dtype=np.uint64)
    for n in range(1, min(most, len(symbols)) + 1):
        codes = (codes[:len(symbols) - n + 1] << np.uint64(8)) | symbols[n - 1:]
        out.append(_slots(codes, kind + n))
    return out


def features(text: str) -> np.ndarray:
    """Distinct feature numbers of a text, in order."""
    raw = text.encode()
    data = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64)
    shape = _CLASS[data.astype(np.intp)]
    runs = shape[np.concatenate(([True], shape[1:] != shape[:-1]))] if len(shape) else shape
    words = raw.split()
    same = np.fromiter(map(hash, words), dtype=np.int64, count=len(words))
    equal = (same[1:] == same[:-1]).astype(np.uint64)
    size = np.array([len(words).bit_length()], dtype=np.uint64)
    found = [*_grams(data, BYTE_GRAMS, 16), *_grams(runs, SHAPE_GRAMS, 32), *_grams(equal, 3, 48), _slots(size, 64)]
    return np.unique(np.concatenate(found))


@dataclass
class Model:
    """Weights of the features and the map from margins to scores; of a fixed size."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, text: str) -> float:
        margin = self.weights[features(text)].sum() + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500))))


def class_counts(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many rows of each class have each feature, over all of ``train(text, label)``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, FEATURES), dtype=np.int64)
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                totals[label, features(text or "")] += 1
        at = np.flatnonzero(totals.any(axis=0))
        yield pa.RecordBatch.from_pydict({"feature": at.astype(np.int64), "low": totals[0, at], "high": totals[1, at]})
    sums = (train.mapInArrow(count, "feature bigint, low bigint, high bigint").groupBy("feature")
            .agg(F.sum("low").alias("low"), F.sum("high").alias("high")).toPandas())  # FEATURES rows at most
    low, high = np.zeros(FEATURES), np.zeros(FEATURES)
    low[sums["feature"]], high[sums["feature"]] = sums["low"], sums["high"]
    return low, high


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = COST,
                            epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss over rows of feature numbers, whose values are ``scale``; labels are +1 and -1."""
    w, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    values = [scale[r] for r in rows]
    square = np.array([v @ v + 1.0 for v in values])
    share = len(labels) / (2 * np.array([max(1, (labels == s).sum()) for s in (-1, 1)]))
    upper = cost * np.where(labels > 0, share[1], share[0])
    order, draw = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        draw.shuffle(order)
        largest = 0.0
        for i in order:
            y, r, v = labels[i], rows[i], values[i]
            gradient = y * (w[r] @ v + bias) - 1
            step = min(max(alpha[i] - gradient / square[i], 0.0), upper[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[r] += step * y * v
                bias += step * y
                largest = max(largest, abs(step) * square[i])
        if largest < 1e-3:
            break
    return w, bias


def _sigmoid_fit(margins: np.ndarray, labels: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and shift of the logistic curve over margins (Newton steps on smoothed targets)."""
    high, low = (labels > 0).sum(), (labels < 0).sum()
    target = np.where(labels > 0, (high + 1) / (high + 2), 1 / (low + 2))
    x = np.stack([margins, np.ones_like(margins)])
    at = np.array([1.0 / max(1e-9, margins.std()), 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -500, 500)))
        slope = x @ (p - target) + 1e-6 * at
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-9)) @ x.T + 1e-6 * np.eye(2), slope)
        at -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(at[0], 1e-9)), float(at[1])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        sample: int = SAMPLE, folds: int = 3, held_out: int = 1) -> Model:
    """Learn from labelled rows whose ``crc32(id) mod folds`` is not ``held_out``.

    Labels that are null or neither 0 nor 1 are left out, of several labels of an id the
    largest counts, null ids have none.  Only ids, labels and texts are read.  With one
    class alone, or none, all scores are that class's (or one half).
    """
    known = (labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & (id_remainder(F.col(doc_id), folds) != held_out))
             .groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("label")))
    train = lookup_join(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
                        .where(id_remainder(F.col(doc_id), folds) != held_out), known, ["doc_id"], "inner")
    low, high = class_counts(train)
    ratio = np.log((high + ALPHA) / (high + ALPHA).sum()) - np.log((low + ALPHA) / (low + ALPHA).sum())

    sizes = dict(known.groupBy("label").count().collect())
    half = sample // 2
    room = {0: max(half, sample - sizes.get(1, 0)), 1: max(half, sample - sizes.get(0, 0))}
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    chosen = F.lit(False)
    for value, n in room.items():
        # the share keeps a margin below the bound, which is a hard one all the same
        chosen |= (F.col("label") == value) & (chance < 0.95 * n / max(1, sizes.get(value, 0)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([features(t or "").tobytes() for t in texts], pa.binary())],
                                             names=["doc_id", "label", "features"])
    picked = known.where(chosen).limit(sample)
    bounded = train.join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").cast("bigint"), "label", "text")
    rows = bounded.mapInArrow(of, "doc_id bigint, label int, features binary").toPandas().sort_values("doc_id", kind="stable")
    y = np.where(rows["label"].to_numpy() == 1, 1.0, -1.0)
    if len(set(y)) < 2:
        return Model(np.zeros(FEATURES), 0.0, 1.0, float(np.sign(y.sum()) * 5) if len(y) else 0.0)
    x = [np.frombuffer(b, dtype=np.int32) for b in rows["features"]]
    # the last fifth sets the curve from margins to scores
    cut = np.random.default_rng(11).permutation(len(x))
    learn, tune = cut[:len(x) * 4 // 5], cut[len(x) * 4 // 5:]
    w, bias = dual_coordinate_descent([x[i] for i in learn], y[learn], ratio)
    weights = ratio * (MIX * w + (1 - MIX) * np.abs(w).mean())
    # one number stands for the class ratios alone, so both models are on one scale
    margins = np.array([weights[x[i]].sum() + bias for i in tune])
    slope, shift = _sigmoid_fit(margins, y[tune]) if len(set(y[tune])) == 2 else (1.0, 0.0)
    return Model(weights.astype(np.float32), bias, slope, shift)


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of label 1 in column ``name``, 0 to 1; null texts count as empty, and empty texts have a score."""
    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t or "") for t in texts.to_pylist()], pa.float64())
    return docs.withColumn(name, score(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; a null id counts as the empty text for the fold."""
    model = fit(docs, labels, doc_id, text, label)
    (score,) = fresh(docs, "score")
    rows = scored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    return rows.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))
