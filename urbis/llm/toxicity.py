"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector shared by all ordered thresholds. x holds, for
each selected feature, log(1 + its count); features are lower-cased words and the prefixes of words, so
inflected forms share weight. Features are chosen by chi-square over the training rows, and the expected
severity is the sum of P(grade >= k) over the grades.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbis.llm.common import Spans, fold, persist, sample, slices, text_bytes

#: Labelled rows the model is fitted on, and features it may have.
TRAINING_ROWS = 12_000
MAX_FEATURES = 6_000
#: Prefix lengths in bytes of UTF-8.
PREFIXES = (5, 6, 7, 8, 9)
#: A feature must occur in that many training rows.
LEAST_ROWS = 5

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature hash) of every occurrence, and the number of words of each text."""
    low = pa.array([(t or "").lower() for t in column.to_pylist()], pa.large_string())
    data, offsets = text_bytes(low)
    solid = np.concatenate([[False], _WORD[data], [False]])
    first = solid[1:] & ~solid[:-1]
    real = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[real] = solid[real + 1]
    starts = np.flatnonzero(first[: len(data)])
    stops = np.flatnonzero(~solid[1:])  # bytes outside words, and the end
    ends = np.minimum(stops[np.searchsorted(stops, starts)], offsets[np.searchsorted(offsets, starts, side="right")]) if len(starts) else starts
    spans, size = Spans(data, offsets), ends - starts
    owner = np.searchsorted(offsets, starts, side="right") - 1
    texts, hashes = [owner], [spans.hashes(starts, ends)]
    for k in PREFIXES:
        longer = np.flatnonzero(size > k)
        texts.append(owner[longer])
        hashes.append(spans.hashes(starts[longer], starts[longer] + k) ^ np.uint64(k))
    return np.concatenate(texts), np.concatenate(hashes).view(np.int64), np.bincount(owner, minlength=len(column))


@dataclass
class OrdinalModel:
    """Sorted feature hashes, their weights, and the thresholds of the grades."""

    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self) -> None:
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.hashes.view(np.uint64) >> np.uint64(44)] = True

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature index, count) of the selected features, and the words of each text."""
        text, h, n_words = features(column)
        maybe = np.flatnonzero(self.sieve[h.view(np.uint64) >> np.uint64(44)])
        text, h = text[maybe], h[maybe]
        at = np.searchsorted(self.hashes, h)
        hit = at < len(self.hashes)
        hit[hit] = self.hashes[at[hit]] == h[hit]
        pairs, n = np.unique(text[hit] * max(len(self.hashes), 1) + at[hit], return_counts=True)
        return pairs // max(len(self.hashes), 1), pairs % max(len(self.hashes), 1), n, n_words

    def at_least(self, column: pa.Array) -> np.ndarray:
        """P(grade >= k) for k = 1 .. (texts x thresholds)."""
        text, feature, n, n_words = self.counts(column)
        eta = np.bincount(text, self.weights[feature] * np.log1p(n), minlength=len(column))
        eta = np.where(n_words > 0, eta, -30.0)  # nothing said
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - eta[:, None], -60, 60)))


def cuts(w: np.ndarray, size: int) -> np.ndarray:
    """The ordered thresholds: the first parameter after the weights, and the exponentials of the others added up."""
    return w[size] + np.concatenate([[0.0], np.cumsum(np.exp(w[size + 1 :]))])


def objective(w: np.ndarray, row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood with the penalty on the weights, and its gradient; w: weights, then the thresholds' parameters."""
    rows, grades = len(grade), int(grade.max(initial=1)) + 1
    size = len(w) - (grades - 1)

    def link(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    eta = np.bincount(row, w[feature] * value, minlength=rows)
    bounds = np.concatenate([[-np.inf], cuts(w, size), [np.inf]])
    high, low = bounds[grade + 1] - eta, bounds[grade] - eta
    up, down = np.where(np.isinf(high), 1.0, link(high)), np.where(np.isinf(low), 0.0, link(low))
    p = np.maximum(up - down, 1e-12)
    d_up, d_down = up * (1 - up) / p, down * (1 - down) / p
    d_theta = np.array([d_down[grade == k + 1].sum() - d_up[grade == k].sum() for k in range(grades - 1)]) / rows
    d_weights = np.bincount(feature, ((d_up - d_down) / rows)[row] * value, minlength=size) + l2 * w[:size]
    d_gaps = [d_theta[k + 1 :].sum() * np.exp(w[size + 1 + k]) for k in range(grades - 2)]
    return float(-np.log(p).mean() + l2 / 2 * (w[:size] @ w[:size])), np.concatenate([d_weights, [d_theta.sum()], d_gaps])


def fit(row: np.ndarray, feature: np.ndarray, n: np.ndarray, grade: np.ndarray, hashes: np.ndarray, l2: float = 1e-5, steps: int = 600) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty, by Adam over the whole sample, for as many grades as the sample has."""
    grades, value = int(grade.max(initial=1)) + 1, np.log1p(n)
    share = np.array([(grade > k).mean() for k in range(grades - 1)])
    start = np.log((1 - share + 1e-6) / (share + 1e-6))
    w = np.concatenate([np.zeros(len(hashes)), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, steps + 1):
        _, g = objective(w, row, feature, value, grade, l2)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return OrdinalModel(hashes, w[: len(hashes)], cuts(w, len(hashes)))


def select_features(rows: DataFrame, text_col: str, label_col: str, limit: int = MAX_FEATURES) -> np.ndarray:
    """Hashes of the features with the highest signed chi-square of "label > 0" over the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            text, h, _ = features(part.column(0))
            label = np.asarray(part.column(1)).astype(np.int64)
            order = np.lexsort((text, h))
            text, h = text[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            text, h = text[new], h[new]
            keys, at = np.unique(h, return_inverse=True)
            at = at.reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(at, minlength=len(keys)).astype(np.int64)), pa.array(np.bincount(at, label[text] > 0, minlength=len(keys)).astype(np.int64))], ["h", "n", "bad"])

    totals = rows.agg(F.count(F.lit(1)), F.count_if(F.col(label_col) > 0)).first()
    if not totals[0] or not totals[1] or totals[0] == totals[1]:
        return np.zeros(0, np.int64)
    rate = totals[1] / totals[0]
    counted = rows.select(text_col, F.col(label_col).cast("int").alias("label")).mapInArrow(run, "h long, n long, bad long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    excess = F.col("bad") - F.col("n") * rate
    best = counted.where(F.col("n") >= LEAST_ROWS).withColumn("z", F.abs(excess) / F.sqrt(F.col("n") * rate * (1 - rate))).where("z > 3.5").orderBy(F.desc("z"), "h").limit(limit).select("h")
    return np.sort(np.array([r[0] for r in best.collect()], np.int64))


def train(rows: DataFrame, text_col: str, grade_col: str) -> OrdinalModel:
    """Fit on the given (bounded) rows, for the grades 0, 1, .. that they hold.

    A binary label is two grades with one threshold; its expected severity is the probability of grade 1.
    """
    rows = persist(rows.where(F.col(text_col).isNotNull() & F.col(grade_col).isNotNull()).select(text_col, F.col(grade_col).cast("int").alias("grade")), "toxicity-sample")
    hashes = select_features(rows, text_col, "grade")
    empty = OrdinalModel(hashes, np.zeros(len(hashes)), np.array([30.0]))
    if not len(hashes):
        return empty
    shared = rows.sparkSession.sparkContext.broadcast(empty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            text, feature, n, _ = shared.value.counts(part.column(0))
            cuts = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (feature, n)]
            yield pa.RecordBatch.from_arrays([part.column(1), *lists], ["grade", "feature", "n"])

    found = rows.mapInArrow(run, "grade int, feature array<int>, n array<int>").toArrow()
    grade = found.column("grade").to_numpy()
    sizes = np.asarray(pc.list_value_length(found.column("feature")).to_numpy()).astype(np.int64)
    feature, n = (np.asarray(pc.list_flatten(found.column(c)).to_numpy()).astype(np.int64) for c in ("feature", "n"))
    row = np.repeat(np.arange(len(grade)), sizes)
    return fit(row, feature, n, grade.astype(np.int64), hashes)


def labelled(documents: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A bounded sample of documents with their label (the largest of several), outside fold 0."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(F.col(id_col)) != 0)).groupBy(id_col).agg(F.max(label_col).alias("label"))
    chosen = sample(known, id_col, rows)
    return documents.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(text_col, "label")


def score(df: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.4) -> DataFrame:
    """One row per input row: id, severity (expected grade), p_toxic (of grade 1 or more), grade, toxic.

    A null text and one without words have severity 0. toxic: p_toxic >= limit. Repeated rows are scored
    alike, other columns are ignored, an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    slim = df.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            p = shared.value.at_least(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array((p >= 0.5).sum(axis=1).astype(np.int32)), pa.array(p[:, 0] >= limit)], [id_col, "severity", "p_toxic", "grade", "toxic"])

    return slim.mapInArrow(run, T.StructType([slim.schema[0], T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())]))


def keep_clean(df: DataFrame, model: OrdinalModel, text_col: str = "text", limit: float = 0.4) -> DataFrame:
    """The rows whose text is not toxic, with all their columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            yield part.filter(pa.array(shared.value.at_least(part.column(text_col))[:, 0] < limit))

    return df.mapInArrow(run, df.schema)
