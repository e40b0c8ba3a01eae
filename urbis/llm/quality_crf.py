"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's score depends on its own features and on those of the lines
before and after it; transitions tie neighbouring labels. Forward-backward gives each line's marginal of
being good; the marginals, weighted by line length, average to the document's quality, which a logistic
curve maps to the probability of the document label.

Line labels are latent in training: a document's label is evidence for each of its lines, EVIDENCE in
log-odds, and the marginal likelihood of the evidence is maximised. A good document may so hold bad lines,
and transitions learn how labels change.
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

from urbis.llm.common import Spans, fold, held_out, persist, sample, slices, sums, text_bytes

#: Labelled documents the model is fitted on.
TRAINING_ROWS = 4_000
#: Documents of more lines are left out of the fit (not of scoring), which bounds the sample on the driver.
TRAINING_LINES = 2_000
#: Log-odds with which a line has its document's label, before its features are seen.
EVIDENCE = 2.0
SLICE_BYTES = 4 << 20
N_FEATURES = 14

_UPPER, _DIGIT, _SYMBOL, _MARK, _SPACE = (np.zeros(256, bool) for _ in range(5))
_UPPER[0x41:0x5B] = True
_DIGIT[0x30:0x3A] = True
_SYMBOL[list(b"#*$%&|<>{}[]=_~^@\\/")] = True
_MARK[list(b"!?.,;:\"'()-")] = True
_SPACE[[0x20, *range(9, 14)]] = True


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (lines x N_FEATURES), their byte lengths, and the n + 1 bounds of each text's lines.

    A text has at least one line, possibly empty; a null text is an empty one.
    """
    data, offsets = text_bytes(column)
    spans = Spans(data, offsets)
    starts, ends, begins = spans.lines()
    word_start, word_end, _ = spans.words()

    def share(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=total[1:])
        return total[ends] - total[starts]

    size = ends - starts
    solid = np.maximum(size - share(_SPACE), 1)
    upper, digit, symbol, mark = (share(t) / solid for t in (_UPPER, _DIGIT, _SYMBOL, _MARK))
    shout = np.zeros(256, bool)
    shout[list(b"!|")] = True
    first, last = np.searchsorted(word_start, starts), np.searchsorted(word_start, ends)
    n = last - first
    each = np.maximum(n, 1)
    length = word_end - word_start
    hashes = spans.hashes(word_start, word_end)
    owner = np.repeat(np.arange(len(starts)), n)
    pair = np.unique(np.stack([owner.astype(np.uint64), hashes]), axis=1)[0].astype(np.int64) if len(owner) else owner
    distinct = np.bincount(pair, minlength=len(starts)) / each
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    bounds = np.append(first, len(word_start))
    odd = np.zeros(len(word_end), bool)
    if len(word_end):
        odd = _SYMBOL[data[word_end - 1]] | (data[word_end - 1] == 0x21)
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    filled = n > 0
    line_hash = spans.hashes(starts, ends) ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at, counts = np.unique(line_hash, return_inverse=True, return_counts=True)
    repeated = (counts[at.reshape(-1)] > 1) & filled
    tail = np.where(size > 0, data[np.maximum(ends - 1, 0)] if len(data) else 0, 0)
    x = np.stack(
        [np.log1p(n), np.log1p(size), np.log1p(sums(length, bounds) / each), upper, digit, symbol, mark, share(shout) / each, distinct, sums(again.astype(np.int64), bounds) / each, sums(odd.astype(np.int64), bounds) / each, repeated.astype(float), np.isin(tail, list(b".!?")).astype(float), (~filled).astype(float)],
        axis=1,
    )
    return x, size, begins


def with_neighbours(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (0 outside the text), and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[begins[:-1]] = 0
    after[begins[1:] - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


def forward_backward(score: np.ndarray, pull: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of good, sums of pair marginals (2 x 2), and the log-normaliser, over chains side by side.

    score: log-potential of good for each line (bad: 0); pull: log-potentials of neighbouring labels.
    """
    sizes = np.diff(begins)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = begins[:-1][order], sizes[order]
    step = np.exp(pull - pull.max())
    scale = np.maximum(score, 0)
    phi = np.stack([np.exp(-scale), np.exp(score - scale)], axis=1)
    alpha, beta, norm = np.empty_like(phi), np.ones_like(phi), np.ones(len(score))
    longest = int(sizes[0]) if len(sizes) else 0
    active = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest)]  # chains with more than t lines
    for t in range(longest):
        now = starts[: active[t]] + t
        a = phi[now] if t == 0 else (alpha[now - 1] @ step) * phi[now]
        norm[now] = a.sum(axis=1)
        alpha[now] = a / norm[now][:, None]
    pairs = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        now = starts[: active[t + 1]] + t
        ahead = phi[now + 1] * beta[now + 1] / norm[now + 1][:, None]
        beta[now] = ahead @ step.T
        pairs += (alpha[now].T @ ahead) * step
    marginal = alpha * beta
    log_z = float((np.log(norm) + scale).sum() + pull.max() * max(len(score) - len(sizes), 0))
    return marginal[:, 1] / marginal.sum(axis=1), pairs, log_z


@dataclass
class LineCrf:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    pull: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)

    def marginals(self, x: np.ndarray, begins: np.ndarray) -> np.ndarray:
        features = with_neighbours((x - self.mean) / self.spread, begins)
        return forward_backward(features @ self.weights, self.pull, begins)[0]

    def quality(self, x: np.ndarray, size: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of each text."""
        weight = size + 1.0
        return sums(self.marginals(x, begins) * weight, begins) / sums(weight, begins)

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability of the good label of each text."""
        q = np.clip(self.quality(*line_features(column)), 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.curve[0] * np.log(q / (1 - q)) + self.curve[1])))


def objective(w: np.ndarray, features: np.ndarray, begins: np.ndarray, label: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Negative marginal log-likelihood of the evidence a line, with the penalty, and its gradient; w: weights, then the 2 x 2 pulls."""
    score, pull = features @ w[:-4], w[-4:].reshape(2, 2)
    toward = EVIDENCE * np.repeat(2.0 * label - 1, np.diff(begins))
    free, free_pairs, free_z = forward_backward(score, pull, begins)
    held, held_pairs, held_z = forward_backward(score + toward, pull, begins)
    loss = (free_z - held_z) / len(score) + l2 / 2 * float(w @ w)
    grad = np.concatenate([features.T @ (free - held), (free_pairs - held_pairs).reshape(-1)]) / len(score) + l2 * w
    return loss, grad


def fit(x: np.ndarray, size: np.ndarray, begins: np.ndarray, label: np.ndarray, steps: int = 120, l2: float = 1e-3) -> LineCrf:
    """Marginal likelihood by Adam, then the logistic curve of the documents' quality."""
    model = LineCrf(x.mean(axis=0), x.std(axis=0) + 1e-6, np.zeros(3 * N_FEATURES + 1), np.zeros((2, 2)))
    if not 0 < label.mean() < 1:
        return LineCrf(model.mean, model.spread, model.weights, model.pull, (0.0, 4.0 if label.mean() else -4.0))
    features = with_neighbours((x - model.mean) / model.spread, begins)
    w = np.zeros(features.shape[1] + 4)
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, steps + 1):
        _, g = objective(w, features, begins, label, l2)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights, model.pull = w[:-4], w[-4:].reshape(2, 2)
    q = np.clip(model.quality(x, size, begins), 1e-4, 1 - 1e-4)
    z, curve = np.log(q / (1 - q)), np.array([1.0, 0.0])
    for _ in range(50):  # Newton's steps, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(curve[0] * z + curve[1], -30, 30)))
        grad = np.array([(p - label) @ z, (p - label).sum()]) + 1e-2 * (curve - [1.0, 0.0])
        s = p * (1 - p) + 1e-9
        hess = np.array([[s @ (z * z), s @ z], [s @ z, s.sum()]]) + 1e-2 * np.eye(2)
        curve = curve - np.clip(np.linalg.solve(hess, grad), -2, 2)
    model.curve = (float(max(curve[0], 0.0)), float(curve[1]))
    return model


def train(documents: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAINING_ROWS) -> LineCrf:
    """Fit on about `rows` labelled documents outside fold 0 (null labels left out, the larger of several taken).

    Documents of more than TRAINING_LINES lines take no part.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(F.col(id_col)) != 0)).groupBy(id_col).agg((F.max(label_col) > 0).cast("int").alias("label"))
    chosen = documents.select(id_col, text_col).join(F.broadcast(sample(known, id_col, rows)), id_col).where(F.col(text_col).isNotNull()).select(text_col, "label")
    chosen = chosen.where(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) < TRAINING_LINES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            x, size, begins = line_features(part.column(0))
            offsets = pa.array(begins.astype(np.int32))
            flat = pa.ListArray.from_arrays(pa.array((begins * N_FEATURES).astype(np.int32)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column(1), pa.ListArray.from_arrays(offsets, pa.array(size.astype(np.int64))), flat], ["label", "size", "x"])

    found = persist(chosen.mapInArrow(run, "label int, size array<long>, x array<double>"), "quality-sample").toArrow()
    if not found.num_rows:
        return LineCrf(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(3 * N_FEATURES + 1), np.zeros((2, 2)), (0.0, 0.0))
    sizes = found.column("size").combine_chunks()
    begins = np.concatenate([[0], np.cumsum(pc.list_value_length(sizes).to_numpy(zero_copy_only=False))]).astype(np.int64)
    x = np.asarray(pc.list_flatten(found.column("x")).to_numpy()).reshape(-1, N_FEATURES)
    return fit(x, np.asarray(pc.list_flatten(sizes)).astype(np.int64), begins, found.column("label").to_numpy().astype(np.int64))


def score(df: DataFrame, model: LineCrf, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.3) -> DataFrame:
    """One row per input row: id, score (0 to 1, higher: better), predicted (1 if score >= limit, else 0).

    Null and empty texts are one empty line and get that line's score. Repeated rows are scored alike,
    other columns are ignored, an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    slim = df.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, SLICE_BYTES):
            p = shared.value.score(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= limit).astype(np.int32))], [id_col, "score", "predicted"])

    return slim.mapInArrow(run, T.StructType([slim.schema[0], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn outside fold 0 and score all rows."""
    return score(documents, train(documents, labels)).withColumn("held_out", held_out(F.col("doc_id")))
