"""Operator 5, quality classifier: a linear-chain conditional random field over a text's lines.

Every line is labelled good or bad from its own features and those of the lines before and after
it. Forward-backward gives each line's marginal; weighted by the lines' lengths they make the
document's quality, which a one-variable logistic curve turns into a probability.

Labels are of documents, so a line first takes its document's label; after a fit, lines of bad
documents that the model finds good are relabelled (each such document keeps its worst line bad),
and the model is fitted again.

Learning: from at most ``SAMPLE`` labelled rows with at most ``LINES`` lines together, those with
the smallest hash of their id (documented bounds; classes keep their share), never those whose
crc32(doc_id) mod 5 is 0. A row that doesn't fit into what is left of the lines is passed over, so
a labelled text of more than ``LINES`` lines is never learned from, and the time and memory of a
fit are bounded whatever the texts' lengths. Scoring covers all rows and whole texts in one scan
without a shuffle.

Defined cases: a null or empty text is one empty line and gets that line's score; repeated labels
of an id count as their smallest; labels other than 0 and 1, or null, are ignored; a null doc_id
is never learned from and isn't held out; without any labels every score is 0.5; repeated
documents each give a row, and one of them is learned from; a very long text is scored whole, in
time linear in its lines; other columns are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import as_text, id_text, remainder, slices

#: Labelled rows that are learned from, and their lines together, at most.
SAMPLE, LINES = 6000, 200_000
HELD_OUT, THRESHOLD = 5, 0.3
ROUNDS, STEPS, RATE, DECAY = 3, 120, 0.1, 1e-4
#: Edges of the bins that each measure of a line is put in.
_BINS = {
    "length": (1, 20, 60, 150, 400, 1000),
    "words": (1, 3, 6, 12, 30, 100),
    "upper": (0.01, 0.05, 0.15, 0.4, 0.7),
    "digits": (0.005, 0.03, 0.1, 0.3),
    "marks": (0.005, 0.02, 0.05, 0.1, 0.2),
    "odd": (0.002, 0.01, 0.03, 0.08, 0.2),
    "word_length": (2.0, 3.5, 5.0, 8.0, 12.0),
    "distinct": (0.1, 0.3, 0.5, 0.7, 0.9),
    "again": (0.01, 0.05, 0.2, 0.5),
    "long_word": (12, 20, 40),
}
_WIDTH = [len(e) + 1 for e in _BINS.values()]
_OFFSET = np.cumsum([0, *_WIDTH])
#: One-hot bins and whether the same line stands elsewhere in the text.
OWN = int(_OFFSET[-1]) + 1
SIZE = 3 * OWN + 3
_CLASS = np.zeros(0x250, dtype=np.uint8)
for _c in range(0x250):
    _s = chr(_c)
    _CLASS[_c] = 1 if _s.isupper() else 2 if _s.isdigit() else 3 if _s in ".,;:!?'\"()-" else 0 if _s.isalpha() or _s.isspace() else 4


class Model(NamedTuple):
    weights: np.ndarray  # emission of "good" over "bad"
    moves: np.ndarray  # [from, to]
    slope: float
    shift: float


def line_bins(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Active features of each line (index or -1) and the lines' lengths."""
    lines = text.split("\n")
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    kinds = _CLASS[np.minimum(codes, 0x24F)]
    lengths = np.array([len(x) for x in lines], dtype=np.int64)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    share = []
    for kind in (1, 2, 3, 4):
        run = np.concatenate(([0], np.cumsum(kinds == kind)))
        share.append((run[ends] - run[starts]) / np.maximum(lengths, 1))
    seen: dict[str, int] = {}
    for line in lines:
        seen[line] = seen.get(line, 0) + 1
    words = [x.split() for x in lines]
    n = np.array([len(w) for w in words], dtype=np.int64)
    distinct = np.array([len(set(w)) for w in words]) / np.maximum(n, 1)
    again = np.array([sum(a == b for a, b in zip(w, w[1:], strict=False)) for w in words]) / np.maximum(n, 1)
    longest = np.array([max(map(len, w), default=0) for w in words])
    mean = np.array([sum(map(len, w)) for w in words]) / np.maximum(n, 1)
    values = (lengths, n, share[0], share[1], share[2], share[3], mean, distinct, again, longest)
    bins = np.stack([np.searchsorted(e, v, side="right") + o for (e, v, o) in zip(_BINS.values(), values, _OFFSET[:-1], strict=True)], axis=1)
    repeated = np.array([OWN - 1 if x and seen[x] > 1 else -1 for x in lines])
    return np.column_stack((bins, repeated)).astype(np.int32), lengths


def emissions(bins: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores of "good" over "bad" for each line, from its features and its neighbours'."""
    padded = np.concatenate((weights, [0.0]))  # -1 is no feature

    def of(block: int) -> np.ndarray:
        return padded[np.where(bins < 0, -1, bins + block * OWN)].sum(axis=1)

    own, before, after = of(0), of(1), of(2)
    out = own + weights[3 * OWN]
    out[1:] += before[:-1]
    out[:-1] += after[1:]
    out[0] += weights[3 * OWN + 1]
    out[-1] += weights[3 * OWN + 2]
    return out


def marginals(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(good) of each line by forward-backward."""
    n = len(scores)
    top = moves.max()
    (bb, bg), (gb, gg) = np.exp(moves - top).tolist()
    good = (1 / (1 + np.exp(-np.clip(scores, -30, 30)))).tolist()
    ahead, f = [0.0] * n, good[0]
    ahead[0] = f
    for t in range(1, n):
        e = good[t]
        g = (f * gg + (1 - f) * bg) * e
        b = (f * gb + (1 - f) * bb) * (1 - e)
        f = g / (g + b)
        ahead[t] = f
    out, back = [0.0] * n, 0.5
    for t in range(n - 1, -1, -1):
        f = ahead[t]
        g, b = f * back, (1 - f) * (1 - back)
        out[t] = g / (g + b)
        e = good[t]
        x, y = e * back, (1 - e) * (1 - back)
        g, b = gg * x + gb * y, bg * x + bb * y
        back = g / (g + b)
    return np.array(out)


def document_quality(bins: np.ndarray, lengths: np.ndarray, model: Model) -> float:
    """Length-weighted mean of the lines' marginals, as log odds."""
    good = marginals(emissions(bins, model.weights), model.moves)
    weight = lengths + 1.0
    mean = float((good * weight).sum() / weight.sum())
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    return math.log(mean / (1 - mean))


def probability(bins: np.ndarray, lengths: np.ndarray, model: Model) -> float:
    z = model.slope * document_quality(bins, lengths, model) + model.shift
    return 1 / (1 + math.exp(-min(max(z, -40.0), 40.0)))


def fit(sample: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """From (bins, lengths, label) of each text; exact gradients of the conditional likelihood."""
    if len({y for *_, y in sample}) < 2:
        return Model(np.zeros(SIZE), np.zeros((2, 2)), 0.0, 0.0 if not sample else (4.0 if sample[0][2] else -4.0))
    lines = [np.full(len(n), y, dtype=np.int64) for _, n, y in sample]
    model = Model(np.zeros(SIZE), np.zeros((2, 2)), 1.0, 0.0)
    for turn in range(ROUNDS):
        model = _ascend([b for b, *_ in sample], lines, model)
        if turn + 1 < ROUNDS:
            for k, (bins, _, y) in enumerate(sample):
                if not y:
                    good = marginals(emissions(bins, model.weights), model.moves)
                    lines[k] = (good > 0.5).astype(np.int64)
                    lines[k][int(good.argmin())] = 0
    x = np.array([document_quality(b, n, model) for b, n, _ in sample])
    y = np.array([y for *_, y in sample], dtype=float)
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton's steps, with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        w = p * (1 - p) + 1e-6
        grad = np.array([((y - p) * x).sum() - 0.1 * (slope - 1), (y - p).sum() - 0.1 * shift])
        hess = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        slope, shift = slope + step[0], shift + step[1]
    return model._replace(slope=float(max(slope, 1e-3)), shift=float(shift))


class Lines:
    """The lines of all texts one after another, and which are their texts' first and last."""

    def __init__(self, bins: list[np.ndarray]) -> None:
        first = np.concatenate(([0], np.cumsum([len(b) for b in bins])))
        self.head, self.tail = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
        self.head[first[:-1]], self.tail[first[1:] - 1] = True, True
        flat = np.concatenate(bins)
        # A feature that isn't there is one more, whose weight is zero.
        self.features = np.where(flat < 0, OWN, flat).astype(np.int64)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        own, before, after = (np.append(weights[k * OWN : (k + 1) * OWN], 0.0)[self.features].sum(axis=1) for k in range(3))
        score = own + weights[3 * OWN] + self.head * weights[3 * OWN + 1] + self.tail * weights[3 * OWN + 2]
        score[1:] += np.where(self.head[1:], 0, before[:-1])
        score[:-1] += np.where(self.tail[:-1], 0, after[1:])
        return score

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of each line over its active features and its neighbours'."""
        grad = np.zeros(SIZE)
        shifted = values, np.where(self.tail, 0, np.r_[values[1:], 0]), np.where(self.head, 0, np.r_[0, values[:-1]])
        for block, x in enumerate(shifted):
            for feature in self.features.T:
                grad[block * OWN : (block + 1) * OWN] += np.bincount(feature, weights=x, minlength=OWN + 1)[:OWN]
        grad[3 * OWN :] = values.sum(), values[self.head].sum(), values[self.tail].sum()
        return grad


def forward_backward(emit: np.ndarray, trans: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward weights of every line of all texts, each scaled to sum one.

    The step into a line is a 2 x 2 matrix, and the step into a text's first line forgets what was
    before it, so all texts are one chain. It is cut into about as many blocks as a block has lines:
    products within all blocks are made at once, and only the blocks' edges one after another.
    Texts of any length therefore take about the square root of the lines in steps of Python.
    """
    n = len(emit)
    size = max(1, math.isqrt(n))
    blocks = -(-n // size)
    flat = np.zeros((2, 2, blocks * size))
    flat[0, 0], flat[1, 1] = 1, 1
    flat[:, :, :n] = np.where(head, 1.0, trans[:, :, None]) * emit.T[None]
    # By place in the block: matrices of all blocks.
    step = np.ascontiguousarray(np.moveaxis(flat.reshape(2, 2, blocks, size), 3, 0))
    until, onward = np.empty_like(step), np.empty_like(step)
    until[0], onward[-1] = step[0], step[-1]
    for j in range(1, size):
        for out, at, a, b in ((until, j, until[j - 1], step[j]), (onward, -1 - j, step[-1 - j], onward[-j])):
            product = a[:, 0, None] * b[None, 0] + a[:, 1, None] * b[None, 1]
            out[at] = product / product.sum(axis=(0, 1))
    enter, leave = np.full((2, blocks), 0.5), np.full((2, blocks), 0.5)
    for k in range(1, blocks):
        a = enter[:, k - 1] @ until[-1, :, :, k - 1]
        enter[:, k] = a / a.sum()
        b = onward[0, :, :, -k] @ leave[:, -k]
        leave[:, -1 - k] = b / b.sum()
    ahead = enter[0] * until[:, 0] + enter[1] * until[:, 1]
    back = np.concatenate((onward[1:, :, 0] * leave[0] + onward[1:, :, 1] * leave[1], leave[None]))
    ahead, back = (np.moveaxis(x, 2, 0).reshape(-1, 2)[:n] for x in (ahead, back))
    return ahead / ahead.sum(axis=1, keepdims=True), back / back.sum(axis=1, keepdims=True)


def gradient(lines: Lines, gold: np.ndarray, params: np.ndarray) -> np.ndarray:
    """Of the log likelihood of the lines' labels, by weights and then moves."""
    weights, moves = params[:SIZE], params[SIZE:].reshape(2, 2)
    e = 1 / (1 + np.exp(-np.clip(lines.scores(weights), -30, 30)))
    emit, trans = np.stack((1 - e, e), 1), np.exp(moves - moves.max())
    ahead, back = forward_backward(emit, trans, lines.head)
    both = ahead * back
    good = both[:, 1] / both.sum(axis=1)
    pairs = np.flatnonzero(~lines.tail)
    true_moves = np.zeros((2, 2))
    np.add.at(true_moves, (gold[pairs], gold[pairs + 1]), 1)
    joint = ahead[pairs][:, :, None] * trans[None] * (emit[pairs + 1] * back[pairs + 1])[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return np.concatenate((lines.spread(gold - good), (true_moves - joint.sum(axis=0)).ravel()))


def _ascend(bins: list[np.ndarray], labels: list[np.ndarray], model: Model) -> Model:
    """Adam on all texts at once."""
    lines, gold = Lines(bins), np.concatenate(labels)
    params = np.concatenate((model.weights, model.moves.ravel()))
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        grad = gradient(lines, gold, params) / len(gold) - DECAY * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(params[:SIZE], params[SIZE:].reshape(2, 2), 1.0, 0.0)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_lines: int = LINES) -> Model:
    """Fits the model on a bounded sample of labelled rows; features are made on the executors."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(
        F.col("quality").isin(0, 1) & (remainder(F.col("doc_id"), HELD_OUT) != 0)
    )
    chosen = named.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64(F.col("doc_id"), F.lit(5)), "doc_id").limit(sample)
    # At most ``sample`` rows of two numbers.
    rows = id_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")

    def features(batches):
        for batch in batches:
            for part in slices(batch):
                texts = as_text(part.column("text"))
                fits = [t.count("\n") < most_lines for t in texts]
                part, made = part.filter(pa.array(fits, pa.bool_())), [line_bins(t) for t, ok in zip(texts, fits, strict=True) if ok]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([b.astype("<i2").tobytes() for b, _ in made], pa.binary()), pa.array([n.astype("<i8").tobytes() for _, n in made], pa.binary()), part.column("quality")],
                    ["doc_id", "bins", "lengths", "quality"],
                )

    made = rows.mapInArrow(features, "doc_id long, bins binary, lengths binary, quality int")
    # One row of each id, however often it is repeated, in the order of the ids' hashes.
    single = made.groupBy("doc_id").agg(F.min(F.struct("lengths", "bins", "quality")).alias("least")).orderBy(F.xxhash64(F.col("doc_id"), F.lit(5)), "doc_id").select("least.*")
    got, left = [], most_lines
    for row in single.toLocalIterator():
        if (n := len(row["lengths"]) // 8) <= left:
            got.append((row["quality"], bytes(row["lengths"]), bytes(row["bins"])))
            left -= n
    width = len(_BINS) + 1
    return fit([(np.frombuffer(bins, "<i2").reshape(-1, width).astype(np.int32), np.frombuffer(lengths, "<i8"), y) for y, lengths, bins in sorted(got)])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            for part in slices(batch):
                p = [probability(*line_bins(t), shared.value) for t in as_text(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    return id_text(docs).mapInArrow(work, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), HELD_OUT) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, filtered where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def good(batches):
        for batch in batches:
            keep = [probability(*line_bins(t), shared.value) >= THRESHOLD for t in as_text(batch.column("text"))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(good, docs.schema)
