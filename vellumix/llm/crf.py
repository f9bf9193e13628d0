"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is good (1) or bad (0). The field scores a labelling by each line's own
and neighbouring lines' features and by label transitions. Forward-backward marginals,
weighted by line length, give the document's quality, and a logistic curve fitted on the same
training sample turns that into a probability of label 1.

Line labels are hidden in training: a document's label speaks for each of its lines with the odds
BELIEF, and the likelihood of the document labels is maximised, so lines of one document can differ
and the transitions are learnt from such changes.

Training takes at most about SAMPLE_ROWS labelled documents of at most SAMPLE_LINES lines together
(documented bounds; documents are taken in the order of a hash, and those that no longer fit are
left out). Scoring reads whole texts in one pass without a shuffle; the broadcast model is a few
hundred numbers.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, give_back, held_once, held_out, labelled_sample, tidy

SAMPLE_ROWS = 6000
SAMPLE_LINES = 300_000
#: Log-odds that a line has its document's label.
BELIEF = 2.0
STEPS = 200
RATE = 0.1
RIDGE = 1e-3

# byte classes: lower, upper, digit, space, stop, exclamation, symbol, beyond ASCII, other
_CLASS = np.full(256, 8, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9, 13]] = 3
_CLASS[[ord(c) for c in ".,;:'\"-()"]] = 4
_CLASS[[ord(c) for c in "!?"]] = 5
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_CLASS[0xC2:0xF5] = 7
OWN = 16
WIDTH = 3 * OWN + 1


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x WIDTH), line lengths, and lines per text. Every text has a line, if an empty one."""
    lines = [t.split(b"\n") for t in texts]
    per_text = np.array([len(x) for x in lines], np.int64)
    flat = [x for own in lines for x in own]
    size = np.array([len(x) for x in flat], np.int64)
    data = np.frombuffer(b"".join(flat), np.uint8)
    n = len(flat)
    count = np.zeros((n, 9))
    begin = np.cumsum(size) - size
    at = 0
    while at < n:  # whole lines, some megabytes at a time
        to = max(at + 1, int(np.searchsorted(begin, begin[at] + (4 << 20))))
        part = data[begin[at] : begin[to - 1] + size[to - 1]]
        line = np.repeat(np.arange(to - at), size[at:to])
        count[at:to] = np.bincount(line * 9 + _CLASS[part], minlength=9 * (to - at)).reshape(-1, 9)
        at = to
    repeated, distinct, words = np.zeros(n), np.ones(n), np.zeros(n)
    k = 0
    for own in lines:
        times = Counter(own)
        for x in own:
            w = x.split()
            words[k] = len(w)
            if w:
                distinct[k] = len(set(w)) / len(w)
                repeated[k] = times[x] - 1
            k += 1
    share = count / np.maximum(size, 1)[:, None]
    last = np.zeros(n)
    filled = size > 0
    last[filled] = np.isin(data[(begin + size - 1)[filled]], list(b".!?"))
    own = np.column_stack([
        share[:, :8], np.log1p(size) / 6, size / np.maximum(words, 1) / 12, words > 3, last, np.log1p(repeated), distinct, size == 0, share[:, 1] > 0.5,
    ])
    first = np.zeros(n, bool)
    first[np.cumsum(per_text) - per_text] = True
    before = np.vstack([np.zeros((1, OWN)), own[:-1]])
    before[first] = 0
    after = np.vstack([own[1:], np.zeros((1, OWN))])
    after[np.append(first[1:], True)] = 0
    return np.column_stack([np.ones(n), own, before, after]), size, per_text


@dataclass
class Field:
    weights: np.ndarray
    transition: np.ndarray  # 2 x 2, from, to
    mean: np.ndarray
    scale: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)

    def marginals(self, x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        return forward_backward(((x - self.mean) / self.scale) @ self.weights, self.transition, per_text)[0]

    def quality(self, x: np.ndarray, size: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the marginals of each text."""
        edge = np.cumsum(per_text) - per_text
        weight = size + 1.0
        p = self.marginals(x, per_text)
        return np.add.reduceat(p * weight, edge) / np.add.reduceat(weight, edge) if len(edge) else np.empty(0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        a, b = self.curve
        return _logistic(a * _logit(self.quality(*line_features(texts))) + b)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def forward_backward(unary: np.ndarray, transition: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 for lines, and the expected transitions of each text (texts x 2 x 2).

    Chains are laid side by side, longest first, so a step of the recursion is one numpy step
    over the chains that are still going. Messages are normalised to stay in range.
    """
    begin = np.cumsum(per_text) - per_text
    order = np.argsort(-per_text, kind="stable")
    begin, length = begin[order], per_text[order]
    steps = int(length[0]) if len(length) else 0
    going = np.searchsorted(-length, -np.arange(steps), "left")  # chains longer than t
    emit = np.exp(np.column_stack([-unary, unary]) / 2 - np.abs(unary)[:, None] / 2)
    move = np.exp(transition - transition.max())
    alpha, beta = np.empty((len(unary), 2)), np.empty((len(unary), 2))
    for t in range(steps):
        at = begin[: going[t]] + t
        a = emit[at] if t == 0 else (alpha[at - 1] @ move) * emit[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    for t in range(steps - 1, -1, -1):
        n, more = going[t], going[t + 1] if t + 1 < steps else 0
        at = begin[:n] + t
        b = np.ones((n, 2))
        nxt = at[:more] + 1
        b[:more] = (emit[nxt] * beta[nxt]) @ move.T
        beta[at] = b / b.sum(axis=1, keepdims=True)
    both = alpha * beta
    both /= both.sum(axis=1, keepdims=True)
    pairs = np.zeros((len(per_text), 2, 2))
    if len(unary) > 1:
        text = np.repeat(np.arange(len(per_text)), per_text)
        inner = np.flatnonzero(text[1:] == text[:-1])
        e = alpha[inner][:, :, None] * move * (emit[inner + 1] * beta[inner + 1])[:, None, :]
        e /= e.sum(axis=(1, 2), keepdims=True)
        np.add.at(pairs, text[inner], e)
    return both[:, 1], pairs


def train(x: np.ndarray, size: np.ndarray, per_text: np.ndarray, y: np.ndarray) -> Field:
    """Penalised maximum likelihood of the documents' labels by Adam, line labels being hidden.

    The gradient is the expectation of the features given the document's label, less that without
    it. Each text weighs the same root of its length.
    """
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[0], scale[scale < 1e-9] = 0.0, 1.0
    z = (x - mean) / scale
    text = np.repeat(np.arange(len(per_text)), per_text)
    each = 1 / np.sqrt(per_text)
    each /= (each * per_text).sum()
    told = (2.0 * y[text] - 1) * BELIEF
    theta = np.zeros(z.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, move = theta[:-4], theta[-4:].reshape(2, 2)
        unary = z @ w
        p, pairs = forward_backward(unary, move, per_text)
        q, seen = forward_backward(unary + told, move, per_text)
        grad = np.concatenate([((q - p) * each[text]) @ z, (each[:, None, None] * (seen - pairs)).sum(axis=0).ravel()]) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    field = Field(theta[:-4], theta[-4:].reshape(2, 2), mean, scale)
    q = _logit(field.quality(x, size, per_text))
    a, b = 1.0, 0.0
    for _ in range(30):  # Newton steps for the curve
        p = _logistic(a * q + b)
        s = p * (1 - p) + 1e-9
        g = np.array([((y - p) * q).mean() - 1e-3 * a, (y - p).mean()])
        h = np.array([[(s * q * q).mean() + 1e-3, (s * q).mean()], [(s * q).mean(), s.mean()]])
        a, b = np.array([a, b]) + np.linalg.solve(h, g)
    field.curve = (float(max(a, 0.0)), float(b))
    return field


def fit(docs: DataFrame, labels: DataFrame, *, mod: int = 5, rem: int = 0, sample_rows: int = SAMPLE_ROWS, sample_lines: int = SAMPLE_LINES) -> Field:
    """Fit on a bounded sample of labelled rows outside the held-out fold.

    Without any such row, or with one label only, every text scores that label's smoothed rate.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, size, per_text = line_features([t.as_py() or b"" for t in batch.column(0)])
            edge = np.cumsum(per_text) - per_text
            cut = [(slice(a, a + n)) for a, n in zip(edge.tolist(), per_text.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([x[c].astype(np.float32).tobytes() for c in cut]), pa.array([size[c].tobytes() for c in cut])], ["y", "x", "size"]
            )

    rows = labelled_sample(docs, labels, "quality", mod, rem, sample_rows).select(F.coalesce("text", F.lit("")).alias("text"), "y")
    lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    rows = rows.withColumn("lines", lines).withColumn("h", F.xxhash64("text"))
    taken, total = {}, 0
    for r in rows.groupBy("h", "lines").agg(F.count("*").alias("k")).orderBy("h").limit(4 * sample_rows).collect():
        if total + r.k * r.lines <= sample_lines:
            taken[r.h] = True
            total += r.k * r.lines
    keep = spark.createDataFrame([(h,) for h in taken], "h bigint")
    rows = rows.join(F.broadcast(keep), "h").select(F.col("text").cast("binary").alias("text"), "y")
    got = rows.mapInArrow(tidy(run), "y int, x binary, size binary").toArrow()
    y = np.array(got.column("y").to_pylist(), np.int64)
    if len(set(y.tolist())) < 2:
        rate = (y.sum() + 1) / (len(y) + 2)
        return Field(np.zeros(WIDTH), np.zeros((2, 2)), np.zeros(WIDTH), np.ones(WIDTH), (0.0, float(np.log(rate / (1 - rate)))))
    x = [np.frombuffer(b.as_py(), np.float32).reshape(-1, WIDTH) for b in got.column("x")]
    size = [np.frombuffer(b.as_py(), np.int64) for b in got.column("size")]
    order = sorted(range(len(y)), key=lambda i: (int(y[i]), x[i].tobytes()))  # the same fit in any row order
    x, size, y = [x[i] for i in order], [size[i] for i in order], y[order]
    return train(np.vstack(x).astype(float), np.concatenate(size), np.array([len(s) for s in size]), y)


def quality_of(spark, field: Field):
    """A Column function: text -> probability that the text is good."""
    shared, key = spark.sparkContext.broadcast(field), uuid.uuid4().hex
    bounded_batches(spark)

    @F.arrow_udf("double")
    def rate(text: pa.Array) -> pa.Array:
        f = held_once(key, lambda: shared.value)
        out = pa.array(f.score([t or b"" for t in text.to_pylist()]), pa.float64())
        give_back()
        return out

    return lambda text: rate(text.cast("binary"))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of every row of docs(doc_id, text), learnt from labels(doc_id, quality).

    Returns doc_id, held_out, score and predicted (1 if score >= 0.3). A null text counts as
    empty: one line of length 0; a text of any length is read whole. Repeated rows give repeated
    results; other columns are ignored; an empty table gives no rows, and without labels every text
    scores the smoothed rate 1/2.
    """
    score = quality_of(docs.sparkSession, fit(docs, labels))
    rows = docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), score(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
