"""Quality classifier: a linear-chain conditional random field over a document's lines.

Each line has simple shape features (shares of character classes, word statistics, repetition), and those of
its previous and next line; states are good and bad. Training starts from the document's label on all its lines; then
lines of bad documents that the model finds good are relabelled (each bad document keeps its worst
line bad) and the field is fitted again. A document's quality is the mean of its lines' forward-backward
marginals, weighted by their length, mapped to a probability by logistic calibration on the training sample.

Everything is numpy over Arrow batches. Documents of one batch run through forward-backward together, sorted by
their number of lines; a very long text is a batch of its own, as its chain is one. Training takes a bounded sample of
labelled ids (``SAMPLE``, and ``SAMPLE_BYTES`` of text), whole texts, of rows of one id that with the least text.

Defined cases: a null or empty text is one empty line. Repeated rows get equal scores. With no labelled row, or
labels of one kind only, every score is that kind's share (0.5 if none). Labels of null doc_ids or null quality are ignored;
of several labels of one doc_id the lowest counts. An input column named like an output is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

SAMPLE = 4000
SAMPLE_BYTES = 64 << 20
CUTOFF = 0.3

# Character classes, in bytes.
CLASSES = {
    "space": b" \t\r\x0b\x0c",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>",
    "mark": b"!?",
    "stop": b".,;:",
    "other": b"\"'()[]{}@_=+/\\^~`-",
}


def _class_tables() -> np.ndarray:
    t = np.zeros((len(CLASSES), 256), np.uint8)
    for k, chars in enumerate(CLASSES.values()):
        t[k, list(chars)] = 1
    return t


_TABLES = _class_tables()
_WORD_CODES = np.random.default_rng(11).integers(1, 1 << 40, 256)
N_OWN = len(CLASSES) + 6
N_FEATURES = 3 * N_OWN + 1


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line: its own and its neighbours' features, and its length; and each text's number of lines."""
    raw = [t.encode("utf-8", "replace") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], breaks[:-1] + 1]).astype(np.int64)
    n_lines = np.array([r.count(b"\n") for r in raw], np.int64)
    length = (breaks - starts).astype(float)
    count = {name: np.add.reduceat(_TABLES[k][data], starts, dtype=np.int64).astype(float) for k, name in enumerate(CLASSES)}
    # words: maximal runs of bytes that are neither white space nor a line's end
    solid = (_TABLES[0][data] == 0) & (data != 10)
    begin = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1]]))
    own_line = np.searchsorted(breaks, begin)
    n = len(starts)
    words = np.bincount(own_line, minlength=n).astype(float)
    again = early = np.zeros(n)
    if len(begin):
        # a word's code ignores the order of its bytes, which is near enough to find repetition
        code = np.add.reduceat(np.where(solid, _WORD_CODES[data], 0), begin)
        same = np.concatenate([[False], (code[1:] == code[:-1]) & (own_line[1:] == own_line[:-1])])
        again = np.bincount(own_line[same], minlength=n)
        # runs of three words seen before in the same text
        text_of = np.repeat(np.arange(len(texts)), n_lines)[own_line]
        three = code.copy()
        three[1:] = three[1:] * 3 + code[:-1]
        three[2:] = three[2:] * 3 + code[:-2]
        key = three * 1000003 + text_of
        _, first = np.unique(key, return_index=True)
        seen = np.ones(len(key), bool)
        seen[first] = False
        early = np.bincount(own_line[seen], minlength=n)
    per_char, per_word = 1 / np.maximum(length, 1), 1 / np.maximum(words, 1)
    own = np.stack(
        [count[c] * per_char * 5 for c in CLASSES]
        + [np.log1p(words) / 4, (length - count["space"]) * per_word / 10, again * per_word, early * per_word, (words == 0).astype(float), (words < 5).astype(float)],
        1,
    )
    before, after = np.vstack([np.zeros((1, own.shape[1])), own[:-1]]), np.vstack([own[1:], np.zeros((1, own.shape[1]))])
    first_line = np.cumsum(n_lines) - n_lines
    before[first_line] = 0
    after[first_line + n_lines - 1] = 0
    return np.hstack([own, before, after, np.ones((n, 1))]), length + 1, n_lines


def _columns(n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts from most to fewest lines, their first lines, and how many have a line at each place."""
    order = np.argsort(-n_lines, kind="stable")
    first = (np.cumsum(n_lines) - n_lines)[order]
    sizes = n_lines[order]
    active = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right") if len(sizes) else np.zeros(0, int)
    return order, first, active


def forward_backward(unary: np.ndarray, trans: np.ndarray, n_lines: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each line (lines x 2) and expected transitions (2 x 2), these weighted by line."""
    order, first, active = _columns(n_lines)
    a, b = np.zeros_like(unary), np.zeros_like(unary)
    log_z = np.zeros(len(n_lines))
    for p, k in enumerate(active):
        at = first[:k] + p
        a[at] = unary[at] if p == 0 else unary[at] + np.logaddexp(a[at - 1, :1] + trans[0], a[at - 1, 1:] + trans[1])
    for p in range(len(active) - 1, -1, -1):
        k = active[p]
        more = active[p + 1] if p + 1 < len(active) else 0
        at = first[:more] + p
        if more:
            step = unary[at + 1] + b[at + 1]
            b[at] = np.stack([np.logaddexp(trans[s, 0] + step[:, 0], trans[s, 1] + step[:, 1]) for s in (0, 1)], 1)
    last = first + n_lines[order] - 1
    z = np.logaddexp(a[last, 0], a[last, 1])
    log_z[order] = z
    z_line = np.repeat(log_z, n_lines)
    marginals = np.exp(a + b - z_line[:, None])
    inner = np.ones(len(unary), bool)
    inner[np.cumsum(n_lines) - 1] = False
    at = np.flatnonzero(inner)
    nxt = unary[at + 1] + b[at + 1]
    w = np.ones(len(at)) if weight is None else weight[at]
    pair = np.array([[(w * np.exp(a[at, s] + trans[s, t] + nxt[:, t] - z_line[at])).sum() for t in (0, 1)] for s in (0, 1)])
    return marginals, pair


@dataclass
class Model:
    weights: np.ndarray  # features: evidence for good
    trans: np.ndarray
    scale: float
    shift: float
    constant: float | None = None

    def quality(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean of the lines' marginals."""
        x, length, n_lines = features(texts)
        u = x @ self.weights
        m, _ = forward_backward(np.stack([-u / 2, u / 2], 1), self.trans, n_lines)
        at = np.cumsum(n_lines) - n_lines
        return np.add.reduceat(m[:, 1] * length, at) / np.add.reduceat(length, at)

    def score(self, texts: list[str], block: int = 400_000) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = np.concatenate([self.quality(b) for b in _blocks(texts, block)]) if texts else np.empty(0)
        return 1 / (1 + np.exp(-(self.scale * _logit(out) + self.shift)))


def _blocks(texts: list[str], size: int = 400_000) -> Iterator[list[str]]:
    """The texts in blocks of about ``size`` characters, or of one longer text: what is in memory as arrays at once."""
    block: list[str] = []
    held = 0
    for t in texts:
        if block and held + len(t) > size:
            yield block
            block, held = [], 0
        block.append(t)
        held += len(t)
    if block:
        yield block


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _fit_field(x: np.ndarray, y: np.ndarray, n_lines: np.ndarray, doc_weight: np.ndarray, start: np.ndarray, rounds: int, l2: float) -> np.ndarray:
    """Maximise the weighted conditional likelihood of the line labels by Adam; parameters: weights, then transitions."""
    theta, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    line_weight = np.repeat(doc_weight, n_lines)
    gold = x.T @ (line_weight * (y - 0.5))
    inner = np.ones(len(y), bool)
    inner[np.cumsum(n_lines) - 1] = False
    at = np.flatnonzero(inner)
    gold_pair = np.zeros((2, 2))
    np.add.at(gold_pair, (y[at].astype(int), y[at + 1].astype(int)), line_weight[at])
    total = line_weight.sum()
    for r in range(1, rounds + 1):
        u, trans = x @ theta[:-4], theta[-4:].reshape(2, 2)
        marg, pair = forward_backward(np.stack([-u / 2, u / 2], 1), trans, n_lines, line_weight)
        g = gold - x.T @ (line_weight * (marg[:, 1] - 0.5))
        g = np.concatenate([g, (gold_pair - pair).ravel()]) / total - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return theta


def train(texts: list[str], labels: list[int], rounds: int = 60, l2: float = 1e-3) -> Model:
    good = np.array(labels, float)
    if not len(good) or good.min() == good.max():
        return Model(np.zeros(N_FEATURES), np.zeros((2, 2)), 1.0, 0.0, float(good.mean()) if len(good) else 0.5)
    parts = [features(block) for block in _blocks(texts)]
    x, n_lines = np.vstack([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
    # both kinds weigh the same, and each document as the root of its lines
    share = np.where(good == 1, 0.5 / good.sum(), 0.5 / (1 - good).sum()) * len(good) / np.sqrt(n_lines)
    y = np.repeat(good, n_lines)
    theta = _fit_field(x, y, n_lines, share, np.zeros(N_FEATURES + 4), rounds, l2)
    at = np.cumsum(n_lines) - n_lines
    u = x @ theta[:-4]
    relabelled = np.where(np.repeat(good, n_lines) == 1, 1.0, (u > 0).astype(float))
    worst = np.minimum.reduceat(u, at)
    relabelled[(u == np.repeat(worst, n_lines)) & (np.repeat(good, n_lines) == 0)] = 0
    theta = _fit_field(x, relabelled, n_lines, share, theta, rounds, l2)
    model = Model(theta[:-4], theta[-4:].reshape(2, 2), 1.0, 0.0)
    q = _logit(np.concatenate([model.quality(block) for block in _blocks(texts)]))
    s, c = 1.0, 0.0
    for _ in range(50):  # Newton's steps of a logistic regression with a little ridge
        p = 1 / (1 + np.exp(-(s * q + c)))
        w = p * (1 - p) + 1e-6
        grad = np.array([((good - p) * q).sum() - 1e-2 * s, (good - p).sum()])
        hess = np.array([[(w * q * q).sum() + 1e-2, (w * q).sum()], [(w * q).sum(), w.sum()]])
        ds, dc = np.linalg.solve(hess, grad)
        s, c = s + np.clip(ds, -1, 1), c + np.clip(dc, -1, 1)
    model.scale, model.shift = float(s), float(c)
    return model


def fit(docs: DataFrame, labels: DataFrame, where: Column, text: str = "text", doc_id: str = "doc_id", bound: int = SAMPLE) -> Model:
    """Train on at most ``bound`` labelled ids for which ``where`` (over the labels' doc_id) holds: the first by a hash of their ids."""
    one = labels.where(where & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"))
    picked = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).select(F.col("doc_id").alias("__l"), "q")
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(picked), F.col("id") == F.col("__l"))
    one = rows.groupBy("id").agg(F.min("t").alias("t"), F.min("q").alias("q"))  # ``bound`` rows at most
    before = F.sum(F.octet_length("t")).over(Window.partitionBy().orderBy(F.xxhash64("id"), "id")) - F.octet_length("t")
    rows = one.withColumn("before", before).where(F.col("before") < SAMPLE_BYTES).collect()
    rows.sort(key=lambda r: str(r["id"]))
    return train([r["t"] for r in rows], [r["q"] for r in rows])


def predict(docs: DataFrame, model: Model, columns: list[str], text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """``columns`` of ``docs`` with score and predicted (1 if the score is at least ``cutoff``)."""
    ship(docs.sparkSession)
    columns = [c for c in columns if c.lower() not in ("score", "predicted")]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*columns).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            score = sent.value.score(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= cutoff).astype(np.int32))], names=[*columns, "score", "predicted"])

    return docs.select(*columns, F.col(text)).mapInArrow(run, schema)
