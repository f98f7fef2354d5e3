"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's features are its byte n-grams (n = 2 to 4 by default, over lower-cased UTF-8, so they cross no
document), hashed to buckets with an embedding each; the embeddings are averaged and a linear softmax gives a
probability for each language. Training uses a bounded sample of labelled rows (``SAMPLE`` documents, or one of each
language if these are more, spread evenly over the languages by hash order; ``SAMPLE_BYTES`` of text), whole texts. A temperature, and for rejection the probability
that all but ``REJECT`` of the right held-back predictions reach, are fitted on a fifth of the sample that SGD doesn't see.

For prediction the embeddings are multiplied with the softmax weights once (if the languages are no more than the
embedding's numbers), so a text costs one table look-up for each n-gram; texts go through in Arrow batches and are used
whole, a very long one in slices of its n-grams.

Defined cases: a null text, or one without letters, is ``und`` with score 0 and rejected. Repeated rows get equal
predictions. Of equal probabilities the first language by name wins. An input column named like an output is replaced. Rows with a null language or doc_id are never trained on. With no labelled row every text is
``und``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

SAMPLE = 2000
SAMPLE_BYTES = 64 << 20
REJECT = 0.01
UNKNOWN = "und"
BITS, DIM = 18, 16
ORDERS = (2, 3, 4)
#: N-grams of one text that are looked up at once.
SLICE = 1 << 20


def ngrams(texts: list[str], bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte n-gram of the texts, and the place where each text's begin. Every text has at least one."""
    raw = [(" " + t.lower() + " ").encode("utf-8", "replace").ljust(max(orders), b" ") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    ends = np.cumsum(sizes)
    out = []
    h = data
    for n in range(2, max(orders) + 1):
        h = h[:-1] * np.uint32(16777619) ^ data[n - 1 :]
        if n in orders:
            mixed = h * np.uint32(2654435761 + 2 * n)
            out.append(np.concatenate([mixed >> np.uint32(32 - bits), np.zeros(n - 1, np.uint32)]))
    # an n-gram belongs to the text where it starts; those that would cross into the next text repeat a text's first
    table = np.stack(out, 1)
    for k, n in enumerate(orders):
        for back in range(1, n):
            table[ends - back, k] = table[ends - sizes, k]
    return table.ravel(), (ends - sizes) * len(orders)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x languages: embeddings times weights; or the embeddings
    weights: np.ndarray | None  # with embeddings: embedding x languages
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, texts: list[str]) -> np.ndarray:
        """Calibrated probabilities, a row for each text."""
        out = np.empty((len(texts), len(self.langs)))
        block: list[str] = []
        at = size = 0
        for i, t in enumerate([*texts, None]):
            if block and (t is None or size + len(t) > 400_000):
                out[at:i] = self._block(block)
                block, at, size = [], i, 0
            if t is not None:
                block.append(t)
                size += len(t)
        return out

    def _block(self, texts: list[str]) -> np.ndarray:
        ids, starts = ngrams(texts, len(self.table).bit_length() - 1)
        counts = np.diff(np.append(starts, len(ids)))
        if len(texts) > 1:
            sums = np.add.reduceat(np.take(self.table, ids, axis=0), starts, axis=0, dtype=np.float64)
        else:
            sums = sum(np.take(self.table, ids[k : k + SLICE], axis=0).sum(0, dtype=np.float64) for k in range(0, len(ids), SLICE))[None]
        means = sums / counts[:, None]
        return softmax(((means if self.weights is None else means @ self.weights) + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], langs: list[str], bits: int = BITS, dim: int = DIM, epochs: int = 8, rate: float = 20.0, seed: int = 7) -> Model:
    """SGD over single texts with a falling rate; every fifth text is held back for calibration."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    w = np.zeros((dim, len(names)), np.float32)
    w += rng.normal(0, 0.1, w.shape)
    b = np.zeros(len(names), np.float32)
    held = np.arange(len(texts)) % 5 == 4
    if held.sum() < len(names) or (~held).sum() == 0:
        held[:] = False
    own = np.flatnonzero(~held)
    counted = []
    for i in own:
        ids, n = np.unique(ngrams([texts[i]], bits)[0], return_counts=True)
        counted.append((ids, (n / n.sum()).astype(np.float32)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(own)):
            ids, share = counted[k]
            x = share @ e[ids]
            p = softmax((x @ w + b)[None])[0]
            p[y[own[k]]] -= 1
            dx = w @ p
            w -= step * 0.05 * np.outer(x, p)
            b -= step * 0.002 * p
            e[ids] -= step * share[:, None] * dx
    model = Model(names, (e @ w).astype(np.float32), None, b, 1.0, 0.0) if len(names) <= dim else Model(names, e, w, b, 1.0, 0.0)
    check = np.flatnonzero(held)
    if len(check):
        p = np.log(model.predict([texts[i] for i in check]) + 1e-12)
        losses = {t: -np.log(softmax(p / t)[np.arange(len(check)), y[check]] + 1e-12).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 4.0)}
        model.temperature = min(losses, key=losses.get)
        best = softmax(p / model.temperature)
        right = np.sort(best.max(1)[best.argmax(1) == y[check]])
        model.threshold = float(right[int(REJECT * len(right))]) if len(right) else 0.0
    return model


def labelled_sample(rows: DataFrame, bound: int = SAMPLE, size: int = SAMPLE_BYTES) -> DataFrame:
    """Of ``rows`` (id, t, l) with a label l, about ``bound`` spread evenly over the labels, in the order of a hash of their ids.

    Every label has a row at least. Of rows of one id that with the least label and text counts. Once the
    texts taken exceed ``size`` bytes, no more are.
    """
    counts = rows.groupBy("l").agg(F.approx_count_distinct("id").alias("n"))
    each = F.greatest(F.lit(1), F.floor(F.lit(bound) / F.count(F.lit(1)).over(Window.partitionBy())))  # a row for each label only
    counts = counts.select(F.col("l").alias("l_"), "n", each.alias("each"))  # as many rows as the model has languages
    by = F.xxhash64("id")
    # a few more than needed by a threshold on the hash, so that no label's rows meet in one task; then the first of them
    near = F.pmod(by, F.lit(1 << 30)) < (4 * F.col("each") + 20) / F.col("n") * (1 << 30)
    some = rows.join(F.broadcast(counts), F.col("l") == F.col("l_")).where(near).groupBy("id").agg(F.min(F.struct("l", "t", "each")).alias("r")).select("id", "r.*")
    first = some.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy(by, "id"))).where("k <= each")
    before = F.sum(F.octet_length("t")).over(Window.partitionBy().orderBy("k", by, "id", "l")) - F.octet_length("t")
    return first.withColumn("before", before).where(F.col("before") < size).select("id", "t", "l")


def fit(docs: DataFrame, where: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", bound: int = SAMPLE) -> Model | None:
    """Train on about ``bound`` rows for which ``where`` holds, or one for each language; None if there is none."""
    usable = where & F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")
    rows = docs.where(usable).select(F.col(doc_id).alias("id"), F.col(text).alias("t"), F.col(lang).alias("l"))
    got = labelled_sample(rows, bound).collect()
    got.sort(key=lambda r: (str(r["id"]), r["t"]))
    order = np.random.default_rng(3).permutation(len(got))
    return train([got[i]["t"] for i in order], [got[i]["l"] for i in order]) if got else None


def predict(docs: DataFrame, model: Model | None, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of ``docs`` with lang_pred, score and rejected."""
    ship(docs.sparkSession)
    columns = [c for c in columns if c.lower() not in ("lang_pred", "score", "rejected")]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*columns).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            n = len(texts)
            lang, score = [UNKNOWN] * n, np.zeros(n)
            known = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if m else []
            if known:
                p = m.predict([texts[i] for i in known])
                for i, k in zip(known, p.argmax(1), strict=True):
                    lang[i] = m.langs[k]
                score[known] = np.clip(p.max(1), 0, 1)
            rejected = [x == UNKNOWN or s < m.threshold for x, s in zip(lang, score.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected, pa.bool_())], names=[*columns, "lang_pred", "score", "rejected"]
            )

    return docs.select(*columns, F.col(text)).mapInArrow(run, schema)
