"""Vector best-fit packing of tokenized documents into fixed-length sequences.

1. Documents are tokenized whole, in Arrow batches; a document's ids end with a separator. Longer ones are cut
   into full sequences, the first piece taking the rest.
2. Pieces are dealt evenly, by a hash of their place in the written table, into groups of about ``GROUP`` pieces, however many there are, so
   packing is parallel and a task's memory is bounded; each group loses at most about one sequence.
3. In a group, longest piece first, a bin is chosen among all open ones in which the piece fits under every
   capacity (tokens, documents, attention cost as the sum of squared lengths): the one with the least
   weighted norm of what would remain, or with the greatest weighted dot product of demand and residual.

The vocabulary's ids come from ``tiktoken`` with the same merges where the text has only characters up to
U+024F, which is about five times as fast; other texts, and those that hold a special token, go through ``tokenizers``.

Defined cases: a null or empty text is the separator alone. Repeated rows are packed each. Null doc_ids stay null.
Empty tables give empty results. Extra columns are not used.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, ship

TOKENS = 2048
SEPARATOR = 0
GROUP = 8192
#: Pieces' columns but doc_id.
PIECE = "piece int, start long, length long, ids_crc32 long"

_loaded: dict = {}
_SIMPLE = re.compile("[\x00-ɏ]*")


def _encoder(vocabulary: str):
    """A function from a text to its ids; made once in each Python worker."""
    if vocabulary not in _loaded:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(vocabulary)
        fast = _same_merges(vocabulary)
        specials = [x.content for x in whole.get_added_tokens_decoder().values()]

        def encode(text: str) -> list[int]:
            if fast is not None and _SIMPLE.fullmatch(text) and not any(s in text for s in specials):
                return fast(text)
            return whole.encode(text, add_special_tokens=False).ids

        _loaded[vocabulary] = encode
    return _loaded[vocabulary]


def _same_merges(vocabulary: str):
    """tiktoken's encoder of the same byte-level vocabulary, if a rank file lies beside it."""
    import base64
    from pathlib import Path

    import public_tokenizers
    import tiktoken

    ranks = Path(vocabulary).with_suffix(".tiktoken")
    if not ranks.exists():
        return None
    with ranks.open("rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all of ``size`` but the first, which may be shorter."""
    first = n % size or size
    return [(0, min(first, n))] + [(s, size) for s in range(first, n, size)] if n > size else [(0, n)]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = TOKENS, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    vocabulary = vocabulary or default_vocabulary()
    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        for batch in batches:
            row, piece, start, length, crc, parts = [], [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encode(t or ""), SEPARATOR], "<u4")
                for k, (s, n) in enumerate(cut(len(ids), size)):
                    own = ids[s : s + n]
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(own.tobytes()))
                    if with_ids:
                        parts.append(own.astype("<i4"))
            out = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array(parts, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    schema = f"doc_id {kind}, {PIECE}" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)


def best_fit(
    lengths: np.ndarray,
    tokens: int = TOKENS,
    documents: int | None = None,
    attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    rule: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken in the given order. Every length must fit an empty bin."""
    documents = documents or tokens
    attention = attention or tokens * tokens
    caps = np.array([tokens, documents, attention], float)
    w = np.array(weights) / (caps if rule == "dot" else caps * caps)
    lengths = np.asarray(lengths, np.int64)
    if len(lengths) and (lengths.max() > tokens or int(lengths.max()) ** 2 > attention):
        raise ValueError("a piece exceeds an empty sequence's capacity")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    least = int(lengths.min()) if len(lengths) else 0
    # residuals of the open bins; those that can't take the shortest piece any more are closed
    left, open_bins, made = np.empty((3, len(lengths)), float), np.empty(len(lengths), np.int64), 0
    n_open = 0
    for i, size in enumerate(lengths.tolist()):
        demand = (size, 1.0, float(size) * size)
        best = -1
        if n_open and size < tokens:
            r = left[:, :n_open]
            fits = np.flatnonzero((r[0] >= size) & (r[1] >= 1) & (r[2] >= demand[2]))
            if len(fits):
                c = r[:, fits]
                if rule == "dot":
                    score = -sum(w[d] * demand[d] / caps[d] * c[d] for d in range(3))
                else:
                    score = sum(w[d] * (c[d] - demand[d]) ** 2 for d in range(3))
                best = int(fits[np.argmin(score)])
        if best < 0:
            best, bins[i], offsets[i] = n_open, made, 0
            left[:, best], open_bins[best] = caps, made
            made += 1
            n_open += 1
        else:
            bins[i], offsets[i] = open_bins[best], tokens - int(left[0, best])
        left[:, best] -= demand
        if left[0, best] < least or left[1, best] < 1 or left[2, best] < least * least:
            n_open -= 1
            left[:, best], open_bins[best] = left[:, n_open], open_bins[n_open]
    return bins, offsets


def pack(table: DataFrame, size: int = TOKENS, documents: int | None = None, attention: int | None = None, rule: str = "norm", group: int = GROUP, scratch: Scratch | None = None) -> DataFrame:
    """``table`` (of ``pieces``) with sequence_id and offset. It is written first, as its rows are counted."""
    ship(table.sparkSession)
    scratch = scratch or Scratch(table.sparkSession)
    schema = StructType([*table.schema.fields]).add("sequence_id", "long").add("offset", "long")
    table = scratch.write(table.withColumn("place", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-table.count() // group))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = best_fit(t.column("length").to_numpy(), size, documents, attention, rule=rule)
        number = key[0].as_py() << 32
        return t.drop_columns(["g", "place"]).append_column("sequence_id", pa.array(bins + number, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    dealt = table.withColumn("g", F.pmod(F.xxhash64("place"), F.lit(groups)).cast("long"))
    return dealt.groupBy("g").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = TOKENS, vocabulary: str | None = None, scratch: Scratch | None = None, **params) -> DataFrame:
    return pack(pieces(docs, doc_id, text, size, vocabulary), size, scratch=scratch, **params)
