"""Packing documents into sequences along a Hilbert curve."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import batches, materialise, table, values
from ._pieces import Memo, Splitter, letters, tokenizer

LENGTH, END = 4096, 2
#: Hashed size of a document vector, dimensions and bits of a dimension of the curve's cube.
HASHED, DIMS, BITS = 1024, 3, 10


class Encoder:
    """Ids of texts as little-endian 32-bit numbers; those of plain texts are joined from remembered pieces."""

    def __init__(self, path: str) -> None:
        self.tok = tokenizer(path)
        self.split, model = Splitter(self.tok), self.tok.model
        self.known = Memo(lambda piece: np.array([t.id for t in model.tokenize(letters(piece))], "<u4").tobytes())

    def ids(self, text: str) -> bytes:
        pieces = self.split.pieces(text)
        if pieces is None:
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self.known = self.known.turned()
        return b"".join(map(self.known.__getitem__, pieces))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of points with integer coordinates below 2**bits (one row each).

    From the most significant bit down, the walker keeps the orientation of its cube: a set bit mirrors the lower bits
    of the first axis, a clear bit swaps them with that axis; the Gray code of what results, read across the axes, is
    the position.
    """
    x = points.astype(np.int64).copy()
    dims = x.shape[1]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for d in range(dims):
            mirror = (x[:, d] >> b) & 1 == 1
            swap = np.where(mirror, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(mirror, low, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    fix = np.zeros(len(x), np.int64)
    for b in range(bits - 1, 0, -1):
        fix ^= np.where((x[:, -1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= fix[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[:, d] >> b) & 1
    return key


@lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(11).normal(0, 1, (HASHED, DIMS))


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert key of each document: token counts hashed to a unit vector, projected at random, cut into equal-probability cells."""
    v = np.stack([np.bincount(i % HASHED, minlength=HASHED) for i in ids]).astype(np.float64)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1)
    cells = np.clip((0.5 + 0.5 * np.tanh(v @ _projection())) * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(cells.astype(np.int64))


def _encode(path: str, end_id: int, kind: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches(it):
            ids = [np.frombuffer(encoder.ids(t) + end, "<u4") for t in values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(curve_keys(ids)), pa.array([i.astype(kind).tobytes() for i in ids], pa.binary())], names=["doc_id", "key", "ids"])

    return run


_PIECES = [("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def _pack(length: int, stored: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        number, used, kind = 0, 0, None
        tail: list[tuple] = []  # pieces of the sequence that is not full yet
        for batch in batches(it, 1024):
            kind, done = batch.column(0).type, []
            for doc, packed in zip(batch.column(0).to_pylist(), values(batch.column(1))):
                ids, at = np.frombuffer(packed, stored).astype("<u4"), 0
                while at < len(ids):
                    n = min(length - used, len(ids) - at)
                    tail.append((doc, at, n, ids[at : at + n].tobytes(), len(ids), first + number, used))
                    at, used = at + n, used + n
                    if used == length:
                        done += tail
                        tail, used, number = [], 0, number + 1
            yield _rows(done, kind)
        if tail:
            yield _rows(_halve(tail, used, first + number), kind)

    return run


def _rows(pieces: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*pieces)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [kind, *(t for _, t in _PIECES)])], names=["doc_id", *(n for n, _ in _PIECES)])


def _halve(pieces: list[tuple], used: int, number: int) -> list[tuple]:
    """The last, short sequence of a range cut into sequences whose lengths are powers of two, greatest first, which need no padding."""
    out, room, offset = [], 0, 0
    for doc, at, n, ids, total, _, _ in pieces:
        done = 0
        while done < n:
            if not room:
                number, room, offset = number + bool(out), 1 << (used.bit_length() - 1), 0
                used -= room
            take = min(room, n - done)
            out.append((doc, at + done, take, ids[4 * done : 4 * (done + take)], total, number, offset))
            done, room, offset = done + take, room - take, offset + take
    return out


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """Token pieces of all documents, packed into sequences of ``length`` tokens.

    Returns (doc_id, start, length, ids, doc_tokens, sequence_id, offset): ``ids`` are the piece's token ids as
    little-endian 32-bit numbers as the tokenizer file at ``path`` gives them, each document ending with id ``end``. Documents are range-partitioned and sorted by the
    Hilbert key of their hashed token vector (ties by id, then by ids, so a group of copies may span ranges), and each
    range is cut into full sequences; its last one is cut into lengths that are powers of two, so nothing is padded.
    Null texts count as empty (the end id alone). Repeated rows and ids are packed each. Other columns are neither read
    nor returned; an empty table gives an empty result. Ids travel in 16 bits where the vocabulary allows it, else in 32.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    if not 0 <= end < 1 << 32:
        raise ValueError("end must be an unsigned 32-bit number")
    kind = "<u2" if max(end, tokenizer(path).get_vocab_size(with_added_tokens=True) - 1, max(tokenizer(path).get_vocab().values(), default=0)) < 1 << 16 else "<u4"
    ids = docs.schema["doc_id"].dataType.simpleString()
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = materialise(body.mapInArrow(_encode(path, end, kind), f"doc_id {ids}, key long, ids binary"), "token_ids")
    coded = coded.withColumn("tie", F.xxhash64("ids"))
    along = coded.repartitionByRange("key", "doc_id", "tie").sortWithinPartitions("key", "doc_id", "tie").select("doc_id", "ids")
    return along.mapInArrow(_pack(length, kind), f"doc_id {ids}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
