"""Token counts, with huge documents encoded in overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import batches, materialise, table, values
from ._pieces import Memo, Splitter, letters, tokenizer

#: Characters of a chunk, and of its overlap with each neighbour at first.
CHUNK, OVERLAP = 1 << 15, 256
#: A boundary counts as proven only this many characters before the end of the chunk that lies left of it: the
#: pre-tokenizer looks two characters ahead, and special tokens must be seen whole.
AHEAD = 32
#: Characters of long texts that a task encodes, and the greatest number of such tasks; beyond it tasks grow.
TASK, TASKS = 1 << 22, 1 << 15


def boundaries(encoding, lo: int, hi: int, at: int) -> list[dict]:
    """Where pre-tokens start between two characters: position in the document (the chunk starts at ``at``) and tokens before it."""
    words, offsets = encoding.word_ids, encoding.offsets
    return [{"pos": at + offsets[i][0], "before": i} for i in range(len(words)) if lo <= offsets[i][0] <= hi and (i == 0 or words[i] != words[i - 1])]


class Counter:
    """Token counts of whole texts; those of plain texts are sums over remembered pieces."""

    def __init__(self, path: str) -> None:
        self.tok = tokenizer(path)
        self.split, model = Splitter(self.tok), self.tok.model
        self.known = Memo(lambda piece: len(model.tokenize(letters(piece))))

    def count(self, text: str) -> int:
        pieces = self.split.pieces(text)
        if pieces is None:
            return len(self.tok.encode(text, add_special_tokens=False))
        self.known = self.known.turned()
        return sum(map(self.known.__getitem__, pieces))


def _whole(path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches(it):
            n = [counter.count(t) for t in values(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def _cut(chunk: int, overlap: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1):
            row, text = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            for k in range(max(1, -(-len(text) // chunk))):
                at, end = max(0, k * chunk - overlap), min(len(text), (k + 1) * chunk + overlap)
                yield pa.RecordBatch.from_pylist([{"row": row, "k": k, "seam": k * chunk, "at": at, "last": (k + 1) * chunk >= len(text), "piece": text[at:end]}], schema=_CUT)

    return run


_CUT = pa.schema([("row", pa.int64()), ("k", pa.int64()), ("seam", pa.int64()), ("at", pa.int64()), ("last", pa.bool_()), ("piece", pa.string())])
_BOUNDS = pa.list_(pa.struct([("pos", pa.int64()), ("before", pa.int64())]))


def _encode(path: str, chunk: int, overlap: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches(it, 1):
            row, k, seam, at, last, piece = (c[0].as_py() for c in batch.columns)
            e = tok.encode(piece, add_special_tokens=False)
            left = boundaries(e, seam - overlap - at, seam + overlap - at, at) if k else []
            right = [] if last else boundaries(e, seam + chunk - overlap - at, len(piece) - AHEAD, at)
            yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([k]), pa.array([last]), pa.array([len(e)], pa.int64()), pa.array([left], _BOUNDS), pa.array([right], _BOUNDS)], names=["row", "k", "last", "n", "left", "right"])

    return run


def splice(chunks: DataFrame) -> DataFrame:
    """(row, n_tokens) from encoded chunks; n_tokens is null where two neighbours share no proven boundary.

    Once two scans start a pre-token at the same character they agree from there on, so the left chunk counts up to the
    first common boundary and the right one from there.
    """
    w = W.partitionBy("row").orderBy("k")
    seam = F.array_min(F.array_intersect(F.transform("left", lambda x: x["pos"]), F.transform("prev", lambda x: x["pos"])))
    s = chunks.withColumn("prev", F.lag("right").over(w)).withColumn("cut", seam)
    own = F.filter("left", lambda x: x["pos"] == F.col("cut"))
    s = s.withColumn("start", F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(F.get(own, F.lit(0))["before"])).withColumn("next", F.lead("cut").over(w))
    stop = F.get(F.filter("right", lambda x: x["pos"] == F.col("next")), F.lit(0))["before"]
    s = s.withColumn("part", F.when(F.col("last"), F.col("n")).otherwise(stop) - F.col("start"))
    return s.groupBy("row").agg(F.when(F.count("part") == F.count("*"), F.sum("part")).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Tokens of every text as the tokenizer file at ``path`` (byte-level BPE by default) gives them for the whole text.

    Returns (doc_id, n_bytes, n_tokens), one row per row of ``docs``. Texts of up to ``chunk`` characters are encoded
    whole. Longer ones are cut into chunks that overlap, spread over all tasks, encoded with offsets and spliced at
    boundaries that both neighbours share; where none is shared (a run without any boundary), chunks and overlaps grow
    eightfold until one is, or until one chunk holds the text. Null texts count as empty and have no tokens. Repeated rows
    and ids stay; other columns are neither read nor returned; an empty table gives an empty result. The vocabulary
    file must lie at ``path`` on every executor.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    ids = docs.schema["doc_id"].dataType.simpleString()
    body = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce("text", F.lit("")).alias("text"))
    schema = f"doc_id {ids}, n_bytes long, n_tokens long"
    short = body.filter(F.char_length("text") <= chunk).mapInArrow(_whole(path), schema)
    # long texts go to the shared folder once, with a number for each row
    long = materialise(body.filter(F.char_length("text") > chunk).withColumn("row", F.monotonically_increasing_id()).withColumn("chars", F.char_length("text").cast("long")), "long_texts")
    # encoding costs by the character, so tasks are dealt by characters, not by the few bytes that a shuffle sees
    tasks = min(TASKS, max(1, -(-(long.agg(F.sum("chars")).first()[0] or 0) // TASK)))
    pending, out = long, short
    while True:
        cut = pending.select("row", "text").mapInArrow(_cut(chunk, overlap), "row long, k long, seam long, at long, last boolean, piece string").repartition(tasks, "row", "k")
        found = materialise(splice(cut.mapInArrow(_encode(path, chunk, overlap), "row long, k long, last boolean, n long, left array<struct<pos:long,before:long>>, right array<struct<pos:long,before:long>>")), "token_counts")
        done = found.filter("n_tokens is not null")
        out = out.unionByName(long.select("row", "doc_id", "n_bytes").join(done, "row").select("doc_id", "n_bytes", "n_tokens"))
        failed = found.filter("n_tokens is null").select("row")
        if failed.isEmpty():
            return out
        pending, chunk, overlap = long.join(failed, "row", "left_semi"), chunk * 8, overlap * 8


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
