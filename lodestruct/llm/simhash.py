"""SimHash near-duplicates found by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import as_bytes, batches, materialise, table, values
from .components import connected_components

SEED = 42
#: Shingles hashed at once, which bounds the memory that one very long text needs.
BLOCK = 1 << 16


def shingle_hashes(text: bytes, words: int = 3) -> Iterator[np.ndarray]:
    """64-bit hashes of the ASCII-lower-cased word shingles of ``text``, repeats included, BLOCK at a time; a shorter text is one shingle, no words none."""
    split = text.lower().split()
    if not split:
        return
    joined, n = b" ".join(split), max(1, len(split) - words + 1)
    ends = np.cumsum([len(w) + 1 for w in split]) - 1
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    stops = ends[min(words, len(split)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        yield np.array([digest(joined[i:j], SEED) for i, j in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])], dtype="<u8")


def folded(blocks: Iterable[np.ndarray]) -> int:
    """64-bit SimHash of hashes: a bit is set where over half of them have it; of none: 0."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash of the word shingles of ``text``; no words: 0."""
    return folded(shingle_hashes(text, words))


def _fingerprints(words: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            found = np.array([fingerprint(t, words) for t in values(batch.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long) of every document. Null and empty texts and texts of white space alone get 0."""
    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", as_bytes(F.col("text")).alias("body")).mapInArrow(_fingerprints(words), f"doc_id {ids}, fp long")


def segment_masks(segments: int) -> list[int]:
    """The 64 bits cut into consecutive runs of nearly equal length, lowest first."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [((1 << hi) - (1 << lo)) for lo, hi in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ring_chain(x: Column, y: Column, max_bits: int, segments: int) -> Column:
    """The pigeonring condition: from some segment on, every chain of l segments differs in at most l * max_bits / segments bits.

    Fingerprints within ``max_bits`` always meet it, so it only prunes.
    """
    diff = x.bitwiseXOR(y)
    part = [F.bit_count(diff.bitwiseAND(F.lit(_signed(m)))) for m in segment_masks(segments)]
    found = F.lit(False)
    for start in range(segments):
        total, chain = F.lit(0), F.lit(True)
        for length in range(1, segments + 1):
            total = total + part[(start + length - 1) % segments]
            chain = chain & (total <= length * max_bits // segments)
        found = found | chain
    return found


def near_links(fps: DataFrame, max_bits: int = 2, bucket: int = 32) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints within ``max_bits`` bits (1 or 2), as components go.

    Cut into max_bits + 2 segments, two close fingerprints agree in two whole segments; those pairs are the buckets.
    Buckets of up to ``bucket`` different fingerprints give all pairs as candidates. A larger bucket would give pairs by
    the square of its size: there each fingerprint is sent to the points one flip of a bit that varies in the bucket
    away, and the candidates are the least fingerprint at a point with each other one there. Two fingerprints meet iff
    they differ in at most two bits, so no link between components is lost and the work stays linear. All candidates are
    pruned by the ring condition and then checked in full.
    """
    if max_bits not in (1, 2):
        raise ValueError("max_bits must be 1 or 2")
    segments = max_bits + 2
    masks = segment_masks(segments)
    distinct = fps.select("fp").filter("fp is not null").distinct()
    keys = F.array(*[F.struct(F.lit(k).alias("slot"), F.col("fp").bitwiseAND(F.lit(_signed(masks[i] | masks[j]))).alias("bits")) for k, (i, j) in enumerate(combinations(range(segments), 2))])
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.slot", "k.bits")
    stats = keyed.groupBy("slot", "bits").agg(F.count("*").alias("n"), F.bit_or("fp").alias("any"), F.bit_and("fp").alias("all")).filter("n > 1")
    met = materialise(keyed.join(stats, ["slot", "bits"]), "buckets")

    small = met.filter(F.col("n") <= bucket).groupBy("slot", "bits").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    pairs = small.select(F.explode(F.expr("flatten(transform(fps, (x, i) -> transform(slice(fps, i + 2, size(fps)), y -> named_struct('a', y, 'b', x))))")).alias("p")).select("p.a", "p.b")

    flips = F.expr("concat(array(0L), transform(filter(sequence(0, 63), i -> (shiftrightunsigned(any ^ all, i) & 1L) = 1L), i -> shiftleft(1L, i)))")
    if max_bits == 2:
        points = met.filter(F.col("n") > bucket).select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")).distinct()
        meet = points.groupBy("point").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1")  # at most 65 fingerprints reach a point
    else:
        points = met.filter(F.col("n") > bucket).select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseAND(F.bitwise_not("flip")).alias("point"), "flip").distinct()
        meet = points.groupBy("point", "flip").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1")
    stars = meet.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).filter("a > b").select("a", "b")
    ring = ring_chain(F.col("a"), F.col("b"), max_bits, segments)
    return pairs.unionByName(stars).distinct().filter(ring).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """Class of near-duplicates of every document.

    Returns one row per row of ``docs``: doc_id, fp, component_id (the smallest doc_id reachable over links of at most
    ``max_bits`` differing bits, itself included). Exact copies share a fingerprint and are one node, whatever their
    number. Null doc_ids get a class like others; it is null only if all its members' ids are. Repeated rows stay
    repeated; other columns of ``docs`` are neither read nor returned; an empty table gives an empty result.
    """
    fps = materialise(fingerprints(docs, words), "fingerprints")
    roots = connected_components(near_links(fps, max_bits))
    groups = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = materialise(groups.join(roots, groups.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "groups")
    best = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    # as a table, so that the skew join can split a fingerprint that many documents have
    classes = materialise(groups.join(best, "root").select("fp", "component_id"), "classes")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
