"""Mixing sources to target weights along a low-discrepancy schedule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import materialise, table

#: Blocks a source is cut into at least (if it has that many words), words of a block at most.
MIN_BLOCKS, MAX_BLOCK_WORDS = 1024, 4096
#: Cells of the unit interval for the join of points with sources; hash buckets of a source's shuffled order; slots ranked together.
CELLS, BUCKETS, CHUNK = 4096, 4096, 1 << 16
#: Number of sources up to which their table (some 100 bytes a row) is broadcast.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def radical_inverse(t: Column) -> Column:
    """Van der Corput point in base 2 of a slot number: its 63 low bits mirrored behind the binary point."""
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        t = F.shiftleft(t.bitwiseAND(F.lit(mask)), shift).bitwiseOR(F.shiftrightunsigned(t, shift).bitwiseAND(F.lit(mask)))
    t = F.shiftleft(t, 32).bitwiseOR(F.shiftrightunsigned(t, 32))
    return F.shiftrightunsigned(t, 11).cast("double") / float(1 << 53)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, max_repeat: int = 3) -> DataFrame:
    """Words to take from each source.

    ``sizes``: (source, source_size), one row per source, the only kind of table that is ordered in one task here.
    Sources by code point, null last, get ``weights`` in turn and share ``share`` of all words. No target exceeds
    ``max_repeat`` times its source; the excess is shared again by weight. That is the level at which
    sum(min(cap, weight * level)) equals the wanted words: sources are ordered by cap / weight, and the first one
    that stays under its cap gives the level. Adds sid, weight, target.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    s = sizes.withColumn("sid", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(max_repeat)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = W.orderBy("ratio", "sid")
    s = s.withColumn("before", F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1))).withColumn("after", F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)))
    whole = W.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce("before", F.lit(0.0))) / F.col("after"))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(whole)["level"])
    return s.select("source", "source_size", "sid", "weight", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def schedule(sources: DataFrame) -> DataFrame:
    """(slot, sid, rank, epoch, block): the order in which blocks are read.

    ``sources`` has sid, blocks, quota. Slot t goes to the source whose part of the unit interval, as long as its share
    of all quotas, holds the t-th van der Corput point. A source keeps its first ``quota`` slots; the few that the
    sequence owes a source at its end follow there. Ranks come from counts of each run of slots, so no task sees a
    whole source. In each epoch a source's blocks start at another place.
    """
    spark = sources.sparkSession
    total = sources.agg(F.sum("quota")).first()[0] or 0
    ends = W.orderBy("sid")
    spans = sources.filter("quota > 0").withColumn("hi", F.sum("quota").over(ends) / float(max(total, 1))).withColumn("lo", F.coalesce(F.lag("hi").over(ends), F.lit(0.0)))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
    points = spark.range(total).select(F.col("id").alias("slot"), radical_inverse(F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    drawn = points.join(spans, "cell").filter("u >= lo and u < hi").select("slot", "sid", "quota", F.expr(f"slot div {CHUNK}").alias("chunk"))
    drawn = materialise(drawn, "slots")
    counts = drawn.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    counts = counts.withColumn("base", F.sum("n").over(W.partitionBy("sid").orderBy("chunk")) - F.col("n")).select("sid", "chunk", "base")
    ranked = drawn.withColumn("rn", F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")) - 1).join(counts, ["sid", "chunk"])
    ranked = ranked.select("slot", "sid", (F.col("base") + F.col("rn")).alias("rank"), "quota").filter("rank < quota").select("slot", "sid", "rank")
    got = drawn.groupBy("sid").agg(F.count("*").alias("got"))
    owed = sources.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < quota")
    owed = owed.select((F.lit(total) + F.col("got")).alias("slot"), "sid", F.explode(F.sequence("got", F.col("quota") - 1)).alias("rank"))
    return ranked.unionByName(owed).join(sources.select("sid", "blocks"), "sid").withColumn("epoch", F.expr("rank div blocks")).select(
        "slot", "sid", "rank", "epoch", F.pmod(F.col("rank") + F.pmod(F.xxhash64("sid", "epoch"), F.col("blocks")), F.col("blocks")).alias("block")
    )


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, max_repeat: int = 3, seed: int = 7) -> DataFrame:
    """How many words of every document a mix of its sources takes.

    Returns one row per row of ``docs``: doc_id, source, size (words), source_size, target and taken. Each source's
    documents, in an order shuffled by hash, form a stream of words that is cut into blocks of equal size; the schedule
    says how often each block is read, and a document's taken words are those of its parts of blocks. A source's taken
    words are within one block of its target, and no document is read more than ``max_repeat`` times.
    Null texts have no words; documents without words take nothing; a null source is a source. Repeated rows count
    each. Ties in the shuffled order (equal id and text) are interchangeable. The same rows give the same result in
    any run. An empty table gives an empty result; other columns are neither read nor returned.
    """
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("h"), F.xxhash64("text").alias("tie")), "sized")
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeat)
    words = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCK_WORDS), F.expr(f"source_size div {MIN_BLOCKS}")))
    sources = sources.withColumn("blocks", F.when(F.col("source_size") > 0, F.greatest(F.lit(1).cast("long"), F.floor(F.col("source_size") / words))).otherwise(F.lit(1).cast("long")))
    sources = materialise(
        sources.withColumn("quota", F.when(F.col("source_size") > 0, F.least(F.col("blocks") * max_repeat, F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))).otherwise(F.lit(0).cast("long")))
        .withColumn("b", F.expr("source_size div blocks")).withColumn("r", F.expr("source_size % blocks")),
        "sources",
    )
    times = schedule(sources.select("sid", "blocks", "quota")).groupBy("sid", "block").agg(F.count("*").alias("times"))

    known = sources.withColumnRenamed("source", "named")
    if known.count() <= BROADCAST_SOURCES:
        known = F.broadcast(known)
    placed = sized.join(known, sized.source.eqNullSafe(F.col("named"))).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    sums = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("base", F.sum("n").over(W.partitionBy("sid").orderBy("bucket")) - F.col("n")).select("sid", "bucket", "base")
    run = W.partitionBy("sid", "bucket").orderBy("h", "doc_id", "tie", "size")
    placed = placed.withColumn("rn", F.row_number().over(run)).withColumn("own", F.sum("size").over(run.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).join(sums, ["sid", "bucket"]).withColumn("at", F.col("base") + F.col("own"))

    def block_of(x: str) -> str:
        return f"if({x} < r * (b + 1), {x} div (b + 1), r + ({x} - r * (b + 1)) div greatest(b, 1L))"

    placed = placed.withColumn("block", F.explode_outer(F.expr(f"if(size = 0, array(), sequence({block_of('at')}, {block_of('(at + size - 1)')}))")))
    parts = placed.join(times, ["sid", "block"], "left")
    overlap = F.least(F.col("at") + F.col("size"), F.expr("(block + 1) * b + least(block + 1, r)")) - F.greatest(F.col("at"), F.expr("block * b + least(block, r)"))
    return parts.groupBy("sid", "bucket", "rn", "doc_id", "source", "size", "source_size", "target").agg(F.sum(F.coalesce(overlap * F.col("times"), F.lit(0).cast("long"))).alias("taken")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
