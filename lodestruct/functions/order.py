"""Dense indices and running sums over an ascending integer key, without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of a key that are ordered together, and bits above them whose ranges are. 64 - 16 - 24 bits are left for the last
#: step, so whatever the keys are, no task orders more than 2^24 rows, and those are sums of ranges.
LOW, HIGH = 16, 24


def _before(of: str, w) -> Column:
    return F.coalesce(F.sum(of).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def tasks(df: DataFrame) -> int:
    """The session's number of tasks of an exchange; rows dealt by an explicit number stay in so many tasks."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_sum(df: DataFrame, key: str, values: dict[str, Column], exclusive: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with, for each name, the sum of its column over all rows of smaller ``key`` (and, if not exclusive, its own), within each group ``by``.

    Keys are 64-bit integers of any sign, dense or sparse, and should be unique in their group; rows of the same key are
    ordered arbitrarily, rows of a null key or group are left out. Null values count as zero. The key's bits cut rows into
    ranges and ranges into ranges of them; each is ordered by itself on top of the sums before it, so neither all rows nor
    a large group meet in one task. In a group, ranges are not cut again: 2^32 dense keys have 65,536 of them.
    """
    by, names = list(by), list(values)
    d = df.dropna(subset=[key, *by]).withColumn("_r1", F.shiftright(F.col(key).cast("long"), LOW)).withColumns({f"_v_{n}": F.coalesce(c, F.lit(0)) for n, c in values.items()})
    sums = d.groupBy(*by, "_r1").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    if by:
        bases = sums.select(*by, "_r1", *[_before(f"_s_{n}", W.partitionBy(*by).orderBy("_r1")).alias(f"_b_{n}") for n in names])
    else:
        sums = sums.withColumn("_r2", F.shiftright("_r1", HIGH))
        top = sums.groupBy("_r2").agg(*[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in names])
        top = top.select("_r2", *[_before(f"_t_{n}", W.orderBy("_r2")).alias(f"_a_{n}") for n in names])
        inner = sums.withColumns({f"_o_{n}": _before(f"_s_{n}", W.partitionBy("_r2").orderBy("_r1")) for n in names})
        bases = inner.join(top, "_r2").select("_r1", *[(F.col(f"_a_{n}") + F.col(f"_o_{n}")).alias(f"_b_{n}") for n in names])
    own = W.partitionBy(*by, "_r1").orderBy(key).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    # dealt by a number that is not lowered afterwards, as what a task holds would grow with the rows that are put together for it
    d = d.repartition(tasks(df), *by, "_r1")
    d = d.withColumns({f"_o_{n}": F.coalesce(F.sum(f"_v_{n}").over(own), F.lit(0)) for n in names}).join(bases, [*by, "_r1"])
    return d.select(*df.columns, *[(F.col(f"_b_{n}") + F.col(f"_o_{n}")).alias(n) for n in names])


def dense_index(df: DataFrame, key: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """0, 1, 2, ... in order of a unique integer key, within each group."""
    return running_sum(df, key, {name: F.lit(1).cast("long")}, by=by)
