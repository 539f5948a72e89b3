"""Partitions of atoms over workers: by space, by index, with halos and sticky owners."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cell_inverse, column_norms, elements, row_times, to_fractional, vec
from ..structures import POSITION, StructureSet


def best_grid(n: int, edges: tuple[float, float, float]) -> tuple[int, int, int]:
    """The factors of ``n`` whose domains, of a box with these edges, have the least surface."""
    found = []
    for a in range(1, n + 1):
        if n % a == 0:
            for b in range(1, n // a + 1):
                if n // a % b == 0:
                    c = n // a // b
                    x, y, z = edges[0] / a, edges[1] / b, edges[2] / c
                    found.append((2 * (x * y + y * z + x * z), (a, b, c)))
    return min(found)[1]


def _placed(ss: StructureSet, grid: tuple[int, int, int]) -> DataFrame:
    a = ss.atoms.join(ss.systems.select("system_id", "cell", "pbc", cell_inverse(F.col("cell")).alias("inv")), "system_id")
    f = to_fractional(vec(POSITION), elements(F.col("inv")))
    for k, n in enumerate("abc"):
        whole = F.floor(f[k] * grid[k]).cast("int")
        a = a.withColumns({f"f{n}": F.when(F.col("pbc")[k], f[k] - F.floor(f[k])).otherwise(f[k]), f"d{n}": F.when(F.col("pbc")[k], F.pmod(whole, F.lit(grid[k]))).otherwise(F.least(F.greatest(whole, F.lit(0)), F.lit(grid[k] - 1)))})
    return a


def _number(grid: tuple[int, int, int], a: Column, b: Column, c: Column) -> Column:
    return ((a * grid[1] + b) * grid[2] + c).cast("int")


def spatial_partition(ss: StructureSet, n: int, grid: tuple[int, int, int] | None = None, place: bool = False) -> DataFrame:
    """Atoms with ``part``, the domain that holds them; outside open axes the nearest one. ``place`` puts each domain in a Spark partition of its own."""
    grid = grid or best_grid(n, _edges(ss))
    if math.prod(grid) != n:
        raise ValueError("the grid must have n domains")
    a = _placed(ss, grid).withColumn("part", _number(grid, F.col("da"), F.col("db"), F.col("dc"))).select(*ss.atoms.columns, "part")
    return a.repartitionById(n, "part") if place else a


def _edges(ss: StructureSet) -> tuple[float, float, float]:
    """Greatest lattice lengths over all systems."""
    c = F.col("cell")
    return tuple(ss.systems.agg(*[F.max(F.sqrt(c[3 * k] ** 2 + c[3 * k + 1] ** 2 + c[3 * k + 2] ** 2)) for k in range(3)]).first())


def index_partition(df: DataFrame, n: int, index: str = "index") -> DataFrame:
    """Rows of a dense index in ``n`` contiguous blocks, the first ones longer by one where they do not divide."""
    total = df.count()
    size, more = divmod(total, n)
    head = more * (size + 1)
    i = F.col(index)
    return df.withColumn("part", F.when(i < head, F.floor(i / (size + 1))).otherwise(more + F.floor((i - head) / max(size, 1))).cast("int"))


def with_halo(ss: StructureSet, width: float, grid: tuple[int, int, int]) -> DataFrame:
    """Atoms with domain, owner and owned: each in its own domain and once in every other one that it, or an image of it, is within ``width`` of.

    Distances are to the domain's faces along the lattice planes, bounds included; a ghost's position is that of the image.
    """
    a = _placed(ss, grid).withColumn("owner", _number(grid, F.col("da"), F.col("db"), F.col("dc")))
    slant = column_norms(elements(F.col("inv")))
    near = []
    for k, n in enumerate("abc"):
        w = slant[k] * width
        lo = F.when(F.col("pbc")[k], F.ceil((F.col(f"f{n}") - w) * grid[k] - 1)).otherwise(F.greatest(F.lit(0), F.ceil((F.col(f"f{n}") - w) * grid[k] - 1)))
        hi = F.when(F.col("pbc")[k], F.floor((F.col(f"f{n}") + w) * grid[k])).otherwise(F.least(F.lit(grid[k] - 1), F.floor((F.col(f"f{n}") + w) * grid[k])))
        near.append(F.sequence(F.least(lo, F.col(f"d{n}")).cast("int"), F.greatest(hi, F.col(f"d{n}")).cast("int")))
    for n, c in zip("abc", near):
        a = a.withColumn(f"t{n}", F.explode(c))
    for k, n in enumerate("abc"):
        a = a.withColumns({f"h{n}": F.when(F.col("pbc")[k], F.pmod(f"t{n}", F.lit(grid[k]))).otherwise(F.col(f"t{n}")), f"i{n}": F.floor(F.col(f"t{n}") / grid[k]).cast("int")})
    a = a.withColumn("domain", _number(grid, F.col("ha"), F.col("hb"), F.col("hc")))
    home = (F.col("ia") == 0) & (F.col("ib") == 0) & (F.col("ic") == 0)
    a = a.withColumn("owned", (F.col("domain") == F.col("owner")) & home).filter((F.col("domain") != F.col("owner")) | F.col("owned"))
    moved = row_times([-F.col("ia"), -F.col("ib"), -F.col("ic")], elements(F.col("cell")))
    a = a.withColumns({c: F.when(F.col("owned"), F.col(c)).otherwise(F.col(c) + m) for c, m in zip(POSITION, moved)} | {"_far": F.abs("ia") + F.abs("ib") + F.abs("ic")})
    # of several images in one domain the one of fewest shifts stays
    pick = a.groupBy("system_id", "atom_id", "domain").agg(F.min_by(F.struct(*ss.atoms.columns, "owner", "owned"), F.struct("_far", "ia", "ib", "ic")).alias("r"))
    return pick.select("r.*", "domain")


def owned(df: DataFrame) -> DataFrame:
    return df.filter("owned")


def reduce_to_owner(df: DataFrame, columns: list[str]) -> DataFrame:
    """Contributions of all copies of an atom added up for its owner."""
    return df.groupBy("system_id", "atom_id", "owner").agg(*[F.sum(c).alias(c) for c in columns])


def sticky_partition(prev: DataFrame, ss: StructureSet, margin: float, grid: tuple[int, int, int]) -> DataFrame:
    """Atoms with ``part``: the former owner (system_id, atom_id, part) while they are within ``margin`` of its domain, else the one that holds them."""
    a = _placed(ss, grid).join(prev.select("system_id", "atom_id", F.col("part").alias("_prev")), ["system_id", "atom_id"], "left")
    slant = column_norms(elements(F.col("inv")))
    was = [F.floor(F.col("_prev") / (grid[1] * grid[2])), F.floor(F.col("_prev") / grid[2]) % grid[1], F.col("_prev") % grid[2]]
    near = F.col("_prev").isNotNull()
    for k, n in enumerate("abc"):
        mid = (was[k] + 0.5) / grid[k]
        off = F.col(f"f{n}") - mid
        off = F.when(F.col("pbc")[k], off - F.rint(off)).otherwise(off)
        near = near & (F.abs(off) <= 0.5 / grid[k] + slant[k] * margin)
    return a.withColumn("part", F.when(near, F.col("_prev")).otherwise(_number(grid, F.col("da"), F.col("db"), F.col("dc")))).select(*ss.atoms.columns, "part")
