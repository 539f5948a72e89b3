"""Mixing, sampling and batching of datasets of structures.

Random orders are orders by MD5 of seed, epoch and id: the same in every run, and in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.order import dense_index, running_sum
from ..structures import StructureSet


#: Cells of the unit interval, by which draws find their dataset.
CELLS = 1024


def shuffle_key(seed: int, epoch: int, *ids: str) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), F.lit(str(epoch)), *[F.col(i).cast("string") for i in ids]))


def mix(children: Sequence[DataFrame | StructureSet], strict: bool = True) -> DataFrame:
    """Systems of all datasets under one index: (dataset_id, local_index, global_index, ...).

    Strict: non-empty datasets must have the same columns. Otherwise those of the first one are kept.
    """
    frames = [c.systems if isinstance(c, StructureSet) else c for c in children]
    if strict and any(set(f.columns) != set(frames[0].columns) for f in frames):  # only then it matters which are empty
        filled = [f for f in frames if not f.isEmpty()]
        if any(set(f.columns) != set(filled[0].columns) for f in filled):
            raise ValueError("datasets differ in their columns")
        frames = [f if set(f.columns) == set(filled[0].columns) else filled[0].limit(0) for f in frames] if filled else frames
    names = frames[0].columns
    rows = [f.select(F.lit(k).alias("dataset_id"), *[F.col(c) if c in f.columns else F.lit(None).alias(c) for c in names]) for k, f in enumerate(frames)]
    out = dense_index(reduce(lambda a, b: a.unionByName(b), rows), "system_id", "local_index", by=("dataset_id",))
    base = out.groupBy("dataset_id").agg(F.count("*").alias("n"))
    base = base.select("dataset_id", F.coalesce(F.sum("n").over(W.orderBy("dataset_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # a row for each dataset
    out = out.join(F.broadcast(base), "dataset_id").withColumn("global_index", F.col("_base") + F.col("local_index"))
    return out.select("dataset_id", "local_index", *names, "global_index")


def locate(mixed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ordinal, dataset_id, local_index) of ``wanted`` (ordinal, global_index); negative indices count from the end, others out of range are an error."""
    n = mixed.count()
    w = wanted.withColumn("global_index", F.when(~F.col("global_index").between(-n, n - 1), F.raise_error(F.lit("index out of range"))).when(F.col("global_index") < 0, F.col("global_index") + n).otherwise(F.col("global_index")))
    return w.join(mixed.select("global_index", "dataset_id", "local_index"), "global_index").select("ordinal", "dataset_id", "local_index")


def allocate(weights: DataFrame, total: int) -> DataFrame:
    """(dataset_id, quota): ``total`` in proportion to (dataset_id, weight) by largest remainders, ties to the smaller id."""
    w = weights.withColumn("_share", F.col("weight") * total / F.sum("weight").over(W.partitionBy()))
    w = w.withColumn("_floor", F.floor("_share")).withColumn("_left", total - F.sum("_floor").over(W.partitionBy()))
    rank = F.row_number().over(W.orderBy((F.col("_share") - F.col("_floor")).desc(), "dataset_id"))
    return w.withColumn("_rank", rank).select("dataset_id", (F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("int")).cast("long").alias("quota"))


def _lengths(mixed: DataFrame, weights: dict[int, float] | None) -> DataFrame:
    n = mixed.groupBy("dataset_id").agg(F.count("*").alias("n"))
    if weights is None:
        return n.withColumn("weight", F.col("n").cast("double"))
    if any(not (w >= 0 and w < float("inf")) for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must be finite, not negative, and not all zero")
    given = mixed.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], "dataset_id int, weight double")
    out = given.join(n, "dataset_id", "left").na.fill(0, ["n"])
    if not out.filter("weight > 0 and n = 0").isEmpty():
        raise ValueError("an empty dataset has a positive weight")
    return out


def weighted_sample(mixed: DataFrame, weights: dict[int, float] | None, n: int, replacement: bool = True, seed: int = 0, epoch: int = 0, shuffle: bool = True) -> DataFrame:
    """(draw, dataset_id, local_index): ``n`` draws over datasets by weight (their lengths by default).

    Shuffled with replacement, each draw picks a dataset and a row by hash. Otherwise each dataset gives its largest-remainder
    quota, in order of its index or of hash; with replacement a dataset begins again at its end, without it that is an error.
    """
    lengths = _lengths(mixed, weights)
    spark = mixed.sparkSession
    if shuffle and replacement:
        by = W.orderBy("dataset_id")  # a row for each dataset
        ends = lengths.filter("weight > 0").withColumn("hi", F.sum("weight").over(by) / F.sum("weight").over(W.partitionBy())).withColumn("lo", F.coalesce(F.lag("hi").over(by), F.lit(0.0)))
        # draws meet only the datasets that reach into their cell of the unit interval
        ends = ends.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
        u = lambda salt: F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.lit(str(epoch)), F.lit(salt), F.col("draw").cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)
        draws = spark.range(n).select(F.col("id").alias("draw")).withColumn("u", u("dataset")).withColumn("cell", F.floor(F.col("u") * CELLS))
        picked = draws.join(ends, "cell").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
        return picked.select("draw", "dataset_id", F.floor(u("row") * F.col("n")).cast("long").alias("local_index"))
    quota = allocate(lengths.select("dataset_id", "weight"), n).join(lengths.select("dataset_id", "n"), "dataset_id")
    if not replacement and not quota.filter("quota > n").isEmpty():
        raise ValueError("a dataset is too short to be drawn without replacement")
    base = F.coalesce(F.sum("quota").over(W.orderBy("dataset_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    turns = quota.withColumn("base", base).filter("quota > 0").select("dataset_id", "n", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("k"))
    rows = mixed.select("dataset_id", "local_index")
    ranked = hash_rank(rows, shuffle_key(seed, epoch, "dataset_id", "local_index"), "pos", ("dataset_id",), ("local_index",)) if shuffle else rows.withColumn("pos", F.col("local_index"))
    rows = turns.withColumn("pos", F.col("k") % F.col("n")).join(ranked, ["dataset_id", "pos"])
    rows = hash_rank(rows, shuffle_key(seed, epoch, "dataset_id", "k"), "draw", (), ("dataset_id", "k")) if shuffle else rows.withColumn("draw", F.col("base") + F.col("k"))
    return rows.select("draw", "dataset_id", "local_index")


def batch_quotas(lengths: dict[int, int], batch_size: int, samples_per_dataset: dict[int, float] | str = "balanced") -> dict[int, int]:
    """Rows of each dataset in a batch: integers are exact, any float makes them ratios, "balanced" shares equally."""
    if samples_per_dataset == "balanced":
        samples_per_dataset = {k: 1.0 for k in lengths}
    if all(isinstance(v, int) for v in samples_per_dataset.values()):
        if sum(samples_per_dataset.values()) != batch_size:
            raise ValueError("samples per dataset must add up to the batch size")
        return dict(samples_per_dataset)
    total = sum(samples_per_dataset.values())
    share = {k: v / total * batch_size for k, v in samples_per_dataset.items()}
    out = {k: int(v) for k, v in share.items()}
    for k in sorted(share, key=lambda k: (out[k] - share[k], k))[: batch_size - sum(out.values())]:
        out[k] += 1
    return out


def mixed_batches(mixed: DataFrame, batch_size: int, samples_per_dataset: dict[int, float] | str = "balanced", policy: str = "min_size", seed: int = 0, epoch: int = 0) -> DataFrame:
    """(batch_id, dataset_id, local_index): batches of fixed composition.

    Policy min_size ends with the dataset that first runs out, max_size with the last (others begin again), dataset_size
    after as many batches as all rows would fill.
    """
    lengths = {r[0]: r[1] for r in mixed.groupBy("dataset_id").count().collect()}  # a row for each dataset
    quota = batch_quotas(lengths, batch_size, samples_per_dataset)
    if any(q and not lengths.get(k) for k, q in quota.items()):
        raise ValueError("an empty dataset takes part")
    full = {k: lengths[k] // q for k, q in quota.items() if q}
    batches = {"min_size": min(full.values()), "max_size": max(-(-lengths[k] // q) for k, q in quota.items() if q), "dataset_size": sum(lengths.values()) // batch_size}[policy]
    table = F.broadcast(mixed.sparkSession.createDataFrame([(k, q, -(-batches * q // lengths[k]), lengths[k]) for k, q in quota.items() if q], "dataset_id int, quota int, turns int, _n long"))  # a row for each dataset
    r = hash_rank(mixed.select("dataset_id", "local_index"), shuffle_key(seed, epoch, "dataset_id", "local_index"), "_r", ("dataset_id",), ("local_index",))
    r = r.join(table, "dataset_id").filter("turns > 0").withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    r = r.withColumn("batch_id", F.floor((F.col("_t") * F.col("_n") + F.col("_r")) / F.col("quota")))
    return r.filter(F.col("batch_id") < batches).select("batch_id", "dataset_id", "local_index")


def hash_rank(df: DataFrame, by: Column, name: str, groups: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """``df`` with each row's place, 0, 1, 2, ..., in the order of an MD5 text, within its group.

    The first bits cut the order into even ranges; rows are ranked inside a range and ranges by their counts, so no task sees a whole group.
    """
    keyed = df.withColumn("_h", by).withColumn("_c", F.conv(F.substring("_h", 1, 12), 16, 10).cast("long").bitwiseAND(F.lit(((1 << 14) - 1) << 34)))
    n = keyed.groupBy(*groups, "_c").agg(F.count("*").alias("_n"))
    base = n.select(*groups, "_c", F.coalesce(F.sum("_n").over(W.partitionBy(*groups).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    own = F.row_number().over(W.partitionBy(*groups, "_c").orderBy("_h", *ties)) - 1
    placed = keyed.withColumn("_o", own).join(base, [*groups, "_c"])
    return placed.select(*df.columns, (F.col("_b") + F.col("_o")).alias(name))


def shuffle(df: DataFrame, seed: int, epoch: int, key: str = "system_id") -> DataFrame:
    """``df`` with its place in the epoch's order."""
    return hash_rank(df, shuffle_key(seed, epoch, key), "position", (), (key,))


def shard(df: DataFrame, readers: int, drop_last: bool = False, position: str = "position") -> DataFrame:
    """Rows of an epoch dealt in turn over ``readers``: (…, reader, turn). All get as many: the head is repeated at the end, or the rest dropped."""
    n = df.count()
    if drop_last:
        out = df.filter(F.col(position) < n - n % readers)
    else:
        need = -n % readers
        out = df if not need or not n else df.unionByName(df.filter(F.col(position) < need).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit((need - 1) // n)))).withColumn(position, F.col(position) + n + F.col("_k") * n).filter(F.col(position) < n + need).drop("_k"))
    return out.withColumns({"reader": F.col(position) % readers, "turn": F.floor(F.col(position) / readers)})


def batches(df: DataFrame, size: int, drop_last: bool = False, position: str = "position") -> DataFrame:
    out = df.withColumn("batch_id", F.floor(F.col(position) / size))
    return out.filter(F.col("batch_id") < df.count() // size) if drop_last else out


def admit(df: DataFrame, capacities: dict[str, int], order: str = "system_id", mask: str | None = None) -> DataFrame:
    """Rows, in order, whose running sums stay within all capacities; sums run over all masked rows, admitted or not."""
    d = df if mask is None else df.filter(F.col(mask))
    r = running_sum(d, order, {f"_cum_{c}": F.col(c) for c in capacities}, exclusive=False)
    return r.filter(reduce(lambda a, b: a & b, [F.col(f"_cum_{c}") <= cap for c, cap in capacities.items()])).select(df.columns)


def size_bins(sizes: DataFrame, max_atoms: int, max_edges: int | None = None, width: int = 8) -> DataFrame:
    """``sizes`` with bin = num_atoms // width; a system over a limit is an error."""
    over = F.col("num_atoms") > max_atoms if max_edges is None else (F.col("num_atoms") > max_atoms) | (F.col("num_edges") > max_edges)
    return sizes.withColumn("bin", F.when(over, F.raise_error(F.concat(F.lit("system too large: "), F.col("system_id").cast("string")))).otherwise(F.floor(F.col("num_atoms") / width)))


def oversized(sizes: DataFrame, max_atoms: int, max_edges: int) -> DataFrame:
    return sizes.filter((F.col("num_atoms") > max_atoms) | (F.col("num_edges") > max_edges))


#: Limits of a batch: atoms, edges and systems; None for one that is open.
Budget = tuple[int | None, int | None, int | None]


def _limits(budget: Budget) -> tuple[float, float, float]:
    if budget[0] is None and budget[1] is None:
        raise ValueError("a limit on atoms or on edges is needed")
    return tuple(float("inf") if b is None else b for b in budget)


class Waiting:
    """Sizes in order, of which the first that fits is taken: a tree of least atoms and least edges, so a search does not walk over those that do not fit."""

    def __init__(self, ids: list[int], atoms: list[int], edges: list[int]) -> None:
        self.ids, self.n = ids, 1 << max(0, (len(ids) - 1).bit_length())
        none = float("inf")
        self.atoms = [none] * self.n + atoms + [none] * (self.n - len(atoms))
        self.edges = [none] * self.n + edges + [none] * (self.n - len(edges))
        for k in range(self.n - 1, 0, -1):
            self._renew(k)

    def _renew(self, k: int) -> None:
        self.atoms[k] = min(self.atoms[2 * k], self.atoms[2 * k + 1])
        self.edges[k] = min(self.edges[2 * k], self.edges[2 * k + 1])

    def __bool__(self) -> bool:
        return self.atoms[1] != float("inf")

    def take(self, atoms: float, edges: float) -> tuple[int, int, int] | None:
        """(id, atoms, edges) of the first with at most so many atoms and edges, which is gone then."""
        stack = [1]
        while stack:
            k = stack.pop()
            if self.atoms[k] > atoms or self.edges[k] > edges:
                continue
            if k >= self.n:
                found = self.ids[k - self.n], self.atoms[k], self.edges[k]
                self.atoms[k] = self.edges[k] = float("inf")
                while k > 1:
                    k //= 2
                    self._renew(k)
                return found
            stack += (2 * k + 1, 2 * k)
        return None


def pack_sizes(bins: dict[int, Waiting], limits: tuple[float, float, float]) -> list[tuple[int, int, int]]:
    """(batch, id, ordinal) of the greedy choice that ``pack_initial`` describes."""
    out, batch = [], 0
    order = sorted(bins)
    while any(bins[b] for b in order):
        left, n, added = list(limits), 0, True
        while added:
            added = False
            for b in order:
                if left[2] < 1:
                    break
                found = bins[b].take(left[0], left[1])
                if found:
                    left = [left[0] - found[1], left[1] - found[2], left[2] - 1]
                    out.append((batch, found[0], n))
                    added, n = True, n + 1
        if not n:
            raise ValueError("a system exceeds the budget")
        batch += 1
        order = [b for b in order if bins[b]]
    return out


def pack_initial(sizes: DataFrame, budget: Budget, shard_col: str = "shard") -> DataFrame:
    """(shard, batch, system_id, ordinal): batches within budgets of atoms, edges and systems; None leaves one open, but not both of atoms and edges.

    Round after round over the bins in ascending order, a batch takes the first system of each bin that still fits, and ends with a round that
    adds none; the next batch starts from what is left. Greedy choice is sequential, so shards are packed independently,
    from their (id, size) rows alone, in n log n; choose shards of bounded size. A system over the budget is an error.
    """
    limits = _limits(budget)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        bins = {b: Waiting(*(g.sort_values("system_id")[c].tolist() for c in ("system_id", "num_atoms", "num_edges"))) for b, g in frame.groupby("bin")}
        out = pd.DataFrame(pack_sizes(bins, limits), columns=["batch", "system_id", "ordinal"])
        return out.assign(shard=key[0])[["shard", "batch", "system_id", "ordinal"]]

    return sizes.select(F.col(shard_col).cast("long").alias("shard"), "system_id", "num_atoms", "num_edges", "bin").groupBy("shard").applyInPandas(run, "shard long, batch long, system_id long, ordinal long")


def refill(pool: DataFrame, used: DataFrame, budget: Budget, shard_col: str = "shard") -> DataFrame:
    """(shard, system_id): systems of ``pool`` that go into what ``used`` (shard, num_atoms, num_edges, n) leaves of the budget, bins in descending order."""
    limits = _limits(budget)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        left = [limit - int(frame[c].iloc[0]) for limit, c in zip(limits, ("u_atoms", "u_edges", "u_n"))]
        out = []
        for row in frame.sort_values(["bin", "system_id"], ascending=[False, True]).itertuples(index=False):
            if row.num_atoms <= left[0] and row.num_edges <= left[1] and left[2] >= 1:
                left = [left[0] - row.num_atoms, left[1] - row.num_edges, left[2] - 1]
                out.append((key[0], row.system_id))
        return pd.DataFrame(out, columns=["shard", "system_id"])

    u = used.select(F.col(shard_col).cast("long").alias("shard"), F.col("num_atoms").alias("u_atoms"), F.col("num_edges").alias("u_edges"), F.col("n").alias("u_n"))
    p = pool.select(F.col(shard_col).cast("long").alias("shard"), "system_id", "num_atoms", "num_edges", "bin").join(u, "shard", "left").na.fill(0, ["u_atoms", "u_edges", "u_n"])
    return p.groupBy("shard").applyInPandas(run, "shard long, system_id long")
