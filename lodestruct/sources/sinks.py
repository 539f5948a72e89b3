"""Sinks for structures and logs: append, read, zero, drain; CSV logs."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Sink:
    """A Parquet table that batches are appended to.

    A batch id makes writing again harmless: each batch has a directory of its own, and its rows are written aside and then
    renamed into its place, so what it replaces is there until the new rows are whole; a writer that is lost between
    the two renames leaves the new rows aside, and the next call of the sink puts them in place. What a batch replaces does not
    count against the capacity. A write that does not fit is an error and changes nothing. The rows of each batch are counted
    once, in the name of its directory, so a capacity costs no scan. One sink has one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, capacity: int | None = None) -> None:
        self.spark, self.path, self.capacity = spark, path, capacity

    def _at(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, within: str = "") -> list[str]:
        fs, p = self._at(within)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _batches(self) -> dict[int, int]:
        """Number of rows of each batch that is in place, after those left aside by a lost writer have been put there."""
        found = {n: self._names(n) for n in self._names() if n.startswith("batch=")}
        aside = {n: self._names(n) for n in self._names() if n.startswith("_aside=")}
        for name, inner in aside.items():
            batch = f"batch={name.split('=')[1]}"
            if batch not in found and inner:  # the old rows are gone already
                self._rename(name, batch)
                found[batch] = inner
        return {int(n.split("=")[1]): int(inner[0].split("=")[1]) for n, inner in found.items() if inner}

    def _rename(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        if not fs.rename(p, self._at(new)[1]) and (fs.exists(p) or not fs.exists(self._at(new)[1])):  # a reader may have done it
            raise OSError(f"{old} could not become {new}")

    def _delete(self, name: str) -> None:
        fs, p = self._at(name)
        fs.delete(p, True)

    def write(self, df: DataFrame, batch_id: int | None = None) -> None:
        held = self._batches()
        batch_id = max(held, default=-1) + 1 if batch_id is None else batch_id
        draft = f"_draft={uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{draft}/rows")
        rows = self.spark.read.schema(df.schema).parquet(f"{self.path}/{draft}/rows").count()
        if self.capacity is not None and sum(n for k, n in held.items() if k != batch_id) + rows > self.capacity:
            self._delete(draft)
            raise OverflowError(f"the sink holds {self.capacity} rows")
        self._rename(f"{draft}/rows", f"{draft}/rows={rows}")
        self._delete(f"_aside={batch_id}")
        self._rename(draft, f"_aside={batch_id}")
        self._delete(f"batch={batch_id}")
        self._rename(f"_aside={batch_id}", f"batch={batch_id}")

    def read(self, batches: Sequence[int] | None = None) -> DataFrame:
        held = self._batches()
        names = [f"{self.path}/batch={k}/rows={n}" for k, n in sorted(held.items()) if batches is None or k in batches]
        if not names:
            raise FileNotFoundError(self.path)
        return self.spark.read.option("basePath", self.path).parquet(*names).drop("rows")

    def __len__(self) -> int:
        return sum(self._batches().values())

    def is_full(self) -> bool:
        return self.capacity is not None and len(self) >= self.capacity

    def zero(self) -> None:
        self._delete("")

    def drain(self, to: str) -> DataFrame:
        """Moves the batches that the sink holds now to ``to`` and returns them; one that is written meanwhile stays."""
        held = sorted(self._batches())
        self.read(held).drop("batch").write.mode("error").parquet(to)
        for k in held:
            self._delete(f"_aside={k}")  # of a writer that was lost before its rows took the place of these
            self._delete(f"batch={k}")
        return self.spark.read.parquet(to)


class BoundedSink(Sink):
    """Room for ``max_systems`` systems of at most ``max_atoms`` atoms and ``max_edges`` edges each.

    Rows have num_atoms and, if edges are limited, num_edges. A system over a limit, or more systems than fit, is an
    error; no system is left out.
    """

    def __init__(self, spark: SparkSession, path: str, max_systems: int, max_atoms: int, max_edges: int | None = None) -> None:
        super().__init__(spark, path, max_systems)
        self.limits = {"num_atoms": max_atoms} | ({} if max_edges is None else {"num_edges": max_edges})

    def write(self, df: DataFrame, batch_id: int | None = None) -> None:
        for column, limit in self.limits.items():
            if not df.filter(F.col(column) > limit).isEmpty():
                raise OverflowError(f"a system has {column} over {limit}")
        super().write(df, batch_id)

    def room(self) -> dict[str, int]:
        """Systems that still fit, and the atoms and edges that they can have in all."""
        free = self.capacity - len(self)
        return {"systems": free} | {c: free * n for c, n in self.limits.items()}


def write_log_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    """Log rows as CSV files with a header; nested columns are not scalars and are an error."""
    df.write.mode(mode).option("header", True).csv(path)
