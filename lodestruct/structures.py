"""The three-level data model: systems, the atoms in them, the edges between atoms."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame

#: Columns of each level that the operators know; any others travel along.
SYSTEM_KEY, ATOM_KEY, EDGE_KEY = ("system_id",), ("system_id", "atom_id"), ("system_id", "i", "j", "sx", "sy", "sz")
KEYS = {"systems": SYSTEM_KEY, "atoms": ATOM_KEY, "edges": EDGE_KEY}
POSITION = ("x", "y", "z_pos")
VELOCITY = ("vx", "vy", "vz")
FORCE = ("fx", "fy", "fz")


@dataclass(frozen=True)
class StructureSet:
    """``systems`` (system_id, cell array of 9, pbc array of 3, ...), ``atoms`` (system_id, atom_id, z, x, y, z_pos, ...), ``edges`` (system_id, i, j, sx, sy, sz, ...; sample-local ends) or None."""

    systems: DataFrame
    atoms: DataFrame
    edges: DataFrame | None = None

    def levels(self) -> dict[str, DataFrame]:
        return {k: df for k, df in (("systems", self.systems), ("atoms", self.atoms), ("edges", self.edges)) if df is not None}

    def map(self, fn: Callable[[DataFrame], DataFrame]) -> StructureSet:
        return StructureSet(**{k: fn(df) for k, df in self.levels().items()})

    def with_(self, **levels: DataFrame | None) -> StructureSet:
        return replace(self, **levels)

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> StructureSet:
        """Kept by the executors from first use on; served again without another scan."""
        return self.map(lambda df: df.persist(level))

    def unpersist(self) -> StructureSet:
        return self.map(lambda df: df.unpersist())

    def transform(self, *steps: Callable[[StructureSet], StructureSet]) -> StructureSet:
        """Steps applied from left to right; ``operators.transforms`` tells which steps go together."""
        from .operators.transforms import Transforms

        return Transforms(steps)(self)


def level_of(ss: StructureSet, column: str) -> str | None:
    """The level that has a column; atoms if several do, None if none does."""
    found = [k for k, df in ss.levels().items() if column in df.columns]
    return "atoms" if "atoms" in found else (found or [None])[0]


def without(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in names]
