"""What the registered queries share: SQL of the views and of brute-force pairs, rounding, a folder for written tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.views import ATOMS, CELL, SYSTEMS, TRAJECTORY

BASE = f"WITH atoms AS ({ATOMS}), systems AS ({SYSTEMS}), trajectory AS ({TRAJECTORY})"
A, B, C = CELL


def pairs_sql(rc: float, half: bool = False, open_z: str = "false", images: int = 2, name: str = "pairs") -> str:
    """A WITH part: all pairs within a cutoff, by trying every two atoms of a system and every image."""
    shift = f"range(-{images}, {images + 1})"
    keep = "i < j OR (i = j AND (sx > 0 OR (sx = 0 AND (sy > 0 OR (sy = 0 AND sz > 0)))))" if half else "NOT (i = j AND sx = 0 AND sy = 0 AND sz = 0)"
    return f"""{name} AS (
  SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS r FROM (
    SELECT a.system_id, a.atom_id AS i, b.atom_id AS j, CAST(u.sx AS INT) AS sx, CAST(v.sy AS INT) AS sy, CAST(w.sz AS INT) AS sz,
      a.x - b.x - {A} * u.sx AS dx, a.y - b.y - {B} * v.sy AS dy, a.z_pos - b.z_pos - {C} * w.sz AS dz,
      a.z AS i_z, b.z AS j_z, a.q AS i_q, b.q AS j_q
    FROM atoms a JOIN atoms b ON a.system_id = b.system_id JOIN systems s ON s.system_id = a.system_id,
      (SELECT unnest({shift}) AS sx) u, (SELECT unnest({shift}) AS sy) v, (SELECT unnest({shift}) AS sz) w
    WHERE NOT (({open_z}) AND w.sz <> 0)
  ) WHERE dx * dx + dy * dy + dz * dz < {rc * rc!r} AND ({keep})
)"""


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; without spark.checkpoint.dir a local session gets a temporary one and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestruct-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lodestruct/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
