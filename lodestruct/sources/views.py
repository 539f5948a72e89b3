"""Structure views over the relational tables, in SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.order import tasks
from ..structures import StructureSet

#: Fixed lattice: an orthorhombic cell of these edges holds every system.
CELL = (51.0, 11.0, 9.0)

ATOMS = """
SELECT l_orderkey AS system_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS atom_id,
  CAST(1 + l_partkey % 8 AS INT) AS z, l_quantity AS x, round(l_discount * 100) AS y, round(l_tax * 100) AS z_pos,
  CASE l_returnflag WHEN 'A' THEN 1.0e0 WHEN 'R' THEN -1.0e0 ELSE 0.0e0 END AS q,
  (l_quantity - 25) / 10 AS vx, l_discount AS vy, l_tax AS vz, CAST(2 + l_partkey % 8 AS DOUBLE) AS mass,
  l_extendedprice / 1000 AS fx, l_discount AS fy, l_tax AS fz, CAST(l_linenumber % 3 AS INT) AS category
FROM lineitem
"""
SYSTEMS = "SELECT o_orderkey AS system_id, o_totalprice AS energy, o_orderpriority AS dataset, o_orderkey % 2 = 0 AS pbc_z FROM orders"
TRAJECTORY = """
SELECT user_id AS system_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS step, ts, event_type AS stage, value AS energy FROM events
"""


def _view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(_named(sql, tables), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def _named(sql: str, tables: tuple[str, ...]) -> str:
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return sql


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt by a number of its own, which is not lowered afterwards: what a task sorts for the atom ids stays small
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(_named(ATOMS, ("lineitem",)), lineitem=rows.repartition(tasks(rows), "l_orderkey"))


def systems(spark: SparkSession, sf_dir: str, mixed_pbc: bool = False) -> DataFrame:
    """``mixed_pbc``: the third axis is open where the id is odd; otherwise all axes are periodic."""
    a, b, c = CELL
    return _view(spark, sf_dir, SYSTEMS, "orders").selectExpr(
        "system_id", f"array({a}D, 0D, 0D, 0D, {b}D, 0D, 0D, 0D, {c}D) AS cell", f"array(true, true, {'pbc_z' if mixed_pbc else 'true'}) AS pbc", "energy", "dataset"
    )


def structures(spark: SparkSession, sf_dir: str, mixed_pbc: bool = False) -> StructureSet:
    return StructureSet(systems(spark, sf_dir, mixed_pbc), atoms(spark, sf_dir))


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, TRAJECTORY, "events")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("label AS system_id", "vec_id AS atom_id", "embedding[0] AS x", "embedding[1] AS y", "embedding[2] AS z_pos")
