"""Structure datasets on storage: Parquet files of each level, in versions.

A dataset at ``path`` is the list of its versions, ``versions/0``, ``versions/1``, ...; each is a manifest that names the
parts and the deletions it is made of. A part holds rows of one level, or some columns of one (``extra``) that are joined by
key on reading. The manifest keeps each part's schema, number of rows and range of ids, and beside a part lie its zones:
the same for each of its files. So nothing is listed or opened to plan a read, a few ids are read from the files
that can hold them, and an append knows the next id. Every change writes new files and then one manifest, under a name that
must not exist yet: of two writers of a version the second one fails (on stores whose "create" is not atomic, only if
they do not meet within that call). A manifest that is not complete is none, so a reader sees one version or the next, never
part of either. All file access goes through Spark and Hadoop, so any store they know will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.structures import rekey, validate
from ..operators.structures import take as take_systems
from ..structures import KEYS, StructureSet

LEVELS = ("systems", "atoms", "edges")
#: Ids up to this number choose files; more are joined with all rows.
CHOOSE = 10_000
ZONES = "file string, least long, greatest long, rows long"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, f"{path}/versions")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the current version, the greatest one that is complete."""
    for version in reversed(_versions(spark, path)):
        try:
            return version, json.loads(spark.read.text(f"{path}/versions/{version}", wholetext=True).first()[0])
        except (TypeError, json.JSONDecodeError):
            continue
    raise FileNotFoundError(path)


def _publish(spark: SparkSession, path: str, version: int, parts: list[dict], deleted: list[dict]) -> None:
    for level in {p["level"] for p in parts}:
        schema_of(parts, level)  # types that do not agree must not become a version
    fs, final = _fs(spark, f"{path}/versions/{version}")
    try:
        out = fs.create(final, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            raise FileExistsError(f"version {version} of {path} was written by another") from None
        raise
    out.write(bytearray(json.dumps({"parts": parts, "deleted": deleted}).encode()))
    out.close()


def schema_of(parts: list[dict], level: str) -> T.StructType:
    """Columns of a level over all its parts, in order of first appearance; an error if a name has two types."""
    found: dict[str, T.StructField] = {}
    for p in parts:
        for f in T.StructType.fromJson(p["schema"]).fields if p["level"] == level else []:
            known = found.setdefault(f.name, f)
            if known.dataType != f.dataType:
                raise ValueError(f"{level}.{f.name} is {known.dataType.simpleString()} and {f.dataType.simpleString()}")
    return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in found.values()])


def next_id(parts: list[dict]) -> int:
    return 1 + max((p["greatest"] for p in parts if p["greatest"] is not None), default=-1)


def _write_part(df: DataFrame, path: str, root: str, level: str, extra: bool = False, **options: str) -> dict:
    """Writes rows of a level, dealt by ranges of their keys so that files have narrow zones (a system of very many rows
    spans several), and their zones; returns the part's entry in a manifest."""
    spark = df.sparkSession
    marked = df.select(*[F.col(c).cast("long").alias(c, metadata={"level": level}) if c == "system_id" else F.col(c).alias(c, metadata={"level": level}) for c in df.columns])
    marked.repartitionByRange(*KEYS[level]).sortWithinPartitions(*KEYS[level]).write.options(**options).parquet(f"{path}/{root}")
    written = spark.read.schema(marked.schema).parquet(f"{path}/{root}")
    zones = written.groupBy(F.concat(F.lit(f"{root}/"), "_metadata.file_name").alias("file")).agg(F.min("system_id").alias("least"), F.max("system_id").alias("greatest"), F.count("*").alias("rows"))
    zones.write.json(f"{path}/{root}.zones")
    least, greatest, rows = spark.read.schema(ZONES).json(f"{path}/{root}.zones").agg(F.min("least"), F.max("greatest"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    return {"level": level, "root": root, "extra": extra, "schema": marked.schema.jsonValue(), "rows": rows, "least": least, "greatest": greatest}


def _write_levels(ss: StructureSet, path: str, options: dict) -> list[dict]:
    name = uuid.uuid4().hex
    return [_write_part(df, path, f"parts/{name}/{level}", level, **options) for level, df in ss.levels().items()]


def write_structures(ss: StructureSet, path: str, mode: str = "error", **options: str) -> None:
    """A new dataset. ``options`` are those of the Parquet writer (compression, block size and the like); mode "overwrite" makes a new version."""
    spark = ss.systems.sparkSession
    found = _versions(spark, path)
    if found and mode != "overwrite":
        raise FileExistsError(path)
    _publish(spark, path, found[-1] + 1 if found else 0, _write_levels(ss, path, options), [])


def _few(ids: DataFrame) -> list[int] | None:
    """The ids in order, or None if they are more than CHOOSE."""
    found = [r[0] for r in ids.select(F.col("system_id").cast("long")).filter("system_id is not null").distinct().limit(CHOOSE + 1).collect()]
    return sorted(found) if len(found) <= CHOOSE else None


def _files(spark: SparkSession, path: str, parts: list[dict], ids: list[int]) -> dict[str, list[str]]:
    """Files of each part whose zone holds one of ``ids``."""
    known = np.array(ids, np.int64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            hit = np.searchsorted(known, b.column("least").to_numpy(), "left") < np.searchsorted(known, b.column("greatest").to_numpy(), "right")
            yield b.filter(pa.array(hit)).select(["file"])

    near = [p["root"] for p in parts if ids and p["rows"] and p["least"] <= ids[-1] and p["greatest"] >= ids[0]]
    out: dict[str, list[str]] = {p["root"]: [] for p in parts}
    if near:
        zones = spark.read.schema(ZONES).json([f"{path}/{root}.zones" for root in near])
        for r in zones.mapInArrow(run, "file string").collect():
            out[r["file"].rpartition("/")[0]].append(r["file"])
    return out


def read_structures(spark: SparkSession, path: str, fields: Sequence[str] | None = None, index: bool = False, ids: DataFrame | None = None) -> StructureSet:
    """The live systems of a dataset.

    ``fields`` restricts the columns besides keys, ``index`` numbers systems 0, 1, 2, ..., ``ids`` (system_id) restricts the
    systems: up to CHOOSE ids choose the files that are read, more of them are joined with all rows. Unknown, null and
    repeated ids change nothing. A column that a part does not have is null there.
    """
    _, made = _manifest(spark, path)
    schemas = {k: schema_of(made["parts"], k) for k in LEVELS if any(p["level"] == k for p in made["parts"])}
    if fields is not None:
        unknown = set(fields) - {c for s in schemas.values() for c in s.names}
        if unknown:
            raise KeyError(", ".join(sorted(unknown)))
    few = None if ids is None else _few(ids)
    files = None if few is None else _files(spark, path, made["parts"], few)

    def rows(parts: list[dict], schema: T.StructType) -> DataFrame:
        paths = [f"{path}/{f}" for p in parts for f in ([p["root"]] if files is None else files[p["root"]])]
        df = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
        return df.filter(F.col("system_id").between(few[0], few[-1])) if few else df

    levels = {}
    for level, schema in schemas.items():
        own = [p for p in made["parts"] if p["level"] == level]
        wanted = [c for c in schema.names if fields is None or c in KEYS[level] or c in fields]
        late = {c: p for p in own if p["extra"] for c in T.StructType.fromJson(p["schema"]).names if c in wanted and c not in KEYS[level]}
        whole = [p for p in own if not p["extra"]]
        early = schema_of(whole, level).names
        df = rows(whole, T.StructType([schema[c] for c in wanted if c in early]))
        for c, part in late.items():  # rows appended since may have the column themselves
            more = rows([part], T.StructType([schema[k] for k in (*KEYS[level], c)])).withColumnRenamed(c, "_late")
            df = df.join(more, list(KEYS[level]), "left").withColumn(c, F.coalesce(c, "_late") if c in early else F.col("_late")).drop("_late")
        levels[level] = df.select(*[F.col(c).alias(c, metadata=schema[c].metadata) for c in wanted])
    ss = StructureSet(**levels)
    if ids is not None:
        ss = ss.map(lambda df: df.join(ids.select(F.col("system_id").cast("long").alias("system_id")), "system_id", "left_semi"))
    if made["deleted"]:
        gone = spark.read.schema("system_id long").parquet(*[f"{path}/{d['root']}" for d in made["deleted"]])
        ss = ss.map(lambda df: df.join(gone, "system_id", "left_anti"))
    return rekey(ss) if index else ss


def take(spark: SparkSession, path: str, wanted: DataFrame, fields: Sequence[str] | None = None) -> StructureSet:
    """Systems of a dataset by ``wanted`` (ordinal, system_id), as the operator of this name gives them, reading only the files that can hold them."""
    return take_systems(read_structures(spark, path, fields, ids=wanted), wanted)


def field_levels(spark: SparkSession, path: str) -> dict[str, str]:
    """The level of each column, from the manifest alone; a key is of the last level that has it."""
    return {c: level for level in LEVELS for c in schema_of(_manifest(spark, path)[1]["parts"], level).names}


def append_structures(ss: StructureSet, path: str) -> None:
    """Systems after those of a dataset, numbered on from its greatest id, which the manifest knows; edge ends stay local to their system."""
    spark = ss.systems.sparkSession
    version, made = _manifest(spark, path)
    moved = rekey(ss).map(lambda df: df.withColumn("system_id", F.col("system_id") + F.lit(next_id(made["parts"]))))
    _publish(spark, path, version + 1, made["parts"] + _write_levels(moved, path, {}), made["deleted"])


def delete_structures(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Marks systems as deleted; their rows stay until compaction."""
    version, made = _manifest(spark, path)
    gone = f"deleted/{uuid.uuid4().hex}"
    ids.select(F.col("system_id").cast("long").alias("system_id")).distinct().write.parquet(f"{path}/{gone}")
    _publish(spark, path, version + 1, made["parts"], [*made["deleted"], {"root": gone}])


def compact(spark: SparkSession, path: str) -> None:
    """Rewrites the live systems, numbered anew, with all columns in one part a level, as the next version; all deleted leaves an empty dataset. Files of older versions stay for their readers."""
    version, _ = _manifest(spark, path)
    _publish(spark, path, version + 1, _write_levels(read_structures(spark, path, index=True), path, {}), [])


def add_custom(spark: SparkSession, path: str, key: str, df: DataFrame, level: str) -> None:
    """A new column of a level, written alone beside its rows; an error unless ``df`` has exactly the keys of the level's live rows."""
    (version, made), keys = _manifest(spark, path), list(KEYS[level])
    if key in schema_of(made["parts"], level).names:
        raise ValueError(f"{level} already has {key}")
    own = getattr(read_structures(spark, path, fields=[]), level).select(*keys, F.lit(1).alias("_own"))
    new = df.select(*keys, key)
    both = own.join(new.select(*keys, F.lit(1).alias("_new")), keys, "full")
    odd = both.groupBy(*keys).agg(F.count("*").alias("n"), F.count("_own").alias("a"), F.count("_new").alias("b")).filter("n <> 1 or a <> 1 or b <> 1")
    if not odd.isEmpty():
        raise ValueError(f"rows of {key} do not match those of {level}")
    part = _write_part(new, path, f"parts/{uuid.uuid4().hex}/{level}", level, extra=True)
    _publish(spark, path, version + 1, [*made["parts"], part], made["deleted"])


def check_store(spark: SparkSession, path: str) -> DataFrame:
    return validate(read_structures(spark, path))


def normalise_records(df: DataFrame, mapping: dict[str, str], id_col: str = "system_id") -> StructureSet:
    """A structure set from parsed records, one row each.

    ``mapping`` names the records' columns for: numbers (array), positions (array of arrays), cell (nine, or three
    arrays of three), pbc, energy, forces (array of arrays), stress, virial (six, nine or three by three), dipole,
    charge, info (map). Only what is present is filled; of info, entries that are not numbers go.
    """
    from ..functions.vectors import voigt_to_matrix

    def flat(name: str):
        kind = df.schema[mapping[name]].dataType.simpleString()
        c = F.flatten(F.col(mapping[name])) if kind.startswith("array<array") else F.col(mapping[name])
        return c.cast("array<double>")

    has = lambda n: mapping.get(n) in df.columns
    s = [F.col(id_col).alias("system_id")]
    s.append((voigt_to_matrix(flat("cell")) if has("cell") else F.lit(None).cast("array<double>")).alias("cell"))
    s.append((F.col(mapping["pbc"]) if has("pbc") else F.array(*[F.lit(has("cell"))] * 3)).alias("pbc"))
    s += [F.col(mapping[n]).cast("double").alias(n) for n in ("energy", "charge") if has(n)]
    s += [voigt_to_matrix(flat(n)).alias(n) for n in ("stress", "virial") if has(n)]
    s += [flat("dipole").alias("dipole")] if has("dipole") else []
    if has("info"):
        numbers = F.transform_values(F.col(mapping["info"]), lambda _, v: v.try_cast("double"))
        s.append(F.map_filter(numbers, lambda _, v: v.isNotNull()).alias("info"))
    parts = [F.col(mapping["numbers"]).alias("z"), F.col(mapping["positions"]).alias("p")] + ([F.col(mapping["forces"]).alias("f")] if has("forces") else [])
    rows = df.select(F.col(id_col).alias("system_id"), F.posexplode(F.arrays_zip(*parts)).alias("atom_id", "a"))
    names = rows.schema["a"].dataType.names
    a = [F.col("system_id"), F.col("atom_id").cast("long"), F.col("a")[names[0]].cast("int").alias("z"), *[F.col("a")[names[1]][k].cast("double").alias(c) for k, c in enumerate(("x", "y", "z_pos"))]]
    a += [F.col("a")[names[2]][k].cast("double").alias(c) for k, c in enumerate(("fx", "fy", "fz"))] if has("forces") else []
    return StructureSet(df.select(*s), rows.select(*a))
