"""Structure datasets as a Spark data source: ``spark.read.format("structures")`` and ``df.write.format("structures")``.

    spark.dataSource.register(datasource.Structures)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")   # for filters on system_id
    spark.read.format("structures").option("level", "atoms").option("columns", "z,x").load(path).filter("system_id < 100")

The files are those of ``store``; they are reached by Arrow, so ``path`` must be a local, shared or Arrow-supported place
(file, hdfs, s3), seen alike by driver and executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..structures import KEYS
from .store import LEVELS, schema_of

LOW, HIGH = -(1 << 63), (1 << 63) - 1


class Place:
    """Files of a dataset by names relative to its path."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __call__(self, name: str = "") -> tuple[pafs.FileSystem, str]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        return fs, f"{root.rstrip('/')}/{name}".rstrip("/")

    def read(self, name: str) -> bytes:
        fs, p = self(name)
        with fs.open_input_stream(p) as f:
            return f.read()

    def write(self, name: str, content: bytes) -> None:
        fs, p = self(name)
        fs.create_dir(p.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(p) as f:
            f.write(content)

    def names(self, folder: str) -> list[str]:
        fs, p = self(folder)
        found = fs.get_file_info(pafs.FileSelector(p, allow_not_found=True))
        return sorted(i.base_name for i in found if not i.base_name.startswith(("_", ".")))

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.names("versions") if n.isdigit())

    def manifest(self) -> tuple[int, dict]:
        for version in reversed(self.versions()):
            try:
                return version, json.loads(self.read(f"versions/{version}"))
            except json.JSONDecodeError:
                continue  # not complete yet
        return -1, {"parts": [], "deleted": []}

    def publish(self, version: int, manifest: dict) -> None:
        """Under a name that must be new: exclusively created on local files, otherwise looked for before it is written."""
        fs, p = self(f"versions/{version}")
        fs.create_dir(p.rpartition("/")[0], recursive=True)
        content = json.dumps(manifest).encode()
        if isinstance(fs, pafs.LocalFileSystem):
            with open(p, "xb") as f:
                f.write(content)
        elif fs.get_file_info(p).type != pafs.FileType.NotFound:
            raise FileExistsError(p)
        else:
            self.write(f"versions/{version}", content)

    def zones(self, part: dict) -> list[dict]:
        folder = f"{part['root']}.zones"
        return [json.loads(line) for n in self.names(folder) for line in self.read(f"{folder}/{n}").splitlines() if line]


@dataclass
class File(InputPartition):
    name: str


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    least: int | None
    greatest: int | None


class Reader(DataSourceReader):
    """A partition for each file of the level that can hold a wanted id; late columns and deletions of its range of ids are joined there, a row group at a time."""

    def __init__(self, place: Place, level: str, schema: T.StructType) -> None:
        self.place, self.level, self.columns = place, level, schema.names
        _, self.made = place.manifest()
        self.low, self.high, self.among = LOW, HIGH, None

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            on_id = getattr(f, "attribute", None) == ("system_id",)
            if on_id and isinstance(f, In) and all(isinstance(v, int) for v in f.value):
                self.among = set(f.value) if self.among is None else self.among & set(f.value)
            elif not on_id or not isinstance(getattr(f, "value", None), int):
                yield f
            elif isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f

    def _own(self, extra: bool) -> list[dict]:
        return [p for p in self.made["parts"] if p["level"] == self.level and bool(p["extra"]) == extra and p["rows"]]

    def _hit(self, least: int, greatest: int) -> bool:
        return least <= self.high and greatest >= self.low and (self.among is None or any(least <= i <= greatest for i in self.among))

    def partitions(self) -> list[File]:
        near = [p for p in self._own(False) if self._hit(p["least"], p["greatest"])]
        return [File(z["file"]) for p in near for z in self.place.zones(p) if self._hit(z["least"], z["greatest"])] or [File("")]

    def _range(self, name: str, columns: list[str], low: int, high: int) -> Iterator[pa.Table]:
        fs, p = self.place(name)
        with fs.open_input_file(p) as f:
            file = pq.ParquetFile(f)
            have = [c for c in columns if c in file.schema_arrow.names]
            for k in range(file.num_row_groups):
                group = file.metadata.row_group(k)
                stats = next(group.column(i).statistics for i in range(group.num_columns) if group.column(i).path_in_schema == "system_id")
                if stats is None or not stats.has_min_max or stats.min <= high and stats.max >= low:
                    t = file.read_row_group(k, columns=have)
                    yield t.filter(pc.and_(pc.greater_equal(t["system_id"], low), pc.less_equal(t["system_id"], high)))

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        keys = list(KEYS[self.level])
        kinds = {f.name: f.dataType for f in schema_of(self.made["parts"], self.level)}
        from pyspark.sql.pandas.types import to_arrow_type

        for t in self._range(partition.name, [*keys, *[c for c in self.columns if c not in keys]], self.low, self.high):
            if self.among is not None:
                t = t.filter(pc.is_in(t["system_id"], pa.array(sorted(self.among), pa.int64())))
            if not t.num_rows:
                continue
            low, high = pc.min(t["system_id"]).as_py(), pc.max(t["system_id"]).as_py()
            gone = [g["system_id"] for d in self.made["deleted"] for n in self.place.names(d["root"]) for g in self._range(f"{d['root']}/{n}", ["system_id"], low, high)]
            if gone:
                t = t.filter(pc.invert(pc.is_in(t["system_id"], pa.chunked_array([c for g in gone for c in g.chunks], pa.int64()))))
            for p in self._own(True):
                late = [c for c in T.StructType.fromJson(p["schema"]).names if c not in keys and c in self.columns]
                found = [x for z in self.place.zones(p) if late and z["least"] <= high and z["greatest"] >= low for x in self._range(z["file"], [*keys, *late], low, high)]
                if found:
                    t = t.join(pa.concat_tables(found).rename_columns([*keys, *[f"_late_{c}" for c in late]]), keys, join_type="left outer")
                    for c in late:
                        new = pc.coalesce(t[f"_late_{c}"], t[c]) if c in t.column_names else t[f"_late_{c}"]
                        t = t.drop([n for n in (c, f"_late_{c}") if n in t.column_names]).append_column(c, new)
            full = [t[c].cast(to_arrow_type(kinds[c])) if c in t.column_names else pa.nulls(t.num_rows, to_arrow_type(kinds[c])) for c in self.columns]
            yield from pa.table(full, names=self.columns).to_batches(1 << 14)


class Writer(DataSourceArrowWriter):
    """Adds a part with the rows of one level. Tasks write files that no reader looks at; the commit gives those of the successful tasks
    their names and publishes a version, so a failed or repeated task, or a failed job, leaves none."""

    def __init__(self, place: Place, level: str, schema: T.StructType, overwrite: bool) -> None:
        missing = [k for k in KEYS[level] if k not in schema.names]
        if missing:
            raise ValueError(f"{level} need {', '.join(missing)}")
        self.place, self.level, self.overwrite = place, level, overwrite
        self.schema = T.StructType([T.StructField(f.name, f.dataType, True, {"level": level}) for f in schema])
        self.root = f"parts/{uuid.uuid4().hex}/{level}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name, rows, least, greatest, out = f"{uuid.uuid4().hex}.parquet", 0, [], [], None
        fs, p = self.place(f"{self.root}/_{name}")
        fs.create_dir(p.rpartition("/")[0], recursive=True)
        for batch in iterator:
            if batch.num_rows:
                out = out or pq.ParquetWriter(p, batch.schema, filesystem=fs, compression="zstd")
                out.write_batch(batch)
                rows += batch.num_rows
                ids = batch.column(batch.schema.get_field_index("system_id"))
                least.append(pc.min(ids).as_py())
                greatest.append(pc.max(ids).as_py())
        if out:
            out.close()
        return Written(name, rows, min((i for i in least if i is not None), default=None), max((i for i in greatest if i is not None), default=None))

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m and m.rows]
        for m in done:
            fs, p = self.place(self.root)
            fs.move(f"{p}/_{m.name}", f"{p}/{m.name}")
        zones = "\n".join(json.dumps({"file": f"{self.root}/{m.name}", "least": m.least, "greatest": m.greatest, "rows": m.rows}) for m in done)
        self.place.write(f"{self.root}.zones/part-0.json", zones.encode())
        version, made = self.place.manifest()
        part = {"level": self.level, "root": self.root, "extra": False, "schema": self.schema.jsonValue(), "rows": sum(m.rows for m in done)}
        part |= {"least": min((m.least for m in done if m.least is not None), default=None), "greatest": max((m.greatest for m in done if m.greatest is not None), default=None)}
        kept = [p for p in made["parts"] if not (self.overwrite and p["level"] == self.level)]
        schema_of([*kept, part], self.level)
        self.place.publish(version + 1, {"parts": [*kept, part], "deleted": made["deleted"]})

    def abort(self, messages: list[Written | None]) -> None:
        fs, p = self.place(self.root)
        if fs.get_file_info(p).type != pafs.FileType.NotFound:
            fs.delete_dir(p)


class Structures(DataSource):
    """One level of a structure dataset.

    Options: path; level (atoms by default); columns, a comma-separated selection (all by default; keys only if named).
    Reading gives the live rows of the current version, as ``store.read_structures`` does: comparisons of system_id with numbers
    choose files and rows where Spark pushes filters to Python sources. Writing adds rows to the level as they are, ids
    included ("append"), or makes them the level's only rows ("overwrite"), in one new version.
    """

    @classmethod
    def name(cls) -> str:
        return "structures"

    def _level(self) -> str:
        level = self.options.get("level", "atoms")
        if level not in LEVELS:
            raise ValueError(f"level must be one of {', '.join(LEVELS)}")
        return level

    def schema(self) -> T.StructType:
        version, made = Place(self.options["path"]).manifest()
        known = schema_of(made["parts"], self._level())
        if version < 0 or not known.names:
            raise FileNotFoundError(f"no {self._level()} at {self.options['path']}")
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        unknown = set(wanted) - set(known.names)
        if unknown:
            raise KeyError(", ".join(sorted(unknown)))
        return T.StructType([known[c] for c in wanted or known.names])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(Place(self.options["path"]), self._level(), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(Place(self.options["path"]), self._level(), schema, overwrite)


def register(spark) -> None:
    """Makes the format known to a session and lets filters reach it."""
    spark.dataSource.register(Structures)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
