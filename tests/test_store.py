"""Stores beyond their round trip: zones, late columns, versions, and the data source over them."""

import pytest
from pyspark.sql import functions as F

from lodestruct.plans.common import folder
from lodestruct.sources import datasource, store
from lodestruct.structures import StructureSet


def made(spark, n=2000, start=0):
    s = spark.range(start, start + n).select(F.col("id").alias("system_id"), (F.col("id") * 1.5).alias("energy"))
    a = s.select("system_id", F.explode(F.expr("sequence(0L, system_id % 3)")).alias("atom_id"), F.lit(1).alias("z")).withColumn("x", F.col("system_id") + F.col("atom_id") / 4)
    return StructureSet(s, a)


@pytest.fixture
def path(spark):
    return folder(spark, "test-zones")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_few_ids_read_few_files(spark, path):
    ss = made(spark, 20000)
    store.write_structures(ss, path, maxRecordsPerFile="100")
    every = store.read_structures(spark, path)
    wanted = spark.range(4000, 4100).select(F.col("id").alias("ordinal"), F.col("id").alias("system_id"))
    got = store.take(spark, path, wanted.unionByName(spark.createDataFrame([(-1, 999999), (0, None), (1, 4000)], "ordinal long, system_id long")))
    for level in ("systems", "atoms"):
        few, all_ = (len(getattr(x, level).inputFiles()) for x in (got, every))
        assert all_ >= 200 and few * 20 < all_
    assert rows(got.systems) == sorted([(1, 6000.0), *((i, i * 1.5) for i in range(4000, 4100))], key=repr)
    assert got.atoms.count() == ss.atoms.filter("system_id between 4000 and 4099").count() + 2
    assert store.read_structures(spark, path, ids=spark.createDataFrame([(-5,), (None,)], "system_id long")).atoms.count() == 0


def test_many_ids_and_none(spark, path, monkeypatch):
    monkeypatch.setattr(store, "CHOOSE", 5)
    store.write_structures(made(spark, 50), path)
    ids = spark.range(10, 40).withColumnRenamed("id", "system_id")
    assert store.read_structures(spark, path, ids=ids).systems.count() == 30
    assert store.read_structures(spark, path, ids=ids.limit(0)).systems.count() == 0


def test_late_column_is_written_alone(spark, path):
    ss = made(spark, 40)
    store.write_structures(ss, path)
    store.add_custom(spark, path, "twice", ss.systems.select("system_id", (F.col("energy") * 2).alias("twice")), "systems")
    parts = store._manifest(spark, path)[1]["parts"]
    assert [f["name"] for f in parts[-1]["schema"]["fields"]] == ["system_id", "twice"] and len(parts) == 3
    store.append_structures(made(spark, 3), path)  # without it
    store.append_structures(made(spark, 2).with_(systems=made(spark, 2).systems.withColumn("twice", F.lit(-1.0))), path)
    got = rows(store.read_structures(spark, path, fields=["twice"]).systems)
    assert got == sorted([*((i, i * 3.0) for i in range(40)), (40, None), (41, None), (42, None), (43, -1.0), (44, -1.0)], key=repr)
    assert store.field_levels(spark, path)["twice"] == "systems"
    for bad in (ss.systems.limit(3), ss.systems.unionByName(ss.systems.limit(1))):
        with pytest.raises(ValueError):
            store.add_custom(spark, path, "more", bad.select("system_id", F.lit(1).alias("more")), "systems")
    store.compact(spark, path)
    assert rows(store.read_structures(spark, path).systems.select("system_id", "twice")) == got
    with pytest.raises(ValueError):  # another type
        store.append_structures(made(spark, 2).with_(systems=made(spark, 2).systems.withColumn("twice", F.lit("x"))), path)
    assert store.read_structures(spark, path).systems.count() == 45


def test_append_reads_no_rows(spark, path):
    store.write_structures(made(spark, 10), path)
    fs, p = store._fs(spark, f"{path}/{store._manifest(spark, path)[1]['parts'][0]['root']}")
    fs.delete(p, True)
    store.append_structures(made(spark, 2), path)
    assert store.next_id(store._manifest(spark, path)[1]["parts"]) == 12


def test_half_a_manifest_is_none(spark, path):
    store.write_structures(made(spark, 10), path)
    fs, p = store._fs(spark, f"{path}/versions/1")
    out = fs.create(p, False)
    out.write(bytearray(b'{"parts": ['))
    out.close()
    assert store.read_structures(spark, path).systems.count() == 10
    assert datasource.Place(path).manifest()[0] == 0


def load(spark, path, level="atoms", **options):
    return spark.read.format("structures").option("level", level).options(**options).load(path)


def test_source_reads_what_the_store_reads(spark, path):
    datasource.register(spark)
    store.write_structures(made(spark, 300), path, maxRecordsPerFile="20")
    store.add_custom(spark, path, "y", made(spark, 300).atoms.select("system_id", "atom_id", (F.col("x") * 2).alias("y")), "atoms")
    store.append_structures(made(spark, 30), path)
    store.delete_structures(spark, path, spark.createDataFrame([(3,), (77,), (310,), (10**9,)], "system_id long"))
    want = store.read_structures(spark, path)
    for level in ("systems", "atoms"):
        assert rows(load(spark, path, level)) == rows(getattr(want, level))
    assert rows(load(spark, path, columns="y").groupBy().agg(F.sum("y"), F.count("*"))) == rows(want.atoms.groupBy().agg(F.sum("y"), F.count("*")))
    for condition in ("system_id = 5", "system_id in (1, 2, 290, 500)", "system_id > 20 and system_id <= 31 and z = 1", "system_id >= 310", "system_id < 0", "system_id <> 4", "y is null", "system_id = 5 and system_id in (6)"):
        assert rows(load(spark, path).filter(condition)) == rows(want.atoms.filter(condition)), condition
    assert load(spark, path).rdd.getNumPartitions() > 20
    assert load(spark, path).filter("system_id between 40 and 42").rdd.getNumPartitions() <= 4
    with pytest.raises(Exception, match="columns|nothing"):
        load(spark, path, columns="nothing").count()
    with pytest.raises(Exception, match="level"):
        load(spark, path, "bonds").count()


def test_source_writes_versions(spark, path):
    datasource.register(spark)
    ss = made(spark, 100)
    ss.systems.repartition(5).write.format("structures").mode("append").option("level", "systems").save(path)
    ss.atoms.write.format("structures").mode("append").save(path)
    assert rows(store.read_structures(spark, path).atoms) == rows(ss.atoms)
    more = made(spark, 10, 500)
    more.systems.write.format("structures").mode("append").option("level", "systems").save(path)
    assert store.read_structures(spark, path).systems.count() == 110
    more.systems.write.format("structures").mode("overwrite").option("level", "systems").save(path)
    assert rows(load(spark, path, "systems")) == rows(more.systems)
    ss.atoms.limit(0).write.format("structures").mode("append").save(path)
    assert load(spark, path).count() == ss.atoms.count()
    with pytest.raises(Exception, match="atom_id"):
        ss.systems.write.format("structures").mode("append").save(path)


def test_failed_task_leaves_no_version(spark, path):
    datasource.register(spark)
    ss = made(spark, 100)
    ss.atoms.write.format("structures").mode("append").save(path)
    before = datasource.Place(path).versions()
    bad = ss.atoms.repartition(4, "system_id").withColumn("x", F.when(F.col("system_id") == 57, F.raise_error(F.lit("lost"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("structures").mode("append").save(path)
    assert datasource.Place(path).versions() == before and load(spark, path).count() == ss.atoms.count()
    with pytest.raises(FileExistsError):  # of two writers of a version the second fails
        datasource.Place(path).publish(before[-1], {"parts": [], "deleted": []})
