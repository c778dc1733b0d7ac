"""Array, Arrow and raw files: round trips over several partitions, and what a failed write leaves."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from starloom.sources import arrays


@pytest.fixture(scope="module")
def rows(spark):
    arrays.register(spark)
    vec = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: (F.col("id") * 10 + j).cast("float"))
    return spark.range(0, 1000, 1, 5).select("id", vec.alias("values"), (F.col("id") % 7).cast("int").alias("code"))


def read(spark, path, kind, **options):
    return spark.read.format(f"arrays.{kind}").options(**options).load(path)


def test_npy_round_trip_in_order(spark, rows, tmp_path):
    path = f"{tmp_path}/a"
    rows.select("values").write.format("arrays.npy").mode("append").option("rows", 90).save(path)
    names = sorted(n for n in os.listdir(path) if n.endswith(".npy"))
    assert len(names) == 15 and not [n for n in os.listdir(path) if n.startswith("_writing")]
    assert np.concatenate([np.load(f"{path}/{n}") for n in names]).tolist() == [[i * 10 + j for j in range(5)] for i in range(1000)]
    found = read(spark, path, "npy", split=600)
    assert found.rdd.getNumPartitions() > 15 and found.dtypes == [("row", "bigint"), ("values", "array<float>")]
    assert {r["row"]: list(r["values"]) for r in found.collect()} == {i: [i * 10 + j for j in range(5)] for i in range(1000)}
    # another write is added behind, an overwriting one takes the place of all
    rows.where("id < 3").select("values").coalesce(1).write.format("arrays.npy").mode("append").save(path)
    assert read(spark, path, "npy").where("row >= 1000").count() == 3
    rows.where("id < 4").select("values").write.format("arrays.npy").mode("overwrite").save(path)
    assert read(spark, path, "npy").count() == 4 and sum(n.endswith(".npy") for n in os.listdir(path)) <= 5


def test_files_that_numpy_wrote(spark, tmp_path):
    arrays.register(spark)
    kinds = {"<f4": "float", ">f8": "double", "|i1": "byte", "|u1": "short", "<u4": "long", "<i8": "long", "|b1": "boolean"}
    for dtype, kind in kinds.items():
        a = np.arange(24).reshape(6, 2, 2).astype(dtype)
        np.save(f"{tmp_path}/x.npy", a)
        got = read(spark, f"{tmp_path}/x.npy", "npy", split=10).orderBy("row")
        assert got.schema["values"].dataType.elementType.typeName() == kind
        assert [list(r["values"]) for r in got.collect()] == a.reshape(6, 4).tolist()
    m = np.lib.format.open_memmap(f"{tmp_path}/m.npy", "w+", np.float64, (50, 3))
    m[:] = np.arange(150).reshape(50, 3)
    m.flush()
    assert read(spark, f"file://{tmp_path}/m.npy", "npy").agg(F.sum(F.aggregate("values", F.lit(0.0), lambda a, x: a + x))).first()[0] == 150 * 149 / 2
    np.savez(f"{tmp_path}/z.npz", ids=np.arange(40), vec=np.ones((40, 2), np.float32), other=np.zeros(3))
    z = read(spark, f"{tmp_path}/z.npz", "npz", columns="vec,ids", split=100)
    assert z.columns == ["vec", "ids"] and sorted(r["ids"] for r in z.collect()) == list(range(40))
    np.savez_compressed(f"{tmp_path}/c.npz", ids=np.arange(40))
    np.save(f"{tmp_path}/f.npy", np.asfortranarray(np.ones((4, 4))))
    for path, kind, said in ((f"{tmp_path}/c.npz", "npz", "compressed"), (f"{tmp_path}/f.npy", "npy", "by columns")):
        with pytest.raises(Exception, match=said):
            read(spark, path, kind).collect()


def test_raw_and_arrow_round_trips(spark, rows, tmp_path):
    rows.select("code").write.format("arrays.raw").mode("append").option("dtype", "<u4").save(f"{tmp_path}/r")
    names = sorted(n for n in os.listdir(f"{tmp_path}/r") if n.endswith(".raw"))
    assert b"".join(open(f"{tmp_path}/r/{n}", "rb").read() for n in names) == (np.arange(1000) % 7).astype("<u4").tobytes()
    assert [r["values"] for r in read(spark, f"{tmp_path}/r", "raw", dtype="<u4", split=64).orderBy("row").collect()] == [i % 7 for i in range(1000)]
    rows.select("values").write.format("arrays.raw").mode("append").option("dtype", "<f4").save(f"{tmp_path}/w")
    assert read(spark, f"{tmp_path}/w", "raw", dtype="<f4", width=5).where("values[0] = 990").first()["values"] == [990, 991, 992, 993, 994]
    with pytest.raises(Exception, match="whole rows"):
        read(spark, f"{tmp_path}/w", "raw", dtype="<f4", width=7).collect()
    cells = rows.withColumn("values", F.when(F.col("id") % 3 > 0, F.col("values"))).withColumn("name", F.concat(F.lit("n"), "id"))
    cells.write.format("arrays.ipc").mode("append").option("rows", 300).save(f"{tmp_path}/i")
    first = next(n for n in sorted(os.listdir(f"{tmp_path}/i")) if n.endswith(".arrow"))
    with pa.memory_map(f"{tmp_path}/i/{first}") as f:
        assert pa.ipc.open_file(f).get_batch(0).num_rows == 128
    got = read(spark, f"{tmp_path}/i", "ipc", columns="name,values", batches=1)
    assert got.columns == ["name", "values"] and got.count() == 1000 and got.where("values is null").count() == 334
    assert sorted(map(str, read(spark, f"{tmp_path}/i", "ipc").collect())) == sorted(map(str, cells.collect()))


def test_a_failed_task_leaves_nothing(spark, rows, tmp_path):
    path = f"{tmp_path}/a"
    rows.select("values").write.format("arrays.npy").mode("append").save(path)
    before = sorted(os.listdir(path))
    odd = rows.select(F.when(F.col("id") < 950, F.col("values")).alias("values"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="nulls"):
            odd.write.format("arrays.npy").mode(mode).option("rows", 50).save(path)
        assert sorted(os.listdir(path)) == before
    ragged = rows.select(F.slice("values", 1, F.when(F.col("id") < 950, 2).otherwise(3)).alias("values")).coalesce(1)
    with pytest.raises(Exception, match="several lengths"):
        ragged.write.format("arrays.npy").mode("append").save(path)
    assert sorted(os.listdir(path)) == before and read(spark, path, "npy").count() == 1000


def test_empty_tables(spark, rows, tmp_path):
    rows.where("id < 0").write.format("arrays.npz").mode("append").save(f"{tmp_path}/e")
    assert read(spark, f"{tmp_path}/e", "npz").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        read(spark, f"{tmp_path}/nowhere", "npy").collect()
