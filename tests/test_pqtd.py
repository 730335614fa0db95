"""PQTD files: round trips, byte ranges, broken files."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import pqtd


def test_round_trip(spark, tmp_path):
    rows = [(i, f"t{i}", float(i) / 3, i % 7 if i % 5 else None, i * 1.5) for i in range(1000)]
    df = spark.createDataFrame(rows, "`a b` long, t string, `é` double, n int, f float").repartition(3)
    pqtd.save(df, f"{tmp_path}/x")
    back = pqtd.load(spark, f"{tmp_path}/x")
    assert back.columns == ["a b", "é", "n", "f"] and back.dtypes[0][1] == "float"
    want = sorted((np.float32(a), np.float32(e), np.float32(n or 0), np.float32(f)) for a, _, e, n, f in rows)
    assert sorted(tuple(map(np.float32, r)) for r in back.collect()) == want
    pqtd.save(df.limit(5), f"file://{tmp_path}/x")
    assert pqtd.load(spark, f"file://{tmp_path}/x").count() == 5
    assert not [p for p in (tmp_path / "x").iterdir() if p.name.startswith("_") or p.suffix != ".pqtd"]
    pqtd.register(spark)
    df.select("f").write.format("pqtd").mode("append").save(f"{tmp_path}/y")
    df.select("f").write.format("pqtd").mode("append").save(f"{tmp_path}/y")
    assert pqtd.load(spark, f"{tmp_path}/y").count() == 2000


def by_hand(path, names, rows, short=0):
    head = b"PQTD" + struct.pack("<QQ", len(rows), len(names)) + b"".join(struct.pack("<I", len(n)) + n for n in names)
    body = np.array(rows, "<f4").tobytes()
    path.write_bytes(head + body[: len(body) - short])


def test_files_of_others(spark, tmp_path):
    by_hand(tmp_path / "one.bin", [b"x", b"y"], [(1, 2), (3, float("nan"))])
    got = pqtd.load(spark, str(tmp_path / "one.bin")).orderBy("x").collect()
    assert tuple(got[0]) == (1, 2) and got[1][0] == 3 and got[1][1] != got[1][1]
    by_hand(tmp_path / "none.bin", [b"x"], [])
    assert pqtd.load(spark, str(tmp_path / "none.bin")).count() == 0
    by_hand(tmp_path / "short.bin", [b"x", b"y"], [(1, 2), (3, 4)], short=3)
    with pytest.raises(Exception, match="incomplete file"):
        pqtd.load(spark, str(tmp_path / "short.bin")).collect()
    (tmp_path / "wrong.bin").write_bytes(b"PAR1....................")
    with pytest.raises(Exception, match="no PQTD file"):
        pqtd.load(spark, str(tmp_path / "wrong.bin"))
    with pytest.raises(TypeError):
        pqtd.save(spark.createDataFrame([("x",)], "t string"), str(tmp_path / "z"))


def test_ranges_of_rows(monkeypatch, tmp_path):
    monkeypatch.setattr(pqtd, "PARTITION_BYTES", 24)
    by_hand(tmp_path / "a.pqtd", [b"x", b"y"], [(i, -i) for i in range(10)])
    by_hand(tmp_path / "b.pqtd", [b"x", b"y"], [(i, -i) for i in range(10, 12)])
    source = pqtd.PqtdSource({"path": str(tmp_path)})
    reader = source.reader(source.schema())
    parts = reader.partitions()
    assert [p.rows for p in parts] == [3, 3, 3, 1, 2]
    assert [x for p in parts for b in reader.read(p) for x in b.column(0).to_pylist()] == list(range(12))
    by_hand(tmp_path / "c.pqtd", [b"x", b"z"], [(1, 1)])
    with pytest.raises(ValueError, match="has columns"):
        reader.partitions()


def test_sum_over_a_file(spark, tmp_path):
    pqtd.save(spark.range(100_000).select((F.col("id") % 100).alias("v")), f"{tmp_path}/x")
    assert pqtd.load(spark, f"{tmp_path}/x").agg(F.sum("v")).first()[0] == 4_950_000
