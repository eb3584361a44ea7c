"""Array files and record shards: round trips, ranges, torn files, lost attempts."""

import io
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilework.sources import arrays, records

RNG = np.random.default_rng(21)


def test_arrays_are_read_by_rows(spark, tmp_path):
    made = {}
    for name, shape, kind in (("a", (50, 7), "f4"), ("b", (3, 7), "f8"), ("c", (0, 7), "f4"), ("d", (9,), "i8")):
        os.makedirs(tmp_path / name)
        made[name] = RNG.normal(size=shape).astype(kind) if kind != "i8" else np.arange(9)
        np.save(tmp_path / name / "features.npy", made[name])
    frame = arrays.read_arrays(spark, str(tmp_path), rowsPerPartition=20)
    assert frame.rdd.getNumPartitions() == 5
    rows = frame.collect()
    for name, x in made.items():
        mine = sorted((r.row, r["values"]) for r in rows if r.slide_id == name)
        assert [k for k, _ in mine] == list(range(len(x))) and np.array_equal(np.array([v for _, v in mine]).reshape(x.shape), x.astype("f8"))
    loaded = {(r.slide_id, r.row): r for r in arrays.preload(spark, str(tmp_path), 2).collect()}
    assert {k for k in loaded if k[0] in "ab"} == {("a", 0), ("a", 1), ("b", 0), ("b", 1)} and loaded["a", 1].features == made["a"][1, 3:].astype("f8").tolist()
    assert loaded["a", 0].x == int(made["a"][0, 1])


def test_first_rows_cost_their_bytes(spark, tmp_path):
    os.makedirs(tmp_path / "s")
    np.save(tmp_path / "s" / "features.npy", np.arange(4000.0).reshape(1000, 4))
    with open(tmp_path / "s" / "features.npy", "r+b") as f:  # all but 30 rows are gone
        f.truncate(128 + 30 * 32)
    assert arrays.read_arrays(spark, str(tmp_path), rows=30).count() == 30
    with pytest.raises(Exception, match="cut off"):
        arrays.read_arrays(spark, str(tmp_path)).collect()


def test_arrays_are_written_and_joined(spark, tmp_path):
    rows = [(s, i, [float(s), i / 2, float(i)]) for s in (1, 2) for i in range(5 * s)]
    frame = spark.createDataFrame(rows, "s int, i int, v array<double>").repartition(3)
    assert sorted(map(tuple, arrays.write_arrays(frame, f"{tmp_path}/out", "s", "i", "v").collect())) == [("1", 5), ("2", 10)]
    arrays.write_arrays(frame.withColumn("v", F.array(F.col("i").cast("double"))), f"{tmp_path}/out", "s", "i", "v", "coords.npy").count()
    assert np.array_equal(np.load(f"{tmp_path}/out/2/features.npy"), [v for s, _, v in rows if s == 2])
    both = arrays.with_coordinates(arrays.read_arrays(spark, f"{tmp_path}/out"), arrays.read_arrays(spark, f"{tmp_path}/out", name="coords.npy")).collect()
    assert sorted((int(r.slide_id), int(r.coords[0]), r["values"]) for r in both) == rows


def test_checksums():
    assert records.crc32c(b"123456789") == 0xE3069283 and records.crc32c(b"") == 0 and records.crc32c(bytes(32)) == 0x8A9136AA
    data = RNG.integers(0, 256, 5000).astype("u1").tobytes()
    crc = 0xFFFFFFFF
    for x in data:
        crc = int(records._TABLE[(crc ^ x) & 0xFF]) ^ (crc >> 8)
    assert records.crc32c(data) == crc ^ 0xFFFFFFFF


def test_fields_round_trip():
    values = {"image": b"\x00\xff" * 300, "name": "Zürich", "dims": -5, "many": [1, 2**40, -1], "x": [0.5, -2.0], "none": None, "empty": []}
    back = records.decode_fields(records.encode_fields(values))
    assert back == {"image": [values["image"]], "name": ["Zürich".encode()], "dims": [-5], "many": values["many"], "x": values["x"], "empty": []}


SCHEMA = "image binary, name string, dims long, scores array<float>"


def test_records_round_trip(spark, tmp_path):
    rows = [(bytes(RNG.integers(0, 256, int(n)).astype("u1")), f"t{i}", i, [i / 2, 1.0], ["train", "test"][i % 4 == 0]) for i, n in enumerate(RNG.integers(0, 3000, 40))]
    frame = spark.createDataFrame([*rows, (None, "none", None, None, "test")], SCHEMA + ", split string")
    records.write_records(frame, f"{tmp_path}/r", 3, "split")
    assert sorted(os.listdir(f"{tmp_path}/r")) == ["test", "train"] and len(os.listdir(f"{tmp_path}/r/train")) == 3
    key = lambda r: (str(r[1]), None if r[0] is None else bytes(r[0]), r[2], r[3])
    assert sorted(key(r) for r in records.read_records(spark, f"{tmp_path}/r", SCHEMA).collect()) == sorted(key(r) for r in [*rows, (None, "none", None, None)])
    assert records.read_records(spark, f"{tmp_path}/r/test", "name string").count() == 11
    records.write_records(frame.limit(0), f"{tmp_path}/none", 2)
    assert records.read_records(spark, f"{tmp_path}/none").count() == 0


def test_torn_records_are_refused(spark, tmp_path):
    records.write_records(spark.createDataFrame([(b"abc" * 100, "n", 1)], "image binary, name string, dims long"), f"{tmp_path}/r", 1)
    name = f"{tmp_path}/r/{os.listdir(f'{tmp_path}/r')[0]}"
    data = open(name, "rb").read()
    for torn in (data[:-1], data[:5], data[:40] + bytes([data[40] ^ 1]) + data[41:], bytes([data[0] ^ 1]) + data[1:]):
        open(name, "wb").write(torn)
        with pytest.raises(Exception, match="damaged"):
            records.read_records(spark, f"{tmp_path}/r").collect()


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    broken = spark.range(20).select(F.expr("case when id = 13 then raise_error('lost') else cast(id as string) end").alias("name"), F.col("id").alias("dims"))
    with pytest.raises(Exception, match="lost"):
        records.write_records(broken, f"{tmp_path}/r", 4)
    assert not os.path.isdir(f"{tmp_path}/r") or os.listdir(f"{tmp_path}/r") == []


def plain_crc(data):
    crc = 0xFFFFFFFF
    for x in data:
        crc = int(records._TABLE[(crc ^ x) & 0xFF]) ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


@pytest.mark.parametrize("together", [1, 700, 1 << 20])
def test_records_are_summed_together(monkeypatch, together):
    """Checksums of many records at once, and records longer than what is read at once; the frame is written out here."""
    monkeypatch.setattr(records, "TOGETHER", together)
    bodies = [RNG.integers(0, 256, int(n)).astype("u1").tobytes() for n in (0, 1, 3, 4, 5, 251, 252, 253, 1000, 12, 5000, 0, 256 * 37 - 4)]
    assert records.checksums(b"".join(bodies), *records._places([len(x) for x in bodies])).tolist() == [plain_crc(x) for x in bodies]
    mask = lambda x: struct.pack("<I", ((plain_crc(x) >> 15 | plain_crc(x) << 17) + 0xA282EAD8) & 0xFFFFFFFF)
    want = b"".join((head := struct.pack("<Q", len(x))) + mask(head) + x + mask(x) for x in bodies)
    assert b"".join(records.framed_all(bodies)) == want and list(records.unframed(io.BytesIO(want), "f")) == bodies
    for at in RNG.integers(0, len(want), 30).tolist():
        with pytest.raises(ValueError, match="damaged"):
            list(records.unframed(io.BytesIO(want[:at] + bytes([want[at] ^ 4]) + want[at + 1 :]), "f"))
    edges = set(np.cumsum([len(x) + 16 for x in bodies]).tolist()) | {0}
    for at in {*RNG.integers(0, len(want), 30).tolist()} - edges:
        with pytest.raises(ValueError, match="damaged"):
            list(records.unframed(io.BytesIO(want[:at]), "f"))
