import struct

import pytest
from pyspark.sql import functions as F

from kinetra.operators.optimise import evolve
from kinetra.sources import files
from kinetra.streaming import tracks as streams


def test_sequences(spark, tmp_path):
    numbers = " ".join(map(str, [1, 0, 0, 5, 0, 1, 0, 6, 0, 0, 1, 7, 0, 0, 0, 1]))
    head = f"ObjectType = Image\r\nDimSize = 4 3 2\r\nSeq_Frame0000_Timestamp = 0.024\r\nSeq_Frame0000_ProbeToTrackerDeviceTransform = {numbers}\r\nSeq_Frame0001_ProbeToTrackerDeviceTransform = 1 2 3\r\nSeq_Frame0001_ImageStatus = INVALID\r\nSeq_Frame0005_ImageStatus = OK\r\nElementDataFile = LOCAL\r\n"
    (tmp_path / "whole.mha").write_bytes(head.encode() + bytes(range(24)))
    (tmp_path / "short.mha").write_bytes(head.encode() + bytes(20))
    (tmp_path / "none.mha").write_bytes(b"ObjectType = Image\n")
    got = {(r.path.rsplit("/")[-1], r.frame_id): r for r in files.read_sequences(spark, str(tmp_path)).collect()}
    assert set(got) == {(f, i) for f in ("whole.mha", "short.mha") for i in (0, 1)}
    a, b = got["whole.mha", 0], got["whole.mha", 1]
    assert (a.Timestamp, a.ProbeToTrackerDeviceTransform[3], bytes(a.image), b.ProbeToTrackerDeviceTransform, b.ImageStatus) == (0.024, 5.0, bytes(range(12)), None, False)
    assert got["short.mha", 1].image is None and got["short.mha", 0].image_bytes == 20
    (tmp_path / "none.mha").write_bytes(head.replace("DimSize", "ElementType = MET_SHORT\r\nDimSize").encode() + bytes(48))
    (tmp_path / "short.mha").write_bytes(head.replace("DimSize", "CompressedData = True\r\nDimSize").encode() + bytes(24))
    faults = {(r.path.rsplit("/")[-1], r.fault, r.image is None) for r in files.read_sequence_images(spark, str(tmp_path)).collect()}
    assert faults == {("whole.mha", None, False), ("none.mha", "element type MET_SHORT", True), ("short.mha", "compressed", True)}
    kinds = [r.k for r in spark.createDataFrame([(x,) for x in ("True", "3 4", "1.5 2", "MET", "")], "v string").select(files.header_value(F.col("v")).kind.alias("k")).collect()]
    assert kinds == ["boolean", "integer", "number", "text", "text"]


def test_frames_written_and_read(spark, tmp_path):
    m = [1.0, 0, 0, 5.5, 0, 1, 0, 6, 0, 0, 1, 7, 0, 0, 0, 1]
    frames = spark.createDataFrame([(7, 3, 2, 2, list(map(float, m)), "OK", 1.25, b"abcd"), (7, 4, 2, 2, None, None, None, None)], "sequence_id int, frame_id int, width int, height int, probe_t array<double>, status string, ts double, image binary")
    files.write_frames(frames, str(tmp_path))
    got = {r.path.rsplit("/")[-1]: r for r in files.read_sequences(spark, str(tmp_path)).collect()}
    r = got["seq_7_frame_0003.mha"]
    assert (r.frame_id, r.Timestamp, r.ProbeToTrackerDeviceTransform, bytes(r.image)) == (0, 1.25, m, b"abcd")
    assert got["seq_7_frame_0004.mha"].image is None


def test_tracker_logs(spark, tmp_path):
    body = ",".join(f"B_N_PRB_{p}" for p in ("q1", "q2", "q3", "q4", "t1", "t2", "t3"))
    (tmp_path / "one.csv").write_text(f"utc_epoch_ms,{body},A_q1\n5,1,0,0,0,1,2,3,9\n")
    (tmp_path / "two.csv").write_text(f"utc_epoch_ms,{body},A_q1\n5,1,0,0,0,1,2,NaN,9\n6,1,0,0,0,1,2,3,9\n")
    t = files.read_tracker_logs(spark, str(tmp_path))
    assert {(r.body, r.seen) for r in t.collect()} == {("B_N_PRB", True), ("B_N_PRB", False)}
    assert [r.readings for r in files.one_reading(t).collect()] == [2]


def test_tracker_logs_of_other_headers(spark, tmp_path):
    """Each file by its own header: other order, further bodies, quotes and a byte-order mark."""
    parts = ("q1", "q2", "q3", "q4", "t1", "t2", "t3")
    (tmp_path / "one.csv").write_text("\ufeffutc_epoch_ms," + ",".join(f"A_{p}" for p in parts) + "\n5,1,0,0,0,1,2,3\n")
    (tmp_path / "two.csv").write_text(",".join(f'"A_{p}"' for p in parts[::-1]) + ',"utc_epoch_ms",' + ",".join(f"B_{p}" for p in parts) + "\r\n13,12,11,0,0,0,1,6,1,0,0,0,7,8,9\r\n")
    got = {(r.path.rsplit("/")[-1], r.body): (r.utc_epoch_ms, r.q, r.t) for r in files.read_tracker_logs(spark, str(tmp_path)).collect()}
    unit = [1.0, 0.0, 0.0, 0.0]
    assert got == {("one.csv", "A"): (5, unit, [1.0, 2.0, 3.0]), ("two.csv", "A"): (6, unit, [11.0, 12.0, 13.0]), ("two.csv", "B"): (6, unit, [7.0, 8.0, 9.0])}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.read_tracker_logs(spark, str(tmp_path / "bad"))


def test_calibrations(spark, tmp_path):
    eye = "1 0 0 0 0 1 0 0 0 0 1 0 0 0 0 1"
    (tmp_path / "c.xml").write_text(
        f'<Set><Transform From="X" To="Y" Matrix="{eye}"/><CoordinateDefinitions><Transform From="Image" To="Probe" Matrix="{eye}" Error="0.5" Date="d"/>'
        '<Transform From="A" To="B" Matrix="1 2 3" Error="" /></CoordinateDefinitions></Set>'
    )
    got = {r.name: r for r in files.read_calibrations(spark, str(tmp_path)).collect()}
    assert set(got) == {"ImageToProbe", "AToB"} and got["ImageToProbe"].error == 0.5 and got["AToB"].matrix is None and got["AToB"].error is None


def test_meshes(spark, tmp_path):
    facets = [(0, 0, 0, 1, 0, 0, 0, 1, 0), (1, 0, 0, 0, 1, 0, 0, 0, 1)]
    content = bytes(80) + struct.pack("<I", 3) + b"".join(struct.pack("<12fH", 0, 0, 0, *f, 0) for f in facets)
    (tmp_path / "m.stl").write_bytes(content)
    (tmp_path / "empty.stl").write_bytes(b"")
    mesh = files.read_meshes(spark, str(tmp_path))
    assert mesh.count() == 2
    vertices, faces = files.indexed_mesh(mesh)
    assert vertices.count() == 4
    assert sorted((r.v1, r.v2, r.v3) for r in faces.collect()) == [(1, 2, 3), (2, 3, 4)]


def test_snapshots(spark, tmp_path):
    for f in ("01_Femur/a.mha", "01_Femur/b.mha", "01_Femur/x.csv", "02_other/q.mha", "02_other/q.csv"):
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_text("x")
    got = sorted((r.folder, r.bone, r.place, r.csv is None) for r in files.snapshot_pairs(spark, str(tmp_path)).collect())
    assert got == [("01_Femur", "F", 1, False), ("01_Femur", "F", 2, True), ("02_other", "U", 1, False)]


def test_runs_append(spark, tmp_path):
    run = spark.createDataFrame([("c1", 7, 0.5)], "combination_id string, seed int, cost double")
    other = spark.createDataFrame([("c1", 8, 0.7)], "combination_id string, seed int, cost double")
    for part in (run, other, run):
        files.append_run(part, str(tmp_path / "runs"))
    assert sorted(r.cost for r in spark.read.parquet(str(tmp_path / "runs")).collect()) == [0.5, 0.7]


def test_evolution_finds_the_minimum(spark):
    runs = spark.createDataFrame([("a", 1), ("b", 2)], "run string, seed int")
    at = lambda i: F.get("x", F.lit(i))
    objective = lambda c: c.select("run", "candidate", (F.pow(at(0) - 1, 2) + 4 * F.pow(at(1) + 2, 2)).alias("cost"))
    got = evolve(runs, objective, [-5.0, -5.0], [5.0, 5.0], population=8, generations=22).collect()
    assert len(got) == 2
    for r in got:
        assert r.best_cost < 0.02 and abs(r.best[0] - 1) < 0.2
    # one parent of three candidates, and an objective that fails
    bad = evolve(runs, lambda c: c.select("run", "candidate", F.lit(float("nan")).alias("cost")), [0.0], [1.0], population=3, generations=2).first()
    assert bad.best_cost == 1e6


def test_streams(spark, tmp_path):
    base = 1_860_000_000_000
    data = [(i, 1, base + i * 500, float(i)) for i in range(20)] + [(3, 1, base + 1500, 3.0), (50, 1, base + 60_000, float("nan")), (51, 1, base + 600_000, 1.0)]
    for k, part in enumerate((data[:12], data[12:])):
        spark.createDataFrame(part, "reading_id bigint, session_id bigint, utc_epoch_ms bigint, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    for name, make in (("motion", lambda s: streams.windowed_motion(s, "v")), ("stretches", streams.stretches)):
        stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sum(r.readings for r in spark.table("motion").collect()) == 21
    assert sorted(r.readings for r in spark.table("stretches").collect()) == [1, 20]


@pytest.mark.parametrize("content", [b"", b"\x00" * 10])
def test_headerless(content):
    assert files.split_sequence(content)[1] == b""
