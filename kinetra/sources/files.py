"""Recorded files as DataFrames: image sequences, tracker logs, calibrations, triangle meshes; and frames as sequence files again."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetra.operators.common import lookup_join, written
from kinetra.operators.tracks import bodies_of, long_tracks
from kinetra.operators.wide_table import frame_table

_FRAME_KEY = re.compile(r"^Seq_Frame(\d+)_(.+)$", re.I)
_FIELDS = "path string, line_no int, entity string, attribute string, attr_value string"
_IMAGES = "path string, frame_id int, image binary, image_bytes bigint, expected_bytes bigint, fault string"
#: Frames of a file that are handed on together.
FRAMES_AT_ONCE = 64


def _binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")


def split_sequence(content: bytes) -> tuple[list[str], bytes]:
    """Header lines and payload of a sequence file; the header ends with ElementDataFile = LOCAL and one line end. Without it all is header."""
    m = re.search(rb"(?im)^\s*ElementDataFile\s*=\s*LOCAL[ \t]*(\r\n|\n|\r|\Z)", content)
    head, rest = (content[: m.end()], content[m.end() :]) if m else (content, b"")
    return head.decode("utf-8", "replace").splitlines(), rest


def header_value(text: Column) -> Column:
    """A header value by what it looks like: its type is boolean, integer, number (one or more, all numeric) or text."""
    parts = F.split(F.trim(text), r"\s+")
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    numeric = (F.trim(text) != "") & F.forall(numbers, lambda x: x.isNotNull())
    whole = F.forall(numbers, lambda x: F.abs(x - F.round(x)) < 1e-12)
    kind = F.when(F.lower(F.trim(text)).isin("true", "false"), "boolean").when(numeric & whole, "integer").when(numeric, "number").otherwise("text")
    return F.struct(kind.alias("kind"), F.when(numeric, numbers).alias("numbers"), F.lower(F.trim(text)).try_cast("boolean").alias("flag"), text.alias("text"))


def read_sequence_fields(spark: SparkSession, path: str) -> DataFrame:
    """The header entries of all sequence files under a folder as rows: path, line_no, entity (Header or Seq_FrameNNNN), attribute, attr_value."""

    def fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                rows = []
                for n, line in enumerate(split_sequence(bytes(content))[0], 1):
                    if (key := re.match(r"^\s*([^=]+?)\s*=\s*(.*?)\s*$", line)) is None:
                        continue
                    frame = _FRAME_KEY.match(key[1])
                    rows.append((file, n, f"Seq_Frame{frame[1]}" if frame else "Header", frame[2] if frame else key[1], key[2]))
                yield pd.DataFrame(rows, columns=["path", "line_no", "entity", "attribute", "attr_value"])

    return _binary(spark, path, "*.mha").mapInPandas(fields, _FIELDS)


def read_sequence_images(spark: SparkSession, path: str) -> DataFrame:
    """The images of all sequence files: path, frame_id (from 0), image (null where the payload is too short), image_bytes, expected_bytes, fault.

    One row per frame of the third number of DimSize; a payload longer than that leaves image_bytes above expected_bytes.
    Only plain payloads of one byte a pixel (ElementType MET_UCHAR, CompressedData False; both may be absent) are images: others leave
    null images and say so in ``fault``. Files without DimSize of three numbers have no rows. Frames leave a file some at a time;
    the file itself is one value, so it must be below 2 GB.
    """

    def images(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                lines, payload = split_sequence(bytes(content))
                said = {k.strip().lower(): v.strip() for k, _, v in (line.partition("=") for line in lines)}
                size = re.findall(r"\d+", said.get("dimsize", ""))
                if len(size) != 3:
                    continue
                w, h, n = map(int, size)
                kind = said.get("elementtype", "MET_UCHAR")
                fault = f"element type {kind}" if kind.upper() != "MET_UCHAR" else "compressed" if said.get("compresseddata", "").lower() == "true" else None
                for first in range(0, n, FRAMES_AT_ONCE):
                    frames = range(first, min(first + FRAMES_AT_ONCE, n))
                    cut = [payload[k * w * h : (k + 1) * w * h] for k in frames]
                    whole = [c if len(c) == w * h and not fault else None for c in cut]
                    yield pd.DataFrame({"path": file, "frame_id": frames, "image": whole, "image_bytes": len(payload), "expected_bytes": w * h * n, "fault": fault})

    return _binary(spark, path, "*.mha").mapInPandas(images, _IMAGES)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """One row per frame: path, frame_id, the typed attributes, and the image. Entries of frames beyond DimSize are left out."""
    fields = read_sequence_fields(spark, path)
    frames = frame_table(fields.withColumnRenamed("path", "sequence_id")).withColumnRenamed("sequence_id", "path")
    return frames.join(read_sequence_images(spark, path), ["path", "frame_id"], "full")


def write_frames(frames: DataFrame, folder: str) -> None:
    """One sequence file of a single frame, numbered 0000, for each row (sequence_id, frame_id, width, height, probe_t, status, ts, image).

    ``folder`` is a path or URI that all machines share. Tasks write their own rows; the names are those of sequence and frame,
    so a task that runs again writes the same files. A null image leaves the file without; one that isn't of width times height bytes fails.
    """
    uri = folder if "://" in folder else Path(folder).absolute().as_uri()

    def write(rows) -> None:
        files, base = fs.FileSystem.from_uri(uri)
        files.create_dir(base, recursive=True)
        for r in rows:
            numbers = " ".join(f"{x:g}" for x in r.probe_t or [])
            head = f"ObjectType = Image\nNDims = 3\nDimSize = {r.width} {r.height} 1\nElementType = MET_UCHAR\nCompressedData = False\n"
            head += f"Seq_Frame0000_ProbeToTrackerDeviceTransform = {numbers}\nSeq_Frame0000_ProbeToTrackerDeviceTransformStatus = {r.status or ''}\n"
            head += f"Seq_Frame0000_Timestamp = {'' if r.ts is None else repr(r.ts)}\nElementDataFile = LOCAL\n"
            image = bytes(r.image or b"")
            if r.image is not None and len(image) != r.width * r.height:
                raise ValueError(f"image of sequence {r.sequence_id}, frame {r.frame_id}: {len(image)} bytes")
            with files.open_output_stream(f"{base}/seq_{r.sequence_id}_frame_{r.frame_id:04d}.mha") as out:
                out.write(head.encode() + image)

    frames.select("sequence_id", "frame_id", "width", "height", "probe_t", "status", "ts", "image").foreachPartition(write)


def read_tracker_logs(spark: SparkSession, path: str) -> DataFrame:
    """The readings of wide tracker logs (CSV with a header of utc_epoch_ms and <body>_q1 ... t3): path, utc_epoch_ms, body, q, t, seen.

    Every file is read by its own header, whatever the order and number of its columns; a body that a file lacks has no rows from it.
    Files without a header line that names utc_epoch_ms have no rows; without any such file it is an error.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\\ufeff|\\r$", "").alias("line"))
    cells = F.transform(F.split("line", ","), lambda c: F.regexp_replace(F.trim(c), '^"(.*)"$', "$1"))
    heads = written(files.where(F.array_contains(cells, "utc_epoch_ms")).groupBy("path").agg(F.min("line").alias("_head")))
    names = sorted(r[0] for r in heads.select(F.explode(F.transform(F.split("_head", ","), lambda c: F.regexp_replace(F.trim(c), '^"(.*)"$', "$1"))).alias("name")).distinct().collect())
    if "utc_epoch_ms" not in names:
        raise ValueError("no column utc_epoch_ms")
    rows = lookup_join(files, heads, ["path"], F.col("line"), "inner").where("line <> _head and trim(line) <> ''")
    place = {n: F.array_position(F.transform(F.split("_head", ","), lambda c: F.regexp_replace(F.trim(c), '^"(.*)"$', "$1")), n) for n in names}
    cell = lambda n: F.when(place[n] > 0, F.get(cells, (place[n] - 1).cast("int")))
    wide = rows.select("path", "_head", cell("utc_epoch_ms").try_cast("bigint").alias("utc_epoch_ms"), *[cell(n).try_cast("double").alias(n) for n in names if n != "utc_epoch_ms"])
    bodies = bodies_of([n for n in names if n != "utc_epoch_ms"])
    return long_tracks(wide, ["path", "_head", "utc_epoch_ms"], bodies).where(F.col("_head").contains(F.concat("body", F.lit("_q1")))).drop("_head")


def one_reading(tracks: DataFrame) -> DataFrame:
    """Files and their number of readings where that isn't one, as a snapshot has to have."""
    return tracks.groupBy("path").agg(F.countDistinct("utc_epoch_ms").alias("readings")).where("readings <> 1")


def read_calibrations(spark: SparkSession, path: str) -> DataFrame:
    """The transforms under CoordinateDefinitions of calibration files: path, name (FromToTo), matrix (16 numbers or null), error, date."""
    kind = "Transform array<struct<_From:string,_To:string,_Matrix:string,_Error:string,_Date:string>>"
    rows = spark.read.format("xml").option("rowTag", "CoordinateDefinitions").schema(kind).load(path).select(F.input_file_name().alias("path"), F.inline("Transform"))
    cells = F.transform(F.split(F.trim("_Matrix"), r"\s+"), lambda x: x.try_cast("double"))
    matrix = F.when((F.size(cells) == 16) & F.forall(cells, lambda x: x.isNotNull()), cells)
    return rows.select("path", F.concat("_From", F.lit("To"), "_To").alias("name"), matrix.alias("matrix"), F.trim("_Error").try_cast("double").alias("error"), F.col("_Date").alias("date"))


def read_meshes(spark: SparkSession, path: str) -> DataFrame:
    """The facets of binary mesh files (80-byte title, count, 50 bytes a facet): mesh_id (path), face_id from 1, ax ... cz.

    A file shorter than its count says gives the facets that are whole.
    """
    corners = [f"{w}{c}" for w in "abc" for c in "xyz"]

    def facets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                content = bytes(content)
                n = min(struct.unpack_from("<I", content, 80)[0], (len(content) - 84) // 50) if len(content) >= 84 else 0
                raw = np.frombuffer(content, np.uint8, n * 50, 84).reshape(n, 50)
                numbers = raw[:, 12:48].copy().view("<f4").astype(float) if n else np.zeros((0, 9))
                yield pd.DataFrame(numbers, columns=corners).assign(mesh_id=file, face_id=range(1, n + 1))[["mesh_id", "face_id", *corners]]

    return _binary(spark, path, "*.stl").mapInPandas(facets, "mesh_id string, face_id bigint, " + ", ".join(f"{c} double" for c in corners))


def indexed_mesh(facets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (mesh_id, vertex_id, x, y, z), each place once, and faces (mesh_id, face_id, v1, v2, v3) over them.

    Vertex ids follow the first facet and corner that has the place.
    """
    corners = facets.select("mesh_id", "face_id", F.posexplode(F.array(*[F.struct(*[F.col(f"{w}{c}").alias(c) for c in "xyz"]) for w in "abc"])).alias("_i", "_p"))
    places = corners.groupBy("mesh_id", "_p").agg(F.min(F.col("face_id") * 3 + F.col("_i")).alias("_first"))
    vertices = places.withColumn("vertex_id", F.row_number().over(Window.partitionBy("mesh_id").orderBy("_first")))
    named = corners.join(vertices, ["mesh_id", "_p"])
    faces = named.groupBy("mesh_id", "face_id").agg(*[F.max(F.when(F.col("_i") == i, F.col("vertex_id"))).alias(f"v{i + 1}") for i in range(3)])
    return vertices.select("mesh_id", "vertex_id", "_p.*"), faces


def snapshot_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Sequence and tracker files of every folder paired by the order of their names: folder, bone, place, mha, csv.

    The bone is F for femur or T for tibia in the folder's name, else U. A folder with unequal numbers of files leaves nulls.
    """
    listed = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{x}").load(path).select("path", F.lit(x).alias("kind")) for x in ("mha", "csv")]
    files = listed[0].unionByName(listed[1]).withColumn("folder", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    w = Window.partitionBy("folder", "kind").orderBy("path")
    placed = files.withColumn("place", F.row_number().over(w)).groupBy("folder", "place").agg(*[F.max(F.when(F.col("kind") == k, F.col("path"))).alias(k) for k in ("mha", "csv")])
    name = F.lower("folder")
    return placed.select("folder", F.when(name.contains("femur"), "F").when(name.contains("tibia"), "T").otherwise("U").alias("bone"), "place", "mha", "csv")


def append_run(results: DataFrame, folder: str) -> None:
    """Adds results to a table of runs, partitioned by combination_id and seed; other runs stay, a run that is repeated is replaced."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("combination_id", "seed").parquet(folder)
