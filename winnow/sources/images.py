"""Directories of photographs: listing, decoding, capture data."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import ship

JPEG = r"\.jpe?g$"


def scan(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, name, modified, bytes) of JPEG files, suffix in any case, in order of path.  Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    found = files.where(F.lower("path").rlike(JPEG)).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    return found.orderBy("path")


def scan_strict(spark: SparkSession, root: str) -> DataFrame:
    """The files directly in root; an error if there are none."""
    found = scan(spark, root, recursive=False)
    if found.isEmpty():
        raise FileNotFoundError(f"no JPEG files in {root}")
    return found


def decode(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, image): BGR pixels, decoded on the JVM; paths are those of scan()."""
    files = spark.read.format("image").option("recursiveFileLookup", str(recursive).lower()).option("dropInvalid", "false").load(root)
    path = F.regexp_replace("image.origin", "^([a-z0-9]+):///", "$1:/")  # as other sources write it
    return files.select(path.alias("path"), "image").where(F.lower("path").rlike(JPEG))


def gigabytes(files: DataFrame) -> DataFrame:
    return files.agg((F.coalesce(F.sum("bytes"), F.lit(0)) / float(1 << 30)).alias("gigabytes"))


# Tag numbers of the Exif standard.
TAGS = {0x829A: "exposure", 0x829D: "aperture", 0x8827: "iso", 0x9003: "taken", 0x920A: "focal", 0x9291: "subsec", 0xA434: "lens"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def exif_fields(data: bytes) -> dict:
    """The TAGS found in a JPEG's Exif segment; empty if there is none or it is broken."""
    try:
        at = 2
        while data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
            size = struct.unpack_from(">H", data, at + 2)[0]
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return _directories(data[at + 10 : at + 2 + size])
            at += 2 + size
    except (IndexError, struct.error):
        pass
    return {}


def _directories(tiff: bytes) -> dict:
    order = "<" if tiff[:2] == b"II" else ">"
    todo, seen, out = [struct.unpack_from(order + "I", tiff, 4)[0]], set(), {}
    while todo:
        at = todo.pop()
        if at in seen:
            continue
        seen.add(at)
        for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
            tag, kind, n = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * k)
            place = at + 10 + 12 * k
            if SIZES.get(kind, 1) * n > 4:
                place = struct.unpack_from(order + "I", tiff, place)[0]
            if tag == 0x8769:
                todo.append(struct.unpack_from(order + "I", tiff, place)[0])
            elif tag in TAGS:
                if kind == 2:
                    out[TAGS[tag]] = tiff[place : place + n].split(b"\0")[0].decode("latin-1").strip()
                elif kind in (5, 10):
                    out[TAGS[tag]] = struct.unpack_from(order + ("II" if kind == 5 else "ii"), tiff, place)
                else:
                    out[TAGS[tag]] = struct.unpack_from(order + ("I" if kind == 4 else "H"), tiff, place)[0]
    return out


def exif(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, taken, subsec, aperture, exposure_n, exposure_d, iso, lens, focal_length_mm) of each JPEG; nulls where unknown."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).where(F.lower("path").rlike(JPEG)).select("path", "content")

    def ratio(x) -> float | None:
        return x[0] / x[1] if isinstance(x, tuple) and x[1] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [exif_fields(x.as_py()) for x in batch.column(1)]
            exposure = [r.get("exposure") if isinstance(r.get("exposure"), tuple) else (None, None) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r.get(k) if isinstance(r.get(k), str) else None for r in rows], pa.string()) for k in ("taken", "subsec")],
                 pa.array([ratio(r.get("aperture")) for r in rows], pa.float64()), pa.array([e[0] for e in exposure], pa.int64()), pa.array([e[1] for e in exposure], pa.int64()),
                 pa.array([r.get("iso") if isinstance(r.get("iso"), int) else None for r in rows], pa.int64()), pa.array([r.get("lens") for r in rows], pa.string()), pa.array([ratio(r.get("focal")) for r in rows], pa.float64())],
                names=["path", "taken", "subsec", "aperture", "exposure_n", "exposure_d", "iso", "lens", "focal_length_mm"],
            )

    found = files.mapInArrow(run, "path string, taken string, subsec string, aperture double, exposure_n bigint, exposure_d bigint, iso bigint, lens string, focal_length_mm double")
    return found.withColumn("taken", F.try_to_timestamp("taken", F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz"))


def capture_time(taken: Column, modified: Column) -> Column:
    return F.coalesce(taken.cast("timestamp"), modified)
