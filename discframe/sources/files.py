"""File manifests and fixed-record packet files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from discframe.operators import ordered as o

# File suffixes that are playable or disc images.
VIDEO_SUFFIXES = ["m2ts", "vob", "evo", "mkv", "mp4", "avi", "mov", "wmv", "ts"]
IMAGE_SUFFIXES = ["iso", "img"]


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def classify_source(manifest: DataFrame, source: str = "source_id", path: str = "path") -> DataFrame:
    """Type of each source tree from its relative paths; the first rule that fits wins.

    A tree with one entry and an empty path is a single file named by *source*.
    """
    p, s = F.col(path), _suffix(F.col(path))
    single = p == ""
    own = _suffix(F.col(source))
    rules = {
        "dvd": p.startswith("VIDEO_TS/"),
        "bluray": p.startswith("BDMV/") | p.startswith("bdmv/"),
        "hddvd": p.startswith("HVDVD_TS/"),
        "bluray_raw": ~single & (s == "m2ts"),
        "dvd_raw": ~single & (s == "vob"),
        "hddvd_raw": ~single & (s == "evo"),
        "iso_unknown": (~single & ~F.contains(p, F.lit("/")) & s.isin(IMAGE_SUFFIXES)) | (single & own.isin(IMAGE_SUFFIXES)),
        "video_file": single & own.isin(VIDEO_SUFFIXES),
    }
    flags = manifest.groupBy(source).agg(*[F.bool_or(rule).alias(name) for name, rule in rules.items()])
    device = F.col(source).startswith("/dev/") | F.col(source).rlike(r"^[A-Za-z]:[\\/]?$")
    kind = F.coalesce(*[F.when(F.col(name), F.lit(name)) for name in rules], F.when(device, F.lit("device")), F.lit("unknown"))
    return flags.select(source, kind.alias("source_type"))


def group_parts(manifest: DataFrame, set_pattern: str, part_pattern: str, group: str = "group_id", path: str = "path") -> DataFrame:
    """Files of multi-part sets in numeric part order, for sets whose part 1 exists.

    The patterns capture the set and the part number in group 1.
    """
    numbered = manifest.select(
        group,
        path,
        F.regexp_extract(path, set_pattern, 1).try_cast("int").alias("set_no"),
        F.regexp_extract(path, part_pattern, 1).try_cast("int").alias("part_no"),
    ).filter(F.col("set_no").isNotNull() & F.col("part_no").isNotNull())
    first = numbered.filter(F.col("part_no") == 1).select(group, "set_no").distinct()
    kept = numbered.join(first, [group, "set_no"], "left_semi")
    ranked = o.ordered(kept, [group, "set_no"], ["part_no", path], _rn=o.row_number())
    return ranked.withColumn("part_idx", F.col("_rn") - 1).drop("_rn")


def _byte(column: str, index: Column | int) -> Column:
    """Unsigned byte at a 0-based *index* of a binary column."""
    spot = (F.lit(index) if isinstance(index, int) else index) + 1
    return F.conv(F.hex(F.substr(column, spot, F.lit(1))), 16, 10).cast("long")


def read_records(spark: SparkSession, path: str, record_len: int, records_per_task: int = 1 << 16) -> DataFrame:
    """``path, offset, record`` of fixed-length records.

    Files are listed without reading them and cut into record-aligned ranges, so a large
    file is read by many tasks and no task holds more than one range.
    """
    chunk = record_len * records_per_task
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    ranges = listed.filter(F.col("length") >= record_len).select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(chunk).cast("long"))).alias("start")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                system, name = fs.FileSystem.from_uri(row["path"])
                with system.open_input_file(name) as handle:
                    handle.seek(row["start"])
                    data = handle.read(min(chunk, row["length"] - row["start"]))
                count = len(data) // record_len
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(record_len), count, [None, pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["path"]] * count, pa.string()),
                        pa.array([row["start"] + i * record_len for i in range(count)], pa.int64()),
                        fixed.cast(pa.binary()),
                    ],
                    names=["path", "offset", "record"],
                )

    spread = ranges.repartition("path", "start")
    return spread.mapInArrow(read, "path string, offset bigint, record binary")


def read_packets(spark: SparkSession, path: str, record_len: int = 192) -> DataFrame:
    """``path, offset, pid, starts, pts`` of the transport packets in files."""
    return decode_packets(read_records(spark, path, record_len), ["path", "offset"], record_len)


def decode_packets(records: DataFrame, keep: list[str], record_len: int = 192) -> DataFrame:
    """*keep* columns and ``pid, starts, pts`` of packets (192 or 188 bytes) in ``record``.

    ``pts`` is set where a packet starts a PES with a presentation time; all decoding is
    column arithmetic on the record bytes.  Records without the sync byte are left out.
    """
    head = record_len - 188
    rows = records.filter(_byte("record", head) == 0x47)
    b1, b2, b3 = (_byte("record", head + i) for i in (1, 2, 3))
    control = F.shiftright(b3, 4).bitwiseAND(F.lit(3))
    skip = F.when(control.bitwiseAND(F.lit(2)) != 0, 1 + _byte("record", head + 4)).otherwise(0)
    base = rows.select(
        *keep,
        "record",
        (F.shiftleft(b1.bitwiseAND(F.lit(0x1F)), 8) + b2).alias("pid"),
        (b1.bitwiseAND(F.lit(0x40)) != 0).alias("starts"),
        F.when(control.bitwiseAND(F.lit(1)) != 0, head + 4 + skip).alias("at"),
    )
    at = F.col("at").cast("int")
    code = F.hex(F.substr("record", at + 1, F.lit(3))) == "000001"
    stamped = F.col("starts") & (at + 14 <= record_len) & code & (_byte("record", at + 7).bitwiseAND(F.lit(0x80)) != 0)
    t = [_byte("record", at + 9 + i) for i in range(5)]
    pts = (
        F.shiftleft(F.shiftright(t[0], 1).bitwiseAND(F.lit(7)), 30)
        + F.shiftleft(t[1], 22)
        + F.shiftleft(F.shiftright(t[2], 1), 15)
        + F.shiftleft(t[3], 7)
        + F.shiftright(t[4], 1)
    )
    return base.select(*keep, "pid", "starts", F.when(stamped, pts).alias("pts"))
