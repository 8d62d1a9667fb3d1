"""Time and position from the EXIF block of image files: bytes to raw tags in one Arrow pass, meaning as Columns.

Files without a block, and blocks that are cut off or point outside themselves, give nulls and never an error.
A coordinate with a zero denominator counts as missing.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonest.functions.expressions import dms_to_degrees, exif_timestamp

# Fixed values of the format: tags, and struct codes of the field types.
DATE_TIME, ORIGINAL, DIGITIZED, EXIF_IFD, GPS_IFD = 0x0132, 0x9003, 0x9004, 0x8769, 0x8825
CODES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
RAW = "path string, taken array<string>, lat array<double>, lat_ref string, lon array<double>, lon_ref string"


def exif_block(data: bytes) -> bytes | None:
    """The TIFF structure inside a JPEG, PNG or WEBP file, or the file itself if it is a TIFF."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    found = None
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                found = data[at + 10 : at + 2 + size]
                break
            at += 2 + max(2, size)
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        found = _chunk(data, 8, b"eXIf", "big", 4)
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        found = _chunk(data, 12, b"EXIF", "little", 0)
    if found is not None and found.startswith(b"Exif\0\0"):
        found = found[6:]
    return found


def _chunk(data: bytes, at: int, want: bytes, order: str, trailer: int) -> bytes | None:
    """The body of the first chunk of a kind: PNG has size, kind, body, checksum; RIFF has kind, size, padded body."""
    while at + 8 <= len(data):
        size_at, kind_at = (at, at + 4) if order == "big" else (at + 4, at)
        size = int.from_bytes(data[size_at : size_at + 4], order)
        if data[kind_at : kind_at + 4] == want:
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (trailer or size % 2)
    return None


def directory(block: bytes, at: int, order: str) -> dict[int, object]:
    """Tags of the directory at an offset: text as str, numbers and ratios as lists of floats."""
    tags: dict[int, object] = {}
    if at < 8 or at + 2 > len(block):
        return tags
    (n,) = struct.unpack_from(order + "H", block, at)
    for entry in range(at + 2, min(at + 2 + 12 * n, len(block) - 11), 12):
        tag, kind, count = struct.unpack_from(order + "HHI", block, entry)
        code = CODES.get(kind)
        if code is None:
            continue
        size = struct.calcsize(order + code) * count
        start = entry + 8 if size <= 4 else struct.unpack_from(order + "I", block, entry + 8)[0]
        body = block[start : start + size]
        if len(body) < size:
            continue
        if code == "s":
            tags[tag] = body.split(b"\0", 1)[0].decode("utf-8", "replace")
            continue
        values = [v for v in struct.iter_unpack(order + code, body)]
        tags[tag] = [float(v[0]) if len(v) == 1 else (v[0] / v[1] if v[1] else None) for v in values]
    return tags


def raw_tags(data: bytes) -> tuple[list[str | None], list, str | None, list, str | None]:
    """Time texts in order of preference, then latitude, its hemisphere, longitude, its hemisphere."""
    block = exif_block(data) or b""
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if order is None or len(block) < 8:
        return [None] * 4, None, None, None, None
    main = directory(block, struct.unpack_from(order + "I", block, 4)[0], order)

    def below(tag: int) -> dict[int, object]:
        pointer = main.get(tag)
        return directory(block, int(pointer[0]), order) if isinstance(pointer, list) and pointer and pointer[0] is not None else {}

    exif, gps = below(EXIF_IFD), below(GPS_IFD)
    text = lambda x: x if isinstance(x, str) else None
    place = lambda x: x if isinstance(x, list) and None not in x else None
    taken = [text(exif.get(ORIGINAL)), text(main.get(ORIGINAL)), text(exif.get(DIGITIZED)), text(main.get(DATE_TIME))]
    return taken, place(gps.get(2)), text(gps.get(1)), place(gps.get(4)), text(gps.get(3))


def read_exif(files: DataFrame) -> DataFrame:
    """``files(path, content)`` to ``(path, ts, lat, lon)``; lat and lon are both known or both null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, numbers = pa.list_(pa.string()), pa.list_(pa.float64())
        for batch in batches:
            rows = [raw_tags(c.as_py() or b"") for c in batch.column("content")]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((texts, numbers, pa.string(), numbers, pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *columns], names=["path", "taken", "lat", "lat_ref", "lon", "lon_ref"])

    raw = files.select("path", "content").mapInArrow(run, RAW)
    lat, lon = dms_to_degrees(F.col("lat"), F.col("lat_ref")), dms_to_degrees(F.col("lon"), F.col("lon_ref"))
    both = lat.isNotNull() & lon.isNotNull()
    ts = exif_timestamp([F.get("taken", F.lit(i)) for i in range(4)])
    return raw.select("path", ts.alias("ts"), F.when(both, lat).alias("lat"), F.when(both, lon).alias("lon"))
