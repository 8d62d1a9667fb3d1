"""Small files made from the test tables: EXIF blocks in their containers, bitmaps, and form bodies."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from photonest.sources.exif import DATE_TIME, DIGITIZED, EXIF_IFD, GPS_IFD, ORIGINAL

Ratios = list[tuple[int, int]]


def exif_tiff(order: str, taken: str | None, digitized: str | None, main: str | None, gps: tuple[Ratios, str | None, Ratios, str | None] | None) -> bytes:
    """A TIFF structure with three directories: the main one, that of the camera, that of the place."""

    def directory(at: int, entries: list[tuple[int, int, int, bytes]]) -> bytes:
        body, spill = struct.pack(order + "H", len(entries)), b""
        free = at + 6 + 12 * len(entries)
        for tag, kind, count, data in sorted(entries):
            if len(data) <= 4:
                value = data.ljust(4, b"\0")
            else:
                value, spill = struct.pack(order + "I", free + len(spill)), spill + data
            body += struct.pack(order + "HHI", tag, kind, count) + value
        return body + bytes(4) + spill

    def text(tag: int, value: str | None) -> list:
        return [(tag, 2, len(value) + 1, value.encode() + b"\0")] if value else []

    def ratios(tag: int, values: Ratios) -> tuple:
        return tag, 5, len(values), b"".join(struct.pack(order + "II", *v) for v in values)

    camera = text(ORIGINAL, taken) + text(DIGITIZED, digitized)
    place = [ratios(2, gps[0]), *text(1, gps[1]), ratios(4, gps[2]), *text(3, gps[3])] if gps else []
    head = text(DATE_TIME, main)
    pointers = lambda a, b: [(EXIF_IFD, 4, 1, struct.pack(order + "I", a)), (GPS_IFD, 4, 1, struct.pack(order + "I", b))]
    camera_at = 8 + len(directory(8, head + pointers(0, 0)))
    place_at = camera_at + len(directory(camera_at, camera))
    start = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    return start + directory(8, head + pointers(camera_at, place_at)) + directory(camera_at, camera) + directory(place_at, place)


def in_jpeg(block: bytes) -> bytes:
    return b"\xff\xd8\xff\xe0\0\4ab\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xda\0\2\xff\xd9"


def _png_chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def in_png(block: bytes) -> bytes:
    return b"\x89PNG\r\n\x1a\n" + _png_chunk(b"IHDR", bytes(13)) + _png_chunk(b"eXIf", block)


def in_webp(block: bytes) -> bytes:
    return b"RIFF" + bytes(4) + b"WEBP" + b"VP8 " + struct.pack("<I", 3) + bytes(4) + b"EXIF" + struct.pack("<I", len(block)) + block


CONTAINERS = (in_jpeg, in_png, in_webp, lambda block: block)


def bmp_file(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    body = b"".join(row[:, ::-1].tobytes() + bytes(-3 * w % 4) for row in rgb[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def png_file(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    rows = b"".join(b"\0" + row.tobytes() for row in rgb)
    return b"\x89PNG\r\n\x1a\n" + _png_chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + _png_chunk(b"IDAT", zlib.compress(rows)) + _png_chunk(b"IEND", b"")
