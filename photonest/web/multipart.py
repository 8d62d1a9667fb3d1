"""Uploads of any size: the parts of a multipart body go to files while they are read."""

from __future__ import annotations

import os
import re
from typing import BinaryIO

#: Bytes read at once; a line may be cut at this length.
STEP = 1 << 16


class BadUpload(ValueError):
    """The body is not what its header says, or has too many parts."""


def boundary_of(content_type: str) -> bytes:
    found = re.search(r'boundary="?([^";]+)"?', content_type or "")
    if not content_type.lower().startswith("multipart/form-data") or not found:
        raise BadUpload("not a form with files")
    return b"--" + found[1].encode("latin-1")


class _Body:
    """Lines of the first ``length`` bytes of a stream."""

    def __init__(self, stream: BinaryIO, length: int):
        self.stream, self.left = stream, length

    def line(self) -> bytes:
        found = self.stream.readline(min(STEP, self.left)) if self.left > 0 else b""
        self.left -= len(found)
        return found


def save_form(stream: BinaryIO, length: int, content_type: str, folder: str, max_parts: int = 10_000) -> tuple[dict[str, str], list[str]]:
    """Plain fields, and the names of the files saved in ``folder``.

    Only the last component of a file name counts; a later file replaces an earlier one of that name. Parts with an
    empty file name are read and forgotten.
    """
    mark, body = boundary_of(content_type), _Body(stream, length)
    fields: dict[str, str] = {}
    saved: list[str] = []
    line = body.line()
    if line.rstrip(b"\r\n") not in (mark, mark + b"--"):
        raise BadUpload("the form does not start with its boundary")
    parts = 0
    while line.rstrip(b"\r\n") == mark:
        parts += 1
        if parts > max_parts:
            raise BadUpload("too many parts")
        about = ""
        while (line := body.line()) not in (b"\r\n", b"\n", b""):
            if line.lower().startswith(b"content-disposition:"):
                about = line.decode("utf-8", "replace").strip()
        name = re.search(r'[; ]name="([^"]*)"', about)
        file = re.search(r'filename="([^"]*)"', about)
        base = re.split(r"[\\/]", file[1])[-1] if file else ""
        base = "" if base in (".", "..") or "\0" in base else base
        sink = open(os.path.join(folder, base), "wb") if base else None
        kept, held = bytearray(), b""
        try:
            # The line break before a boundary belongs to the boundary, so one is held back.
            while True:
                line = body.line()
                if not line:
                    raise BadUpload("the form ends early")
                if line.startswith(mark) and line.rstrip(b"\r\n") in (mark, mark + b"--") and (not held or held.endswith(b"\n")):
                    held = held[:-2] if held.endswith(b"\r\n") else held[:-1]
                    break
                if sink:
                    sink.write(held)
                elif not file:
                    kept += held
                    if len(kept) > STEP:
                        raise BadUpload("a field is too long")
                held = line
                if held.endswith(b"\r") and not held.endswith(b"\n") and body.left > 0:
                    held += body.line()
            if sink:
                sink.write(held)
            elif not file:
                kept += held
        finally:
            if sink:
                sink.close()
        if base and base not in saved:
            saved.append(base)
        elif not file and name:
            fields[name[1]] = kept.decode("utf-8", "replace")
    return fields, saved
