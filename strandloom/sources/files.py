"""Opening files by their ending, and expanding paths on the driver."""

from __future__ import annotations

import bz2
import glob
import gzip
import io
import lzma
import os
import sys
from typing import BinaryIO


def open_binary(path: str) -> BinaryIO:
    """A file for reading: ``-`` is standard input; .gz, .bz2 and .xz are decompressed."""
    if path == "-":
        return sys.stdin.buffer
    opener = {".gz": gzip.open, ".bgz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}.get(os.path.splitext(path)[1])
    return opener(path, "rb") if opener else open(path, "rb")  # noqa: SIM115


def open_output(path: str, level: int = 6) -> BinaryIO:
    """A file for writing, compressed by its ending; ``-`` is standard output."""
    if path == "-":
        return sys.stdout.buffer
    ending = os.path.splitext(path)[1]
    if ending == ".gz":
        return gzip.open(path, "wb", compresslevel=level)
    opener = {".bz2": bz2.open, ".xz": lzma.open}.get(ending)
    return opener(path, "wb") if opener else open(path, "wb")  # noqa: SIM115


def lines(path: str) -> io.BufferedReader:
    """The lines of a file, decompressed, as bytes."""
    return io.BufferedReader(open_binary(path), 1 << 20)


def local_path(path: str) -> str:
    """A path without the scheme of the file system that every machine mounts."""
    return path.removeprefix("file:").replace("//", "/") if path.startswith("file:") else path


def expanded(path: str) -> list[str]:
    """The files of a path: itself, a pattern's matches, or a folder's files; comma-separated parts add up."""
    out: list[str] = []
    for part in path.split(","):
        part = local_path(part)
        if part == "-":
            out.append(part)
        elif os.path.isdir(part):
            out += sorted(p for p in glob.glob(f"{part}/*") if os.path.isfile(p) and os.path.basename(p)[0] not in "._")
        else:
            out += sorted(glob.glob(part))
    if not out:
        raise FileNotFoundError(path)
    return out
