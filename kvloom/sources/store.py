"""Ranged reads and whole-file writes in any store, from driver or executor.

Paths are those that Spark gives and takes: ``/x``, ``file:/x``, ``hdfs://..``,
``s3://..`` and so on. Local paths go through the operating system, all others
through Arrow's file systems; a store that Arrow does not know is an error,
never a local folder of that name.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

#: Bytes read at a time where a whole range is passed on.
PIECE = 4 << 20


def local_path(path: str) -> str | None:
    """The path as the operating system takes it; None for a path of another store."""
    if m := re.match(r"([A-Za-z][A-Za-z0-9+.-]+):", path):
        if m[1] != "file":
            return None
        return "/" + path[5:].lstrip("/")
    return path


def required_local(path: str) -> str:
    """local_path, or an error where there is none."""
    if (own := local_path(path)) is None:
        raise ValueError(f"{path} is no folder of the operating system")
    return own


def _arrow(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


class Ranged:
    """A file that is read by ranges, as if it ended at most at the place ``end``; n_read counts bytes."""

    def __init__(self, path: str, end: int | None = None):
        self.path, self.n_read, own = path, 0, local_path(path)
        if own is not None:
            self.f = open(own, "rb")
            self.size = os.fstat(self.f.fileno()).st_size
        else:
            store, name = _arrow(path)
            self.f = store.open_input_file(name)
            self.size = self.f.size()
        self.size = self.size if end is None else min(self.size, end)

    def read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        data = self.f.read(max(0, min(n, self.size - at)))
        self.n_read += len(data)
        return data

    def pieces(self, begin: int = 0, end: int | None = None) -> Iterable[bytes]:
        end = self.size if end is None else min(end, self.size)
        while begin < end:
            data = self.read(begin, min(PIECE, end - begin))
            if not data:
                return
            begin += len(data)
            yield data

    def close(self) -> None:
        self.f.close()

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def read_spans(f: Ranged, spans: list[tuple[int, int]], most: int = PIECE, gap: int = 64 << 10) -> list[bytes]:
    """The bytes of (place, size) spans that ascend by place; neighbours are read as one range of at most ``most`` bytes, or of one span."""
    out: list[bytes] = []
    i = 0
    while i < len(spans):
        begin, end = spans[i][0], sum(spans[i])
        j = i + 1
        while j < len(spans) and spans[j][0] <= end + gap and sum(spans[j]) - begin <= most:
            end, j = max(end, sum(spans[j])), j + 1
        data = f.read(begin, end - begin)
        out += [data[a - begin : a - begin + n] for a, n in spans[i:j]]
        i = j
    return out


class Cursor:
    """Reads a file forward from a place; what is skipped beyond the buffer is not read."""

    def __init__(self, f: Ranged, at: int = 0, piece: int = 1 << 18):
        self.f, self.at, self.piece, self.buffer, self.begin = f, at, piece, b"", at

    def _fill(self, n: int) -> None:
        """n bytes from the place on into the buffer, or as many as there are."""
        if self.at + n > self.begin + len(self.buffer):
            kept = self.buffer[self.at - self.begin :] if self.at < self.begin + len(self.buffer) else b""
            got = self.at + len(kept)
            self.buffer, self.begin = kept + self.f.read(got, max(n - len(kept), self.piece)), self.at

    def peek(self, n: int) -> bytes:
        self._fill(n)
        i = self.at - self.begin
        return self.buffer[i : i + n]

    def read(self, n: int) -> bytes:
        data = self.peek(n)
        self.at += len(data)
        return data

    def skip(self, n: int) -> bool:
        """Whether there were so many bytes."""
        self.at += n
        return self.at <= self.f.size

    def line(self) -> bytes | None:
        """Bytes up to the next CRLF, which is passed; None if there is none."""
        n = 64
        while True:
            data = self.peek(n)
            if (end := data.find(b"\r\n")) >= 0:
                self.at += end + 2
                return data[:end]
            if len(data) < n:
                return None
            n *= 8


def readable(path: str) -> bool:
    """Whether Ranged can read the path's store."""
    return re.match(r"([A-Za-z][A-Za-z0-9+.-]+):", path) is None or path.split(":", 1)[0] in ("file", "hdfs", "s3", "s3a", "s3n", "gs", "gcs", "abfs", "abfss")


def write_new(folder: str, part: str, name, pieces: Iterable[bytes]) -> tuple[int, str]:
    """(size, path) of folder/name(size): written as ``part`` and renamed, so that readers see all of it or nothing, and a task that runs again replaces it."""
    own, size = local_path(folder), 0
    if own is not None:
        os.makedirs(own, exist_ok=True)
        with open(os.path.join(own, part), "wb") as f:
            for p in pieces:
                f.write(p)
                size += len(p)
            f.flush()
            os.fsync(f.fileno())
        path = os.path.join(own, name(size))
        os.replace(os.path.join(own, part), path)
        return size, path
    store, base = _arrow(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{part}") as f:
        for p in pieces:
            f.write(p)
            size += len(p)
    store.move(f"{base}/{part}", f"{base}/{name(size)}")
    return size, f"{folder}/{name(size)}"


def listed(spark, folder: str) -> list[tuple[str, int]]:
    """(path, size) of the files in a folder, by Spark's own file system: hidden and empty files are left out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(s.getPath(), s.getLen()) for s in files.listStatus(path)]
    return sorted((p.toString(), n) for p, n in found if n and not p.getName().startswith(("_", ".")))
