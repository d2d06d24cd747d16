"""Files read or written in part from a task, wherever they lie."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa

#: Schemes of paths whose files a task can reach by itself; of others whole files come through Spark.
REACHED = ("file", "hdfs", "s3", "s3a", "gs", "abfss")
#: Bytes that are read at once when a file is opened.
FIRST = 4096

Read = Callable[[int, int], bytes]


def located(path: str) -> tuple:
    """The file system of a path or URI, and the place in it."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), f"/{rest.lstrip('/')}"
    return fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}:{rest}")


@contextmanager
def opened(path: str) -> Iterator[Read]:
    """A reader of parts of a file: it gives the bytes of a place and length, less at the end.  Raises OSError for what can't be opened."""
    try:
        store, place = located(path)
        file = store.open_input_file(place)
    except pa.ArrowException as e:
        raise OSError(str(e)) from e
    try:
        start, size = file.read_at(FIRST, 0), file.size()

        def read(at: int, n: int) -> bytes:
            if at + n <= len(start):
                return start[at : at + n]
            return file.read_at(min(n, size - at), at) if at < size else b""

        yield read
    finally:
        file.close()
