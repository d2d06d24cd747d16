"""A data source that writes a file for each row, under the row's own name."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .store import located


@dataclass
class Written(WriterCommitMessage):
    """Names of files, by the place they wait in."""

    files: dict[str, str]


class NamedFilesWriter(DataSourceWriter):
    """Tasks write under names of their own into a folder beside; the driver gives the files their names when all are there.

    So a file is seen whole or not at all, a task that is tried twice leaves one, and a
    job that fails leaves none.
    """

    def __init__(self, path: str):
        self.path, self.waiting = path, f"_waiting-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        store, root = located(self.path)
        store.create_dir(f"{root}/{self.waiting}", recursive=True)
        done = {}
        for row in rows:
            if not row["name"] or "/" in row["name"]:
                raise ValueError(f"no name for a file: {row['name']!r}")
            place = f"{root}/{self.waiting}/{uuid.uuid4().hex}"
            with store.open_output_stream(place) as out:
                out.write((row["value"] or "").encode())
            done[place] = row["name"]
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = located(self.path)
        store.create_dir(root, recursive=True)
        for message in messages:
            for place, name in (message.files if message else {}).items():
                store.move(place, f"{root}/{name}")
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*located(self.path))

    def _clear(self, store, root: str) -> None:  # noqa: ANN001
        from pyarrow import fs

        if store.get_file_info(f"{root}/{self.waiting}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.waiting}")


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"])
