"""Files written by a user-defined encoder, published all together or not at all.

Every task writes into a staging folder under a name of its own; the driver moves the files of the tasks that Spark
has committed into place once all have ended, and drops the staging folder if one has failed.  Retried and speculative
tasks therefore leave nothing behind.
"""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Turns a row into the bytes that are written for it.
Encoder = Callable[[Row], bytes]

STAGING = "_staging"


@dataclass
class Written(WriterCommitMessage):
    """A file that a task has closed."""

    name: str
    rows: int


def files_at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _encoder(name: str) -> Encoder:
    module, _, function = name.rpartition(".")
    return getattr(importlib.import_module(module), function)


class EncodedWriter(DataSourceWriter):
    def __init__(self, path: str, encoder: str, overwrite: bool, suffix: str):
        self.path, self.encoder, self.overwrite, self.suffix = path.rstrip("/"), encoder, overwrite, suffix
        self.job = uuid.uuid4().hex
        files, folder = files_at(self.path)
        if not overwrite and files.get_file_info(folder).type != fs.FileType.NotFound and self._published(files, folder):
            raise FileExistsError(f"{path} holds files already")

    def _published(self, files: fs.FileSystem, folder: str) -> list[str]:
        return [f.path for f in files.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File]

    def write(self, iterator: Iterator[Row]) -> Written:
        encode = _encoder(self.encoder)
        files, folder = files_at(self.path)
        staging = f"{folder}/{STAGING}/{self.job}"
        files.create_dir(staging, recursive=True)
        name, rows = f"part-{uuid.uuid4().hex}{self.suffix}", 0
        with files.open_output_stream(f"{staging}/{name}") as out:
            for row in iterator:
                out.write(encode(row))
                rows += 1
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = files_at(self.path)
        old = self._published(files, folder) if self.overwrite and files.get_file_info(folder).type == fs.FileType.Directory else []
        files.create_dir(folder, recursive=True)
        for message in messages:
            if message is not None and message.rows:
                files.move(f"{folder}/{STAGING}/{self.job}/{message.name}", f"{folder}/{message.name}")
        for path in old:
            files.delete_file(path)
        self._clean(files, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*files_at(self.path))

    def _clean(self, files: fs.FileSystem, folder: str) -> None:
        """Drop this job's staging folder, and the one above it if no other job uses it."""
        above = f"{folder}/{STAGING}"
        for path, own in ((f"{above}/{self.job}", True), (above, False)):
            if files.get_file_info(path).type == fs.FileType.Directory and (own or not files.get_file_info(fs.FileSelector(path))):
                files.delete_dir(path)


class Encoded(DataSource):
    """Options: path, encoder (dotted name of a function), suffix."""

    @classmethod
    def name(cls) -> str:
        return "rillstone-encoded"

    def writer(self, schema, overwrite: bool) -> EncodedWriter:
        return EncodedWriter(self.options["path"], self.options["encoder"], overwrite, self.options.get("suffix", ""))


def write_encoded(df: DataFrame, path: str, encoder: str, overwrite: bool = True, suffix: str = ".txt") -> None:
    """Write each row as the bytes that the function `encoder` (a dotted name that workers can import) makes of it.

    One file per task with rows.  Earlier files of the folder go when the new ones are in place; without `overwrite` a
    folder that holds files is an error.  If a task fails for good, the folder is as it was before.
    """
    df.sparkSession.dataSource.register(Encoded)
    mode = "overwrite" if overwrite else "append"
    df.write.format(Encoded.name()).mode(mode).options(path=path, encoder=encoder, suffix=suffix).save()


def pairs_line(row: Row) -> bytes:
    """`name=value;name=value` and a line end; backslashes, separators and line ends inside texts are escaped, null is empty."""
    shown = []
    for name, value in row.asDict().items():
        text = "" if value is None else str(value)
        for plain, escaped in (("\\", "\\\\"), (";", "\\;"), ("\n", "\\n"), ("\r", "\\r")):
            text = text.replace(plain, escaped)
        shown.append(f"{name}={text}")
    return (";".join(shown) + "\n").encode()
