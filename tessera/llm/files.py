"""Byte files in a folder that all executors reach, through Arrow's file systems."""

from __future__ import annotations

import posixpath
import re

from pyarrow import fs


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file:, hdfs:, s3:, gs:) and the path in it. Hadoop's names for S3 (s3a:, s3n:) are S3."""
    path = re.sub(r"^s3[an]://", "s3://", path)
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


class NewFile:
    """A file that appears under its name only once it is whole: it is written under
    a name of this attempt and then moved, so a retried or a speculative task
    replaces the file with the same bytes; a killed one leaves a .draft that nothing reads."""

    def __init__(self, path: str, attempt: str):
        self.name = path
        self.fs, self.path = file_system(path)
        self.draft = f"{self.path}.{attempt}.draft"
        self.fs.create_dir(posixpath.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.draft)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.draft, self.path)


def open_at(path: str):
    """A random-access file."""
    where, inner = file_system(path)
    return where.open_input_file(inner)
