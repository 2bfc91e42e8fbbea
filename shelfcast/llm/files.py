"""Files that tasks write to and read from the shared folder, by its own file system.

A task writes to names of its own; what counts is the written list of files of the tasks that
succeeded, so a task that is repeated or run twice leaves a file behind but no row.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark import TaskContext


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it; a path without a scheme is local."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


def task_file(folder: str, suffix: str) -> str:
    """A new name for a file of this task attempt."""
    task = TaskContext.get()
    return f"{folder.rstrip('/')}/part-{task.partitionId():05d}-{uuid.uuid4().hex}{suffix}"


class Writer:
    """An output stream that creates its folder, counts bytes and closes with its context."""

    def __init__(self, path: str) -> None:
        system, inner = file_system(path)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        self.path, self.size = path, 0
        self.stream = system.open_output_stream(inner, compression=None)

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, *_) -> None:
        self.stream.close()


def read_range(path: str, start: int, size: int) -> bytes:
    system, inner = file_system(path)
    with system.open_input_file(inner) as file:
        file.seek(start)
        return file.read(size)


def chunks(path: str, size: int = 1 << 20) -> Iterator[bytes]:
    system, inner = file_system(path)
    with system.open_input_stream(inner, compression=None) as stream:
        while data := stream.read(size):
            yield data


Batches = Callable[[Iterator], Iterator]
