"""Byte files in the shared folder, opened on the executors through pyarrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs as arrow_fs


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return arrow_fs.FileSystem.from_uri(path)


def new_output(folder: str, name: str) -> tuple[str, object]:
    """(path, stream) of a file whose name no other attempt uses: a repeated task leaves the first one alone,
    and readers go by the manifest of the attempt that counted."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    where, plain = opened(path)
    where.create_dir(plain.rsplit("/", 1)[0], recursive=True)
    return path, where.open_output_stream(plain)


def read_range(path: str):
    where, plain = opened(path)
    return where.open_input_file(plain)
