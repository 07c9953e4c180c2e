"""Plain byte files in the shared folder, by whatever scheme its address has."""

from __future__ import annotations

import re


def opened(uri: str):
    """(file system, path) for an address such as file:/x, /x, hdfs://..., s3://..."""
    from pyarrow import fs

    if uri.startswith("file:") or uri.startswith("/"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    store, path = opened(uri)
    store.create_dir(path, recursive=True)


def write_bytes(uri: str, parts) -> int:
    """Write byte strings in a row; returns the file's length."""
    store, path = opened(uri)
    n = 0
    with store.open_output_stream(path) as f:
        for p in parts:
            f.write(p)
            n += len(p)
    return n


def read_bytes(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    store, path = opened(uri)
    with store.open_input_file(path) as f:
        if offset:
            f.seek(offset)
        return f.read(length) if length is not None else f.read()
