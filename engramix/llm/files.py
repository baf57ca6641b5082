"""Whole files in the shared folder, written and read by the executors through Arrow's file systems."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterable

import numpy as np
from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_whole(uri: str, write: Callable) -> None:
    """``write(stream)`` into a file that appears under its name only when complete, so that a lost or repeated task leaves none half written."""
    system, path = at(uri)
    spare = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(spare) as stream:
            write(stream)
        system.move(spare, path)
    except BaseException:
        if system.get_file_info(spare).type == fs.FileType.File:
            system.delete_file(spare)
        raise


def make_dir(uri: str) -> None:
    system, path = at(uri)
    system.create_dir(path, recursive=True)


def join_whole(uri: str, parts: Iterable[str | bytes]) -> None:
    """One file of the parts, in their order: bytes, or the names of files, which are deleted."""
    used = []

    def write(stream) -> None:
        for part in parts:
            if isinstance(part, bytes):
                stream.write(part)
                continue
            system, path = at(part)
            used.append((system, path))
            with system.open_input_stream(path) as own:
                shutil.copyfileobj(own, stream, 1 << 20)

    write_whole(uri, write)
    for system, path in used:
        system.delete_file(path)


def whole(uri: str) -> bytes:
    system, path = at(uri)
    with system.open_input_stream(path) as stream:
        return stream.read()


def mapped(uri: str, dtype) -> np.ndarray:
    """A whole file as an array that stays on disk where the shared folder is mounted; from a remote file system it is read into the worker's memory."""
    system, path = at(uri)
    if not isinstance(system, fs.LocalFileSystem):
        return np.frombuffer(whole(uri), dtype=dtype)
    return np.asarray(np.memmap(path, dtype=dtype, mode="r")) if os.path.getsize(path) else np.empty(0, dtype=dtype)
