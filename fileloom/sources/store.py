"""Files by path: local ones, and those of any store that Arrow reads, where the path is a URI (``s3://...``, ``hdfs://...``)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyarrow import fs


def remote(path: str) -> bool:
    return "://" in path


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def read(path: str) -> bytes:
    if remote(path):
        store, inner = _at(path)
        with store.open_input_stream(inner) as f:
            return f.read()
    with open(path, "rb") as f:
        return f.read()


def write(path: str, data: bytes) -> None:
    """Write beside the target and rename: a file is whole or not there, and a second attempt replaces it by the same."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    if remote(path):
        store, inner = _at(path)
        own = _at(part)[1]
        store.create_dir(os.path.dirname(inner), recursive=True)
        try:
            with store.open_output_stream(own) as f:
                f.write(data)
            store.move(own, inner)
        except OSError:
            if store.get_file_info(own).type != fs.FileType.NotFound:
                store.delete_file(own)
            raise
        return
    folder = os.path.dirname(path)
    if folder:
        os.makedirs(folder, exist_ok=True)
    try:
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
    except OSError:
        if os.path.exists(part):
            os.unlink(part)
        raise


def kind(path: str) -> str | None:
    """``file``, ``dir`` or ``other``; none where there is nothing."""
    if remote(path):
        store, inner = _at(path)
        found = store.get_file_info(inner).type
        return {fs.FileType.File: "file", fs.FileType.Directory: "dir", fs.FileType.NotFound: None}.get(found, "other")
    return "dir" if os.path.isdir(path) else "file" if os.path.isfile(path) else "other" if os.path.exists(path) else None


def size(path: str) -> int:
    if remote(path):
        store, inner = _at(path)
        return store.get_file_info(inner).size or 0
    return os.path.getsize(path)


def delete(path: str) -> None:
    if remote(path):
        store, inner = _at(path)
        if store.get_file_info(inner).type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        store.delete_file(inner)
    else:
        os.unlink(path)


def same(a: str, b: str) -> bool:
    """Whether two paths name one file."""
    return a == b if remote(a) or remote(b) else os.path.realpath(a) == os.path.realpath(b)


def entries(folder: str) -> Iterator[tuple[str, str, str]]:
    """(path, name, kind) of what lies in a folder, hidden names left out. Sizes are asked for by :func:`stat`."""
    if remote(folder):
        store, inner = _at(folder)
        for found in store.get_file_info(fs.FileSelector(inner)):
            if not found.base_name.startswith("."):
                what = {fs.FileType.File: "file", fs.FileType.Directory: "dir"}.get(found.type, "other")
                yield f"{folder.rstrip('/')}/{found.base_name}", found.base_name, what
        return
    with os.scandir(folder) as listed:
        for e in listed:
            if not e.name.startswith("."):
                yield e.path, e.name, "dir" if e.is_dir() else "file" if e.is_file() else "other"


def stat(path: str) -> tuple[int, int]:
    """Size and time of change in milliseconds."""
    if remote(path):
        store, inner = _at(path)
        found = store.get_file_info(inner)
        return found.size or 0, (found.mtime_ns or 0) // 1_000_000
    found = os.stat(path)
    return found.st_size, found.st_mtime_ns // 1_000_000
