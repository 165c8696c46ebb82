"""Files for Python data sources: a local or mounted path, or a store that Arrow's file systems open (s3, gs, hdfs, ...)."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs

PLAIN = "file:"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if path.startswith(PLAIN):
        path = "/" + path[len(PLAIN) :].lstrip("/")
    return (pafs.LocalFileSystem(), path) if "://" not in path else pafs.FileSystem.from_uri(path)


def readable(path: str) -> bool:
    """Whether Arrow has a file system for the path."""
    try:
        opened(path)
    except Exception:  # a scheme that it does not know, or a store without its library
        return False
    return True


def names(folder: str, end: str) -> list[tuple[str, int]]:
    """(name, size) of the files directly in a folder with this end, by name; hidden ones too."""
    fs, path = opened(folder)
    if fs.get_file_info(path).type != pafs.FileType.Directory:
        raise ValueError(f"not a folder: {folder}")
    found = fs.get_file_info(pafs.FileSelector(path))
    return sorted((f.base_name, f.size) for f in found if f.type == pafs.FileType.File and f.base_name.endswith(end))


def read(folder: str, name: str) -> bytes:
    fs, path = opened(folder)
    with fs.open_input_stream(f"{path.rstrip('/')}/{name}") as stream:
        return stream.read()


def unique(stem: str) -> str:
    """A name that no other attempt of a task takes."""
    return f"{stem}-{uuid.uuid4().hex}"
