"""Files by path or URI from Python workers, where the JVM's file systems aren't at hand."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyarrow import fs

#: Names that the JVM's connectors give what Arrow knows by another.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}
_KNOWN = {"", "file", "s3", "gs", "hdfs", *_SCHEMES}


def locate(place: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    scheme = urlsplit(place).scheme
    if "://" not in place and not place.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(place)
    if scheme == "file":
        return fs.LocalFileSystem(), urlsplit(place).path
    return fs.FileSystem.from_uri(_SCHEMES.get(scheme, scheme) + place[len(scheme) :])


def is_folder(place: str) -> bool:
    """Whether this is the path or URI of a folder, in a file system that Arrow knows."""
    if urlsplit(place).scheme not in _KNOWN:
        return False
    own, path = locate(place)
    return own.get_file_info(path).type == fs.FileType.Directory


def entries(place: str) -> Iterator[tuple[str, bool]]:
    """What a folder holds, as it comes: (name, whether it is a folder). Names that start with ``.`` or ``_`` are hidden."""
    own, path = locate(place)
    if own.type_name == "local":
        with os.scandir(path) as found:
            for e in found:
                if e.name[0] not in "._" and ((deep := e.is_dir()) or e.is_file()):
                    yield e.name, deep
        return
    for i in own.get_file_info(fs.FileSelector(path)):
        if i.base_name[0] not in "._":
            yield i.base_name, i.type == fs.FileType.Directory


def walk(place: str) -> Iterator[str]:
    """The files of a folder and of those in it, by path or URI as ``place`` is."""
    for name, deep in entries(place):
        own = f"{place.rstrip('/')}/{name}"
        if deep:
            yield from walk(own)
        else:
            yield own


def make_folder(place: str) -> None:
    own, path = locate(place)
    own.create_dir(path, recursive=True)


def write_whole(own: fs.FileSystem, path: str, data: bytes) -> None:
    """All of the file or nothing: a task that runs again, or twice at once, leaves it whole."""
    folder, _, name = path.rpartition("/")
    if own.type_name not in ("local", "hdfs"):  # object stores show a file once it is closed
        with own.open_output_stream(path) as out:
            out.write(data)
        return
    own.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with own.open_output_stream(part) as out:
        out.write(data)
    own.move(part, path)


def read_whole(place: str) -> bytes:
    own, path = locate(place)
    with own.open_input_stream(path) as f:
        return f.read()


def files_below(place: str, ending: str) -> list[str]:
    """The file itself, or the files of the folder whose names end so in any case, sorted; given as ``place`` is, by path or URI."""
    own, path = locate(place)
    if own.get_file_info(path).type == fs.FileType.File:
        return [place]
    found = [i.base_name for i in own.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.File and i.base_name.lower().endswith(ending)]
    return [f"{place.rstrip('/')}/{n}" for n in sorted(found)]
