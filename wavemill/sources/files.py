"""Files by path or URI, local or of any store that Arrow's filesystems reach; the driver and every executor open them the same way."""

from __future__ import annotations

import os
import re

from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]+:", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file://").removeprefix("file:"))


def open_input(path: str):
    """A file with seek, read and size."""
    disk, at = place(path)
    return disk.open_input_file(at)


def open_output(path: str):
    disk, at = place(path)
    disk.create_dir(os.path.dirname(at), recursive=True)
    return disk.open_output_stream(at, compression=None)


def move(a: str, b: str) -> None:
    disk, at = place(a)
    disk.move(at, place(b)[1])


def remove(path: str) -> None:
    disk, at = place(path)
    if disk.get_file_info(at).type == fs.FileType.File:
        disk.delete_file(at)


def listing(path: str, ending: str = "") -> list[str]:
    """The file itself, or the files with an ending in a folder, in order."""
    disk, at = place(path)
    if disk.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    names = sorted(f.base_name for f in disk.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.base_name.endswith(ending))
    return [f"{path.rstrip('/')}/{n}" for n in names if not n.startswith((".", "_"))]
