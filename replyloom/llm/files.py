"""Binary files of the corpus operators, in the folder that driver and executors share."""

from __future__ import annotations

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a folder URI such as ``file:/x`` or ``hdfs://h/x``."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    system, path = open_folder(uri)
    system.create_dir(path, recursive=True)
