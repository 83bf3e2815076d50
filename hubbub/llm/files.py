"""Whole files and ranges in the shared folder, through pyarrow's file systems (file, hdfs, s3, ...)."""

from __future__ import annotations

import uuid


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:"))


def write_file(path: str, data: bytes) -> None:
    """Written under another name and moved, so that a lost task leaves no half file behind."""
    system, name = filesystem(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, name)


def read_file(path: str) -> bytes:
    system, name = filesystem(path)
    with system.open_input_file(name) as data:
        return data.read()


def list_files(folder: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files under a folder, in the order of their names."""
    from pyarrow import fs

    system, name = filesystem(folder)
    scheme = folder.split("://", 1)[0]
    host = folder[: len(folder) - len(name)] if folder.endswith(name) else f"{scheme}://"
    found = system.get_file_info(fs.FileSelector(name, recursive=False, allow_not_found=True))
    return sorted((host + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix))
