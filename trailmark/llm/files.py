"""Files in the shared folder, as tasks read and write them."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str):
    if "://" not in uri and uri.startswith("file:/"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def listing(uri: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(uri, bytes) of the files under a folder, by name; hidden ones are left out."""
    system, path = _at(uri)
    if not (info := system.get_file_info(path)).type == fs.FileType.Directory:
        return [(uri, info.size)] if info.type == fs.FileType.File else []
    found = [(i.path, i.size) for i in system.get_file_info(fs.FileSelector(path, recursive=True)) if i.type == fs.FileType.File and i.base_name.endswith(suffixes) and i.base_name[0] not in "_."]
    head = uri.rstrip("/")
    return [(head + p[len(path.rstrip("/")) :], n) for p, n in sorted(found)]


def opened(uri: str):
    """A seekable input file."""
    system, path = _at(uri)
    return system.open_input_file(path)


def written(uri: str, chunks) -> str:
    """Writes chunks under a name of this attempt's own and returns it: attempts that
    run twice never touch each other's files, and only returned names are read."""
    system, path = _at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    stem, dot, suffix = uri.rpartition(".")
    own = f"{stem}-{uuid.uuid4().hex}{dot}{suffix}"
    with system.open_output_stream(_at(own)[1]) as out:
        for chunk in chunks:
            out.write(chunk)
    return own
