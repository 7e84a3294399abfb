"""Files by URI from any task, through Arrow's file systems."""

from __future__ import annotations

import fnmatch

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; a bare path is a local one."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def files(uri: str, pattern: str = "*") -> list[str]:
    """Paths of a file, or of the files below a folder whose name fits, sorted; files and folders that begin with . or _ are not listed."""
    system, path = at(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    names = system.get_file_info(fs.FileSelector(path, recursive=True))
    shown = lambda p: not any(x[0] in "._" for x in p[len(path) :].strip("/").split("/"))
    return sorted(f.path for f in names if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and shown(f.path))


def remove(uri: str) -> None:
    system, path = at(uri)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)


def settle(system: fs.FileSystem, files: dict[str, str]) -> None:
    """Moves files to their names, making the folders they need."""
    for folder in sorted({final.rpartition("/")[0] for final in files.values()}):
        system.create_dir(folder, recursive=True)
    for hidden, final in files.items():
        system.move(hidden, final)
