"""Opening files of any store that pyarrow knows, by URI or local path."""

from __future__ import annotations


def filesystem(uri: str):
    """The file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def read_at(uri: str, at: int, size: int) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        f.seek(at)
        return f.read(size)


def listed(uri: str, ends: tuple[str, ...]) -> list[tuple[str, int]]:
    """Files under a folder, or the file itself, with their sizes, by name."""
    from pyarrow import fs as pafs

    fs, path = filesystem(uri)
    info = fs.get_file_info(path)
    scheme = uri.split("://")[0] + "://" if "://" in uri else ""
    if info.type == pafs.FileType.File:
        return [(uri, info.size)]
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
    return sorted((scheme + f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(ends))
