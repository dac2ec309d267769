"""Files in the shared folder, written and read inside tasks."""

from __future__ import annotations

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder or file URI (``file:/x`` and plain paths too)."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def put(uri: str, parts: list[bytes], attempt: str) -> int:
    """Write a file whole: a retried or speculative task leaves the same bytes under
    the same name, and readers never see half a file."""
    store, path = opened(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(f"{path}.{attempt}.tmp") as out:
        for p in parts:
            out.write(p)
    store.move(f"{path}.{attempt}.tmp", path)
    return sum(map(len, parts))


def get(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    store, path = opened(uri)
    with store.open_input_file(path) as src:
        size = src.size()
        src.seek(offset)
        return src.read(size - offset if length is None else length)
