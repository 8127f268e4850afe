"""Arrays as files of the shared folder, which workers map into memory."""

from __future__ import annotations

import mmap
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np

#: Files mapped by a worker at once.
MOST = 1 << 15


def opened(uri: str, mode: str):
    """A file of the shared folder: a local path for file:, else through Arrow's file systems."""
    if uri.startswith("file:"):
        return open(uri.removeprefix("file://").removeprefix("file:"), mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path) if "w" in mode else store.open_input_stream(path)


class Growing:
    """A file of the shared folder, written piece by piece; it is complete once it has its name, so tasks can be repeated."""

    def __init__(self, uri: str):
        self.uri, self.part = uri, f"{uri}.{uuid.uuid4().hex}"
        if uri.startswith("file:"):
            os.makedirs(os.path.dirname(uri.removeprefix("file://")), exist_ok=True)
        self.file = opened(self.part, "wb")

    def add(self, a: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(a).tobytes())

    def close(self) -> None:
        self.file.close()
        if self.uri.startswith("file:"):
            os.replace(self.part.removeprefix("file://"), self.uri.removeprefix("file://"))
        else:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(self.uri)
            store.move(path + self.part.removeprefix(self.uri), path)


def put(uri: str, arrays: Iterable[np.ndarray]) -> None:
    """Writes arrays one after the other."""
    out = Growing(uri)
    for a in arrays:
        out.add(a)
    out.close()


_MAPPED: dict[str, np.ndarray] = {}


def mapped(uri: str) -> np.ndarray:
    """A file of the shared folder as bytes mapped into memory; one of a remote store is copied to local disk first.

    A mapping keeps no open file, of which a process may have few.
    """
    if uri not in _MAPPED:
        if len(_MAPPED) > MOST:
            _MAPPED.clear()
        path = uri.removeprefix("file://")
        if not uri.startswith("file:"):
            with opened(uri, "rb") as f, tempfile.NamedTemporaryFile(delete=False) as to:
                shutil.copyfileobj(f, to)
            path = to.name
        with open(path, "rb") as f:
            _MAPPED[uri] = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), np.uint8)
        if not uri.startswith("file:"):
            os.unlink(path)  # the mapping keeps it until the worker ends
    return _MAPPED[uri]
