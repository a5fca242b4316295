"""Files of a model in the shared folder: written once by a task, memory-mapped by workers."""

from __future__ import annotations

import mmap
import os
import tempfile
from urllib.parse import urlparse

import numpy as np


def _local(uri: str) -> str | None:
    """The path behind a file: URI or a plain path; None for a store that only has an API."""
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def put(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Write named arrays as one file. A file appears whole or not at all, so a task that is
    run again, or twice at once, does no harm: its bytes are the same."""
    names = list(arrays)
    head = ";".join(f"{n}:{arrays[n].dtype.str}:{len(arrays[n])}" for n in names).encode()
    body = b"".join([len(head).to_bytes(8, "little"), head.ljust(-(-(len(head) + 8) // 64) * 64 - 8)])
    parts = [body]
    for n in names:
        raw = arrays[n].tobytes()
        parts.append(raw + bytes(-len(raw) % 64))
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(at), recursive=True)
        with store.open_output_stream(at) as f:
            f.writelines(parts)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    fd, part = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".part-")
    with os.fdopen(fd, "wb") as f:
        f.writelines(parts)
    os.replace(part, path)


def load(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped. From a store without local paths the file is copied
    to the worker's temporary folder first and unlinked at once: the mapping alone keeps it."""
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(uri)
        with tempfile.TemporaryFile() as f, store.open_input_stream(at) as source:
            while part := source.read(1 << 24):
                f.write(part)
            f.flush()
            mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with open(path, "rb") as f:
            mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    size = int.from_bytes(mapped[:8], "little")
    at, out = -(-(size + 8) // 64) * 64, {}
    for item in mapped[8 : 8 + size].decode().strip().split(";"):
        name, kind, count = item.rsplit(":", 2)
        kind, count = np.dtype(kind), int(count)
        out[name] = np.frombuffer(mapped, kind, count, at)
        at += -(-(count * kind.itemsize) // 64) * 64
    return out
