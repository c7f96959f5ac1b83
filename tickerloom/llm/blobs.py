"""Arrays as files in the shared folder, memory-mapped by workers.

Files are written under a temporary name and then renamed, so a repeated or speculative task
leaves one whole file. A folder on a mounted file system is mapped in place; from any other
store a worker fetches a file once, maps it and unlinks its copy, which is its own alone.
"""

from __future__ import annotations

import os
import tempfile
from urllib.parse import urlparse
from uuid import uuid4

import numpy as np


def _local(folder: str) -> str | None:
    parts = urlparse(folder)
    return parts.path if parts.scheme in ("", "file") else None


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    local = _local(folder)
    if local is not None:
        os.makedirs(local, exist_ok=True)
        part = f"{local}/.{name}-{uuid4().hex}"
        with open(part, "wb") as file:
            np.save(file, values)
        os.replace(part, f"{local}/{name}.npy")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    part = f"{path}/.{name}-{uuid4().hex}"
    with store.open_output_stream(part) as file:
        np.save(file, values)
    store.move(part, f"{path}/{name}.npy")


def map_array(folder: str, name: str) -> np.ndarray:
    local = _local(folder)
    if local is not None:
        return np.load(f"{local}/{name}.npy", mmap_mode="r")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    with tempfile.NamedTemporaryFile(suffix=".npy") as copy:
        with store.open_input_stream(f"{path}/{name}.npy") as file:
            while block := file.read(1 << 24):
                copy.write(block)
        copy.flush()
        return np.load(copy.name, mmap_mode="r")  # the mapping outlives the name
