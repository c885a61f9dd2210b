"""Binary files in the shared folder: written by tasks, read by byte ranges or memory-mapped."""

from __future__ import annotations

import json
import os
import tempfile
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs

_ALIGN = 64


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """The file system behind a path or URI of the shared folder."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(path).path
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def create(path: str) -> pa.NativeFile:
    """Opens a new file for writing, with its folder."""
    system, name = resolve(path)
    system.create_dir(os.path.dirname(name), recursive=True)
    return system.open_output_stream(name)


def open_ranges(path: str) -> pa.NativeFile:
    """Opens a file for reading at any place."""
    system, name = resolve(path)
    return system.open_input_file(name)


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays one after another, aligned, behind a JSON header that locates them."""
    at, places = 0, {}
    for name, x in arrays.items():
        places[name] = (x.dtype.str, len(x), at)
        at += -(-x.nbytes // _ALIGN) * _ALIGN
    header = json.dumps(places).encode()
    header += b" " * (-(len(header) + 8) % _ALIGN)
    with create(path) as out:
        out.write(len(header).to_bytes(8, "little") + header)
        for x in arrays.values():
            out.write(memoryview(np.ascontiguousarray(x)).cast("B") if x.nbytes else b"")
            out.write(b"\0" * (-x.nbytes % _ALIGN))


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of ``write_arrays``, memory-mapped.

    A file in a store that cannot be mapped is copied to a local file first, which is unlinked
    at once and so goes with the process.
    """
    system, name = resolve(path)
    if isinstance(system, fs.LocalFileSystem):
        data = np.memmap(name, np.uint8, "r")
    else:
        with tempfile.NamedTemporaryFile() as local, system.open_input_stream(name) as source:
            while part := source.read(1 << 24):
                local.write(part)
            local.flush()
            data = np.memmap(local.name, np.uint8, "r")
    # A plain view of the map: slicing the map itself costs more than most reads.
    data = np.asarray(data)
    start = 8 + int.from_bytes(data[:8].tobytes(), "little")
    places = json.loads(data[8:start].tobytes())
    return {k: data[start + at : start + at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, n, at) in places.items()}
