"""Binary files in the folder that driver and executors share."""

from __future__ import annotations

import io
import json
import mmap
import os
import tempfile
from uuid import uuid4

import numpy as np
from pyarrow import fs


def open_store(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a path or URI (file, hdfs, s3, ...)."""
    return fs.FileSystem.from_uri(folder)


def write_file(folder: str, stem: str, content: bytes) -> str:
    """A new file under a name of its own, so a repeated task attempt never overwrites one that is in use."""
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    name = f"{stem}-{uuid4().hex}"
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(content)
    return name


def pack(arrays: dict[str, np.ndarray], facts: dict) -> bytes:
    """Arrays behind a JSON header, each at a multiple of 8 bytes, so that a reader can map them."""
    body, places = io.BytesIO(), {}
    for name, array in arrays.items():
        body.write(bytes(-body.tell() % 8))
        places[name] = [body.tell(), str(array.dtype), len(array)]
        body.write(np.ascontiguousarray(array).tobytes())
    head = json.dumps({"arrays": places, "facts": facts}).encode()
    head += b" " * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + body.getvalue()


def mapped(folder: str, name: str) -> tuple[dict[str, np.ndarray], dict]:
    """Arrays and facts of a packed file, memory-mapped; a store without local paths is copied to a temporary file first."""
    store, path = open_store(folder)
    if isinstance(store, fs.LocalFileSystem):
        handle = open(f"{path}/{name}", "rb")
    else:
        handle = tempfile.TemporaryFile()
        with store.open_input_stream(f"{path}/{name}") as source:
            while block := source.read(1 << 22):
                handle.write(block)
        handle.flush()
    with handle:
        data = mmap.mmap(handle.fileno(), os.fstat(handle.fileno()).st_size, access=mmap.ACCESS_READ)
    size = int.from_bytes(data[:8], "little")
    head = json.loads(data[8:8 + size])
    return {name: np.frombuffer(data, np.dtype(kind), n, 8 + size + at) for name, (at, kind, n) in head["arrays"].items()}, head["facts"]
