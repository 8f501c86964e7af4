"""Plain arrays in the shared folder: written whole by tasks, memory-mapped by workers.

A ``file:`` folder (one that all executors share) is mapped, and files appear there at once
and whole. In other stores, which only pyarrow's filesystems reach, arrays are read into
memory; whether a file that is being written can be seen in part is the store's matter
(object stores show whole files only). In both a task that runs again writes the same bytes.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse
from urllib.request import url2pathname

import numpy as np


def _local(folder: str) -> str | None:
    parts = urlparse(folder)
    return url2pathname(parts.path) if parts.scheme in ("", "file") else None


def put(folder: str, name: str, array: np.ndarray) -> None:
    if (local := _local(folder)) is not None:
        os.makedirs(local, exist_ok=True)
        part = f"{local}/.{name}-{uuid.uuid4().hex}"
        array.tofile(part)
        os.replace(part, f"{local}/{name}")
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path)
    with system.open_output_stream(f"{path}/{name}") as out:
        out.write(np.ascontiguousarray(array).tobytes())


def get(folder: str, name: str, kind: type) -> np.ndarray:
    if (local := _local(folder)) is not None:
        path = f"{local}/{name}"
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read(), kind)


def put_all(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Several arrays as one file: their number, kinds and lengths, then each from a multiple of 8 bytes on."""
    head = [len(arrays)]
    for x in arrays:
        head += [int.from_bytes(x.dtype.str[1:].encode(), "little"), len(x)]
    parts = [np.array(head, np.uint64).view(np.uint8)]
    for x in arrays:
        parts += [np.ascontiguousarray(x).view(np.uint8), np.zeros(-x.nbytes % 8, np.uint8)]
    put(folder, name, np.concatenate(parts))


def get_all(folder: str, name: str) -> list[np.ndarray]:
    data = get(folder, name, np.uint8)
    count = int(data[:8].view(np.uint64)[0])
    head = data[8 : 8 + 16 * count].view(np.uint64).tolist()
    at, out = 8 + 16 * count, []
    for code, length in zip(head[::2], head[1::2], strict=True):
        kind = np.dtype(code.to_bytes(8, "little").rstrip(b"\0").decode())
        out.append(data[at : at + length * kind.itemsize].view(kind))
        at += -(-length * kind.itemsize // 8) * 8
    return out
