"""Arrays as compressed bytes, and files in the folder that all executors share."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np


def pack(*arrays: np.ndarray | bytes, level: int = 1) -> bytes:
    import zstandard

    raw = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    return zstandard.compress(np.array([len(x) for x in raw], dtype=np.int64).tobytes() + b"".join(raw), level)


def unpack(payload: bytes, *kinds: type) -> list:
    """What was packed: arrays of the given kinds, or bytes."""
    import zstandard

    raw = zstandard.decompress(payload)
    sizes = np.frombuffer(raw, np.int64, len(kinds))
    ends = 8 * len(kinds) + np.cumsum(sizes)
    return [raw[e - s : e] if k is bytes else np.frombuffer(raw[e - s : e], k) for s, e, k in zip(sizes, ends, kinds, strict=True)]


def _local(folder: str) -> str | None:
    where = urlparse(folder)
    return where.path if where.scheme in ("", "file") else None


def write(folder: str, name: str, data: bytes) -> None:
    """One file, whole or not at all; a task that is run again writes the same file again."""
    if (path := _local(folder)) is not None:
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, f"{path}/{name}")
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, f"{path}/{name}")


@functools.cache
def _copies() -> str:
    own = tempfile.mkdtemp(prefix="quern-mapped-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


@functools.lru_cache(maxsize=4096)
def mapped(folder: str, name: str, kind: str, missing: bool = False) -> np.ndarray | None:
    """A file as a memory-mapped array, None where it may be missing and is; from a store without paths it is copied once for the worker."""
    if (path := _local(folder)) is not None:
        at = f"{path}/{name}"
        if missing and not os.path.exists(at):
            return None
    else:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        if missing and system.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
            return None
        at = f"{_copies()}/{folder.rsplit('/', 1)[-1]}-{name}"
        with system.open_input_stream(f"{path}/{name}") as f, open(at, "wb") as out:
            shutil.copyfileobj(f, out)
    return np.memmap(at, dtype=kind, mode="r") if os.path.getsize(at) else np.zeros(0, kind)


def new_folder(shared: str, kind: str) -> str:
    """A name for a folder in the shared one; removed when the driver ends."""
    folder = f"{shared.rstrip('/')}/{kind}-{uuid.uuid4().hex}"

    def remove() -> None:
        if (path := _local(folder)) is not None:
            shutil.rmtree(path, ignore_errors=True)
        else:
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(folder)
            system.delete_dir(path)

    atexit.register(remove)
    return folder
