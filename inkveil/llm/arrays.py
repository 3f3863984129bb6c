"""Arrays in the shared folder that workers memory-map, and their packing for a shuffle."""

from __future__ import annotations

import io
import os
import urllib.parse
import uuid

import numpy as np

#: Bytes of arrays that a worker keeps where they cannot be memory-mapped.
HELD = 256 << 20
_open: dict[tuple[str, str], np.ndarray] = {}


def _local(uri: str) -> str | None:
    parts = urllib.parse.urlsplit(uri)
    return parts.path if parts.scheme in ("", "file") else None


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Writes an array aside and moves it to its final name: a task that is killed leaves no torn file, one that runs twice the same file."""
    path, part = _local(folder), f".{name}-{uuid.uuid4().hex}.npy"
    if path is not None:
        os.makedirs(path, exist_ok=True)
        np.save(f"{path}/{part}", array)
        os.replace(f"{path}/{part}", f"{path}/{name}.npy")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    data = io.BytesIO()
    np.save(data, array)
    with store.open_output_stream(f"{path}/{part}") as out:
        out.write(data.getbuffer())
    if store.get_file_info(f"{path}/{name}.npy").type == fs.FileType.File:
        store.delete_file(f"{path}/{name}.npy")
    store.move(f"{path}/{part}", f"{path}/{name}.npy")


def load(folder: str, name: str) -> np.ndarray:
    """Memory-maps an array, once for each worker process. From a store without files (no mount) it is read into memory, HELD bytes at most at a time."""
    key = folder, name
    if key not in _open:
        path = _local(folder)
        if path is not None:
            if len(_open) > 20_000:
                _open.clear()
            _open[key] = np.load(f"{path}/{name}.npy", mmap_mode="r")
        else:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(folder)
            with store.open_input_stream(f"{path}/{name}.npy") as source:
                array = np.load(io.BytesIO(source.read()))
            if sum(a.nbytes for a in _open.values()) + array.nbytes > HELD:
                _open.clear()
            _open[key] = array
    return _open[key]


def smallest(numbers: np.ndarray) -> np.ndarray:
    """The numbers (none negative) in the smallest unsigned type that holds them."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))


def packed(numbers: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, byte by byte of their places: the high bytes are zeros that compress away."""
    return np.diff(numbers.astype(np.uint64), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    return counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their counts."""
    if len(keys) == 0:
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(counts, starts)
