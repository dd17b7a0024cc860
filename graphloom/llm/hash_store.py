"""Sorted hash arrays in the shared folder, memory-mapped by workers.

Tasks write one file each; readers map the files of the parts they need.
Files are written under a spare name and renamed when whole, so a task
that is run again, or twice at once, leaves the same file.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder (a URI) below the shared checkpoint folder."""
    base = shared_folder(spark)
    if "://" not in base:
        base = f"file://{os.path.abspath(base.removeprefix('file:'))}"
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    return folder


#: Text behind one part: its arrays, and the task that merges them, stay small.
PART_BYTES = 64 << 20


def parts_for(texts: DataFrame, text_col: str, least: int, part_bytes: int = PART_BYTES) -> int:
    """Parts in proportion to the bytes of a text column, ``least`` at least."""
    total = texts.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(least, -(-total // part_bytes))


def by_part(parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(parts, kind="stable")
    used, firsts = np.unique(parts[order], return_index=True)
    for p, idx in zip(used, np.split(order, firsts[1:])):
        yield int(p), idx


class HashArray:
    """48-bit keys in order.

    Many keys are stored as offsets by the upper 16 bits and the sorted lower
    32 bits; few as they are, without offsets, for the offsets would outweigh
    them.
    """

    FEW = 1 << 17

    @staticmethod
    def layout(keys: np.ndarray) -> list[np.ndarray]:
        if len(keys) < HashArray.FEW:
            return [np.zeros(0, "<u8"), keys.astype("<u8")]
        offsets = np.searchsorted(keys >> np.uint64(32), np.arange(65537, dtype=np.uint64)).astype("<u8")
        return [offsets, (keys & np.uint64(0xFFFFFFFF)).astype("<u4")]

    def __init__(self, offsets: np.ndarray, low: np.ndarray) -> None:
        self.offsets, self.low = offsets, low

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 if absent."""
        if not len(self.offsets):
            whole = self.low.view("<u8")
            if not len(whole):
                return np.full(len(keys), -1)
            at = np.minimum(np.searchsorted(whole, keys), len(whole) - 1)
            return np.where(whole[at] == keys, at, -1)
        top = (keys >> np.uint64(32)).astype(np.int64)
        want = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        lo, end = self.offsets[top].astype(np.int64), self.offsets[top + 1].astype(np.int64)
        hi = end.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.low[mid] < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        ok = lo < end
        ok[ok] = self.low[lo[ok]] == want[ok]
        return np.where(ok, lo, -1)


def write_arrays(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """One file: count and byte lengths, then the arrays; renamed when whole,
    so that a task that is run again or twice leaves the same file."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    head = np.array([len(arrays), *(x.nbytes for x in arrays)], "<u8").tobytes()
    spare = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(spare) as out:
        out.write(head)
        for x in arrays:
            out.write(np.ascontiguousarray(x).tobytes())
    fs.move(spare, f"{path}/{name}")


_mapped: dict[tuple[str, str], list[np.ndarray]] = {}
_local: dict[str, str] = {}


def read_arrays(folder: str, name: str, dtypes: list[str]) -> list[np.ndarray]:
    """Memory-map a model file; from a remote store it is fetched once.

    Maps of other folders are given up first: a worker serves one model at a
    time, and mapped pages count as its memory."""
    if (folder, name) not in _mapped:
        for other in [k for k in _mapped if k[0] != folder]:
            del _mapped[other]
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        place = f"{path}/{name}"
        if not isinstance(fs, pyarrow.fs.LocalFileSystem):
            if folder not in _local:
                _local[folder] = tempfile.mkdtemp(prefix="hash-store-")
                atexit.register(shutil.rmtree, _local[folder], True)
            pyarrow.fs.copy_files(place, f"{_local[folder]}/{name}", source_filesystem=fs)
            place = f"{_local[folder]}/{name}"
        raw = np.memmap(place, np.uint8, "r")
        n = int(raw[:8].view("<u8")[0])
        sizes, at, out = raw[8 : 8 + 8 * n].view("<u8").astype(int), 8 + 8 * n, []
        for size, dtype in zip(sizes, dtypes):
            out.append(raw[at : at + size].view(dtype) if at % np.dtype(dtype).itemsize == 0 else np.ndarray(size // np.dtype(dtype).itemsize, dtype, raw, at))
            at += size
        _mapped[folder, name] = out
    return _mapped[folder, name]


def exists(folder: str, name: str) -> bool:
    if (folder, name) in _mapped:
        return True
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    return fs.get_file_info(f"{path}/{name}").type == pyarrow.fs.FileType.File
