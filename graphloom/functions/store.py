"""Sparse rows and plain arrays in files of the shared folder.

Tasks write one file a part and map the files they need, so that a table is
read by many tasks without being dealt out once for each of them.  Numbers
are kept in the narrowest type that holds them exactly.  Files are written
under a spare name and renamed when whole, so that a task that is run again,
or twice at once, leaves the same file.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.session import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder (a URI) below the shared checkpoint folder."""
    base = shared_folder(spark)
    if "://" not in base:
        base = f"file://{os.path.abspath(base.removeprefix('file:'))}"
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    return folder


def drop_folder(folder: str) -> None:
    """Delete a folder of ``new_folder`` that nothing reads any more."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.delete_dir(path)


def narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest type that holds them exactly."""
    if not len(x):
        return x
    if x.dtype.kind == "f":
        if not np.isfinite(x).all() or abs(x).max() >= 1 << 31 or (x != np.rint(x)).any() or np.signbit(x[x == 0]).any():
            return x
        x = x.astype(np.int64)
    low, high = int(x.min()), int(x.max())
    for kind in (np.uint8, np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


def write_arrays(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """One file: the arrays one after another, each on a multiple of eight bytes."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    head = np.array([len(arrays), *(v for x in arrays for v in (len(x), int.from_bytes(x.dtype.str.encode(), "little")))], "<i8")
    spare = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(spare) as out:
        out.write(head.tobytes())
        for x in arrays:
            out.write(np.ascontiguousarray(x).tobytes())
            out.write(bytes(-x.nbytes % 8))
    fs.move(spare, f"{path}/{name}")


_mapped: dict[str, dict[str, list[np.ndarray] | None]] = {}
_local: dict[str, str] = {}
#: Folders of which a worker keeps maps.
KEPT = 4


def read_arrays(folder: str, name: str) -> list[np.ndarray] | None:
    """Map a file of ``write_arrays``, or nothing if there is none; from a remote
    store it is fetched once."""
    held = _mapped.setdefault(folder, {})
    if name not in held:
        for old in [k for k in _mapped if k != folder][:-KEPT]:
            del _mapped[old]
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        place = f"{path}/{name}"
        if fs.get_file_info(place).type != pyarrow.fs.FileType.File:
            held[name] = None
            return None
        if not isinstance(fs, pyarrow.fs.LocalFileSystem):
            if folder not in _local:
                _local[folder] = tempfile.mkdtemp(prefix="rows-")
                atexit.register(shutil.rmtree, _local[folder], True)
            pyarrow.fs.copy_files(place, f"{_local[folder]}/{name}", source_filesystem=fs)
            place = f"{_local[folder]}/{name}"
        raw = np.memmap(place, np.uint8, "r")
        n = int(raw[:8].view("<i8")[0])
        head, at, out = raw[8 : 8 + 16 * n].view("<i8").reshape(n, 2), 8 + 16 * n, []
        for size, said in head.tolist():
            kind = np.dtype(said.to_bytes(8, "little").rstrip(b"\0").decode())
            out.append(np.asarray(raw[at : at + size * kind.itemsize].view(kind)))
            at += -(-size * kind.itemsize // 8) * 8
        held[name] = out
    return held[name]


#: Entries of a file of rows, about.
FILE_ENTRIES = 250_000


@dataclass(frozen=True)
class Rows:
    """A sparse matrix in files, one for all rows whose id has a remainder by
    ``parts``: ids, starts, columns, weights and sums of the rows.

    ``factor`` scales it; with ``shares`` rows are divided by their sums.
    """

    folder: str
    parts: int
    low: int
    high: int
    factor: float = 1.0
    shares: bool = False

    def scaled(self, factor: float) -> Rows:
        return replace(self, factor=self.factor * factor)

    def of_part(self, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts, columns and weights of the rows of a part, and their factors."""
        held = read_arrays(self.folder, str(part))
        if held is None:
            return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        ids, starts, cols, w, sums = held
        return ids, starts, cols, w, self.factor / np.maximum(sums, 1e-32) if self.shares else np.full(len(ids), self.factor)

    def found(self, keys: np.ndarray) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
        """(a part, places in it, places in ``keys``) of the rows asked for that there are."""
        part = keys % self.parts
        order = np.argsort(part, kind="stable")
        used, first = np.unique(part[order], return_index=True)
        for p, own in zip(used.tolist(), np.split(order, first[1:])):
            held = self.of_part(p)
            if len(held[0]):
                at = np.minimum(np.searchsorted(held[0], keys[own]), len(held[0]) - 1)
                met = held[0][at] == keys[own]
                yield held, at[met], own[met]

    def sizes(self, keys: np.ndarray) -> np.ndarray:
        """How many entries the rows asked for have."""
        out = np.zeros(len(keys), np.int64)
        for (_, starts, *_), at, own in self.found(keys):
            out[own] = starts[at + 1] - starts[at]
        return out

    def take(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, columns, weights) of the rows asked for, in their order."""
        starts = np.concatenate(([0], np.cumsum(self.sizes(keys))))
        cols, weights = np.zeros(starts[-1], np.int64), np.zeros(starts[-1])
        for (_, begin, c, w, factor), at, own in self.found(keys):
            size = begin[at + 1] - begin[at]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            there, here = step + np.repeat(begin[at], size), step + np.repeat(starts[own], size)
            cols[here], weights[here] = c[there], w[there] * np.repeat(factor[at], size)
        return starts, cols, weights


def keep_rows(edges: DataFrame, shares: bool = False, about: int | None = None) -> Rows:
    """Write ``edges(src, dst, w)`` as ``Rows``; repeated entries add up, those
    with a null are left out.  The edges are dealt out once.  ``about`` is
    their number where it is known; it sets the number of files only."""
    spark = edges.sparkSession
    folder = new_folder(spark, "rows")
    count = edges.count() if about is None else about
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // FILE_ENTRIES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        src, dst, w = (np.concatenate([h[k] for h in held]) for k in range(3))
        del held
        part = src % parts
        order = np.lexsort((dst, src, part))
        src, dst, w, part = src[order], dst[order], w[order], part[order]
        cell = np.flatnonzero(np.concatenate(([True], (src[1:] != src[:-1]) | (dst[1:] != dst[:-1]))))
        src, dst, part, w = src[cell], dst[cell], part[cell], np.add.reduceat(w, cell)
        begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        for lo, hi in zip(begin, np.append(begin[1:], len(part))):
            ids, first = np.unique(src[lo:hi], return_index=True)
            arrays = [ids, np.append(first, hi - lo).astype(np.int64), narrow(dst[lo:hi]), narrow(w[lo:hi]), np.add.reduceat(w[lo:hi], first)]
            write_arrays(folder, str(int(part[lo])), arrays)
        yield pa.RecordBatch.from_arrays([pa.array([int(dst.min())]), pa.array([int(dst.max())])], names=["low", "high"])

    plain = edges.where("src is not null and dst is not null and w is not null").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w"))
    span = plain.repartition(parts, F.pmod("src", F.lit(parts))).mapInArrow(write, "low long, high long").agg(F.min("low").alias("low"), F.max("high").alias("high")).first()
    return Rows(folder, parts, span.low or 0, span.high if span.high is not None else -1, 1.0, shares)
