"""Sorted hash arrays: tables of 63-bit keys and numeric columns as files in the shared folder, which workers map into memory.

Keys are hashes, so their upper bits deal rows evenly over shards of bounded size; a file holds a shard's keys in ascending order and then each column. Whatever
a table's size, a worker maps the files that it asks for and the system keeps the pages that are in use; where the shared folder is no mounted file system, a
file is read whole instead. Files are written under another name and renamed when whole, so a task that is run again (or twice at once) leaves one good file. An empty table has no files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map
from tidemark.session import shared_dir

#: Rows of a shard, about.
SHARD_ROWS = 1_000_000
BITS = 63
_ODD, _MASK = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << BITS) - 1)

#: Arrays that this process has open, by file. Those of another folder go when a new one is used.
_OPEN: dict[str, tuple[np.ndarray, ...]] = {}


def spread(x: np.ndarray) -> np.ndarray:
    """Keys of numbers below 2**63: each its own (an odd factor can be undone), dealt evenly."""
    return ((x.astype(np.uint64) * _ODD) & _MASK).astype(np.int64)


def stretches(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each stretch of equal neighbours."""
    cuts = np.flatnonzero(x[1:] != x[:-1]) + 1
    if len(x):
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(x)], strict=True)


def save(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """A file with the arrays, all of one length, after each other."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    aside = f"{path}/_{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
    if isinstance(system, fs.LocalFileSystem) or system.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
        system.move(aside, f"{path}/{name}")
    else:  # another attempt has written the same
        system.delete_file(aside)


def opened(folder: str, name: str, types: list[str], n: int) -> tuple[np.ndarray, ...]:
    full = f"{folder}/{name}"
    if full not in _OPEN:
        for other in [k for k in _OPEN if not k.startswith(folder.rpartition("/")[0])]:
            del _OPEN[other]
        system, path = fs.FileSystem.from_uri(full)
        if isinstance(system, fs.LocalFileSystem):
            raw = np.memmap(path, dtype=np.uint8, mode="r")
        else:
            with system.open_input_file(path) as f:
                raw = np.frombuffer(f.read(), dtype=np.uint8)
        at, out = 0, []
        for t in types:
            size = np.dtype(t).itemsize * n
            out.append(raw[at : at + size].view(t))
            at += size
        _OPEN[full] = tuple(out)
    return _OPEN[full]


class HashArrays:
    """A written table: its folder, columns and their types, and how many rows each shard has."""

    def __init__(self, folder: str, columns: dict[str, str], counts: np.ndarray) -> None:
        self.folder, self.columns, self.counts = folder, columns, counts
        self.firsts = np.cumsum(counts) - counts
        self.shift = BITS - (len(counts) - 1).bit_length()

    def __len__(self) -> int:
        return int(self.counts.sum())

    def shard(self, k: int) -> tuple[np.ndarray, ...]:
        return opened(self.folder, f"{k:06d}", ["<i8", *self.columns.values()], int(self.counts[k]))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Of keys in ascending order: each one's row number (-1: absent) and columns (0 where absent). Files are read in ascending order."""
        row = np.full(len(keys), -1, dtype=np.int64)
        values = {c: np.zeros(len(keys), dtype=t) for c, t in self.columns.items()}
        shards = keys >> self.shift
        for a, b in stretches(shards):
            k = int(shards[a])
            if not self.counts[k]:
                continue
            stored, *rest = self.shard(k)
            at = np.searchsorted(stored, keys[a:b])
            at[at == len(stored)] = 0
            hit = np.flatnonzero(stored[at] == keys[a:b])
            row[a + hit] = self.firsts[k] + at[hit]
            for c, column in zip(self.columns, rest, strict=True):
                values[c][a + hit] = column[at[hit]]
        return row, values


def written(df: DataFrame, name: str, columns: dict[str, str], n: int) -> HashArrays:
    """df (key, unique and below 2**63, and columns), of n rows, as sorted hash arrays. One number for each shard comes to the driver."""
    bits = max(0, (-(-n // SHARD_ROWS) - 1).bit_length())
    folder = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        now, done = None, []

        def close() -> None:
            if now is not None:
                arrays = [np.concatenate(x) for x in zip(*held, strict=True)]
                save(folder, f"{now:06d}", arrays)
                done.append((now, len(arrays[0])))

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            parts = [batch.column("key").to_numpy(), *(batch.column(c).to_numpy(zero_copy_only=False).astype(t) for c, t in columns.items())]
            for a, b in stretches(shard):
                if shard[a] != now:
                    close()
                    now, held = int(shard[a]), []
                held.append([p[a:b] for p in parts])
        close()
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.int64()), pa.array([m for _, m in done], pa.int64())], ["shard", "n"])

    rows = df.select("key", *columns, F.shiftright("key", BITS - bits).alias("shard") if bits else F.lit(0).cast("long").alias("shard"))
    rows = rows.repartition(1 << bits, "shard").sortWithinPartitions("shard", "key")
    counts = np.zeros(1 << bits, dtype=np.int64)
    for r in arrow_map(rows, run, "shard long, n long").collect():
        counts[r["shard"]] = r["n"]
    return HashArrays(folder, columns, counts)
