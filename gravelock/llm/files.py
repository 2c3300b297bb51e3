"""Files of arrays in the shared folder, which workers map: what is too large to collect or to broadcast."""

from __future__ import annotations

import json
import mmap
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravelock.llm.common import removed, scratch

#: Files that a worker keeps mapped.
MAX_MAPPED = 256


def laid_out(arrays: dict[str, np.ndarray], meta: dict) -> bytes:
    """A header that tells where each array is, and the arrays."""
    at, parts, meta = 0, [], dict(meta)
    for k, a in arrays.items():
        raw = a.tobytes()
        raw += b"\0" * (-len(raw) % 8)
        meta[k] = [at, a.dtype.str, len(a)]
        parts.append(raw)
        at += len(raw)
    head = json.dumps(meta).encode()
    head += b" " * (-(len(head) + 8) % 8)
    return b"".join([len(head).to_bytes(8, "little"), head, *parts])


class Filed:
    """The header and the arrays of a file."""

    def __init__(self, data: mmap.mmap | bytes):
        self.size = int.from_bytes(data[:8], "little")
        self.meta, self.data = json.loads(data[8 : 8 + self.size]), data

    def array(self, k: str) -> np.ndarray:
        at, kind, n = self.meta[k]
        return np.frombuffer(self.data, kind, n, 8 + self.size + at)


def put_file(path: str, data: bytes) -> None:
    fs, to = pa.fs.FileSystem.from_uri(path)
    fs.create_dir(to.rpartition("/")[0], recursive=True)
    part = f"{to}.{uuid.uuid4().hex}"  # a task that runs twice writes the same file twice
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, to)


def drop_file(path: str) -> None:
    fs, at = pa.fs.FileSystem.from_uri(path)
    fs.delete_file(at)


def mapped(path: str) -> Filed:
    """The file, mapped where the shared folder is a mounted one, else read."""
    fs, at = pa.fs.FileSystem.from_uri(path)
    if fs.type_name == "local":
        with open(at, "rb") as file:
            return Filed(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False))
    with fs.open_input_stream(at) as source:
        return Filed(source.read())


class Mapped(OrderedDict):
    """path -> its file; the one used longest ago goes when there are too many."""

    def __missing__(self, path: str) -> Filed:
        if len(self) >= MAX_MAPPED:
            self.popitem(last=False)
        self[path] = mapped(path)
        return self[path]

    def __getitem__(self, path: str) -> Filed:
        found = super().__getitem__(path)
        self.move_to_end(path)
        return found


def file_of(values: np.ndarray, files: int) -> np.ndarray:
    """Unsigned values go to files by ranges."""
    return ((values >> np.uint64(32)) * np.uint64(files) >> np.uint64(32)).astype(np.int64)


class LongSet:
    """The different values of a table's one column (long), sorted in files by ranges; `within` asks for many at once."""

    def __init__(self, table: DataFrame | None = None):
        self.path, self.files, self.n = "", [], 0
        if table is None:
            return
        spark = table.sparkSession
        self.path = path = scratch(spark, "longs")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.files = files = min(1 << 14, parts)
        (column,) = table.columns
        # The file that file_of() gives, as a column.
        of = F.shiftright(F.shiftrightunsigned(column, 32) * F.lit(files), 32)

        def write(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def done(k: int, held: list[np.ndarray]) -> int:
                values = np.unique(np.concatenate(held))
                put_file(f"{path}/{k}", laid_out({"values": values}, {}))
                return len(values)

            held, now, rows = [], None, []
            for b in found:
                values = b.column(0).to_numpy().view(np.uint64)
                own = file_of(values, files)
                for k in np.unique(own).tolist():
                    if held and k != now:
                        rows.append((now, done(now, held)))
                        held = []
                    now = k
                    held.append(values[own == k])
            if held:
                rows.append((now, done(now, held)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())], ["file", "n"])

        sizes = table.distinct().withColumn("_of", of).repartition(files, "_of").sortWithinPartitions("_of").select(column).mapInArrow(write, "file int, n long").collect()  # a row for each file
        self.n = sum(r["n"] for r in sizes)
        self.files = [int(any(r["file"] == k for r in sizes)) for k in range(files)] if len(sizes) < files else [1] * files

    def within(self, values: np.ndarray, maps: Mapped) -> np.ndarray:
        """Which of the (signed) values are in the set."""
        out = np.zeros(len(values), bool)
        if not self.n or not len(values):
            return out
        values = values.view(np.uint64)
        by = np.argsort(values)
        v = values[by]
        cuts = np.searchsorted(file_of(v, len(self.files)), np.arange(len(self.files) + 1))
        for k in np.flatnonzero(np.diff(cuts) * np.array(self.files)).tolist():
            a, z = cuts[k], cuts[k + 1]
            chosen = maps[f"{self.path}/{k}"].array("values")
            out[by[a:z]] = chosen[np.minimum(np.searchsorted(chosen, v[a:z]), len(chosen) - 1)] == v[a:z]
        return out

    def remove(self, table: DataFrame) -> None:
        if self.path:
            removed(table.sparkSession, self.path)
