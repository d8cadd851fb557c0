"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitscope.session import ensure_checkpoint_dir

# A word is a run of characters other than the blank and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, also where it is not on their path.

    A cluster normally gets it through ``--py-files`` or ``PYTHONPATH``; otherwise the
    sources go to the executors once per application with ``addPyFile``.
    """
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = Path(tempfile.mkdtemp()) / "splitscope.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "splitscope").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the session's shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back (cuts the lineage)."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that driver and executors share."""
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, write) -> None:
    """Write one file whole: to a name of this attempt first, then renamed.

    A lost or repeated task leaves at most an unnamed leftover, never half a file.
    """
    system, path = open_fs(uri)
    trial = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(trial) as out:
        write(out)
    system.move(trial, path)


class Kept(dict):
    """A dictionary of bounded size for a worker: at ``most`` entries they become the older
    half, which is dropped at the next turn unless asked for again."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def __missing__(self, key):
        self[key] = value = self.older[key]  # KeyError where neither half has it
        return value

    def turn(self) -> None:
        """Call between uses, never while entries must stay."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(*cols: Column) -> Column:
    """A number in [0, 1) from the hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(2**53))


def crc_mod(key: Column, modulus: int) -> Column:
    """CRC-32 of the key written as text, modulo ``modulus`` (null key: null)."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


@functools.cache
def _trim():
    """malloc_trim of the C library, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda keep: 0


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, also in other jobs,
    and would keep the most that any of them took."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batches, rows: int = 1024):
    """The arrays or record batches cut into shorter ones, so that what a task makes of one stays small."""
    for b in batches:
        for lo in range(0, max(len(b), 1), rows):
            yield b.slice(lo, rows)
        give_back()
    give_back()


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column in a row, and the offsets of its texts (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return text_bytes_of(column.fill_null("").cast(pa.large_string()))


def text_bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same of a large string or large binary array without nulls."""
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=column.offset + n + 1)[column.offset :]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


@functools.lru_cache(maxsize=None)
def powers(n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, 2**n_bits of them."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        a = np.full(1 << n_bits, b, dtype=np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a, dtype=np.uint64))
    return out[0], out[1]


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs [start, end) of ``data``, all at once.

    Polynomial hash by prefix sums modulo 2**64, then mixed; equal runs get equal
    hashes wherever they stand.
    """
    n = max(12, int(len(data)).bit_length())
    up, down = powers(n)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    own = sums[1:]
    own[:] = data
    own += np.uint64(1)
    own *= up[: len(data)]
    np.cumsum(own, out=own)
    h = sums[end]
    h -= sums[start]
    h *= down[start]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def windows(offsets: np.ndarray, size: int = 1 << 21, rows: int = 1 << 30):
    """Runs [lo, hi) of whole texts: at most ``rows`` of them, and about ``size`` bytes unless one text is longer."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, lo + rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1))
        yield lo, hi
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased and all others as they are."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << np.uint8(5))


def byte_runs(inside: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes that stay within one text: begins, ends and the text of each.

    ``own`` holds the offsets of the texts within the bytes.
    """
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[own] = True
    ahead = np.zeros(len(inside) + 2, dtype=bool)
    ahead[1:-1] = inside
    start = np.flatnonzero(inside & (~ahead[:-2] | edge[:-1]))
    end = np.flatnonzero(inside & (~ahead[2:] | edge[1:])) + 1
    return start, end, np.searchsorted(own, start, side="right") - 1


def run_strings(data: np.ndarray, inside: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.DictionaryArray:
    """All runs of ``byte_runs`` as strings, dictionary-encoded (compared as strings, not by hash)."""
    offsets = np.zeros(len(start) + 1, dtype=np.int32)
    np.cumsum(end - start, out=offsets[1:])
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[inside])).dictionary_encode()


def range_numbers(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of ranges of the given sizes, one range after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def discard(uri: str) -> None:
    """Delete a folder of intermediate files that this job wrote and has done with."""
    system, path = open_fs(uri)
    if system.get_file_info(path).type == pafs.FileType.Directory:
        system.delete_dir(path)
