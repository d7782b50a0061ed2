"""What the text operators share: word hashes, flat numpy views of a batch, and, from the core, tables written between jobs."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.plans.tables import fits, scratch, tidy, written

__all__ = ["BASE", "as_bytes", "documents", "fits", "fresh", "hashed", "mixed", "remembered", "rolling", "scratch", "slices", "split_words", "tidy", "written"]

T = TypeVar("T")

#: Rows of text handled at a time inside an Arrow batch, and bytes after which a slice ends early.
SLICE_ROWS, SLICE_BYTES = 512, 2_000_000
#: An odd base of polynomial hashes, its inverse modulo 2**64, and the most bytes of a word that is hashed so.
BASE = 0x9E3779B97F4A7C15
BACK, LONG_WORD = pow(BASE, -1, 1 << 64), 32


def split_words(text: bytes | None, lower: bool = False) -> list[bytes]:
    """Runs of bytes other than 0x20 and 0x09-0x0D; null has none."""
    if not text:
        return []
    return (text.lower() if lower else text).split()


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch, of at most SLICE_ROWS rows and, beyond one row, `most` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= SLICE_ROWS or held + n > most):
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield start, batch.num_rows
    hand_back()  # what the batch took, before the next one comes


def hand_back() -> None:
    """Free memory goes back to the system: Arrow's and, where the C library can, malloc's. A worker that waits for its next task holds none."""
    pa.default_memory_pool().release_unused()
    if trim := remembered(("trim",), lambda: getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def remembered(key: tuple, make: Callable[[], T]) -> T:
    """make(), once for each process and key. Kept beside the interpreter's state, so that it never travels with a function."""
    held = sys.__dict__.setdefault("_blockloom", {})
    if key not in held:
        held[key] = make()
    return held[key]


def hash_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z lower-cased, whether a byte parts words, a random number for each byte)."""
    lower, space = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
    lower[65:91] += 32
    space[[9, 10, 11, 12, 13, 32]] = True
    return lower, space, np.random.default_rng(BASE).integers(0, 1 << 64, 256, np.uint64)


def powers(n: int, base: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, n of them or up to twice as many."""

    def make(size: int) -> np.ndarray:
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    size = max(1 << 21, 1 << (n - 1).bit_length())
    return remembered(("powers", base), lambda: make(size)) if size == 1 << 21 else make(size)


def hashed(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words of all texts, end to end; number of words of each text).

    A word's hash is a polynomial in BASE of its bytes' random numbers, taken from running sums over
    the whole buffer, with its length, mixed. Long words, for which two polynomials could be made to meet, are hashed one by one.
    """
    small, parts, number = remembered(("tables",), hash_tables)
    raw = b"\n" + b"\n".join(t or b"" for t in texts) + b"\n"
    flat = np.frombuffer(raw, np.uint8)
    flat = small[flat] if lower else flat
    blank = parts[flat]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    sums = number[flat]
    sums *= powers(len(flat), BASE)[: len(flat)]
    np.cumsum(sums, out=sums)
    size = ends - starts
    h = (sums[ends - 1] - sums[starts - 1]) * powers(len(flat), BACK)[starts]
    h = mixed(h + size.astype(np.uint64))
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(flat[starts[k] : ends[k]].tobytes())
    last = np.cumsum(np.fromiter(map(len, (t or b"" for t in texts)), np.int64, len(texts)) + 1)
    return h, np.diff(np.searchsorted(starts, last), prepend=0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(words: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Rabin-Karp: the polynomial hash modulo 2**64 of each run of `width` words, mixed at the end.

    Words come as random 64-bit hashes and the base is odd, so two different runs meet with
    probability about 2**-64.
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    b, out = np.uint64(base | 1), words[:n].copy()
    for j in range(1, width):
        out *= b
        out += words[j : j + n]
    return mixed(out)


def as_bytes(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string").cast("binary")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
