"""Shared plumbing: a scratch folder all executors see, Arrow text buffers, rolling hashes."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a kernel works on at once; one longer text is taken alone.
BLOCK_BYTES = 1 << 20


class Scratch:
    """Cuts lineage with Parquet tables in the folder named by ``spark.checkpoint.dir``.

    Tables written there outlive lost executors. Where the setting is unset (tests), a local
    folder is used. Whatever is left is deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
            base = tempfile.mkdtemp(prefix="nearfield-")
            atexit.register(shutil.rmtree, base, True)
        self.spark = spark
        self.root = f"{base.rstrip('/')}/nearfield-{uuid.uuid4().hex}"
        atexit.register(self._quietly_delete, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _quietly_delete(self, path: str) -> None:
        try:
            self._delete(path)
        except Exception:  # the JVM may have ended first
            pass


def text_blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with their texts as one byte buffer and ``len + 1`` offsets; null counts as empty."""
    texts = pc.fill_null(batch.column(column), b"" if pa.types.is_binary(batch.schema.field(column).type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi
    pa.default_memory_pool().release_unused()  # or a worker keeps the most that any batch took


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Picker:
    """Cheap hashes of spans modulo 2**64, to choose among spans: some families of different long spans share one."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.base = int(rng.integers(1, 1 << 63)) * 8 + 5
        self.base &= (1 << 64) - 1
        self.bytes = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self._power = self._inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._power) < n:
            size = 1 << (n - 1).bit_length()

            def powers(b: int) -> np.ndarray:
                out = np.full(size, b, np.uint64)
                out[0] = 1
                return np.cumprod(out, dtype=np.uint64)

            self._power, self._inverse = powers(self.base), powers(pow(self.base, -1, 1 << 64))

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        n = len(symbols)
        self._grow(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * self._power[:n], dtype=np.uint64, out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((prefix[end] - prefix[start]) * self._inverse[start])

    def rolling(self, prefix: np.ndarray, width: int) -> np.ndarray:
        n = max(0, len(prefix) - width)
        return mix64((prefix[width:] - prefix[:n]) * self._inverse[:n])


PICK = Picker(11)

#: Modulus of the rollers, a prime, and its bits.
PRIME, BITS = (1 << 61) - 1, 61
_P, _30, _31, _32 = np.uint64(PRIME), np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1), np.uint64((1 << 32) - 1)
#: Values worked on at once, so that what comes between stays in cache.
_STEP = 1 << 14


def _reduced(x: np.ndarray) -> np.ndarray:
    """Values below 2**64 modulo ``PRIME``."""
    x = (x & _P) + (x >> np.uint64(BITS))
    return np.minimum(x, x - _P)  # wraps to a large value where x is below the prime


def multiplied(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Products modulo ``PRIME`` of values below it."""
    out = np.empty(len(a), np.uint64)
    one = np.ndim(b) == 0
    for i in range(0, len(a), _STEP):
        x, y = a[i : i + _STEP], b if one else b[i : i + _STEP]
        xh, xl, yh, yl = x >> np.uint64(31), x & _31, y >> np.uint64(31), y & _31
        middle = xh * yl + xl * yh
        out[i : i + _STEP] = _reduced((xh * yh << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & _30) << np.uint64(31)) + xl * yl)
    return out


class Roller:
    """Hashes of spans of a symbol sequence from one prefix sum: polynomials over the field of ``PRIME`` elements.

    Two different sequences of at most ``n`` symbols share a hash with probability ``n / 2**61`` over the base.
    """

    def __init__(self, seed: int):
        self.base = int(np.random.Generator(np.random.PCG64(seed)).integers(1 << 60, PRIME))
        self._power = self._inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._power) < n:
            size = 1 << (n - 1).bit_length()

            def powers(b: int) -> np.ndarray:
                out = np.ones(1, np.uint64)
                while len(out) < size:
                    out = np.concatenate([out, multiplied(out, np.uint64(pow(b, len(out), PRIME)))])
                return out

            self._power, self._inverse = powers(self.base), powers(pow(self.base, -1, PRIME))

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        """Of symbols that are bytes, or values below 2**64 spread evenly."""
        n = len(symbols)
        self._grow(n + 1)
        out = np.zeros(n + 1, np.uint64)
        small, carry = symbols.dtype == np.uint8, np.uint64(0)
        for i in range(0, n, _STEP):
            power, x = self._power[i : min(i + _STEP, n)], symbols[i : i + _STEP].astype(np.uint64)
            if small:
                x += np.uint64(1)  # no byte counts as nothing
                low, high = x * (power & _32), x * (power >> np.uint64(32))
            else:
                x = multiplied(_reduced(x), power)
                low, high = x & _32, x >> np.uint64(32)
            low, high = _reduced(np.cumsum(low, dtype=np.uint64)), _reduced(np.cumsum(high, dtype=np.uint64))
            high = ((high << np.uint64(32)) & _P) + (high >> np.uint64(29))  # times 2**32
            out[i + 1 : i + 1 + len(x)] = _reduced(low + high + carry)
            carry = out[i + len(x)]
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._shifted(prefix[end], prefix[start], self._inverse[start])

    def rolling(self, prefix: np.ndarray, width: int) -> np.ndarray:
        n = max(0, len(prefix) - width)
        return self._shifted(prefix[width:], prefix[:n], self._inverse[:n])

    @staticmethod
    def _shifted(high: np.ndarray, low: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        return mix64(multiplied(_reduced(high + (_P - low)), inverse))


ONE, TWO = Roller(11), Roller(29)


def digests(raw: bytes, start: list[int], end: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """BLAKE2b of stretches of a buffer, 128 bits as two longs."""
    out = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start, end, strict=True)])
    pairs = np.frombuffer(out, np.int64).reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(data: np.ndarray, at: np.ndarray, separator: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words, and the words' offsets by text (``len(at)`` values).

    ``cut`` marks further bytes (and one past the last) before which a word ends.
    """
    n = len(data)
    inside = np.zeros(n + 1, bool)
    np.logical_not(separator[data], out=inside[:n])
    first = np.zeros(n + 1, bool)
    first[at] = True
    if cut is not None:
        first |= cut
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    starts = np.flatnonzero(begins[:n])
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:-1]
    ends = np.flatnonzero(before & (~inside | first))
    return starts, ends, np.searchsorted(starts, at)


def byte_strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive stretches of a byte buffer as binary values."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, roller: Roller = ONE) -> np.ndarray:
    """Hashes of words; ``data`` are bytes."""
    return roller.spans(roller.prefix(data), starts, ends)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    if len(x) < width:
        return x[:0]
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return x if done == width else np.minimum(x[: len(x) - (width - done)], x[width - done :])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
