"""Exact substring dedup with a Burrows-Wheeler transform built column by column.

The collection of a batch is built as Bauer, Cox, Rosone and Sciortino describe: each round inserts
one symbol (a few bytes) of every text, from the last to the first, into the transform, and updates the array of
longest common prefixes from range minima. Both live in external files that each round reads and
writes from front to back; in memory are only a position and a text pointer for each text, and one
batch. Since the cost is rounds times size, whole documents are not inserted: the content-keyed
segments of ``_segments`` bring together the stretches that can share a window, one of each digest,
and each batch inserts equal stretches once and leaves out those that no other stretch can meet.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import PICK, Scratch, mix64, text_blocks
from ._segments import TAG, Units, merged, repeated_spans

#: Bytes of the grams that key segments: long enough that hardly any repeats by chance in a large corpus.
GRAM = 48
#: Stands where a text has no preceding symbol; no symbol has this code.
END = 65535


class Columns:
    """Transform and common prefixes of a growing collection, in two files of a folder.

    A symbol is a group of four bytes (two or one where the width is no multiple, or a batch has too
    many different groups), so each text is inserted once for each phase and a column takes as many
    bytes at once.
    """

    def __init__(self, folder: str, data: np.ndarray, at: np.ndarray, width: int):
        self.file = {x: os.open(os.path.join(folder, x), os.O_RDWR | os.O_CREAT) for x in ("bwt", "lcp")}
        self.size = 0
        self.data, self.at, self.width = data, at, width
        self.group, self.codes = self._codes()
        self.cap = width // self.group
        ends = (at[1:, None] - np.arange(self.group)).ravel()
        self.ends, self.lengths = ends, np.maximum(ends - np.repeat(at[:-1], self.group), 0) // self.group

    def __enter__(self) -> Columns:
        return self

    def __exit__(self, *_: object) -> None:
        for x in self.file.values():
            os.close(x)

    def _codes(self) -> tuple[int, np.ndarray]:
        """The code of the group that starts at each byte."""
        d = np.concatenate([self.data, np.zeros(3, np.uint8)]).astype(np.uint32)
        n = len(self.data)
        if self.width % 4 == 0:
            values, codes = np.unique(d[:n] | d[1 : n + 1] << 8 | d[2 : n + 2] << 16 | d[3 : n + 3] << 24, return_inverse=True)
            if len(values) < END:
                return 4, codes.astype(np.uint16)
        if self.width % 2 == 0:
            return 2, (d[:n] | d[1 : n + 1] << 8).astype(np.uint16)
        return 1, d[:n].astype(np.uint16)

    def _read(self, name: str) -> np.ndarray:
        return np.frombuffer(os.pread(self.file[name], 2 * self.size, 0), np.uint16)

    def _write(self, name: str, values: np.ndarray) -> None:
        view, done = memoryview(np.ascontiguousarray(values)).cast("B"), 0
        while done < len(view):
            done += os.pwrite(self.file[name], view[done:], done)

    def build(self) -> None:
        lengths, ends, codes, group = self.lengths, self.ends, self.codes, self.group
        m = len(lengths)

        def before(texts: np.ndarray, inserted: int) -> np.ndarray:
            """The symbol before the suffix of ``inserted`` symbols."""
            out = np.full(len(texts), END, np.uint16)
            more = lengths[texts] > inserted
            out[more] = codes[ends[texts[more]] - group * (inserted + 1)]
            return out

        texts = np.arange(m)
        rank, symbol = np.arange(m), before(texts, 0)
        self._write("bwt", symbol)
        self._write("lcp", np.zeros(m, np.uint16))
        self.size = m
        done = 0
        while True:
            on = symbol != END
            texts, rank, symbol = texts[on], rank[on], symbol[on]
            if not len(texts):
                break
            done += 1
            bwt, lcp = self._read("bwt"), self._read("lcp")
            n = len(bwt)
            order = np.argsort(bwt, kind="stable").astype(np.int32)
            place = np.empty(n, np.int32)
            place[order] = np.arange(n, dtype=np.int32)
            k = place[rank]
            lcp = np.append(lcp, np.uint16(0))
            left, right = self._minima(order, bwt, lcp, k, rank, symbol, n)
            spot = k + m
            go = np.argsort(spot, kind="stable")
            texts, spot, left, right = texts[go], spot[go], left[go], right[go]
            symbol = before(texts, done)
            old = np.ones(n + len(spot), bool)
            old[spot] = False
            grown = np.empty(len(old), np.uint16)
            grown[old], grown[spot] = bwt, symbol
            self._write("bwt", grown)
            common = np.empty(len(old) + 1, np.uint16)
            common[:-1][old] = lcp[:-1]
            common[spot + 1] = right
            common[spot] = left
            self._write("lcp", common[:-1])
            self.size = len(old)
            rank = spot

    def _minima(self, order, bwt, lcp, k, rank, symbol, n):
        """Common prefixes of the new suffixes with their neighbours: one more than the minimum between the rests."""
        has_left = k > 0
        p = order[np.maximum(k - 1, 0)]
        has_left &= bwt[p] == symbol
        has_right = k + 1 < n
        q = order[np.minimum(k + 1, n - 1)]
        has_right &= bwt[q] == symbol
        left, right = np.zeros(len(k), np.uint16), np.zeros(len(k), np.uint16)
        for has, lo, hi, out in ((has_left, p, rank, left), (has_right, rank, q, right)):
            rows = np.flatnonzero(has)
            if len(rows):
                rows = rows[np.argsort(hi[rows], kind="stable")]
                cuts = np.empty(2 * len(rows), np.int64)
                cuts[::2], cuts[1::2] = lo[rows] + 1, hi[rows] + 1
                out[rows] = np.minimum(np.minimum.reduceat(lcp, cuts)[::2] + 1, self.cap)
        return left, right

    def repeated(self) -> list[np.ndarray]:
        """For each text, which of its starts have a suffix sharing ``width`` bytes with another one."""
        bwt, lcp = self._read("bwt"), self._read("lcp")
        m, lengths = len(self.lengths), self.lengths
        high = np.append(lcp >= self.cap, False)
        flag = high[:-1] | high[1:]
        place = np.empty(len(bwt), np.int64)
        place[np.argsort(bwt, kind="stable")] = np.arange(len(bwt)) + m
        out = np.zeros(len(self.data), bool)
        texts, rank = np.arange(m), np.arange(m)
        for size in range(1, int(lengths.max(initial=0)) + 1):
            on = lengths[texts] >= size
            texts, rank = texts[on], place[rank[on]]
            if size >= self.cap:
                out[self.ends[texts[flag[rank]]] - self.group * size] = True
        return [out[x : max(x, y - self.width + 1)] for x, y in zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True)]


def narrowed(key: np.ndarray, data: np.ndarray, at: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Stretches of segments that may hold a repeated window: segment, first window, windows, core.

    Windows are dealt to blocks by their distance from the segment's key gram; all windows of a block
    hold the same core of ``width - block + 1`` bytes around it, so a block whose core no other
    segment has can hold no repeated window.
    """
    block = max(1, min(16, width // 4))
    size = np.diff(at) - width + 1
    prefix = PICK.prefix(PICK.bytes[data])
    grams = PICK.rolling(prefix, gram)
    owner = np.repeat(np.arange(len(size)), np.diff(at))[: len(grams)]
    is_key = np.flatnonzero(grams == key.view(np.uint64)[owner])
    spot = is_key[np.searchsorted(is_key, at[:-1])] - at[:-1]
    low, high = (spot - size + 1) // block, spot // block
    count = high - low + 1
    seg = np.repeat(np.arange(len(size)), count)
    q = np.repeat(high, count) - (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    start = at[seg] + spot[seg] - q * block
    core = PICK.spans(prefix, start, start + width - block + 1) ^ mix64(q.astype(np.uint64))
    first = np.maximum(spot[seg] - q * block - block + 1, 0)
    last = np.minimum(spot[seg] - q * block, size[seg] - 1)
    _, which, times = np.unique(core, return_inverse=True, return_counts=True)
    on = times[which] > 1
    return seg[on], first[on], (last - first + 1)[on], which[on]


def bwt_kernel(width: int, gram: int):
    """Repeated windows of a batch of segments."""

    def kernel(key, n, first, last, data, at):
        lengths, raw = np.diff(at), data.tobytes()
        flags = [np.full(x - width + 1, bool(k > 1)) for x, k in zip(lengths.tolist(), n.tolist(), strict=True)]
        seg, start, size, core = narrowed(key, data, at, width, gram)
        new = np.ones(len(seg), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (start[1:] != start[:-1] + size[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(seg)) - 1
        texts: dict[bytes, int] = {}
        of = np.array([texts.setdefault(raw[x : x + k + width - 1], len(texts)) for x, k in zip((at[seg[head]] + start[head]).tolist(), (start[tail] + size[tail] - start[head]).tolist(), strict=True)], np.int64)
        times = np.bincount(of, minlength=len(texts))
        # a text needs comparing only where another text has one of its cores
        pair = np.unique(core * (len(texts) + 1) + np.repeat(of, tail - head + 1))
        rivals = np.bincount(pair // (len(texts) + 1))
        mixed = np.zeros(len(texts), bool)
        mixed[(pair % (len(texts) + 1))[rivals[pair // (len(texts) + 1)] > 1]] = True
        order = np.flatnonzero(mixed)
        chosen = [t for t, m in zip(texts, mixed.tolist(), strict=True) if m]
        found: dict[int, np.ndarray] = {}
        if chosen:
            sizes = np.array([len(t) for t in chosen])
            with tempfile.TemporaryDirectory() as folder:
                with Columns(folder, np.frombuffer(b"".join(chosen), np.uint8), np.concatenate([[0], np.cumsum(sizes)]), width) as columns:
                    columns.build()
                    found = dict(zip(order.tolist(), columns.repeated(), strict=True))
        for s, x, y, t in zip(seg[head].tolist(), start[head].tolist(), (start[tail] + size[tail]).tolist(), of.tolist(), strict=True):
            if times[t] > 1:
                flags[s][x:y] = True
            elif t in found:
                flags[s][x:y] |= found[t]
        out = []
        for flag in flags:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
            out.append([(a, b - 1 + width, -(2**63)) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
        return out

    return kernel


def remove_repeated_bytes(docs: DataFrame, width: int = 200, scratch: Scratch | None = None, max_group: int = 20_000) -> DataFrame:
    """``docs`` with ``spans`` (the removed stretches, byte offsets) and ``kept`` (the remaining bytes).

    A byte goes if a string of ``width`` bytes that covers it also starts anywhere else, in the same
    document or another one; matches never cross documents and are judged on the input. A null
    text counts as empty. Rows with a null id keep their text and are matched with nothing.
    Rows that repeat an id count as documents of their own. All columns of ``docs`` stay; ones named ``spans``
    or ``kept`` are replaced. An empty table gives an empty result.
    """
    if width > 60_000:
        raise ValueError("width must be at most 60000")
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.drop("spans", "kept")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    units = Units(words=False, width=width, gram=max(1, min(GRAM, width // 2)))
    spans = repeated_spans(source, units, bwt_kernel(width, units.gram), False, scratch, max_group)
    same = (F.col("doc_id").cast("long") == F.col("__doc")) & (F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit((1 << TAG) - 1)) == F.col("__tag"))
    joined = docs.join(spans.withColumnsRenamed({"doc": "__doc", "tag": "__tag"}), same, "left").drop("__doc", "__tag")
    names = [f.name for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in text_blocks(batch, "text"):
                raw, lists = data.tobytes(), part.column("spans")
                rows = lists.fill_null([]) if lists.null_count else lists
                removed, kept = [], []
                for i in range(part.num_rows):
                    base, size = int(at[i]), int(at[i + 1] - at[i])
                    gone = merged(rows, i, size)
                    edges = [0, *(x for s in gone for x in s), size]
                    removed.append([{"o": a, "e": b} for a, b in gone])
                    kept.append(b"".join(raw[base + a : base + b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(removed, pa.list_(pa.struct([("o", pa.int64()), ("e", pa.int64())]))), pa.array(kept, pa.binary())], [*names, "spans", "kept"])

    schema = T.StructType([*docs.schema.fields, T.StructField("spans", T.ArrayType(T.StructType([T.StructField("o", T.LongType()), T.StructField("e", T.LongType())]))), T.StructField("kept", T.BinaryType())])
    return joined.select(*names, "spans").mapInArrow(run, schema)


def removal_digest(docs: DataFrame, width: int = 200, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of :func:`remove_repeated_bytes`."""
    out = remove_repeated_bytes(docs.select("doc_id", "text"), width, scratch)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x.e - x.o)
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
