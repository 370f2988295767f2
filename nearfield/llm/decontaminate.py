"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Blocks of each item's words, lower-cased, become patterns framed by single spaces. A document is
normalised to the same form once, with the offset of every word kept, and scanned once; hits grow to windows and map
back to words and bytes of the original.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import LOWER, Scratch, text_blocks, word_bounds

#: Bytes that separate words: all ASCII but digits and letters.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[:128] = True
SEPARATOR[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
#: Bytes of one automaton (one pass over the documents), and what it takes for a character of its items, as measured.
AUTOMATON_BYTES, BYTES_A_CHARACTER = 128 << 20, 40


def normalised(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and their offsets by text."""
    return word_bounds(data, at, SEPARATOR)


def _flat(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words, lower-cased, each with one space after it, and where each begins; a space precedes all."""
    size = ends - starts + 1
    begin = np.cumsum(size) - size + 1
    out = np.full(int(size.sum()) + 1, 0x20, np.uint8)
    step = np.repeat(starts - begin, size - 1) if len(size) else np.zeros(0, np.int64)
    spot = np.repeat(begin - np.cumsum(size - 1) + (size - 1), size - 1) + np.arange(int((size - 1).sum()))
    out[spot] = LOWER[data[spot + step]]
    return out.tobytes(), begin


def _text(flat: bytes) -> str:
    return flat.decode("latin-1")  # one character a byte: the automaton's offsets are byte offsets


class Items:
    """Benchmark items of one automaton, normalised: words with one space after each, and what the automaton looks for.

    An item's window of ``width`` words holds a whole one of its blocks of ``(width + 1) // 2`` words that do not
    overlap, so blocks are the patterns: as many characters as the items have, where all windows would take
    ``width`` times as many. What is around a block that occurs is compared word by word. An item of
    fewer words is a pattern as a whole.
    """

    def __init__(self, rows: list[tuple[str, str]], width: int):
        self.width, self.block = width, (width + 1) // 2
        self.names, self.flat, self.begin = [], [], []
        owners: dict[str, list[tuple[int, int]]] = {}
        for name, text in rows:
            raw = np.frombuffer(text.encode(), np.uint8)
            starts, ends, _ = normalised(raw, np.array([0, len(raw)]))
            if not len(starts):
                continue
            flat, begin = _flat(raw, starts, ends)
            flat, begin, n = _text(flat), np.append(begin, len(flat)).astype(np.int32), len(starts)
            for p in range(0, n - self.block + 1, self.block) if n >= width else (-1,):
                a, b = (p, p + self.block) if p >= 0 else (0, n)
                owners.setdefault(flat[begin[a] - 1 : begin[b]], []).append((len(self.names), p))
            self.names.append(name)
            self.flat.append(flat)
            self.begin.append(begin)
        self.patterns = "\0".join(owners)  # no pattern holds this mark
        self.first = np.cumsum([0, *map(len, owners.values())])
        self.owners = np.array([o for own in owners.values() for o in own], np.int32).reshape(-1, 2)

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.names:
            return None
        machine = ahocorasick.Automaton()
        for i, p in enumerate(self.patterns.split("\0")):
            machine.add_word(p, (i, p.count(" ") - 1, len(p)))
        machine.make_automaton()
        return machine

    def _same(self, item: int, at: int, flat: str, begin: np.ndarray, word: int, step: int, most: int) -> int:
        """How many words from there on (backwards for a negative ``step``) the item and the text share, at most ``most``."""
        own, text, n = self.begin[item], self.flat[item], 0
        while n < most and 0 <= at < len(own) - 1 and 0 <= word < len(begin) - 1 and text[own[at] : own[at + 1]] == flat[begin[word] : begin[word + 1]]:
            n, at, word = n + 1, at + step, word + step
        return n

    def windows(self, which: int, words: int, flat: str, begin: np.ndarray, word: int) -> Iterator[tuple[str, int, int]]:
        """Items with windows around a pattern found at a word of a text, and the words that those cover."""
        for item, p in self.owners[self.first[which] : self.first[which + 1]].tolist():
            if p < 0:
                yield self.names[item], word, word + words
                continue
            left = self._same(item, p - 1, flat, begin, word - 1, -1, self.block - 1)
            right = self._same(item, p + words, flat, begin, word + words, 1, self.width - words)
            if left + words + right >= self.width:
                yield self.names[item], word - left, word + words + right


_MACHINES: dict[str, ahocorasick.Automaton | None] = {}


def _machine(key: str, items: Items) -> ahocorasick.Automaton | None:
    """One automaton for all tasks of a worker process; the one of an earlier pass is dropped."""
    if key not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[key] = items.automaton()
    return _MACHINES[key]


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` and ``spans``.

    Words are lower-cased (A-Z) stretches of anything but ASCII other than letters and digits. ``items``
    holds the sorted distinct ids (as strings) of items with a window in the document; ``spans`` the
    byte stretches of the original text that hit windows cover. Null texts have no words; items without words or with a null id
    never occur. Repeated items count once. All columns of ``docs`` stay; ones with the four names
    are replaced. Empty tables give empty or clean results.

    An automaton takes at most about ``AUTOMATON_BYTES``; more items take further passes over the documents, each with
    those whose hash falls to it. The automaton is built once a worker process and pass.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_hit", "items", "spans")
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 2)).first()[0] or 0
    passes = max(1, -(-total * BYTES_A_CHARACTER // AUTOMATON_BYTES))
    out = None
    for k in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k).collect()
        found = _scan(docs if out is None else out, rows, width, out is not None, spark)
        out = scratch.save(found, f"pass-{k}") if passes > 1 else found
    return out


def _scan(docs: DataFrame, rows: list, width: int, again: bool, spark) -> DataFrame:
    found_in = Items([(r.item, r.text) for r in rows], width)
    shared, key = spark.sparkContext.broadcast(found_in), uuid.uuid4().hex
    names = [f.name for f in docs.schema if f.name not in ("n_words", "n_hit", "items", "spans")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked = shared.value
        machine = _machine(key, looked)
        for batch in batches:
            for part, data, at in text_blocks(batch, "text"):
                starts, ends, own = normalised(data, at)
                n = part.num_rows
                hit = np.zeros(len(starts) + 1, np.int64)
                items: list[set[str]] = [set() for _ in range(n)]
                for i in range(n) if machine is not None else ():
                    a, b = int(own[i]), int(own[i + 1])
                    if a == b:
                        continue
                    flat, begin = _flat(data, starts[a:b], ends[a:b])
                    flat, begin = _text(flat), np.append(begin, len(flat))
                    for end, (which, words, size) in machine.iter(flat):
                        w = int(np.searchsorted(begin, end - size + 2))
                        for item, x, y in looked.windows(which, words, flat, begin, w):
                            hit[a + x] += 1
                            hit[a + y] -= 1
                            items[i].add(item)
                covered = np.cumsum(hit)[:-1] > 0
                spans = []
                old_items, old_spans = (part.column(c).to_pylist() for c in ("items", "spans")) if again else ([[]] * n, [[]] * n)
                for i in range(n):
                    a, b = int(own[i]), int(own[i + 1])
                    for x in old_spans[i]:
                        covered[a:b] |= (starts[a:b] >= at[i] + x["o"]) & (ends[a:b] <= at[i] + x["e"])
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered[a:b].astype(np.int8), [0]])))
                    spans.append([{"o": int(starts[a + x] - at[i]), "e": int(ends[a + y - 1] - at[i])} for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                sums = np.concatenate([[0], np.cumsum(covered)])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(np.diff(own), pa.int64()), pa.array(np.diff(sums[own]), pa.int64()), pa.array([sorted({*x, *y}) for x, y in zip(items, old_items, strict=True)], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("o", pa.int64()), ("e", pa.int64())])))],
                    [*names, "n_words", "n_hit", "items", "spans"],
                )

    span = T.ArrayType(T.StructType([T.StructField("o", T.LongType()), T.StructField("e", T.LongType())]))
    fields = [docs.schema[c] for c in names]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", span)]))


def contamination_digest(docs: DataFrame, benchmark: DataFrame, width: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of :func:`find_contamination`."""
    out = find_contamination(docs.select("doc_id", "text"), benchmark, width, scratch)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
