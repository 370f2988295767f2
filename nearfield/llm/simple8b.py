"""Token ids in files of Simple-8b words.

A word has a selector in its top four bits and 60 bits of ids of one width. Ids are coded in blocks of
``BLOCK``; each block starts on a word of its own, whose offset the footer keeps, so any range of
ids decodes by blocks and all words of one selector at once. Selector 15 escapes to a table of
values that need more than 60 bits.

File: magic, words (little-endian), escaped values, word offset of each block, document ids (with a
null mark), ids per document, then a fixed trailer with the counts and the magic again.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, SPACE, Scratch, byte_strings, text_blocks, word_bounds, word_hashes
from ._files import AtomicFile, locate

MAGIC = b"NFS8B1\0\0"
BLOCK = 1024
#: Selector -> (ids in a word, bits of an id).
LAYOUT = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
TRAILER = struct.Struct("<QQQQQ8s")


#: How the maximum over that many ids comes from two shorter ones: (shorter, shorter, shift of the second).
LADDER = {2: (1, 1, 1), 3: (2, 1, 2), 4: (2, 2, 2), 5: (4, 1, 4), 6: (4, 2, 4), 7: (4, 3, 4), 8: (4, 4, 4), 10: (8, 2, 8), 12: (8, 4, 8), 15: (8, 7, 8), 20: (10, 10, 10), 30: (15, 15, 15), 60: (30, 30, 30)}


def _selectors(bits: np.ndarray) -> np.ndarray:
    """The densest selector that can start at each column; a row goes on with zeros."""
    need = {1: bits}
    for count, (x, y, shift) in LADDER.items():
        out = need[x].copy()
        np.maximum(out[:, :-shift], need[y][:, shift:], out=out[:, :-shift])
        need[count] = out
    best = np.full(bits.shape, ESCAPE, np.int8)
    for s in range(len(LAYOUT) - 1, -1, -1):
        count, width = LAYOUT[s]
        best[need[count] <= width] = s
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, word offset of each block (one more than blocks), and escaped values."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    rows = -(-n // BLOCK)
    values = np.zeros((rows, BLOCK + 60), np.uint64)
    flat = np.zeros(rows * BLOCK, np.uint64)
    flat[:n] = ids
    values[:, :BLOCK] = flat.reshape(rows, BLOCK)
    big = values >> np.uint64(60) > 0
    escaped = values[big]
    if n and ids.max() >> np.uint64(52):
        bits = np.zeros(values.shape, np.uint8)
        rest = values.copy()
        for step in (32, 16, 8, 4, 2, 1):
            high = rest >> np.uint64(step) > 0
            bits[high] += step
            rest = np.where(high, rest >> np.uint64(step), rest)
        bits += rest > 0
    else:
        bits = np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    best = _selectors(bits)
    size = np.array([c for c, _ in LAYOUT] + [0, 1])
    length = np.full(rows, BLOCK)
    if rows:
        length[-1] = n - (rows - 1) * BLOCK
    at = np.zeros(rows, np.int64)
    row_parts, at_parts = [], []
    live = np.arange(rows)
    while len(live):
        row_parts.append(live)
        at_parts.append(at[live])
        at[live] += size[best[live, at[live]]]
        live = live[at[live] < length[live]]
    row, spot = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (row_parts, at_parts))
    order = np.lexsort((spot, row))
    row, spot = row[order], spot[order]
    chosen = best[row, spot].astype(np.int64)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s, (count, width) in enumerate(LAYOUT):
        w = np.flatnonzero(chosen == s)
        for i in range(count):
            words[w] |= values[row[w], spot[w] + i] << np.uint64(i * width)
    w = np.flatnonzero(chosen == ESCAPE)
    words[w] |= np.arange(len(w), dtype=np.uint64)
    return words, np.searchsorted(row, np.arange(rows + 1)), escaped


def decode(words: np.ndarray, offsets: np.ndarray, n: int, escaped: np.ndarray) -> np.ndarray:
    """The ids of whole blocks; ``n`` of them."""
    rows = len(offsets) - 1
    selector = (words >> np.uint64(60)).astype(np.int64)
    size = np.array([c for c, _ in LAYOUT] + [0, 1])[selector]
    before = np.cumsum(size) - size
    block = np.repeat(np.arange(rows), np.diff(offsets))
    at = before - before[offsets[:-1]][block]
    out = np.zeros((rows, BLOCK + 60), np.uint64)
    for s, (count, width) in enumerate(LAYOUT):
        w = np.flatnonzero(selector == s)
        mask = np.uint64((1 << width) - 1)
        for i in range(count):
            out[block[w], at[w] + i] = words[w] >> np.uint64(i * width) & mask
    w = np.flatnonzero(selector == ESCAPE)
    out[block[w], at[w]] = escaped[(words[w] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out[:, :BLOCK].ravel()[:n]


#: ASCII letters, ASCII marks that end a run of letters for any reader of the text, and digits.
LETTER, MARK, DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK[1:128] = ~LETTER[1:128] & ~SPACE[1:128]
MARK[[ord(c) for c in "'<|"]] = False
DIGIT[48:58] = True
#: Words of small Latin letters, which the normalizer and the split leave as they are; and what the byte level makes of their letters.
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHIFTED = [b for b in range(256) if b not in _SHOWN]
BYTE_LEVEL = {c: "".join(chr(b if b in _SHOWN else 0x100 + _SHIFTED.index(b)) for b in chr(c).encode()) for c in range(0xDF, 0x100)}
#: What the tokenizer must do before its merges for texts to be encoded piece by piece.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def _ramp(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of each stretch, one after the other."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - total + size, size)


class Memory:
    """Ids of pieces in a hash table that never grows; equal hashes are told apart by the bytes of the pieces.

    A piece whose hash another one has is not kept. With ``entries`` of them it takes about ``60 * entries`` bytes.
    """

    def __init__(self, entries: int):
        self.entries, self.n = entries, 0
        self.table = np.full(2 * entries, -1, np.int32)
        self.hashes, self.at, self.start = np.zeros(entries, np.uint64), np.zeros(entries + 1, np.int32), np.zeros(entries + 1, np.int32)
        self.text, self.ids = np.zeros(16 * entries, np.uint8), np.zeros(6 * entries, np.uint32)

    def find(self, hashes: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entry of each piece (bytes of ``data`` from ``at``), or -1."""
        out = np.full(len(hashes), -1, np.int64)
        spot, todo = (hashes % np.uint64(len(self.table))).astype(np.int64), np.arange(len(hashes))
        while len(todo):
            entry = self.table[spot]
            same = (entry >= 0) & (self.hashes[entry] == hashes[todo])
            out[todo[same]] = entry[same]
            go = (entry >= 0) & ~same
            todo, spot = todo[go], (spot[go] + 1) % len(self.table)
        hit = np.flatnonzero(out >= 0)
        entry = out[hit]
        equal = size[hit] == self.at[entry + 1] - self.at[entry]
        out[hit[~equal]] = -1
        hit, entry = hit[equal], entry[equal]
        if len(hit):  # no piece is empty
            differ = data[_ramp(at[hit], size[hit])] != self.text[_ramp(self.at[entry], size[hit])]
            out[hit[np.logical_or.reduceat(differ, np.cumsum(size[hit]) - size[hit])]] = -1
        return out

    def coded(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of entries one after the other, and how many each has."""
        size = (self.start[entry + 1] - self.start[entry]).astype(np.int64)
        return self.ids[_ramp(self.start[entry].astype(np.int64), size)], size

    def add(self, hashes: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray, ids: np.ndarray, count: np.ndarray) -> bool:
        """False, and nothing is kept, if there is no room."""
        n, m, text, code = self.n, len(hashes), int(self.at[self.n]), int(self.start[self.n])
        if n + m > self.entries or text + size.sum() > len(self.text) or code + len(ids) > len(self.ids):
            return False
        self.hashes[n : n + m] = hashes
        self.at[n + 1 : n + m + 1] = text + np.cumsum(size)
        self.start[n + 1 : n + m + 1] = code + np.cumsum(count)
        self.text[text : self.at[n + m]] = data[_ramp(at, size)]
        self.ids[code : code + len(ids)] = ids
        self.n += m
        spot, todo = (hashes % np.uint64(len(self.table))).astype(np.int64), np.arange(n, n + m)
        while len(todo):
            free = self.table[spot] < 0
            self.table[spot[free]] = todo[free]
            held = self.table[spot]
            go = (held != todo) & (self.hashes[held] != self.hashes[todo])
            todo, spot = todo[go], (spot[go] + 1) % len(self.table)
        return True


class Encoder:
    """Encodes texts piece by piece: the tokenizer sees each distinct piece once while it is remembered.

    A tokenizer with ``NORMALIZER`` and ``SPLIT`` lower-cases, and never joins what ASCII white space, an end of an
    ASCII digit or a change between an ASCII letter and an ASCII mark separates; apostrophes
    (contractions) and ``<|`` (special tokens) keep their surroundings whole. So the ids of a text are those of its pieces in
    order. Texts go whole to any other tokenizer. The memory has two halves of ``entries`` pieces: once the
    young one is full, it becomes the old one, whose pieces are forgotten unless they come again.
    """

    def __init__(self, path: str, end: int, entries: int = 1 << 18):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.entries = Tokenizer.from_file(path), end, entries
        shape = json.loads(self.tokenizer.to_str())
        steps = (shape.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
        special = [t["content"] for t in shape["added_tokens"]]
        self.piecewise = shape["normalizer"] == NORMALIZER and steps[0] == SPLIT and all(t.startswith("<|") for t in special)
        self.merged = self.tokenizer.model.tokenize
        self.young, self.old = Memory(entries), None

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encoded(self, piece: bytes) -> list[int]:
        """Ids of a piece; plain words need nothing but the merges."""
        text = piece.decode()
        if not PLAIN.fullmatch(text):
            return self._whole(text)
        return [t.id for t in self.merged(text if text.isascii() else text.translate(BYTE_LEVEL))]

    def _learned(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces one after the other, where those of each piece begin, and how many it has."""
        at, size, hashes = at[:-1], np.diff(at), word_hashes(data, at[:-1], at[1:])
        parts, start, count, had = [], np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), 0
        todo = np.arange(len(at))

        def take(where: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
            nonlocal had
            parts.append(ids)
            start[where], count[where] = had + np.cumsum(n) - n, n
            had += len(ids)

        again = todo[:0]
        for memory in (self.young, self.old) if self.old else (self.young,):
            entry = memory.find(hashes[todo], data, at[todo], size[todo])
            again, todo, entry = todo[entry >= 0], todo[entry < 0], entry[entry >= 0]
            take(again, *memory.coded(entry))
        if len(todo):
            raw = data.tobytes()
            got = [self._encoded(raw[a:b]) for a, b in zip(at[todo].tolist(), (at[todo] + size[todo]).tolist(), strict=True)]
            n = np.fromiter(map(len, got), np.int64, len(got))
            take(todo, np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum())), n)
        new, pool = np.concatenate([again, todo]) if self.old else todo, np.concatenate(parts)
        for a in range(0, len(new), self.entries):
            part = new[a : a + self.entries]
            kept = hashes[part], data, at[part], size[part], pool[_ramp(start[part], count[part])], count[part]
            if not self.young.add(*kept):
                self.young, self.old = Memory(self.entries), self.young
                self.young.add(*kept)
        return pool, start, count

    def _pieces(self, data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, and their offsets by text."""
        letter, mark, digit = LETTER[data], MARK[data], DIGIT[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = letter[:-1] & mark[1:] | mark[:-1] & letter[1:] | digit[:-1] | digit[1:]
        starts, ends, own = word_bounds(data, at, SPACE, cut)
        low = LOWER[data]
        special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        for i in np.unique(np.searchsorted(starts, special, side="right") - 1).tolist():  # a special token in capitals is none
            low[starts[i] : ends[i]] = data[starts[i] : ends[i]]
        return byte_strings(low[~SPACE[data]], ends - starts), own

    def block(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and their offsets."""
        if self.piecewise:
            pieces, own = self._pieces(data, at)
            coded = pieces.dictionary_encode()
            which, pieces = coded.indices.to_numpy(), coded.dictionary
            spot = np.frombuffer(pieces.buffers()[1], np.int64)[: len(pieces) + 1] if len(pieces) else np.zeros(1, np.int64)
            pool, start, size = self._learned(np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[: spot[-1]], spot)
        else:
            raw, own = data.tobytes(), np.arange(len(at))
            got = [self._whole(raw[x:y].decode()) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            which, size = own[:-1], np.fromiter(map(len, got), np.int64, len(got))
            pool, start = np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum())), np.cumsum(size) - size
        size, start = size[which], start[which]
        total = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(start - total[:-1], size) + np.arange(total[-1])
        texts = len(at) - 1
        out = np.full(total[-1] + texts, self.end, np.uint32)
        text = np.repeat(np.arange(texts), np.diff(total[own]))
        out[np.arange(total[-1]) + text] = pool[source]
        return out, total[own] + np.arange(texts + 1)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end: int) -> Encoder:
    """One encoder for all tasks of a worker process, so that it keeps what it has learned."""
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = Encoder(path, end)
    return _ENCODERS[path, end]


class Writer:
    """Writes one file; holds at most a few blocks of ids, and 17 bytes a document for the footer."""

    def __init__(self, file: AtomicFile):
        self.file, self.held, self.count = file, [], 0
        self.ids: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.offsets: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.escaped: list[np.ndarray] = []
        self.words = self.n = 0
        file.write(MAGIC)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.nulls.append(np.asarray(doc_ids.is_null().to_numpy(zero_copy_only=False), np.uint8))
        self.ids.append(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        self.sizes.append(np.asarray(sizes, np.int64))
        self.held.append(ids)
        self.count += len(ids)
        if self.count >= 64 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        take = len(ids) if last else len(ids) // BLOCK * BLOCK
        words, offsets, escaped = encode(ids[:take])
        had = sum(map(len, self.escaped))
        if len(escaped):
            words = np.where(words >> np.uint64(60) == ESCAPE, words + np.uint64(had), words)
        self.file.write(words.astype("<u8").tobytes())
        self.escaped.append(escaped)
        self.offsets.append(offsets[1:] + self.words)
        self.words += len(words)
        self.n += take
        self.held, self.count = [ids[take:]], len(ids) - take

    def close(self) -> int:
        self._flush(True)
        join = lambda x, kind: np.concatenate([*x, np.zeros(0, kind)]).astype(kind).tobytes()
        for x, kind in ((self.escaped, "<u8"), (self.offsets, "<i8"), (self.ids, "<i8"), (self.nulls, "u1"), (self.sizes, "<i8")):
            self.file.write(join(x, kind))
        docs = sum(map(len, self.ids))
        self.file.write(TRAILER.pack(self.words, sum(map(len, self.escaped)), sum(map(len, self.offsets)) - 1, docs, self.n, MAGIC))
        return self.n


class Reader:
    """Decodes one file by blocks of words."""

    def __init__(self, uri: str):
        system, path = locate(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        self.words, escaped, blocks, docs, self.n, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is no file of token ids")
        at = len(MAGIC) + 8 * self.words

        def table(count: int, kind: str) -> np.ndarray:
            nonlocal at
            width = np.dtype(kind).itemsize
            out = np.frombuffer(self.file.read_at(count * width, at), kind)
            at += count * width
            return out

        self.escaped, self.offsets = table(escaped, "<u8"), table(blocks + 1, "<i8")
        self.doc_ids, self.nulls, self.sizes = table(docs, "<i8"), table(docs, "u1"), table(docs, "<i8")

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last`` of the file."""
        if first >= last:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK, -(-last // BLOCK)
        words = np.frombuffer(self.file.read_at(8 * int(self.offsets[b] - self.offsets[a]), len(MAGIC) + 8 * int(self.offsets[a])), "<u8")
        out = decode(words, self.offsets[a : b + 1] - self.offsets[a], min(b * BLOCK, self.n) - a * BLOCK, self.escaped)
        return out[first - a * BLOCK : last - a * BLOCK].astype(np.uint32)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end: int = 2) -> DataFrame:
    """Writes a file for each range of ``doc_id`` and returns ``part, uri, n_ids, n_docs``; the call is lazy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        uri, docs = f"{folder}/part-{part:06d}.s8b", 0
        coder, pool = encoder(tokenizer, end), pa.default_memory_pool()
        with AtomicFile(uri) as file:
            writer = Writer(file)
            for batch in batches:
                for piece, data, at in text_blocks(batch, "text"):
                    ids, own = coder.block(data, at)
                    writer.add(piece.column("doc_id"), ids, np.diff(own))
                    docs += piece.num_rows
                    pool.release_unused()  # or it keeps the most that any block took
            n = writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([uri]), pa.array([n], pa.int64()), pa.array([docs], pa.int64())], ["part", "uri", "n_ids", "n_docs"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, "part long, uri string, n_ids long, n_docs long")


def read_tokens(files: list[tuple[str, int]], spark, docs_at_once: int = 256) -> DataFrame:
    """``doc_id, start, ids`` of files given with the number of ids before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column("uri").to_pylist(), batch.column("before").to_pylist(), strict=True):
                reader = Reader(uri)
                at = np.concatenate([[0], np.cumsum(reader.sizes)])
                for a in range(0, len(reader.sizes), docs_at_once):
                    b = min(a + docs_at_once, len(reader.sizes))
                    ids = reader.ids(int(at[a]), int(at[b]))
                    lists = pa.ListArray.from_arrays(pa.array(at[a : b + 1] - at[a], pa.int32()), pa.array(ids.astype(np.int32)))
                    doc_ids = pa.array(reader.doc_ids[a:b], mask=reader.nulls[a:b].astype(bool))
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(before + at[a:b], pa.int64()), lists], ["doc_id", "start", "ids"])

    rows = spark.createDataFrame(files, "uri string, before long")
    return rows.repartition(max(1, len(files))).mapInArrow(run, "doc_id long, start long, ids array<int>")


def tokenize_to_files(docs: DataFrame, tokenizer: str, end: int = 2, scratch: Scratch | None = None) -> tuple[DataFrame, list[tuple[str, int]]]:
    """Token ids of every document in files, and what reading them back gives (``doc_id, start, ids``).

    Texts are encoded without special tokens and followed by ``end``; null counts as empty. Files
    follow ascending ``doc_id`` (null first; equal ids in any order); ``start`` is the number of ids
    before a document. Further columns are ignored. An empty table writes no documents.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    manifest = scratch.save(write_tokens(docs, tokenizer, scratch.path("tokens"), end), "manifest")
    files, before = [], 0
    for r in sorted(manifest.where("n_docs > 0").collect()):  # one row a file
        files.append((r.uri, before))
        before += r.n_ids
    return read_tokens(files, docs.sparkSession), files


def token_digest(docs: DataFrame, tokenizer: str, end: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``, read from the files."""
    rows, _ = tokenize_to_files(docs, tokenizer, end, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at, ids = np.asarray(lists.offsets), np.asarray(lists.values).astype("<u4")
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
