"""Windows of fixed width that occur more than once in a corpus, found by content-keyed segments.

Every window of ``width`` symbols has a key that depends on its content alone: the least hash of the
``k``-grams in it. Consecutive windows with the same occurrence of that gram form a segment (about
one row for every ``(width - k) / 2`` symbols), and equal windows always meet under one key. So

* keys seen once drop out after a count that is combined on the map side;
* equal segments collapse to one digest (BLAKE2b, 128 bits), whatever the number of copies;
* only keys with several different segments ("mixed") fetch one text per digest, and a kernel that
  the operator supplies compares those: the groups are as large as the number of different
  contexts, not of copies. A mixed key with over ``max_group`` digests is not given to one task:
  its windows are counted one by one by Spark instead.

A row is known by its id and a few bits of its text's hash, so rows that repeat an id with other texts stay apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BLOCK_BYTES, ONE, PICK, SPACE, TWO, Roller, Scratch, digests, list_array, signed, sliding_min, text_blocks, word_bounds, word_hashes

#: Windows in a segment at most.
RUN = 256
#: Bits of a place: tag of the text, first symbol, windows.
TAG, START, SIZE = 22, 32, 9
SEGMENT = ["key", "ext", "alt"]
SPANS = "array<struct<o:int,e:int,first:bigint>>"
SPAN_TYPE = pa.list_(pa.struct([("o", pa.int32()), ("e", pa.int32()), ("first", pa.int64())]))


@dataclass(frozen=True)
class Units:
    """What a symbol is: a byte, or a word between white space."""

    words: bool
    width: int
    gram: int

    def symbols(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets of symbols by text, and where each symbol starts and ends."""
        if self.words:
            starts, ends, own = word_bounds(data, at, SPACE)
            return own, starts, ends
        here = np.arange(len(data) + 1)
        return at, here[:-1], here[1:]

    def values(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, roller: Roller = ONE) -> np.ndarray:
        """What a roller takes for the symbols."""
        return word_hashes(data, starts, ends, roller) if self.words else data

    def plain(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The symbols with nothing but one space after each word, and where each begins (and the last ends)."""
        if not self.words:
            return data.tobytes(), np.arange(len(data) + 1)
        begin = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        out = np.full(int(begin[-1]), 0x20, np.uint8)
        inside = data[~SPACE[data]]
        out[np.arange(len(inside)) + np.repeat(np.arange(len(starts)), ends - starts)] = inside
        return out.tobytes(), begin


def tagged(docs: DataFrame) -> DataFrame:
    """``doc, tag, text`` of rows that can share windows."""
    source = docs.where("doc_id is not null and text is not null")
    return source.select(F.col("doc_id").alias("doc"), F.xxhash64("text").bitwiseAND(F.lit((1 << TAG) - 1)).alias("tag"), "text")


def segments(data: np.ndarray, at: np.ndarray, units: Units) -> tuple[np.ndarray, ...]:
    """Segments of a block of texts: text number, first symbol in the text, windows, key and digest (two longs)."""
    own, starts, ends = units.symbols(data, at)
    n, w, k = len(starts), units.width, units.gram
    none = (np.zeros(0, np.int64),) * 6
    if n < w:
        return none
    grams = PICK.rolling(PICK.prefix(units.values(data, starts, ends) if units.words else PICK.bytes[data]), k)
    least = sliding_min(grams, w - k + 1)
    lengths = np.diff(own)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    whole = np.flatnonzero(owner[: len(least)] == owner[w - 1 :])
    if not len(whole):
        return none
    key, text = least[whole], owner[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1] + 1)
    new[1:] |= grams[whole[:-1]] == key[:-1]  # the gram leaves with the window before: another occurrence takes over
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(whole)))
    if size.max() > RUN:  # equal windows have equal keys wherever a run is cut
        pieces = -(-size // RUN)
        piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, size = np.repeat(first, pieces) + piece * RUN, np.minimum(np.repeat(size, pieces) - piece * RUN, RUN)
    start = whole[first]
    raw, begin = units.plain(data, starts, ends)
    ext, alt = digests(raw, begin[start].tolist(), begin[start + size + w - 1].tolist())
    return text[first], start - own[text[first]], size, signed(key[first]), ext, alt


def _runs(docs: DataFrame, units: Units) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in text_blocks(batch, "text", BLOCK_BYTES if units.words else BLOCK_BYTES // 4):
                text, start, size, key, ext, alt = segments(data, at, units)
                doc, tag = (part.column(c).to_numpy()[text] for c in ("doc", "tag"))
                pos = (tag << START + SIZE) + (start << SIZE) + size
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, ext, alt, doc, pos)], [*SEGMENT, "doc", "pos"])

    return docs.mapInArrow(run, "key long, ext long, alt long, doc long, pos long")


def _tag() -> Column:
    return F.shiftright("pos", START + SIZE)


def _start() -> Column:
    return F.shiftright("pos", SIZE).bitwiseAND(F.lit((1 << START) - 1)).cast("int")


def _size() -> Column:
    return F.col("pos").bitwiseAND(F.lit((1 << SIZE) - 1)).cast("int")


def _cut(wanted: DataFrame, docs: DataFrame, units: Units) -> DataFrame:
    """The text of each wanted segment; each document is read once for all its segments."""
    fields = [*SEGMENT, "n", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in text_blocks(batch, "text"):
                lists = part.column("wanted")
                rows = lists.flatten()
                text = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
                start, size = rows.field("start").to_numpy(), rows.field("size").to_numpy()
                own, starts, ends = units.symbols(data, at)
                a = starts[own[text] + start]
                b = ends[own[text] + start + size + units.width - 2]
                raw = data.tobytes()
                cuts = pa.array([raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(rows.field(f) for f in fields), cuts], [*fields, "segment"])

    by_doc = wanted.groupBy("doc", _tag().alias("tag")).agg(F.collect_list(F.struct(*fields, _start().alias("start"), _size().alias("size"))).alias("wanted"))
    joined = docs.join(by_doc, ["doc", "tag"]).select("text", "wanted")
    return joined.mapInArrow(run, "key long, ext long, alt long, n long, first long, last long, segment binary")


#: Takes keys, counts, first and last ids, and the segments as bytes with offsets; gives for each a list of (from, to, first id).
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[list[tuple[int, int, int]]]]


def _resolved(cuts: DataFrame, kernel: Kernel, batch_bytes: int) -> DataFrame:
    """Spans by digest; a task streams through its keys and never splits one."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        key, ext, alt, n, first, last = (np.concatenate([b.column(c).to_numpy() for b in rows]) for c in (*SEGMENT, "n", "first", "last"))
        parts = [x for b in rows for _, *x in text_blocks(b, "segment", 1 << 60)]
        data = np.concatenate([d for d, _ in parts])
        at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(a) for _, a in parts]))])
        spans = kernel(key, n, first, last, data, at)
        some = [i for i, x in enumerate(spans) if x]
        flat = [{"o": o, "e": e, "first": f} for i in some for o, e, f in spans[i]]
        lists = list_array(pa.array(flat, SPAN_TYPE.value_type), np.concatenate([[0], np.cumsum([len(spans[i]) for i in some])]))
        return pa.RecordBatch.from_arrays([*(pa.array(x[some]) for x in (key, ext, alt)), lists], [*SEGMENT, "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            for part, _, at in text_blocks(batch, "segment", batch_bytes // 4):
                keys = part.column("key").to_numpy()
                if size + at[-1] > batch_bytes and held:
                    stays = int(np.argmax(keys != last)) if (keys != last).any() else len(keys)
                    if stays < len(keys):
                        yield solve([*held, part.slice(0, stays)])
                        held, size, part = [], 0, part.slice(stays)
                held.append(part)
                size += int(at[-1])
                last = keys[-1]
        if held:
            yield solve(held)

    return cuts.repartition("key").sortWithinPartitions("key").mapInArrow(run, f"key long, ext long, alt long, spans {SPANS}")


def _counted(cuts: DataFrame, units: Units, across: bool) -> DataFrame:
    """The same for keys with very many digests: each window on its own, counted by Spark."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in text_blocks(batch, "segment"):
                own, starts, ends = units.symbols(data, at)
                size = np.diff(own) - units.width + 1
                row = np.repeat(np.arange(len(size)), size)
                offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                start = own[row] + offset
                h1, h2 = (r.spans(r.prefix(units.values(data, starts, ends, r)), start, start + units.width) for r in (ONE, TWO))
                take = [part.column(c).take(pa.array(row)) for c in (*SEGMENT, "n", "first", "last")]
                yield pa.RecordBatch.from_arrays([*take, pa.array(offset, pa.int32()), pa.array(signed(h1)), pa.array(signed(h2))], [*SEGMENT, "n", "first", "last", "o", "h1", "h2"])

    windows = cuts.mapInArrow(explode, "key long, ext long, alt long, n long, first long, last long, o int, h1 long, h2 long")
    known = windows.groupBy("h1", "h2").agg(F.sum("n").alias("count"), F.min("first").alias("least"))
    hits = windows.join(known, ["h1", "h2"])
    hits = hits.where(F.col("least") < F.col("last")) if across else hits.where("count > 1")
    first = F.col("least") if across else F.lit(-(2**63))
    span = F.struct(F.col("o"), (F.col("o") + units.width).alias("e"), first.alias("first"))
    return hits.groupBy(*SEGMENT).agg(F.collect_list(span).alias("spans"))


def repeated_spans(docs: DataFrame, units: Units, kernel: Kernel, across: bool, scratch: Scratch, max_group: int = 20_000, batch_bytes: int = 1 << 20) -> DataFrame:
    """``doc, tag, spans``: stretches (symbol offsets ``o`` to ``e``) of each document covered by repeated windows.

    ``across``: a window counts where it also starts in a document with a smaller id; otherwise
    where it also starts anywhere else.
    """
    docs = tagged(docs)
    runs = _runs(docs, units)
    # counted keys and sizes are written first: a join with nothing but exchanges below can split a hot key
    keys = scratch.save(runs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    runs = scratch.save(runs.join(keys, "key", "left_semi"), "runs")
    copies = runs.groupBy(*SEGMENT).agg(F.count("*").alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"), F.min(F.struct("doc", "pos")).alias("rep"))
    copies = scratch.save(copies, "digests")
    size = scratch.save(copies.groupBy("key").agg(F.count("*").alias("group")), "sizes")
    copies = scratch.save(copies.join(size, "key"), "sized")
    whole = F.array(F.struct(F.lit(0).alias("o"), (F.col("rep.pos").bitwiseAND(F.lit((1 << SIZE) - 1)) + units.width - 1).cast("int").alias("e"), (F.col("first") if across else F.lit(-(2**63))).alias("first")))
    alone = copies.where("group = 1").where("first < last" if across else "n > 1").select(*SEGMENT, whole.cast(SPANS).alias("spans"))
    several = copies.where("group > 1").select(*SEGMENT, "n", "first", "last", "group", "rep.doc", "rep.pos")
    cuts = _cut(several.where(F.col("group") <= max_group), docs, units)
    found = alone.union(_resolved(cuts, kernel, batch_bytes))
    large = several.where(F.col("group") > max_group)
    if large.limit(1).count():
        cuts = scratch.save(_cut(large, docs, units), "large")
        found = found.union(_counted(cuts, units, across))
    found = scratch.save(found, "found")
    here = F.transform(F.filter("spans", lambda x: x.first < F.col("doc")), lambda x: F.struct((x.o + _start()).alias("o"), (x.e + _start()).alias("e")))
    hits = runs.join(found, SEGMENT).select("doc", _tag().alias("tag"), here.alias("spans")).where("size(spans) > 0")
    spans = scratch.save(hits.groupBy("doc", "tag").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")), "spans")
    scratch.drop("keys", "runs", "digests", "sizes", "sized", "large", "found")
    return spans


def merged(spans: pa.ListArray, row: int, limit: int) -> list[tuple[int, int]]:
    """Disjoint maximal stretches of one document, which has ``limit`` symbols."""
    a, b = spans.offsets[row].as_py(), spans.offsets[row + 1].as_py()
    if a == b:
        return []
    o, e = (spans.values.field(f).to_numpy()[a:b] for f in ("o", "e"))
    order = np.argsort(o, kind="stable")
    o, e = np.minimum(o[order], limit), np.minimum(np.maximum.accumulate(e[order]), limit)
    new = np.ones(len(o), bool)
    new[1:] = o[1:] > e[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(o) - 1)
    return [(x, y) for x, y in zip(o[new].tolist(), e[last].tolist(), strict=True) if x < y]
