"""Exact substring dedup on words with fixed-block anchors.

Blocks of half a window that do not overlap are indexed in every reference segment, each segment is
probed at every word, and hits grow to the full windows around them: any window of ``width`` words
holds a whole block of ``width // 2``. Windows that share a hit are looked up by their 128-bit rolling
hash, the smallest document id of each is kept, and neighbouring windows are joined to maximal
repeats. The content-keyed segments of ``_segments`` choose what meets in one index, so copies cost
one row a digest and no pair of documents is ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import ONE, SPACE, TWO, Scratch, text_blocks, word_bounds, word_hashes
from ._segments import TAG, Units, merged, repeated_spans


def anchor_kernel(width: int):
    """For each segment, its windows that start in a document with a smaller id than its last one."""
    block = max(1, width // 2)

    def kernel(key, n, first, last, data, at):
        starts, ends, own = word_bounds(data, at, SPACE)
        p1, p2 = ONE.prefix(word_hashes(data, starts, ends, ONE)), TWO.prefix(word_hashes(data, starts, ends, TWO))
        lengths = np.diff(own)
        owner = np.repeat(np.arange(len(lengths)), lengths)

        # index of fixed blocks: hash -> first and last segment that has it
        per = lengths // block
        seg = np.repeat(np.arange(len(lengths)), per)
        spot = own[seg] + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * block
        hashes = ONE.spans(p1, spot, spot + block)
        order = np.argsort(hashes, kind="stable")
        hashes, seg = hashes[order], seg[order]
        head = np.ones(len(hashes), bool)
        head[1:] = hashes[1:] != hashes[:-1]
        begin = np.flatnonzero(head)
        index, low, high = hashes[begin], seg[begin], seg[np.append(begin[1:], len(seg)) - 1]

        # probes: every rolling block
        rolling = ONE.rolling(p1, block)
        inside = owner[: len(rolling)] == owner[block - 1 :]
        found = np.minimum(np.searchsorted(index, rolling), len(index) - 1)
        mine = owner[: len(rolling)]
        hit = inside & (index[found] == rolling) & ((low[found] != mine) | (high[found] != mine))

        # growth to whole windows, and the smallest id of each
        total = np.concatenate([[0], np.cumsum(hit)])
        spots = len(owner) - width + 1
        window = np.flatnonzero((owner[:spots] == owner[width - 1 :]) & (total[width - block + 1 : width - block + 1 + spots] > total[:spots])) if spots > 0 else np.zeros(0, np.int64)
        h1, h2 = ONE.spans(p1, window, window + width), TWO.spans(p2, window, window + width)
        order = np.lexsort((first[owner[window]], h2, h1))
        h1, h2, window = h1[order], h2[order], window[order]
        head = np.ones(len(window), bool)
        head[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        least = first[owner[window]][head][np.cumsum(head) - 1]
        by_word = first[owner].copy()
        by_word[window] = least

        out = []
        for i, (a, b) in enumerate(zip(own[:-1].tolist(), own[1:].tolist(), strict=True)):
            ids = by_word[a : b - width + 1]
            edge = np.flatnonzero(np.diff(ids)) + 1
            cut = [0, *edge.tolist(), len(ids)]
            out.append([(x, y - 1 + width, int(ids[x])) for x, y in zip(cut[:-1], cut[1:], strict=True) if ids[x] < last[i]])
        return out

    return kernel


def remove_repeated_words(docs: DataFrame, width: int = 50, scratch: Scratch | None = None, max_group: int = 20_000) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept`` (the remaining words joined by one space).

    Words are the stretches between white space, unchanged. A word goes if a window of ``width``
    consecutive words that covers it also starts in a document with a smaller ``doc_id``; windows
    are judged on the input and never cross documents. A null text has no words. Rows with a null
    id keep all their words and remove none elsewhere; rows that repeat an id count as
    documents of their own, none of them smaller than another.
    All columns of ``docs`` stay; ones named ``n_words``, ``n_removed`` or ``kept`` are replaced.
    An empty table gives an empty result.
    """
    if width < 2:
        raise ValueError("width must be at least 2")
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed", "kept")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    units = Units(words=True, width=width, gram=max(1, min(8, width // 2)))
    spans = repeated_spans(source, units, anchor_kernel(width), True, scratch, max_group)
    same = (F.col("doc_id").cast("long") == F.col("__doc")) & (F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit((1 << TAG) - 1)) == F.col("__tag"))
    joined = docs.join(spans.withColumnsRenamed({"doc": "__doc", "tag": "__tag", "spans": "__spans"}), same, "left").drop("__doc", "__tag")
    names = [f.name for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in text_blocks(batch, "text"):
                raw, lists = data.tobytes(), part.column("__spans")
                rows = lists.fill_null([]) if lists.null_count else lists
                total, gone, kept = [], [], []
                for i in range(part.num_rows):
                    words = raw[at[i] : at[i + 1]].split()
                    size = len(words)
                    for a, b in reversed(merged(rows, i, size)):
                        del words[a:b]
                    total.append(size)
                    gone.append(size - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [*names, "n_words", "n_removed", "kept"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return joined.mapInArrow(run, schema)


def removal_digest(docs: DataFrame, width: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of :func:`remove_repeated_words`."""
    out = remove_repeated_words(docs.select("doc_id", "text"), width, scratch)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
