"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

Each sentence with a word that has a weight gets a logistic score from its words; others are no evidence and
count for nothing, so length alone makes no document toxic. A document's score is the noisy-or of
its sentences, ``1 - prod(1 - p)``. Weights are trained from document labels alone and then locate
the offending sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import LOWER, text_blocks, word_bounds, word_hashes
from .decontaminate import SEPARATOR

FEATURES = 1 << 18
#: Labelled rows that training uses at most.
SAMPLE_ROWS = 8000
#: Bias that training starts from.
START = -4.0
SENTENCE_END = np.zeros(256, bool)
SENTENCE_END[[ord(c) for c in ".!?\n"]] = True


def sentences(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature and sentence of each word, offsets of the sentences' words, text of each sentence, and byte bounds of words."""
    starts, ends, own = word_bounds(data, at, SEPARATOR)
    feature = (word_hashes(LOWER[data], starts, ends) % np.uint64(FEATURES)).astype(np.int64)
    stops = np.concatenate([[0], np.cumsum(SENTENCE_END[data])])
    new = np.zeros(len(starts), bool)
    new[1:] = stops[starts[1:]] != stops[starts[:-1]]
    first = own[:-1][np.diff(own) > 0]
    new[first] = True
    begin = np.flatnonzero(new)
    text = np.searchsorted(own, begin, side="right") - 1
    return feature, np.append(begin, len(starts)), text, starts, ends


def sentence_scores(weights: np.ndarray, bias: float, feature: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Log odds of each sentence; minus infinity without a word that has a weight."""
    own = weights[feature].astype(np.float64)
    total, known = (np.concatenate([[0], np.cumsum(x)]) for x in (own, own != 0))
    return np.where(known[begin[1:]] > known[begin[:-1]], bias + total[begin[1:]] - total[begin[:-1]], -np.inf)


def noisy_or(z: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """``1 - prod(1 - sigmoid(z))`` of each text's sentences, 0 without any."""
    return -np.expm1(-np.bincount(text, weights=np.logaddexp(0, z), minlength=texts))


def _ratio(hot: np.ndarray, has: np.ndarray, positive: float, n: float) -> np.ndarray:
    """G statistic of having a word against being toxic."""
    out = np.zeros(len(has))
    for seen, a, b in ((hot, has, positive), (has - hot, has, n - positive), (positive - hot, n - has, positive), (n - positive - has + hot, n - has, n - positive)):
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.where(seen > 0, 2 * seen * np.log(seen * n / (a * b)), 0)
    return out


def telling(has: np.ndarray, hot: np.ndarray, positive: float, n: float, least: float = 25.0) -> np.ndarray:
    """Words that toxic documents have more often, with a likelihood ratio (G) of at least ``least``.

    Only these get a weight: rare words would otherwise be learned by heart to explain noisy labels.
    """
    return (hot * n > has * positive) & (_ratio(hot, has, positive, n) >= least)


def fit(docs: list[tuple[int, np.ndarray, np.ndarray]], rounds: int = 150, rate: float = 0.25, decay: float = 2e-4, weak: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and bias from ``(label, telling features, sentence of each)``.

    Words that alone give a sentence less than ``weak`` are dropped, since a long text has many, and the rest is
    fitted anew.
    """
    if not docs:
        return np.zeros(FEATURES, np.float32), START
    y, used = np.array([d[0] for d in docs], np.float64), np.zeros(FEATURES, bool)
    docs = [d[1:] for d in docs]
    weights, bias = _solve(docs, y, rounds, rate, decay)
    for f, _ in docs:
        used[f] = True
    used &= bias + weights >= np.log(weak / (1 - weak))
    if used.any():
        weights, bias = _solve([(f[m], s[m]) for f, s in docs for m in [used[f]]], y, rounds, rate, decay)
    return weights.astype(np.float32), bias


def _solve(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Gradient steps (with momentum) on the likelihood of the labels under noisy-or; decay pulls weights to zero."""
    kept, slot = np.unique(np.concatenate([f for f, _ in docs]), return_inverse=True)
    offset = np.concatenate([[0], np.cumsum([int(s.max(initial=-1)) + 1 for _, s in docs])])
    used_in, sentence = np.unique(np.concatenate([s + o for (_, s), o in zip(docs, offset[:-1], strict=True)]), return_inverse=True)
    text = np.searchsorted(offset, used_in, side="right") - 1
    w = np.zeros(len(kept) + 1)
    w[-1] = START
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = w[-1] + np.bincount(sentence, weights=w[slot], minlength=len(text))
        s = np.exp(-np.logaddexp(0, -z))
        p = np.clip(noisy_or(z, text, len(docs)), 1e-9, 1 - 1e-9)
        g = s * np.where(y > 0, -(1 - p) / p, 1.0)[text]
        grad = np.append(np.bincount(slot, weights=g[sentence], minlength=len(kept)), g.sum()) / len(docs)
        grad[:-1] += decay * w[:-1] / 10
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        w -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-5)
    weights = np.zeros(FEATURES)
    weights[kept] = w[:-1]
    return weights, float(w[-1])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Learns from labelled rows whose ``crc32(doc_id) % 5`` is not 0, ``sample_rows`` of them at most (drawn by a hash of the id).

    A first pass over their whole texts counts in how many documents each word is, a second one gathers for the
    driver where the few telling words are, so no text's length weighs on it.
    """
    rows = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = rows.where(~_held_out("id")).where("toxic in (0, 1)")
    rows = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows)

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(rows), "id").select("id", "toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has, hot = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
        n = positive = 0
        for batch in batches:
            for part, data, at in text_blocks(batch, "text"):
                feature, _, _, _, _ = sentences(data, at)
                words = np.diff(word_bounds(data, at, SEPARATOR)[2])
                label = part.column("toxic").to_numpy()
                pair = np.unique(np.repeat(np.arange(part.num_rows), words) * FEATURES + feature)
                has += np.bincount(pair % FEATURES, minlength=FEATURES)
                hot += np.bincount(pair % FEATURES, weights=label[pair // FEATURES], minlength=FEATURES).astype(np.int64)
                n, positive = n + part.num_rows, positive + int(label.sum())
        some = np.flatnonzero(has)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(has[some], n)), pa.array(np.append(hot[some], positive))], ["feature", "has", "hot"])

    counts = found.mapInArrow(count, "feature int, has long, hot long").groupBy("feature").agg(F.sum("has").alias("has"), F.sum("hot").alias("hot")).toArrow()  # at most FEATURES rows
    has, hot, feature = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1), counts.column("feature").to_numpy()
    has[feature], hot[feature] = counts.column("has").to_numpy(), counts.column("hot").to_numpy()
    used = telling(has[:-1], hot[:-1], hot[-1], has[-1])
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(used))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for part, data, at in text_blocks(batch, "text"):
                feature, begin, text, _, _ = sentences(data, at)
                sentence = np.repeat(np.arange(len(text)), np.diff(begin))
                on = np.flatnonzero(used[feature])
                own = text[sentence[on]] if len(on) else on
                first, cut = np.searchsorted(text, np.arange(part.num_rows)), np.searchsorted(own, np.arange(part.num_rows + 1))
                spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), first.tolist(), strict=True))
                lists = [pa.array([feature[on[a:b]].astype("<i4").tobytes() for a, b, _ in spans], pa.binary()), pa.array([(sentence[on[a:b]] - c).astype("<i4").tobytes() for a, b, c in spans], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("toxic"), *lists], ["id", "toxic", "feature", "sentence"])

    got = sorted(found.mapInArrow(run, "id long, toxic int, feature binary, sentence binary").collect(), key=lambda r: (r.id, r.feature))
    return fit([(r.toxic, np.frombuffer(r.feature, "<i4"), np.frombuffer(r.sentence, "<i4")) for r in got])


def _held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``offending``: byte bounds and scores of sentences of at least one half.

    Null and wordless texts score 0. All columns of ``docs`` stay; ones with the two names are replaced.
    """
    docs = docs.drop("score", "offending")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES floats
    names = docs.columns
    item = pa.struct([("o", pa.int64()), ("e", pa.int64()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            for part, data, at in text_blocks(batch, "text"):
                feature, begin, text, starts, ends = sentences(data, at)
                z = sentence_scores(weights, bias, feature, begin) if len(text) else np.zeros(0)
                p = noisy_or(z, text, part.num_rows)
                hot = np.flatnonzero(z >= 0)
                found = [[] for _ in range(part.num_rows)]
                for s in hot.tolist():
                    t = int(text[s])
                    found[t].append({"o": int(starts[begin[s]] - at[t]), "e": int(ends[begin[s + 1] - 1] - at[t]), "p": float(1 / (1 + np.exp(-z[s])))})
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(np.clip(p, 0, 1)), pa.array(found, pa.list_(item))], [*names, "score", "offending"])

    spans = T.ArrayType(T.StructType([T.StructField("o", T.LongType()), T.StructField("e", T.LongType()), T.StructField("p", T.DoubleType())]))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("offending", spans)]))


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document; labels are used to train only.

    Repeated label rows count as toxic if one is; labels that are null or neither 0 nor 1 are left out.
    Rows with a null id are held out. Without usable labels all scores are near 0. An empty table
    gives an empty result.
    """
    out = score(docs.select("doc_id", "text"), train(docs, labels, sample_rows))
    return out.select("doc_id", _held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
