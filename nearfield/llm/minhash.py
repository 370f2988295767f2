"""Near-duplicate documents by SetSketch registers (Ertl 2021), banded, estimated and verified.

Every distinct shingle owns a Poisson process of rate ``a * m`` whose points fall on random
registers; a register keeps the smallest point of any shingle, stored as the truncated value
``1 - floor(log_b(point))``. Such sketches merge by taking maxima, and two registers agree with a
probability that grows with the similarity of the sets. Bands of register values give candidates,
a joint likelihood over all registers (larger, smaller, equal) drops the hopeless ones, and the
rest are verified on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, ONE, SPACE, Scratch, mix64, signed, text_blocks, word_bounds, word_hashes
from ._graph import components

#: Registers, their base and rate; 40 bands of 8: a pair at 0.85 shares no band with probability 3e-6.
REGISTERS, BANDS, BASE, RATE = 320, 40, 1.1, 20.0
#: Points drawn in one step of sketching a block, and of one shingle.
DRAWS, MOST_DRAWS = 1 << 14, 64
#: At least four standard deviations of the estimate (0.02 at 0.85) below the threshold.
SLACK = 0.08
#: Shingles of a shard, so that a block's texts (a few bytes a shingle) stay small whatever the documents' lengths.
SHARD_SHINGLES = 500_000
#: Members of blocks that a task gets.
TASK_MEMBERS = 2000


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their offsets."""
    starts, ends, word_at = word_bounds(data, at, SPACE)
    w = word_hashes(LOWER[data], starts, ends)
    count = np.diff(word_at)
    docs = len(count)
    if not len(w):
        return w, np.zeros(docs + 1, np.int64)
    owner = np.repeat(np.arange(docs), count)
    h, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(w) >= words:
        n = len(w) - words + 1
        h = np.zeros(n, np.uint64)
        for i in range(words):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += w[i : i + n]
        whole = owner[:n] == owner[words - 1 :]
        h, own = mix64(h[whole]), owner[:n][whole]
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        hs = np.zeros(len(short), np.uint64)
        for i in range(words):
            has = count[short] > i
            hs[has] = hs[has] * np.uint64(0xD6E8FEB86659FD93) + w[np.minimum(word_at[short] + i, len(w) - 1)][has]
        h, own = np.concatenate([h, mix64(hs + count[short].astype(np.uint64))]), np.concatenate([own, short])
        order = np.argsort(own, kind="stable")
        h, own = h[order], own[order]
    bounds = np.searchsorted(own, np.arange(docs + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def sketch(h: np.ndarray, at: np.ndarray, m: int = REGISTERS, base: float = BASE, rate: float = RATE) -> np.ndarray:
    """Registers (one row of ``m`` bytes a set) of sets given by sorted hashes and offsets.

    The ``i``-th draw of a shingle is a function of its hash and ``i``: the upper half gives the time since
    the point before, the lower half the register. A shingle ends once it is past all registers of its set.
    """
    docs = len(at) - 1
    least = np.full((docs, m), np.inf)
    flat = least.ravel()
    owner = np.repeat(np.arange(docs), np.diff(at))
    time, drawn = np.zeros(len(h)), 0
    while len(h):
        steps = np.arange(drawn + 1, drawn + 1 + min(MOST_DRAWS, max(1, DRAWS // len(h))), dtype=np.uint64)
        draws = mix64(h[:, None] + steps * np.uint64(0x9E3779B97F4A7C15))
        times = np.log(((draws >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32)
        times = time[:, None] - np.cumsum(times, axis=1) / (rate * m)
        spot = ((draws & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64) + owner[:, None] * m
        np.minimum.at(flat, spot.ravel(), times.ravel())
        time, drawn = times[:, -1], drawn + len(steps)
        heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        bound = least[owner[heads]].max(axis=1)
        on = time < np.repeat(bound, np.diff(np.append(heads, len(owner))))
        h, time, owner = h[on], time[on], owner[on]
    with np.errstate(divide="ignore"):
        k = np.floor(1.0 - np.log(least) / np.log(base))
    return np.clip(np.where(np.isfinite(k), k, 0), 0, 255).astype(np.uint8).reshape(docs, m)


def estimate(more: np.ndarray, less: np.ndarray, n1: np.ndarray, n2: np.ndarray, m: int = REGISTERS, base: float = BASE) -> np.ndarray:
    """Joint maximum-likelihood similarity from how many registers are larger and smaller in the first sketch."""
    u = n1 / (n1 + n2)
    v = 1.0 - u
    top = np.minimum(u / v, v / u)
    same = m - more - less

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)

    def likelihood(j: np.ndarray) -> np.ndarray:
        a, b = p(u - v * j), p(v - u * j)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(more > 0, more * np.log(a), 0) + np.where(less > 0, less * np.log(b), 0) + np.where(same > 0, same * np.log(np.maximum(1 - a - b, 1e-300)), 0)

    lo, hi, g = np.zeros_like(u), top.copy(), (np.sqrt(5) - 1) / 2
    for _ in range(24):  # golden section; the likelihood is concave in j
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        left = likelihood(x) > likelihood(y)
        hi, lo = np.where(left, y, hi), np.where(left, lo, x)
    return (lo + hi) / 2


def signatures(docs: DataFrame, words: int = 5) -> DataFrame:
    """``doc_id, n_shingles, d1, d2`` (128-bit digest of the set) and ``registers``; null and wordless texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in text_blocks(batch, "text"):
                h, own = shingle_sets(data, at, words)
                regs = sketch(h, own)
                n = np.diff(own)
                digests = np.frombuffer(b"".join(hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(own[:-1], own[1:], strict=True)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.array([r.tobytes() if k else None for r, k in zip(regs, n, strict=True)], pa.binary())],
                    ["doc_id", "n_shingles", "d1", "d2", "registers"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, registers binary")


def _bucket_hashes(regs: np.ndarray, bands: int) -> np.ndarray:
    rows = REGISTERS // bands
    buckets = np.zeros((len(regs), bands), np.uint64)
    buckets += np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    wide = regs[:, : bands * rows].reshape(len(regs), bands, rows).astype(np.uint64)
    for i in range(rows):
        buckets = mix64(buckets * np.uint64(257) + wide[:, :, i])
    return buckets


def _bands(sets: DataFrame, bands: int) -> DataFrame:
    """``doc_id, bucket``: a hash of each band's register values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            buckets = _bucket_hashes(_registers(batch.column("registers")), bands)
            ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), bands)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(signed(buckets.ravel()))], ["doc_id", "bucket"])

    return sets.select("doc_id", "registers").mapInArrow(run, "doc_id long, bucket long")


def _registers(column: pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint8).reshape(-1, REGISTERS)


def _likely(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs ``(a, b)`` whose estimated similarity is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _registers(batch.column("ra")), _registers(batch.column("rb"))
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
            keep = estimate((x > y).sum(axis=1), (x < y).sum(axis=1), na, nb) >= least
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    left = sets.select(F.col("doc_id").alias("a"), F.col("registers").alias("ra"), F.col("n_shingles").alias("na"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("registers").alias("rb"), F.col("n_shingles").alias("nb"))
    near = F.least("na", "nb") >= least * F.greatest("na", "nb")
    return pairs.join(left, "a").join(right, "b").where(near).mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach ``100 * intersection >= percent * union``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in text_blocks(batch, "ta"):
                other = list(text_blocks(part, "tb", 1 << 40))
                if not other:
                    continue
                ha, oa = shingle_sets(data, at, words)
                hb, ob = shingle_sets(other[0][1], other[0][2], words)
                n, k = len(oa) - 1, len(ha)
                owner = np.concatenate([np.repeat(np.arange(n), np.diff(oa)), np.repeat(np.arange(n), np.diff(ob))])
                h = np.concatenate([ha, hb])
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                twin = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
                both = np.bincount(owner[1:][twin], minlength=n)
                union = np.diff(oa) + np.diff(ob) - both
                keep = pa.array((100 * both >= percent * union) & (union > 0))
                yield pa.RecordBatch.from_arrays([part.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    joined = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _grid(rest: DataFrame, shard: int, shard_shingles: int = SHARD_SHINGLES) -> DataFrame:
    """``rest(bucket, doc_id, component_id, n_shingles)`` dealt to blocks ``(i, j)``, pairs of shards of at most ``shard`` members and ``shard_shingles`` shingles on average.

    The shards of a bucket's largest component come first and meet only those of the other members: pairs
    inside it are joined already. So a huge component with a few strangers costs rows in proportion to
    its size, and what is quadratic is the number of members outside it. A bucket that fits in one shard is one block.
    """
    parts = rest.groupBy("bucket", "component_id").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    size = parts.groupBy("bucket").agg(F.max(F.struct("n", "component_id", "s")).alias("top"), F.sum("n").alias("total"), F.sum("s").alias("shingles"))
    shards = lambda n, s: F.ceil(F.greatest(n / F.lit(shard), s / F.lit(shard_shingles))).cast("int")
    several = shards(F.col("total"), F.col("shingles")) > 1
    apart, there = F.when(several, F.col("top.n")).otherwise(0), F.when(several, F.col("top.s")).otherwise(0)
    size = size.select("bucket", F.when(several, F.col("top.component_id")).alias("main"), shards(apart, there).alias("g"), shards(F.col("total") - apart, F.col("shingles") - there).alias("r"))
    inside, deal = F.col("component_id").eqNullSafe(F.col("main")), lambda n: F.pmod(F.xxhash64("doc_id"), F.greatest(F.col(n), F.lit(1))).cast("int")
    own = F.when(inside, deal("g")).otherwise(F.col("g") + deal("r"))
    meets = F.explode(F.sequence(F.when(inside, F.col("g")).otherwise(F.lit(0)), F.col("g") + F.col("r") - 1))
    dealt = rest.join(size, "bucket").withColumn("own", own).withColumn("x", meets)
    return dealt.select("bucket", "doc_id", "component_id", "own", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"))


MEMBER = ["doc_id", "component_id", "own", "n_shingles", "registers"]
BLOCK = "bucket long, i int, j int"


class _Block:
    """Two shards of a bucket, and the pairs across components that are worth verifying.

    A pair is tried only in the bucket of the first band where its sketches agree.
    """

    def __init__(self, key: tuple, table: pa.Table, least: float, bands: int):
        bucket, self.i, self.j = (k.as_py() for k in key)
        self.ids, self.comp, self.own, self.n = (table.column(c).to_numpy().copy() for c in MEMBER[:4])
        self.regs, self.least, self.rows = _registers(table.column("registers").combine_chunks()), least, REGISTERS // bands
        self.band = int(np.flatnonzero(_bucket_hashes(self.regs[:1], bands)[0].view(np.int64) == bucket)[0])

    def likely(self) -> Iterator[tuple[int, list[int]]]:
        """For each member, those of other components (as they are by then) that it is likely to be linked with."""
        right, least, n, regs, comp = self.own == self.j, self.least, self.n, self.regs, self.comp
        for x in np.flatnonzero(self.own == self.i).tolist():
            there = np.flatnonzero(right & (comp != comp[x]) & (np.minimum(n, n[x]) >= least * np.maximum(n, n[x])) & ((self.ids > self.ids[x]) if self.i == self.j else True))
            if not len(there):
                continue
            r = regs[there]
            same = (regs[x] == r).sum(axis=1) >= (least - 0.1) * REGISTERS  # registers agree at least as often as shingles do
            there, r = there[same], r[same]
            if len(there):
                earlier = (regs[x] == r)[:, : self.band * self.rows].reshape(len(r), self.band, self.rows).all(axis=2).any(axis=1)
                there, r = there[~earlier], r[~earlier]
            if len(there):
                guess = estimate((regs[x] > r).sum(axis=1), (regs[x] < r).sum(axis=1), np.full(len(there), float(n[x])), n[there].astype(float))
                yield x, there[guess >= least].tolist()


def _tempted(dealt: DataFrame, least: float, bands: int) -> DataFrame:
    """The members of each block that have a likely partner in it; no text is needed to tell."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block, some = _Block(key, table, least, bands), set()
        for x, there in block.likely():
            some.update(there, [x] if there else [])
        return table.take(pa.array(sorted(some), pa.int64()))

    return dealt.groupBy("bucket", "i", "j").applyInArrow(run, f"{BLOCK}, doc_id long, component_id long, own int, n_shingles long, registers binary")


def _links_across(members: DataFrame, least: float, words: int, percent: int, bands: int) -> DataFrame:
    """Verified links between different components inside each block; a pair is not tried once the block has joined its components."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = _Block(key, table, least, bands)
        sets: list[np.ndarray] = []
        for batch in table.select(["text"]).to_batches():
            for _, data, at in text_blocks(batch, "text"):
                h, own = shingle_sets(data, at, words)
                sets += [h[x:y] for x, y in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
        ids, comp, n, a, b = block.ids, block.comp, [len(s) for s in sets], [], []
        for x, there in block.likely():
            for y in there:
                if comp[y] == comp[x]:
                    continue
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (n[x] + n[y] - both):
                    a.append(max(ids[x], ids[y]))
                    b.append(min(ids[x], ids[y]))
                    comp[comp == comp[y]] = comp[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return members.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 85, shard: int = 500, scratch: Scratch | None = None, bands: int = BANDS) -> DataFrame:
    """One row a document: ``doc_id, n_shingles, component_id, kept``.

    Texts are lower-cased (A-Z) and split at white space; a set holds the distinct runs of ``words``
    words, or the whole sequence if there are fewer. Documents with ``100 * intersection >= percent *
    union`` are linked; ``component_id`` is the smallest id reachable and ``kept`` marks it. Null or
    wordless texts have an empty set and link with nothing. Rows with a null id form a component
    of their own each (``component_id`` null, kept). Repeated ids count as one document each. Further
    columns of ``docs`` are ignored. An empty table gives an empty result.

    Equal sets are one class (one representative each). Candidates of a bucket are its members with
    the bucket's smallest id; only where that leaves a bucket with several components are the
    remaining pairs across components tried in a grid of bounded blocks; texts are fetched only for
    members with a likely partner. ``bands`` share the
    registers in equal runs; a lower ``percent`` needs more of them to miss as little.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    least = percent / 100 - max(SLACK, 4 * (percent * (100 - percent) / REGISTERS) ** 0.5 / 100)
    every = scratch.save(signatures(docs, words), "signatures")
    has = every.where("n_shingles > 0 and doc_id is not null")
    classes = has.groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id"))
    sets = scratch.save(has.join(classes.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "n_shingles", "registers"), "sets")
    banded = _bands(sets, bands)
    shared = banded.groupBy("bucket").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where("pivot <> last").drop("last")
    members = scratch.save(banded.join(shared, "bucket"), "members")
    pairs = members.where("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = scratch.save(_likely(pairs, sets, least), "pairs")
    inside = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    texts = scratch.save(source.join(inside, "doc_id", "left_semi"), "texts")
    links = scratch.save(_verified(pairs, texts, words, percent), "links")
    found = scratch.save(components(links, scratch, "star"), "star")

    # what is left: buckets whose members, beside the pivot, lie in several components
    label = members.where("doc_id <> pivot").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("bucket", "doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))
    label = scratch.save(label, "labelled")
    mixed = label.groupBy("bucket").agg(F.min("component_id").alias("x"), F.max("component_id").alias("y")).where("x <> y").select("bucket")
    rest = scratch.save(label.join(mixed, "bucket", "left_semi"), "rest")
    if rest.limit(1).count():
        dealt = _grid(rest.join(sets.select("doc_id", "n_shingles"), "doc_id"), shard).join(sets, "doc_id")
        tasks = max(1, rest.count() // TASK_MEMBERS)  # by members: sketches are few bytes for the work on them
        dealt = dealt.select("bucket", "i", "j", *MEMBER).repartition(tasks, "bucket", "i", "j")
        tempted = scratch.save(_tempted(dealt, least, bands), "tempted")
        texts = scratch.save(source.join(tempted.select("doc_id").distinct(), "doc_id", "left_semi"), "texts-2")
        more = scratch.save(_links_across(tempted.join(texts, "doc_id"), least, words, percent, bands), "links-2")
        links = links.union(more)
        found = scratch.save(components(links, scratch, "all"), "all")
    of_class = classes.join(found.withColumnRenamed("id", "class_id"), "class_id", "left").select("d1", "d2", F.coalesce("component_id", "class_id").alias("component_id"))
    of_class = scratch.save(of_class, "classes")  # with nothing but exchanges below the next join, Spark can split a class of very many copies
    scratch.drop("sets", "members", "pairs", "texts", "links", "star", "labelled", "rest", "tempted", "texts-2", "links-2", "all")
    out = has.select("doc_id", "n_shingles", "d1", "d2").join(of_class, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id")
    alone = every.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
