"""Operation log: numbered inserts, deletes and checkpoints, one Parquet batch for each append."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .snapshot import Store

SCHEMA = "seq long, op string, id long, vector array<float>, metadata string, last_applied_seq long"


class OpLog:
    """Entries ``seq, op, id, vector, metadata, last_applied_seq``; ``op`` is insert, delete, checkpoint or compact."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def _kept(self) -> dict:
        """What the last truncation left: entries above ``after``, the first of them in table ``folder``, which holds those up to ``last``."""
        return json.loads(self.store.read("kept.json")) if self.store.exists("kept.json") else {"after": -1, "folder": None, "last": -1, "next": 0}

    def _batches(self) -> list[str]:
        """Whole tables that hold live entries; those that a truncation replaced, or left half written, do not count."""
        kept = self._kept()
        later = [b for b in self.store.list() if b.startswith("batch-") and int(b[6:]) > kept["last"]]
        return [b for b in ([kept["folder"]] if kept["folder"] else []) + later if self.store.exists(f"{b}/_SUCCESS")]

    def entries(self) -> DataFrame:
        """All entries without a gap: what follows a missing number is not replayed."""
        batches = self._batches()
        if not batches:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*(self.store.uri(b) for b in batches))
        # batches are numbered by their first entry and hold entries without gaps
        spans = sorted((r.a, r.b) for r in rows.groupBy(F.input_file_name().alias("f")).agg(F.min("seq").alias("a"), F.max("seq").alias("b")).groupBy(F.regexp_extract("f", r"((?:batch|kept)-\d+)", 1)).agg(F.min("a").alias("a"), F.max("b").alias("b")).collect())
        end = None
        for a, b in spans:
            if end is not None and a != end + 1:
                break
            end = b
        return rows.where(F.col("seq") <= end) if end is not None else rows

    def next_sequence(self) -> int:
        last = self.entries().agg(F.max("seq")).first()[0]
        return max(self._kept()["next"], 0 if last is None else last + 1)

    def append(self, ops: DataFrame) -> int:
        """Appends ``ops(op, id[, vector][, metadata])`` in the order of column ``n`` (or of the id); returns the last number."""
        first = self.next_sequence()
        order = F.col("n") if "n" in ops.columns else F.col("id")
        # places by range partition: counts of the parts, then a rank in each
        parts = ops.repartitionByRange(order).withColumn("part", F.spark_partition_id()).persist()
        try:
            counts = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
            before, total = {}, 0
            for p in sorted(counts):
                before[p], total = total, total + counts[p]
            if not total:
                return first - 1
            offset = F.element_at(F.create_map(*(F.lit(x) for p, n in before.items() for x in (p, n))), F.col("part"))
            place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + offset + F.lit(first)
            have = set(ops.columns)
            column = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
            out = parts.select(place.cast("long").alias("seq"), column("op", "string"), column("id", "long"), column("vector", "array<float>"), column("metadata", "string"), F.lit(None).cast("long").alias("last_applied_seq"))
            out.write.mode("overwrite").parquet(self.store.uri(f"batch-{first:020d}"))
        finally:
            parts.unpersist()
        return first + total - 1

    def checkpoint(self, seq: int) -> int:
        """Records that everything up to ``seq`` is in a snapshot."""
        n = self.next_sequence()
        row = self.spark.createDataFrame([(n, "checkpoint", None, None, None, seq)], SCHEMA)
        row.coalesce(1).write.mode("overwrite").parquet(self.store.uri(f"batch-{n:020d}"))
        return n

    def last_checkpoint(self) -> int | None:
        return self.entries().where("op = 'checkpoint'").agg(F.max("last_applied_seq")).first()[0]

    def truncate_to_checkpoint(self) -> int:
        """Drops entries up to the last checkpoint; returns how many.

        What stays is written first, then one small file that is renamed into place makes it the log, and only then
        are old tables deleted: whenever this is cut short, the log is the old one or the new one.
        """
        last = self.last_checkpoint()
        if last is None:
            return 0
        entries = self.entries()
        old = entries.where(F.col("seq") <= last).count()
        stays = entries.where(F.col("seq") > last)
        end = stays.agg(F.max("seq")).first()[0]
        before, folder = [b for b in self.store.list() if b.startswith(("batch-", "kept-"))], None
        if end is not None:
            folder = f"kept-{time.time_ns():020d}"
            stays.write.mode("overwrite").parquet(self.store.uri(folder))
        bound = last if end is None else end
        self.store.write("kept.json", json.dumps({"after": last, "folder": folder, "last": bound, "next": bound + 1}))
        for b in before:
            if b.startswith("kept-") or int(b[6:]) <= bound:
                self.store.delete(b)
        return old

    def replay_after(self, seq: int) -> DataFrame:
        return self.entries().where(F.col("seq") > seq)

    def pending(self) -> int:
        last = self.last_checkpoint()
        return self.entries().where((F.col("seq") > (-1 if last is None else last)) & F.col("op").isin("insert", "delete")).count()


def state(entries: DataFrame) -> DataFrame:
    """``id, vector, metadata``: the last operation of each id, without deleted ones."""
    last = entries.where("op in ('insert', 'delete')").groupBy("id").agg(F.max_by(F.struct("op", "vector", "metadata"), "seq").alias("x"))
    return last.where("x.op = 'insert'").select("id", "x.vector", "x.metadata")
