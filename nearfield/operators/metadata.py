"""Metadata by id: ``metadata(id, metadata map<string, VALUE>)``, changed by whole-table expressions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.filters import VALUE, Condition, Tagged, all_of, decode_json, tag_of

MAP = f"map<string,{VALUE}>"


_ITEM = [("tag", pa.string()), ("s", pa.string()), ("i", pa.int64()), ("d", pa.float64()), ("b", pa.bool_())]
_ARROW = pa.map_(pa.string(), pa.struct([*_ITEM, ("a", pa.list_(pa.struct(_ITEM)))]))


def from_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """``id, metadata`` of JSON objects; malformed text and anything but an object give an empty map.

    The parsing of values with their types stays in Python: numbers keep integer and float apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [list(decode_json(x).items()) for x in batch.column("json").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(maps, _ARROW)], ["id", "metadata"])

    return rows.select(F.col("id").cast("long").alias("id"), F.col(column).cast("string").alias("json")).mapInArrow(run, f"id long, metadata {MAP}")


def _key(value: Column) -> Column:
    """A plain value with its type as text; null for others. Zero has one sign, and NaN, which equals nothing, no key."""
    number = F.when(value["d"] == 0, F.lit(0.0)).otherwise(value["d"])
    text = F.when(value["tag"] == "string", value["s"]).when(value["tag"] == "integer", value["i"].cast("string")).when(value["tag"] == "boolean", value["b"].cast("string")).when((value["tag"] == "float") & ~F.isnan(value["d"]), number.cast("string"))
    return F.concat(value["tag"], F.lit(":"), text)


def _literal(value: object) -> Column:
    tag = tag_of(value)
    if tag == "float":
        return F.concat(F.lit("float:"), F.lit(value or 0.0).cast("string"))
    return F.lit(f"{tag}:{str(value).lower() if tag == 'boolean' else value}")


class MetadataStore:
    """Each change gives a new store; ``version`` counts changes, and an index remembers the one it was built from."""

    def __init__(self, rows: DataFrame, version: int = 0, indexes: dict[str, tuple[int, DataFrame]] | None = None):
        self.rows, self.version, self.indexes = rows, version, indexes or {}

    def _with(self, rows: DataFrame) -> MetadataStore:
        return MetadataStore(rows, self.version + 1, self.indexes)

    def insert(self, fields: DataFrame) -> MetadataStore:
        """Sets single fields: ``fields(id, field, value)``; of repeated ones the greatest ``seq`` wins if there is such a column."""
        order = F.desc("seq") if "seq" in fields.columns else F.lit(1)
        last = fields.withColumn("n", F.row_number().over(Window.partitionBy("id", "field").orderBy(order))).where("n = 1")
        new = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("new"))
        joined = self.rows.join(new, "id", "full_outer")
        kept = F.map_filter("metadata", lambda k, _: ~F.map_contains_key("new", k))
        merged = F.when(F.col("new").isNull(), F.col("metadata")).when(F.col("metadata").isNull(), F.col("new")).otherwise(F.map_concat(kept, "new"))
        return self._with(joined.select("id", merged.alias("metadata")))

    def insert_all(self, rows: DataFrame) -> MetadataStore:
        """Replaces the whole map of each id in ``rows(id, metadata)``."""
        return self._with(self.rows.join(rows.select("id"), "id", "left_anti").unionByName(rows.select("id", "metadata")))

    def remove(self, ids: DataFrame) -> MetadataStore:
        return self._with(self.rows.join(ids.select("id"), "id", "left_anti"))

    def get(self, id: int) -> DataFrame:
        return self.rows.where(F.col("id") == id)

    def get_field(self, id: int, name: str) -> DataFrame:
        return self.get(id).select(F.element_at("metadata", name).alias("value"))

    def count(self) -> int:
        return self.rows.count()

    def is_empty(self) -> bool:
        return self.rows.isEmpty()

    def build_index(self, name: str, folder: str | None = None) -> MetadataStore:
        """Ids by plain value of a field (``key, id``), for :meth:`filter`; lists and nulls are not indexed.

        With a ``folder`` the index is written there, sorted by key, so a lookup reads few row groups.
        """
        value = F.element_at("metadata", name)
        index = self.rows.select("id", _key(value).alias("key")).where("key is not null")
        if folder is not None:
            index.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(folder)
            index = index.sparkSession.read.parquet(folder)
        return MetadataStore(self.rows, self.version, self.indexes | {name: (self.version, index)})

    def indexed_fields(self) -> list[str]:
        return sorted(self.indexes)

    def is_indexed(self, name: str) -> bool:
        return name in self.indexes

    def is_index_stale(self, name: str) -> bool:
        return name in self.indexes and self.indexes[name][0] != self.version

    def dirty_fields(self) -> list[str]:
        return [x for x in self.indexed_fields() if self.is_index_stale(x)]

    def needs_rebuild(self) -> bool:
        return bool(self.dirty_fields())

    def rebuild_dirty(self) -> MetadataStore:
        out = self
        for name in self.dirty_fields():
            out = out.build_index(name)
        return out

    def filter(self, condition: Condition) -> DataFrame:
        """``id`` of rows that match. Ids without metadata never match, whatever the condition.

        What fresh indexes can answer (equality and lists; an "and" by any of its parts, an "or" by all) is looked up;
        the rest of the condition is evaluated on the rows found.
        """
        ids, rest = self._looked_up(condition)
        if ids is None:
            return self.rows.where(condition.compile(Tagged("metadata"))).select("id")
        return ids if rest is None else self.rows.join(ids, "id", "left_semi").where(rest.compile(Tagged("metadata"))).select("id")

    def _looked_up(self, c: Condition) -> tuple[DataFrame | None, Condition | None]:
        """Ids from indexes (None without one), and what they leave to check."""
        if c.op in ("eq", "in") and c.name in self.indexes and not self.is_index_stale(c.name):
            values = list(c.value) if c.op == "in" else [c.value]
            if not any(tag_of(x) in ("null", "array") for x in values):
                keys = [_literal(x) for x in values if x == x]
                index = self.indexes[c.name][1]
                return index.where(F.col("key").isin(keys) if keys else F.lit(False)).select("id").distinct(), None
        if c.op == "and":
            got = [self._looked_up(p) for p in c.parts]
            found = [ids for ids, _ in got if ids is not None]
            rest = [r if ids is not None else p for p, (ids, r) in zip(c.parts, got, strict=True) if ids is None or r is not None]
            if found:
                return reduce(lambda a, b: a.join(b, "id", "left_semi"), found), all_of(*rest) if rest else None
        if c.op == "or" and c.parts:
            got = [self._looked_up(p) for p in c.parts]
            if all(ids is not None and rest is None for ids, rest in got):
                return reduce(DataFrame.union, (ids for ids, _ in got)).distinct(), None
        return None, c

    def matches(self, id: int, condition: Condition) -> bool:
        return not self.filter(condition).where(F.col("id") == id).isEmpty()
