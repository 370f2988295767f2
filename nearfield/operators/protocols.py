"""What the indexes have in common; an index does not change, so updates give a new one."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class VectorIndex(Protocol):
    """Searches a set of vectors."""

    @property
    def dimension(self) -> int: ...

    def count(self) -> int: ...

    def is_empty(self) -> bool: ...

    def search(self, query: list[float], k: int = 10) -> DataFrame: ...

    def batch_search(self, queries: DataFrame, k: int = 10) -> DataFrame: ...


@runtime_checkable
class MutableVectorIndex(VectorIndex, Protocol):
    """Also takes new vectors and drops old ones."""

    def add(self, rows: DataFrame) -> MutableVectorIndex: ...

    def remove(self, ids: DataFrame) -> MutableVectorIndex: ...


@runtime_checkable
class FinalizableIndex(Protocol):
    """Built step by step, then put in the form that is searched."""

    def finalize(self) -> FinalizableIndex: ...

    def is_finalized(self) -> bool: ...
