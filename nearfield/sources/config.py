"""Configuration with defaults and checks; reads TOML."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import asdict, dataclass, field

from nearfield.errors import InvalidConfig
from nearfield.functions.distances import parse_metric

MAX_TOP_K, MAX_BATCH, NAME = 10_000, 100_000, re.compile(r"[A-Za-z0-9_-]{1,128}")


@dataclass(frozen=True)
class IvfConfig:
    n_clusters: int = 1024
    nprobe: int = 16
    max_iterations: int = 25

    def validate(self) -> None:
        if not 1 <= self.nprobe <= self.n_clusters:
            raise InvalidConfig("nprobe must be between 1 and n_clusters")


@dataclass(frozen=True)
class HnswConfig:
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50

    def validate(self) -> None:
        if self.m < 2 or self.ef_construction < self.m or self.ef_search < 1:
            raise InvalidConfig("m must be at least 2, ef_construction at least m, ef_search at least 1")


@dataclass(frozen=True)
class PqConfig:
    n_subvectors: int = 32
    bits: int = 8
    rerank_factor: int = 4

    def validate(self) -> None:
        if self.bits not in (4, 8) or self.n_subvectors < 1 or self.rerank_factor < 1:
            raise InvalidConfig("bits must be 4 or 8, n_subvectors and rerank_factor positive")


@dataclass(frozen=True)
class CollectionConfig:
    index_type: str = "brute_force"
    metric: str = "euclidean"
    dimension: int | None = None
    ivf: IvfConfig = field(default_factory=IvfConfig)
    hnsw: HnswConfig = field(default_factory=HnswConfig)
    pq: PqConfig = field(default_factory=PqConfig)

    def validate(self) -> None:
        if self.index_type not in ("brute_force", "ivf", "ivf_pq", "hnsw"):
            raise InvalidConfig(f"unknown index type {self.index_type!r}")
        parse_metric(self.metric)
        if self.dimension is not None and self.dimension < 1:
            raise InvalidConfig("dimension must be positive")
        if self.dimension and self.index_type == "ivf_pq" and self.dimension % self.pq.n_subvectors:
            raise InvalidConfig("dimension must be a multiple of n_subvectors")
        for part in (self.ivf, self.hnsw, self.pq):
            part.validate()

    @staticmethod
    def from_dict(d: dict) -> CollectionConfig:
        try:
            parts = {k: kind(**d[k]) for k, kind in (("ivf", IvfConfig), ("hnsw", HnswConfig), ("pq", PqConfig)) if k in d}
            out = CollectionConfig(**{k: v for k, v in d.items() if k not in parts}, **parts)
        except TypeError as e:
            raise InvalidConfig(str(e)) from e
        out.validate()
        return out

    @staticmethod
    def from_toml(text: str) -> CollectionConfig:
        try:
            return CollectionConfig.from_dict(tomllib.loads(text))
        except tomllib.TOMLDecodeError as e:
            raise InvalidConfig(str(e)) from e


@dataclass(frozen=True)
class LogConfig:
    level: str = "info"
    json: bool = False

    def validate(self) -> None:
        if self.level not in ("trace", "debug", "info", "warn", "error"):
            raise InvalidConfig(f"unknown level {self.level!r}")


@dataclass(frozen=True)
class EngineConfig:
    """Folders, limits and defaults of a catalog; there is no server, so no section for one."""

    data_dir: str = "./data"
    wal_dir: str | None = None
    max_memory_bytes: int = 8 << 30
    request_timeout_ms: int = 30_000
    default_index: CollectionConfig = field(default_factory=CollectionConfig)
    log: LogConfig = field(default_factory=LogConfig)

    def log_folder(self) -> str:
        return self.wal_dir or f"{self.data_dir.rstrip('/')}/wal"

    def validate(self) -> None:
        if self.max_memory_bytes < 1 or self.request_timeout_ms < 1:
            raise InvalidConfig("max_memory_bytes and request_timeout_ms must be positive")
        self.default_index.validate()
        self.log.validate()

    @staticmethod
    def from_toml(text: str) -> EngineConfig:
        try:
            d = tomllib.loads(text)
            parts = {"default_index": CollectionConfig.from_dict(d.pop("default_index", {})), "log": LogConfig(**d.pop("log", {}))}
            out = EngineConfig(**d, **parts)
        except (tomllib.TOMLDecodeError, TypeError) as e:
            raise InvalidConfig(str(e)) from e
        out.validate()
        return out

    def to_toml(self) -> str:
        """Text that :meth:`from_toml` reads as the same configuration."""
        lines: list[str] = []

        def section(name: str, d: dict) -> None:
            plain, inner = {k: v for k, v in d.items() if not isinstance(v, dict) and v is not None}, {k: v for k, v in d.items() if isinstance(v, dict)}
            lines.extend([f"[{name}]"] if name else [])
            lines.extend(f"{k} = {json.dumps(v)}" for k, v in plain.items())
            for k, v in inner.items():
                section(f"{name}.{k}" if name else k, v)

        section("", asdict(self))
        return "\n".join(lines) + "\n"


def check_batch(n: int) -> None:
    if n > MAX_BATCH:
        raise InvalidConfig(f"{n} rows in a batch; the limit is {MAX_BATCH}")


def check_name(name: str) -> None:
    if not NAME.fullmatch(name):
        raise InvalidConfig(f"bad name {name!r}")


def check_top_k(k: int) -> None:
    if not 1 <= k <= MAX_TOP_K:
        raise InvalidConfig(f"k must be 1 to {MAX_TOP_K}")
