"""Settings from the environment, and checks of paths."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

#: The kinds of vector index that can be named; flat is exact, the others search the nearest cells of an inverted file.
INDEX_TYPES = ("flat", "ivf", "hnsw")


def _flag(name: str) -> bool:
    return os.getenv(name, "true").lower() == "true"


@dataclass(frozen=True)
class Settings:
    index_folder: str = field(default_factory=lambda: os.getenv("INDEX_CACHE_DIR", ".index_cache"))
    embedding_enabled: bool = field(default_factory=lambda: _flag("EMBEDDING_ENABLED"))
    batch_size: int = field(default_factory=lambda: int(os.getenv("EMBEDDING_BATCH_SIZE", "16")))
    max_file_mb: float = field(default_factory=lambda: float(os.getenv("MAX_FILE_SIZE_MB", "10")))
    threshold: float = field(default_factory=lambda: float(os.getenv("SIMILARITY_THRESHOLD", "0.7")))
    index_type: str = field(default_factory=lambda: os.getenv("VEC_INDEX_TYPE", "flat"))
    quantize: bool = field(default_factory=lambda: _flag("ENABLE_QUANTIZATION"))
    sync_on_search: bool = field(default_factory=lambda: _flag("AUTO_SYNC_ON_SEARCH"))

    def __post_init__(self) -> None:
        if self.index_type not in INDEX_TYPES:
            raise ValueError(f"unknown index type {self.index_type}")


def codebase(path: str) -> str:
    """The absolute path of a folder; others are refused."""
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(f"Path does not exist: {path}")
    if not p.is_dir():
        raise NotADirectoryError(f"Path is not a directory: {path}")
    return str(p.resolve())


def listed(value: str | None) -> list[str] | None:
    """A list from values between commas; none for none."""
    return [x.strip() for x in value.split(",")] if value else None
