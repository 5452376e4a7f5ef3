"""Embedding by an exchangeable function; the default hashes words, as a lexical stand-in that needs no model."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Words whose places a worker remembers, after which it starts anew.
_MEMORY = 1 << 18


def hashed_all(texts: list[str], dims: int = 64, known: dict[str, tuple[int, int]] | None = None) -> np.ndarray:
    """Signed counts of hashed words, of length one, a row for each text."""
    known = {} if known is None else known
    out = np.zeros((len(texts), dims))
    for row, text in zip(out, texts, strict=True):
        for w in text.lower().split():
            found = known.get(w)
            if found is None:
                if len(known) >= _MEMORY:
                    known.clear()
                h = zlib.crc32(w.encode())
                found = known[w] = h % dims, 1 if h >> 31 else -1
            row[found[0]] += found[1]
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0).astype(np.float32)


def hashed(text: str, dims: int = 64) -> np.ndarray:
    return hashed_all([text], dims)[0]


def hashing() -> Callable[[list[str]], np.ndarray]:
    """The default model as a worker loads it: texts to vectors."""
    known: dict[str, tuple[int, int]] = {}
    return lambda texts: hashed_all(texts, known=known)


def embedded(chunks: DataFrame, embed: Callable[[str], np.ndarray] = hashed, batch_size: int = 16, load: Callable[[], Callable[[list[str]], np.ndarray]] | None = None) -> DataFrame:
    """chunks with the embedding of their type and content.

    load: loads a model in a worker, once for all its batches, that turns up to batch_size texts into as many vectors; without it
    `embed` is called on each text, the default one on whole batches.
    """
    load = load or (hashing if embed is hashed else None)

    def make() -> Callable[[np.ndarray], np.ndarray]:
        model = load() if load else lambda texts: np.stack([np.asarray(embed(x), np.float32) for x in texts])
        return lambda texts: model([x or "" for x in np.ravel(texts).tolist()])

    run = predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch_size)
    text: Column = F.concat_ws(": ", "semantic_type", F.coalesce("content", F.lit("")))
    return chunks.withColumn("embedding", run(text))
