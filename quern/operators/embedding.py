"""Batch embedding of chunk text, and scans with a user's function."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashing_embedder(texts: list[str], width: int = 64) -> list[list[float]]:
    """A deterministic embedding from hashed words, for tests and runs without a model."""
    out = []
    for text in texts:
        vector = np.zeros(width)
        for word in text.lower().split():
            h = xxhash.xxh3_64_intdigest(word)
            vector[h % width] += 1 if h >> 63 else -1
        size = np.linalg.norm(vector)
        out.append((vector / size if size else vector).tolist())
    return out


def embed_chunks(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]] = hashing_embedder, batch: int = 20, cut: int = 2000, attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """chunk_id and embedding (null for blank text or a failed batch) of every row of ``chunks`` (chunk_id, content).

    Texts are cut to ``cut`` characters and go to ``embed`` in batches of ``batch``; a failing batch is tried again after ``wait``,
    then twice ``wait`` seconds, and given up after ``attempts``.
    """

    def tried(texts: list[str]) -> list[list[float]] | None:
        for turn in range(attempts):
            try:
                return embed(texts)
            except Exception:  # whatever the caller's function raises
                if turn + 1 < attempts:
                    time.sleep(wait * 2**turn)
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t[:cut] if isinstance(t, str) and t.strip() else None for t in frame["content"]]
            filled = [i for i, t in enumerate(texts) if t]
            vectors: list = [None] * len(texts)
            for at in range(0, len(filled), batch):
                part = filled[at : at + batch]
                for i, vector in zip(part, tried([texts[i] for i in part]) or []):
                    vectors[i] = vector
            yield pd.DataFrame({"chunk_id": frame["chunk_id"], "embedding": vectors})

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", "content").mapInPandas(run, f"chunk_id {kind}, embedding array<float>")


def pattern_scan(chunks: DataFrame, pattern: str, limit: int = 10) -> DataFrame:
    """The first chunks, by id, whose content fits a pattern."""
    return chunks.filter(F.col("content").rlike(pattern)).orderBy("chunk_id").limit(limit)


def scan(chunks: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, limit: int | None = None) -> DataFrame:
    """A user's function over batches of chunks, with an optional stop after ``limit`` rows."""
    out = chunks.mapInPandas(function, schema)
    return out if limit is None else out.limit(limit)
