"""Embedding texts in batches, with a deterministic stand-in for a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BATCH = 32
#: FNV-1a with 64 bits, and the step of the generator that its hash seeds.
FNV_START, FNV_PRIME = 14695981039346656037, 1099511628211
STEP, ADD = 6364136223846793005, 1442695040888963407


class EmbeddingError(ValueError):
    pass


def hashed(dimensions: int) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors that depend on the text's bytes alone."""
    # All steps of the generator at once: h * a**i + (a**(i-1) + ... + 1) * c.
    powers, sums = [1], [0]
    for _ in range(dimensions):
        sums.append((sums[-1] * STEP + ADD) % 2**64)
        powers.append(powers[-1] * STEP % 2**64)
    powers, sums = np.array(powers[1:], np.uint64), np.array(sums[1:], np.uint64)

    def embed(texts: list[str]) -> np.ndarray:
        seeds = []
        for t in texts:
            h = FNV_START
            for b in t.encode():
                h = (h ^ b) * FNV_PRIME % 2**64
            seeds.append(h)
        h = np.array(seeds, np.uint64)[:, None] * powers + sums
        v = h.view(np.int64).astype(np.float32) / np.float32(2**63 - 1)
        return v / np.sqrt((v * v).sum(axis=1, dtype=np.float32))[:, None]

    return embed


def embed(rows: DataFrame, model: Callable[[list[str]], np.ndarray], dimensions: int, batch: int = BATCH) -> DataFrame:
    """``rows`` (id, text) to (id, v). ``model`` gets at most ``batch`` texts at a time.

    An answer with another number of vectors or dimensions fails the job. Null
    texts count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                got = np.asarray(model([t or "" for t in part["text"].to_pylist()]), np.float32)
                if got.shape != (part.num_rows, dimensions):
                    raise EmbeddingError(f"{got.shape} for {part.num_rows} texts of {dimensions} dimensions")
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(list(got), pa.list_(pa.float32()))], names=["id", "v"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text").mapInArrow(run, f"id {kind}, v array<float>")
