"""Operator 8: near-duplicate components by circulant MinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .near import near_components
from .shared import stage, table
from .text import U64, shingle_sets

U32 = np.uint32
ROWS, BANDS = 8, 48
EMPTY = 0xFFFFFFFF


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation of the 32-bit values: a fixed bijection made of odd factors and shifts."""
    x ^= x >> U32(16)
    x *= U32(0x85EBCA6B)
    x ^= x >> U32(13)
    x *= U32(0xC2B2AE35)
    x ^= x >> U32(16)
    return x


def circulant_signature(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates for each document: shingles are permuted once, and the second permutation, shifted
    circularly by 0, 1, 2 ... places, gives one minimum each. Documents without shingles get EMPTY everywhere."""
    out = np.full((len(at) - 1, size), EMPTY, U32)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        placed = ((values * U64(0xA24BAED4963EE407) + U64(0x9FB21C651E98DF25)) >> U64(32)).astype(U32)
        for j in range(size):
            out[some, j] = np.minimum.reduceat(_second(placed + U32(j)), at[some])
    return out


def set_key(shingles: np.ndarray) -> bytes:
    """Equal exactly for equal shingle sets, up to collisions of 128 bits."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def sketches(docs: DataFrame, k: int = 5, lower: bool = True, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, key, bytes) of each row of ``docs(doc_id, text)``; null texts have no shingles. ``bytes`` has
    the low byte of each coordinate: ``rows`` of them make a band."""
    size = rows * bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in shingle_sets(batch.column("text"), k, lower):
                count = np.array([len(s) for s in sets], np.int64)
                at = np.concatenate([[0], np.cumsum(count)])
                signature = circulant_signature(np.concatenate(sets), at, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, len(sets)),
                        pa.array(count),
                        pa.array([set_key(s) for s in sets], pa.binary()),
                        pa.array([x.tobytes() for x in signature.astype(np.uint8)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "key", "bytes"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, key binary, bytes binary")


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, lower: bool = True, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents link when 100 * |intersection| >= percent * |union| of their distinct ``k``-word shingles, confirmed
    on the full sets. A pair at similarity s misses all bands with probability (1 - s**rows)**bands: 2e-7 at 0.85
    and 1e-4 at 0.8 with the defaults. A document's result depends on all others, but on no order of rows. Null and empty texts, and texts without words, have no shingles and link
    with nothing. Equal texts, ties and repeated rows fall in one class. An empty table gives no rows. Columns
    other than doc_id and text are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = stage(sketches(docs, k, lower, rows, bands), "sketches")
    found = near_components(sketched, docs, percent, k, lower, rows, bands)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates at 85 per cent over all of ``documents``: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)
