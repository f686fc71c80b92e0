"""Operator 1: document fingerprints by MinHash with universal hash permutations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .circulant import set_key
from .near import near_components
from .shared import drop, release, stage, table, width
from .text import U64, shingle_sets, shingles, slices

PERMUTATIONS = 128
#: Coordinates of a band and bands, for links at 0.8.
ROWS, BANDS = 6, 51
EMPTY = 0xFFFFFFFF


def permutations(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of the universal hashes x -> (a * x + b) mod 2**64, read from the high bits."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, count, dtype=U64) * U64(2) + U64(1), rng.integers(0, 2**63, count, dtype=U64)


def signatures(values: np.ndarray, at: np.ndarray, count: int = PERMUTATIONS) -> np.ndarray:
    """MinHash signatures (uint32) of documents whose shingles are ``values[at[i]:at[i + 1]]``."""
    out = np.full((len(at) - 1, count), EMPTY, np.uint32)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        for j, (a, b) in enumerate(zip(*permutations(count), strict=True)):
            out[some, j] = np.minimum.reduceat(values * a + b, at[some]) >> U64(32)
    return out


def of_texts(column: pa.Array, k: int, count: int = PERMUTATIONS) -> np.ndarray:
    parts = []
    for s in slices(column):
        parts.append(signatures(*shingles(s.hashes(), s.first, k), count))
    return np.concatenate(parts) if parts else np.zeros((0, count), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal coordinates: an estimate of the Jaccard similarity."""
    return (a == b).mean(axis=-1)


def in_order(docs: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, text, tail) dealt into ranges of doc_id and sorted, each range followed by a tail row: the row
    that comes after the range, or the very first after the last range.

    Rows of ``links(doc_id, digest, component)`` go to the range of their doc_id and stand there ahead of its texts;
    digest is null in rows of texts. One shuffle of the texts. The cuts come from quantiles of doc_id alone, and the driver gets one number a range.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_key"), "doc_id", "text")
    n = width(spark)
    cuts = sorted({int(x) for x in docs.select(F.percentile_approx("_key", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []})
    inner = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def part(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(inner, key.to_numpy(), "right").astype(np.int32))

    heads = [(r["part"], r["low"]) for r in docs.select("_key").groupBy(part("_key").alias("part")).agg(F.min("_key").alias("low")).orderBy("part").collect()]
    before = {low: heads[i - 1][0] for i, (_, low) in enumerate(heads)}
    placed = docs.withColumn("_part", part("_key"))
    none = F.lit(None).cast("long")
    if not before:
        return placed.select("_key", "doc_id", "text", F.lit(False).alias("tail"), none.alias("digest"), none.alias("component"))
    previous = F.create_map(*[F.lit(x) for low, p in before.items() for x in (low, p)])
    homes = F.array(F.struct(F.col("_part").alias("part"), F.lit(False).alias("tail")))
    extra = F.array(F.struct(F.col("_part").alias("part"), F.lit(False).alias("tail")), F.struct(previous[F.col("_key")].alias("part"), F.lit(True).alias("tail")))
    dealt = placed.withColumn("_to", F.explode(F.when(F.col("_key").isin(list(before)), extra).otherwise(homes)))
    dealt = dealt.select("_key", "doc_id", "text", F.col("_to.tail").alias("tail"), none.alias("digest"), none.alias("component"), F.col("_to.part").alias("part"))
    if links is not None:
        own = links.select(F.col("doc_id").alias("_key"), "doc_id", F.lit(None).cast("string").alias("text"), F.lit(False).alias("tail"), "digest", "component")
        dealt = dealt.unionByName(own.withColumn("part", part("_key")))
    return dealt.repartitionById(len(cuts) + 1, F.col("part")).drop("part").sortWithinPartitions("tail", "_key", F.col("digest").isNull(), "text")


def digest(text: str) -> int:
    """A signed 64-bit hash that tells texts of one doc_id apart."""
    return int.from_bytes(xxhash.xxh3_64_digest(text.encode()), "big", signed=True)


def fingerprints(docs: DataFrame, k: int = 5, links: DataFrame | None = None) -> DataFrame:
    """Fingerprint every text and its edited text, and compare each with the edited and with the next text.

    Fingerprints are hexadecimal MinHash signatures over ``k``-word shingles of the whole text; a text of fewer
    words is one shingle. Null texts count as empty; texts without words share one fingerprint, which is like only
    itself. Rows without doc_id come first in the order; rows of equal doc_id are ordered by text. A table of one
    row is its own next; an empty table gives no rows. Other columns are not looked at.

    ``links(doc_id, digest, component)`` has the rows, by doc_id and digest of the text, that belong to a component
    of another doc_id. With it, component_id and kept follow: all other rows are their own component and kept.
    """
    linked = links is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row that still waits for the next one
        over = False
        parts: dict[tuple[int, int], int] = {}  # of the range; its links stand ahead of their texts
        for batch in batches:
            if linked:
                told = batch.filter(pc.is_valid(batch.column("digest")))
                parts.update(zip(zip(told.column("doc_id").to_pylist(), told.column("digest").to_pylist()), told.column("component").to_pylist()))
                batch = batch.filter(pc.is_null(batch.column("digest")))
            ids, tails = batch.column("doc_id").to_pylist(), batch.column("tail").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if any(tails):  # of several rows that tie at the head of the next range, the first comes next
                end = tails.index(True) + 1
                end = end if not over else 0
                over = True
                ids, texts = ids[:end], texts[:end]
            if not ids:
                continue
            own = of_texts(pa.array(texts, pa.large_string()), k)
            if held:
                ids, texts, own = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], own])
            held = ids[-1], texts[-1], own[-1:]
            n = len(ids) - 1
            edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(texts[:n], texts[1:], strict=True)]
            other = of_texts(pa.array(edited, pa.large_string()), k)
            extra = []
            if linked:
                component = [parts.get((i, digest(t)), i) for i, t in zip(ids[:n], texts[:n], strict=True)]
                extra = [pa.array(component, pa.int64()), pa.array([c == i for c, i in zip(component, ids[:n], strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[:n], pa.int64()),
                    pa.array([len(t) for t in texts[:n]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array([x.astype(">u4").tobytes().hex() for x in own[:n]], pa.string()),
                    pa.array([x.astype(">u4").tobytes().hex() for x in other], pa.string()),
                    pa.array(likeness(own[:n], other), pa.float64()),
                    pa.array(likeness(own[:n], own[1:]), pa.float64()),
                    *extra,
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "component_id", "kept"][: 7 + len(extra)],
            )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, links).mapInArrow(run, schema + ", component_id long, kept boolean" * linked)


def linked_sketches(docs: DataFrame, percent: int, k: int, rows: int, bands: int) -> DataFrame:
    """(doc_id, n_shingles, digest, component_id, kept) of each row of ``docs``; see near_links."""
    size = rows * bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in shingle_sets(batch.column("text"), k, False):
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                signature = signatures(np.concatenate(sets), at, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, len(sets)),
                        pa.array(np.diff(at)),
                        pa.array([digest(t or "") for t in batch.column("text").slice(lo, len(sets)).to_pylist()], pa.int64()),
                        pa.array([set_key(s) for s in sets], pa.binary()),
                        pa.array([x.tobytes() for x in signature.astype(np.uint8)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "digest", "key", "bytes"],
                )

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sketched = stage(docs.mapInArrow(run, "doc_id long, n_shingles long, digest long, key binary, bytes binary"), "sketches")
    return near_components(sketched, docs, percent, k, False, rows, bands)


def near_links(docs: DataFrame, percent: int = 80, k: int = 5, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: bands of the MinHash signature joined, Jaccard verified on full sets.

    Null, empty and wordless texts link with nothing; equal texts are one class; an empty table gives no rows. A pair
    at similarity s shares no band with probability (1 - s**rows)**bands: 2e-7 at 0.8 with the defaults.
    """
    return linked_sketches(docs, percent, k, rows, bands).select("doc_id", "n_shingles", "component_id", "kept")


def linked_fingerprints(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """The rows of fingerprints, with component_id and kept of near_links, which is done first: its intermediate
    tables and shuffles are gone when the texts are put in order."""
    found = linked_sketches(docs, percent, k, ROWS, BANDS)
    moved = stage(found.where("not kept").select("doc_id", "digest", F.col("component_id").alias("component")).distinct(), "moved")
    drop(*found._reads)
    release(docs.sparkSession, 3)
    return fingerprints(docs, k, moved)


def op1_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """linked_fingerprints over all of ``documents``, with links at 80 per cent."""
    return linked_fingerprints(table(spark, sf_dir, "documents"))
