"""Operator 2: packing into length buckets whose boundaries minimise padding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stage, table, width
from .text import slices

#: Lengths up to 2**EXACT are told apart exactly; longer ones in cells of a 2**(EXACT - 1)th or less.
EXACT = 11
BUCKETS, BUDGET = 8, 16384


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): the number of words of each whole text; null texts have none. Very long texts count in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s.lo, s.hi - s.lo), pa.array(np.diff(s.first).astype(np.int64))], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def boundaries(sizes: np.ndarray, counts: np.ndarray, totals: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """The boundaries, of at most ``buckets`` buckets, with the least padding, and that padding.

    ``sizes`` ascend; ``counts`` rows, of ``totals`` tokens together, are to be padded to at least that size. A
    boundary is a size. Dynamic programming: the best way to end a bucket at each size, with one more bucket each round.
    """
    m = len(sizes)
    rows, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(totals)])
    best = np.concatenate([[0.0], np.full(m, np.inf)])
    back: list[np.ndarray] = []
    for _ in range(min(buckets, m)):
        nxt, came = best.copy(), np.full(m + 1, -1)
        for j in range(1, m + 1):
            cost = best[:j] + sizes[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            i = int(np.argmin(cost))
            if cost[i] < nxt[j]:
                nxt[j], came[j] = cost[i], i
        best = nxt
        back.append(came)
    out, at = [], m
    for came in back[::-1]:
        if at and came[at] >= 0:
            out.append(int(sizes[at - 1]))
            at = int(came[at])
    return out[::-1], int(best[m]) if m else 0


def pack(measured: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, n_tokens) -> the same with bucket, boundary, batch, slot and padding.

    The histogram of all lengths, in the cells of EXACT, is gathered on the driver: at most 2**EXACT +
    2**(EXACT - 1) cells for each further doubling, however many rows there are. The size of a cell is its longest
    row, so a boundary is a length that occurs and no row is padded beyond the longest of its bucket. A batch of a bucket holds
    budget // boundary rows, one at least, each padded to the boundary; a row longer than the budget is a batch of
    its own bucket's rule and is never cut. Within a bucket rows stand in the order of a hash of doc_id, numbered by
    parts: a bucket that holds most rows is many parts, and the table of part counts is a few for each partition.

    Null lengths count as 0; rows of equal or null doc_id all get places. An empty table gives no rows.
    """
    spark = measured.sparkSession
    measured = stage(measured.select("doc_id", "n_tokens"), "lengths")  # texts are read once, their lengths three times
    rows = measured.select("doc_id", F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.lit(0)).alias("n_tokens"))
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))) - EXACT + 1)).cast("long")
    rows = rows.withColumn("_size", (F.ceil(F.col("n_tokens") / step) * step).cast("long"))
    cells = rows.groupBy("_size").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest")).toPandas().sort_values("_size")
    sizes, counts = cells["longest"].to_numpy(np.int64), cells["n"].to_numpy(np.int64)
    ends, _ = boundaries(sizes, counts, cells["tokens"].to_numpy(np.int64), buckets)
    goal, total = 4 * width(spark), max(1, int(counts.sum()))
    bucket = F.lit(len(ends))
    for i in range(len(ends) - 1, -1, -1):
        bucket = F.when(F.col("n_tokens") <= ends[i], F.lit(i)).otherwise(bucket)
    held = [int(counts[(sizes <= e) & (sizes > b)].sum()) for b, e in zip([-1, *ends], ends, strict=False)]
    facts = spark.createDataFrame([(i, e, max(1, budget // max(e, 1)), max(1, -(-n * goal // total))) for i, (e, n) in enumerate(zip(ends, held, strict=True))], "bucket int, boundary long, room long, parts int")
    placed = rows.withColumn("bucket", bucket.cast("int")).join(F.broadcast(facts), "bucket").withColumn("_hash", F.xxhash64("doc_id"))
    placed = placed.withColumn("_part", F.floor(F.shiftrightunsigned("_hash", 33) / F.lit(float(1 << 31)) * F.col("parts")).cast("int"))
    by_part = placed.groupBy("bucket", "_part").agg(F.count("*").alias("n"))
    running = Window.partitionBy("bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = by_part.select("bucket", "_part", (F.sum("n").over(running) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("bucket", "_part").orderBy("_hash", "doc_id", "n_tokens"))
    placed = placed.withColumn("_own", own).join(F.broadcast(before), ["bucket", "_part"]).withColumn("_rank", F.col("before") + F.col("_own") - 1)
    return placed.select(
        "doc_id", "n_tokens", "bucket", "boundary", F.expr("_rank div room").cast("long").alias("batch"), F.expr("_rank % room").cast("int").alias("slot"), (F.col("boundary") - F.col("n_tokens")).alias("padding")
    )


def op2_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack over the lengths in words of all of ``documents``. Byte-level BPE lengths cost twice the CPU budget."""
    return pack(lengths(table(spark, sf_dir, "documents")))
