"""Operator 5: sharding by Hilbert-curve order over several metadata dimensions. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, width

#: Bits of each dimension on the curve. Three dimensions of 4 bits give 4096 cells.
BITS = 4


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """The place on the Hilbert curve of a point whose coordinates are integers below 2**bits.

    The transform works from the highest bit down: coordinates are exchanged or inverted in their low bits by what
    the higher bits say, then Gray-coded; the bits of all coordinates, interleaved, are the index.
    """
    n = len(dims)
    at = F.array(*[d.cast("int") for d in dims])
    xor = lambda x, y: x.bitwiseXOR(y)

    def by_dim(x: Column, b: Column, i: Column) -> Column:
        own, head = F.element_at(x, i + 1), F.element_at(x, 1)
        low = F.call_function("shiftleft", F.lit(1), b) - 1
        on = own.bitwiseAND(low + 1) != 0
        swap = xor(head, own).bitwiseAND(low)
        return F.transform(x, lambda v, j: F.when((j == 0) & on, xor(v, low)).when(~on & ((j == 0) | (j == i)), xor(v, swap)).otherwise(v))

    if bits > 1:
        steps = F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1))
        at = F.aggregate(steps, at, lambda x, b: F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), x, lambda y, i: by_dim(y, b, i)))
    # Gray code: each coordinate takes in all before it
    at = F.transform(at, lambda _, j: F.aggregate(F.slice(at, 1, j + 1), F.lit(0), xor))
    fix = F.aggregate(F.sequence(F.lit(bits), F.lit(1), F.lit(-1)), F.lit(0), lambda t, b: F.when((b > 1) & (F.element_at(at, n).bitwiseAND(F.call_function("shiftleft", F.lit(1), b - 1)) != 0), xor(t, F.call_function("shiftleft", F.lit(1), b - 1) - 1)).otherwise(t))
    at = F.transform(at, lambda v: xor(v, fix))
    bit = lambda v, b: F.call_function("shiftright", v, b).bitwiseAND(F.lit(1))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), F.lit(0), lambda out, b: F.aggregate(at, out, lambda o, v: F.shiftleft(o, 1).bitwiseOR(bit(v, b))))


def cells(bits: int = BITS) -> tuple[Column, Column, Column]:
    """Language, source and length (log scale), quantised."""
    top = (1 << bits) - 1
    lang = F.crc32(F.coalesce(F.col("lang").cast("string"), F.lit("")).cast("binary")).bitwiseAND(F.lit(top)).cast("int")
    source = F.crc32(F.coalesce(F.col("source").cast("string"), F.lit("")).cast("binary")).bitwiseAND(F.lit(top)).cast("int")
    length = F.least(F.lit(top), F.floor(F.log2(F.col("_size").cast("double"))) - F.lit(3)).cast("int")
    return lang, source, F.greatest(F.lit(0), length)


def shards(docs: DataFrame, count: int = 16, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert of each row.

    Law ``rows``: rows in Hilbert order are cut into ``count`` runs whose row counts differ by one at most. Within a
    cell of the curve rows stand in the order of a hash of doc_id and text, so a cell with very many rows spreads evenly over
    as many parts as it needs. Equal texts with equal metadata share a cell, and a shard but where a cut passes.

    Ranks come from counts: rows of each part are numbered by themselves, and the numbers of rows in earlier parts
    are added. Cells are at most 2**(3 * bits), and parts few more than four for each shuffle partition, so both
    count tables are of bounded size. One shuffle, of narrow rows without texts.

    Null texts have size 1 and the CRC of nothing; null languages and sources count as empty; rows of equal or
    null doc_id are numbered in any order among them. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", (F.octet_length(text) + 1).cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dims = cells(bits)
    narrow = docs.select("doc_id", F.col("_size").alias("size"), "text_crc32", *[d.alias(f"_d{i}") for i, d in enumerate(dims)])
    # the curve index of each distinct point is worked out once
    points = narrow.groupBy("_d0", "_d1", "_d2").agg(F.count("*").alias("n"))
    total = F.sum("n").over(_all())
    goal = 4 * width(spark)
    points = points.select("_d0", "_d1", "_d2", "n", hilbert_index([F.col(f"_d{i}") for i in range(3)], bits).alias("hilbert"), F.ceil(F.col("n") * goal / total).cast("int").alias("parts"))
    hashed = F.xxhash64("doc_id", "text_crc32", "size")
    placed = narrow.join(F.broadcast(points.drop("n")), ["_d0", "_d1", "_d2"]).withColumn("_hash", hashed)
    # the high bits of the hash name the part, so parts are in the order of the hash
    placed = placed.withColumn("_part", F.floor((F.shiftrightunsigned("_hash", 33)) / F.lit(float(1 << 31)) * F.col("parts")).cast("int"))
    by_part = placed.groupBy("hilbert", "_part").agg(F.count("*").alias("n"))
    before = by_part.select("hilbert", "_part", (F.sum("n").over(_ordered()) - F.col("n")).alias("before"), F.sum("n").over(_all()).alias("total"))
    ranked = placed.withColumn("_own", F.row_number().over(_within()))
    rank = F.col("before") + F.col("_own") - 1
    placed = ranked.join(F.broadcast(before), ["hilbert", "_part"]).withColumn("_rank", rank.cast("long"))
    # the first `wide` shards have one row more
    least, wide = F.expr(f"total div {count}"), F.expr(f"total % {count}")
    shard = F.when(F.col("_rank") < wide * (least + 1), F.expr(f"_rank div (total div {count} + 1)")).otherwise(wide + F.expr(f"(_rank - (total % {count}) * (total div {count} + 1)) div greatest(total div {count}, 1)"))
    placed = placed.withColumn("shard", shard.cast("int"))
    start = F.col("shard") * least + F.least(F.col("shard").cast("long"), wide)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_rank") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def _all():
    return Window.partitionBy()


def _ordered():
    return Window.orderBy("hilbert", "_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _within():
    return Window.partitionBy("hilbert", "_part").orderBy("_hash", "doc_id")


def write_shards(docs: DataFrame, path: str, count: int = 16, bits: int = BITS) -> None:
    """Write whole documents by shard in slot order, so that files prune on every dimension. Every row is written, also
    without doc_id and with a doc_id that others have: rows of one doc_id, checksum and size are dealt out by number."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = ["_id", "_crc", "_size", "_nth"]
    id_, crc, size = F.col("doc_id").cast("long"), F.crc32(text.cast("binary")), (F.octet_length(text) + 1).cast("long")
    nth = lambda *order: F.row_number().over(Window.partitionBy("_id", "_crc", "_size").orderBy(*order))
    placed = shards(docs, count, bits).select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), F.col("size").alias("_size"), "shard", "slot").withColumn("_nth", nth("shard", "slot"))
    own = docs.withColumns({"_id": id_, "_crc": crc, "_size": size}).withColumn("_nth", nth("lang", "source"))
    same = reduce(Column.__and__, [own[c].eqNullSafe(placed[c]) for c in names])
    joined = own.join(placed, same).select(*[own[c] for c in docs.columns], placed["shard"], placed["slot"])
    joined.repartitionByRange(count, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shards over all of ``documents``, law ``rows``, with the curve index as a column more."""
    return shards(table(spark, sf_dir, "documents"))
