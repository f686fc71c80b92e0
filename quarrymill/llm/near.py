"""From signature bands to exact links: bucket stars, verification on full shingle sets, and the pairs that remain.

``sketches``: (doc_id long, n_shingles long, key binary, bytes binary), one row per document; ``key`` is equal
exactly for equal shingle sets, ``bytes`` has the low byte of each signature coordinate. Documents of one key form
a class, represented by its smallest doc_id, and only representatives are compared.

1. Bands are runs of signature bytes. They are exploded and joined a few bands at a time, and shuffles are released
   between, so that the disk holds a part of them at once. Members of a band value make a bucket.
2. Every bucket links its members to one pivot, so a bucket of n members makes n - 1 candidates. The pivot is the
   member that meets the most others over all its buckets: in a group of edited copies, the text in their middle,
   which links them all.
3. Candidates are verified on whole shingle sets. The pivot's set goes once to each block of its members.
4. Two members of a bucket that no verified link connects by now may still be similar to each other. Signatures
   say which members can have such a partner. Their shingle sets meet in blocks, every pair of which is compared
   inside one task that keeps account of components and gives a row only for a link that joins two of them:
   n - 1 rows at most for n members, however dense the group.

So no pair is lost that shares a band; members that are connected already are not compared again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import drop, release, sift, stage, width
from .text import shingle_sets

#: Members that share one copy of their pivot's text.
BLOCK = 256
#: Members of a bucket, and shingles of them, whose sets or signatures are compared with each other at a time.
CROSS, CROSS_SHINGLES = 1024, 1 << 20
#: Bands that are joined at a time.
AT_ONCE = 13


def verified(pairs: DataFrame, docs: DataFrame, percent: int, k: int, lower: bool) -> DataFrame:
    """``pairs(pivot, member)`` -> the same with ``linked``: 100 * intersection >= percent * union of shingle sets.

    Members meet their pivot in blocks of about BLOCK, each with its own copy of the pivot's text, sorted before
    the members; a task holds one set at a time beside a batch.
    """
    spark = pairs.sparkSession
    size = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = pairs.join(size, "pivot").select("pivot", "member", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int").alias("block"))
    roles = members.select(F.col("member").alias("_id"), "pivot", "block", F.lit(1).alias("role")).unionByName(
        size.select(F.col("pivot").alias("_id"), "pivot", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"), F.lit(0).alias("role"))
    )
    texts = sift(docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")), "_id", roles.select("_id").distinct())
    met = roles.join(texts, "_id").repartition(width(spark), "pivot", "block").sortWithinPartitions("pivot", "block", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = None, None
        for batch in batches:
            pivot, block, role, ident = (batch.column(c).to_pylist() for c in ("pivot", "block", "role", "_id"))
            out: tuple[list, list, list] = ([], [], [])
            for lo, sets in shingle_sets(batch.column("_text"), k, lower):
                for i, own in enumerate(sets, lo):
                    if role[i] == 0:
                        at, base = (pivot[i], block[i]), own
                        continue
                    assert at == (pivot[i], block[i])
                    small, large = (own, base) if len(own) <= len(base) else (base, own)
                    if 100 * len(small) < percent * len(large) or not len(small):
                        linked = False
                    else:
                        where = np.minimum(np.searchsorted(large, small), len(large) - 1)
                        both = int((large[where] == small).sum())
                        linked = 100 * both >= percent * (len(small) + len(large) - both)
                    for values, value in zip(out, (pivot[i], ident[i], linked), strict=True):
                        values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_())], ["pivot", "member", "linked"])

    return met.select("pivot", "block", "role", "_id", "_text").mapInArrow(run, "pivot long, member long, linked boolean")


def buckets(reps: DataFrame, rows: int, bands: int) -> DataFrame:
    """(band, doc_id, n) of ``reps(doc_id, bytes)``: every band value that several of them have, with their number.

    ``band`` hashes the ``rows`` bytes of the band; its low byte is the number of the band, below 256. Values are counted with partial aggregation; one
    that very many documents share is then a skewed sort-merge join, which adaptive execution splits.
    """
    out = []
    for lo in range(0, bands, AT_ONCE):
        keys = [F.xxhash64(F.substring("bytes", b * rows + 1, rows)).bitwiseAND(F.lit(-256)).bitwiseOR(F.lit(b)) for b in range(lo, min(bands, lo + AT_ONCE))]
        each = reps.select("doc_id", F.explode(F.array(*keys)).alias("band"))
        shared = each.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
        out.append(stage(each.join(shared, "band"), "members"))
        release(reps.sparkSession)
    together = reduce(DataFrame.unionByName, out)
    together._parts = out
    return together


def near_components(sketches: DataFrame, docs: DataFrame, percent: int, k: int, lower: bool, rows: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and the other columns of ``sketches``, but key and bytes.

    The sketches, a staged table, are dropped; ``_reads`` of the result lists the staged tables that it reads. Rows without a doc_id or shingles link with nothing; component_id is
    their own doc_id and kept is true. Repeated rows of a doc_id share its fate; if their texts differ, each
    row goes by its own text.
    """
    spark = sketches.sparkSession
    # signatures that agree in five standard deviations less than the threshold rule a pair out in step 4
    least = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / (rows * bands)) ** 0.5
    plain = stage(sketches.drop("bytes"), "documents")
    usable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    several = plain.where(usable).groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("doc_id", F.lit(True).alias("_several"))
    if not several.isEmpty():
        return _by_text(sketches, docs, stage(several, "several"), percent, k, lower, rows, bands)
    classes = stage(sketches.where(usable).groupBy("key").agg(F.min(F.struct("doc_id", "bytes", "n_shingles")).alias("_rep")).select("key", "_rep.*"), "classes")
    drop(sketches)
    release(spark)
    members = buckets(classes.select("doc_id", "bytes"), rows, bands)
    popular = members.groupBy("doc_id").agg(F.sum("n").alias("popularity"))
    ranked = members.join(popular, "doc_id").select("band", "doc_id", F.struct("popularity", -F.col("doc_id")).alias("order"))
    pivots = ranked.groupBy("band").agg(F.max("order").alias("top")).select("band", (-F.col("top.col2")).alias("pivot"))
    pairs = stage(members.select("band", "doc_id").join(pivots, "band").where("doc_id <> pivot").select("pivot", F.col("doc_id").alias("member")).distinct(), "pairs")
    release(spark)
    tested = stage(verified(pairs, docs, percent, k, lower).where("linked"), "tested")
    release(spark)
    parts = stage(components(tested.select(F.col("pivot").alias("a"), F.col("member").alias("b"))), "parts")
    release(spark)
    open_ = stage(_open(members, classes, parts, least, rows), "open")
    release(spark)
    if not open_.isEmpty():
        more = stage(_joining(open_, docs, parts, percent, k, lower), "joining")
        if not more.isEmpty():
            known = parts.select(F.col("id").alias("a"), F.col("component").alias("b"))
            again = stage(components(known.unionByName(more)), "parts")
            drop(parts)
            parts = again
        drop(more)
    reps = stage(classes.select("key", F.col("doc_id").alias("rep")), "reps")
    drop(pairs, tested, open_, classes, *members._parts)
    release(spark)
    named = reps.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))
    joined = plain.join(named, "key", "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
    out = joined.withColumn("component_id", component).withColumn("kept", F.coalesce(component == F.col("doc_id"), F.lit(True))).drop("component", "key")
    out._reads = [plain, reps, parts]
    return out


def _by_text(sketches: DataFrame, docs: DataFrame, several: DataFrame, percent: int, k: int, lower: bool, rows: int, bands: int) -> DataFrame:
    """near_components where texts of some doc_ids differ: each text of those is told apart by a number below 0 made of
    doc_id and key, and components are named by real doc_ids at the end."""
    from .circulant import set_key

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in shingle_sets(batch.column("text"), k, lower):
                piece = batch.slice(lo, len(sets))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array([set_key(s) for s in sets], pa.binary())], ["doc_id", "text", "key"])

    def numbered(frame: DataFrame) -> DataFrame:
        own = F.when(F.col("_several"), F.lit(-1) - F.pmod(F.xxhash64("doc_id", "key"), F.lit(1 << 62))).otherwise(F.col("doc_id"))
        return frame.join(several, "doc_id", "left").withColumn("_doc", F.col("doc_id")).withColumn("doc_id", own).drop("_several")

    texts = stage(numbered(docs.select("doc_id", "text").mapInArrow(keyed, "doc_id long, text string, key binary")).select("doc_id", "text"), "texts")
    each = near_components(stage(numbered(sketches), "sketches"), texts, percent, k, lower, rows, bands)
    found = stage(each, "found")
    drop(sketches, several, texts, *each._reads)
    low = found.where("doc_id is not null").groupBy("component_id").agg(F.min("_doc").alias("_low"))
    named = found.join(low, "component_id", "left").withColumn("doc_id", F.col("_doc")).withColumn("component_id", F.when(F.col("_doc").isNotNull(), F.col("_low")))
    out = named.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))).drop("_doc", "_low")
    out._reads = [found]
    return out


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (band, doc_id, n_shingles, ...) -> copies for every pair of blocks (i, j) of their band, with ``own`` one of
    the two. A band has a block for CROSS members or CROSS_SHINGLES shingles of them."""
    sizes = rows.groupBy("band").agg(F.ceil(F.greatest(F.count("*") / CROSS, F.sum("n_shingles") / CROSS_SHINGLES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    each = rows.join(sizes, "band").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(width(rows.sparkSession), "band", "i", "j").sortWithinPartitions("band", "i", "j")


def _grouped(compare, columns: list[str]):
    """For mapInPandas: ``compare`` on each run of rows of one (band, i, j). Parts of a run are gathered, a run at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in frames:
            key = pdf[["band", "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            if held and not (held[0][["band", "i", "j"]].to_numpy()[0] == key[0]).all():
                yield pd.DataFrame(compare(pd.concat(held, ignore_index=True)), columns=columns)
                held = []
            out = []
            for a, b in zip(starts, starts[1:], strict=False):
                out.append(compare(pd.concat([*held, pdf.iloc[a:b]], ignore_index=True)))
                held = []
            held.append(pdf.iloc[starts[-1] :])
            if out:
                yield pd.DataFrame(np.concatenate(out), columns=columns)
        if held:
            yield pd.DataFrame(compare(pd.concat(held, ignore_index=True)), columns=columns)

    return run


def _sides(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the left and of the right block; they are the same block if the last is true."""
    own, i = group["own"].to_numpy(), group["i"].iat[0]
    if i == group["j"].iat[0]:
        return np.arange(len(group)), np.arange(len(group)), True
    return np.flatnonzero(own == i), np.flatnonzero(own != i), False


def _open(members: DataFrame, classes: DataFrame, parts: DataFrame, least: float, width_: int) -> DataFrame:
    """(band, doc_id, n_shingles, component): members of a bucket that may be similar to a member of another component,
    by signature bytes that agree in ``least`` of places. A pair that shares several bands counts in the first.

    Only buckets of three or more members in several components are looked at. Signatures are compared block against
    block; a task gives one row for each member at most.
    """
    known = members.select("band", "doc_id").join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = known.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high and n > 2")
    rows = known.join(mixed.select("band"), "band").join(classes.select("doc_id", "n_shingles", "bytes"), "doc_id")

    def compare(group: pd.DataFrame) -> np.ndarray:
        x = np.frombuffer(b"".join(group["bytes"]), np.uint8).reshape(len(group), -1)
        columns = group[["band", "doc_id", "n_shingles", "component"]].to_numpy(np.int64)
        part = columns[:, 3]
        left, right, _ = _sides(group)
        use = np.zeros(len(x), bool)
        before = x[:, : (int(columns[0, 0]) & 255) * width_]  # of the bands ahead of this one
        for at in left:
            to = right[part[right] != part[at]]
            to = to[(x[to] == x[at]).mean(axis=1) >= least] if len(to) else to
            if len(to) and before.shape[1]:
                same = (before[to] == before[at]).reshape(len(to), -1, width_).all(axis=2).any(axis=1)
                to = to[~same]
            use[to] = True
            use[at] |= len(to) > 0
        return columns[use]

    names = ["band", "doc_id", "n_shingles", "component"]
    return _dealt(_blocks(rows)).mapInPandas(_grouped(compare, names), "band long, doc_id long, n_shingles long, component long").distinct()


def joining(sets: list[np.ndarray], part: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, percent: int) -> list[tuple[int, int]]:
    """Pairs (row, row) of sets similar to ``percent`` that join two parts, one for each join; ``part`` numbers them."""
    up = np.unique(part, return_inverse=True)[1]
    size = np.array([len(s) for s in sets], np.int64)
    at_right = np.concatenate([[0], np.cumsum(size[right])])
    values, code = np.unique(np.concatenate([sets[r] for r in right]), return_inverse=True)
    out = []
    mark = np.zeros(len(values) + 1, np.int64)
    for a in left:
        other = (up[right] != up[a]) & (100 * np.minimum(size[right], size[a]) >= percent * np.maximum(size[right], size[a])) & (size[right] > 0)
        if same:
            other &= right > a
        if not other.any():
            continue
        where = np.searchsorted(values, sets[a])
        where = where[values[np.minimum(where, len(values) - 1)] == sets[a]]
        mark[where] = 1
        both = np.add.reduceat(np.append(mark[code], 0), at_right[:-1])
        mark[where] = 0
        for b in np.flatnonzero(other & (100 * both >= percent * (size[right] + size[a] - both))):
            x, y = up[a], up[right[b]]
            if x != y:
                out.append((a, right[b]))
                up[up == max(x, y)] = min(x, y)
    return out


def _joining(rows: DataFrame, docs: DataFrame, parts: DataFrame, percent: int, k: int, lower: bool) -> DataFrame:
    """(a, b): links between members of different components of a bucket, verified on full shingle sets; enough of them
    to join all that are linked."""

    places = _blocks(rows).select("doc_id", F.struct("band", "i", "j", "own", "component").alias("place")).groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    names = ["band", "i", "j", "own", "component"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in shingle_sets(batch.column("text"), k, lower):
                own = batch.column("places").slice(lo, len(sets))
                at, flat = np.repeat(np.arange(len(sets)), np.diff(own.offsets.to_numpy())), own.flatten()
                raw = pa.array([s.tobytes() for s in sets], pa.binary())
                for a in range(0, len(at), 256):
                    some = pa.array(at[a : a + 256])
                    columns = dict(zip((f.name for f in flat.type), flat.slice(a, 256).flatten(), strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(sets)).take(some), raw.take(some), *(columns[c] for c in names)], ["doc_id", "shingles", *names])

    texts = sift(docs.select("doc_id", "text"), "doc_id", places.select("doc_id")).dropDuplicates(["doc_id"])
    sets = texts.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(hashed, "doc_id long, shingles binary, band long, i int, j int, own int, component long")

    def compare(group: pd.DataFrame) -> np.ndarray:
        ids = group["doc_id"].to_numpy()
        found = joining([np.frombuffer(x, np.uint64) for x in group["shingles"]], group["component"].to_numpy(), *_sides(group), percent)
        return np.array([(ids[a], ids[b]) for a, b in found], np.int64).reshape(-1, 2)

    return _dealt(sets).mapInPandas(_grouped(compare, ["a", "b"]), "a long, b long").distinct()
