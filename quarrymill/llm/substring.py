"""Operator 4: passages repeated across documents, by seed and extend on winnowed anchors.

1. Seeds. Anchors are runs of SEED words chosen by winnowing, so that every window of ``length`` words holds one,
   the same one wherever the window stands. Documents are joined on equal anchors.
2. The windows around shared anchors meet on a 64-bit print, which names the smallest doc_id that may have the
   window: its source. No pairs of documents are made, so a passage in m documents costs m rows.
3. Sources cut out the runs of windows that are asked for, in pieces of at most PIECE windows, and send their words
   to the documents that asked.
4. Extension. From each seed the words of document and piece are compared to the left and to the right as far as
   they agree; what is ``length`` words long at least is a repeat, and repeats that touch or overlap make a maximal
   one. Prints never decide: a window whose words differ from those of its source is looked up again by its words
   among all documents that have the print.

Documents of equal words are told apart from others by SHA-256 first: all but the one of smallest doc_id are repeats
as a whole and send no windows. Anchors and prints are joined a part of their values at a time, and shuffles are
released between, so that the disk holds one part at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop, release, sieve, sift, stage, table
from .text import U64, Slice, runs, slices

#: Words in an anchor; at most half of a window.
SEED = 7
#: Windows in a piece, and parts of the values that are joined one after the other.
PIECE, PARTS = 64, 4


class Windows:
    """The ``length``-word windows of a slice of documents: where they start, in which document, and their prints."""

    def __init__(self, s: Slice, length: int, bits: int = 64):
        self.words, self.length, self.bits = s.hashes(), length, bits
        words_in = np.diff(s.first)
        doc = np.repeat(np.arange(len(words_in)), words_in)
        at = np.arange(max(0, len(self.words) - length + 1))
        self.at = at[at + length <= s.first[doc[: len(at)] + 1]] if len(at) else at
        self.doc = doc[self.at] if len(at) else at

    def anchors(self, seed: int) -> np.ndarray:
        """The winnowed anchor of each window."""
        grams, span = runs(self.words, seed), self.length - seed + 1
        if not len(self.at):
            return np.zeros(0, np.int64)
        view = np.lib.stride_tricks.sliding_window_view(grams, span)
        chosen = self.at + span - 1 - np.argmin(view[self.at][:, ::-1], axis=1)  # the last smallest
        return grams[chosen].view(np.int64)

    def prints(self) -> np.ndarray:
        return (runs(self.words, self.length)[self.at] >> U64(64 - self.bits)).view(np.int64)


def _by_doc(doc: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """The distinct values of each of ``n`` documents."""
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[new], np.arange(n + 1)).astype(np.int32)), pa.array(values[new], pa.int64()))


def _among(doc: np.ndarray, values: np.ndarray, allowed: list[list[int] | None]) -> np.ndarray:
    """Which values are in their document's own list."""
    use = np.zeros(len(values), bool)
    bounds = np.searchsorted(doc, np.arange(len(allowed) + 1))
    for i, some in enumerate(allowed):
        if some and bounds[i] < bounds[i + 1]:
            use[bounds[i] : bounds[i + 1]] = np.isin(values[bounds[i] : bounds[i + 1]], np.array(some, np.int64))
    return use


def _raw(s: Slice, i: int) -> bytes:
    return s.data[s.offsets[i] : s.offsets[i + 1]].tobytes()


def _digest(raw: bytes) -> bytes:
    """Of the words, whatever stands between them."""
    return hashlib.sha256(b" ".join(raw.split())).digest()


def seeds(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(doc_id, digest, found): the anchors of each document of ``length`` words or more, and the digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                w = Windows(s, length)
                n = s.hi - s.lo
                use = np.flatnonzero(np.diff(s.first) >= length)
                ids = batch.column("doc_id").slice(s.lo, n)
                found = _by_doc(w.doc, w.anchors(seed), n)
                yield pa.RecordBatch.from_arrays([ids.take(use), pa.array([_digest(_raw(s, i)) for i in use], pa.binary()), found.take(use)], ["doc_id", "digest", "found"])

    return docs.mapInArrow(run, "doc_id long, digest binary, found array<long>")


def _met(found: DataFrame, part: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, value) of a part of the values, and (value, low) of those in two rows at least, low the smallest doc_id.

    Values are counted with partial aggregation; a value that very many documents share is then a skewed
    sort-merge join, which adaptive execution splits.
    """
    own = F.filter("found", lambda x: F.pmod(x, F.lit(PARTS)) == part)
    each = found.select("doc_id", F.explode(own).alias("value"))
    return each, each.groupBy("value").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1").select("value", "low")


def _in_parts(found: DataFrame, pick, tag: str) -> DataFrame:
    """``pick`` of the two tables of _met, a part after the other; ``_parts`` of the result lists what is staged."""
    out = []
    for part in range(PARTS):
        each, low = _met(found, part)
        out.append(stage(pick(each.join(low, "value")), tag))
        release(found.sparkSession)
    together = reduce(DataFrame.unionByName, out)
    together._parts = out
    return together


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted(doc_id, ...)`` with the text of each row of that doc_id."""
    return sift(docs.select("doc_id", "text"), "doc_id", wanted.select("doc_id")).join(wanted, "doc_id")


def windows(docs: DataFrame, shared: DataFrame, copies: DataFrame, length: int, seed: int, bits: int) -> DataFrame:
    """(doc_id, found): prints of the windows around shared anchors, of texts that are not copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, gone = batch.column("anchors").to_pylist(), batch.column("copies").to_pylist()
            for s in slices(batch.column("text")):
                w = Windows(s, length, bits)
                n = s.hi - s.lo
                allowed = [None if gone[s.lo + i] and _digest(_raw(s, i)) in gone[s.lo + i] else own[s.lo + i] for i in range(n)]
                use = _among(w.doc, w.anchors(seed), allowed)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s.lo, n), _by_doc(w.doc[use], w.prints()[use], n)], ["doc_id", "found"])

    met = _texts(docs, shared.join(copies, "doc_id", "left"))
    return met.select("doc_id", "text", "anchors", "copies").mapInArrow(run, "doc_id long, found array<long>").where("size(found) > 0")


def pieces(docs: DataFrame, wanted: DataFrame, length: int, bits: int) -> DataFrame:
    """(low, piece, words, found): of each source the runs of windows that are asked for by ``wanted(doc_id, prints)``,
    as words joined by one space, in pieces of at most PIECE windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asked = batch.column("doc_id").to_pylist(), batch.column("prints").to_pylist()
            for s in slices(batch.column("text")):
                w = Windows(s, length, bits)
                prints = w.prints()
                use = np.flatnonzero(_among(w.doc, prints, asked[s.lo : s.hi]))
                # a run ends where the next window does not follow in the same document, and a piece after PIECE windows
                step = np.r_[True, (np.diff(w.at[use]) != 1) | (np.diff(w.doc[use]) != 0)] if len(use) else np.zeros(0, bool)
                start = np.maximum.accumulate(np.where(step, np.arange(len(use)), 0))
                cuts = np.flatnonzero((np.arange(len(use)) - start) % PIECE == 0)
                low, name, words, found = [], [], [], []
                for a, b in zip(cuts, np.append(cuts[1:], len(use)), strict=True):
                    raw = b" ".join(s.word(j) for j in range(w.at[use[a]], w.at[use[b - 1]] + length))
                    low.append(ids[s.lo + w.doc[use[a]]])
                    name.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                    words.append(raw)
                    found.append(np.unique(prints[use[a:b]]))
                yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(name, pa.int64()), pa.array(words, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["low", "piece", "words", "found"])

    return _texts(docs, wanted).select("doc_id", "text", "prints").mapInArrow(run, "low long, piece long, words binary, found array<long>")


def extend(words: list[bytes], prints: np.ndarray, given: list[bytes], exact: set[bytes], length: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of a document are repeats, and the prints of those that look so but have other words.

    ``given`` are pieces of sources. A window and a piece's window of one print are a seed; from there words are
    compared to either side as far as they agree. ``exact`` has the words of further windows that are repeats.
    """
    ok = np.zeros(len(prints), bool)
    seeds_of: dict[int, list[tuple[list[bytes], int]]] = {}
    if given:
        for s in slices(pa.array(given, pa.binary()).cast(pa.large_string())):
            w = Windows(s, length, bits)
            split = [g.split(b" ") for g in given[s.lo : s.hi]]
            for doc, at, value in zip(w.doc.tolist(), (w.at - s.first[w.doc]).tolist(), w.prints().tolist(), strict=True):
                seeds_of.setdefault(value, []).append((split[doc], at))
    seen = np.flatnonzero(np.isin(prints, np.array(list(seeds_of), np.int64)))
    for p in seen.tolist():
        if ok[p]:
            continue
        for other, q in seeds_of[int(prints[p])]:
            if words[p : p + length] != other[q : q + length]:
                continue
            left, right = p, p + length
            while left and q - (p - left) and words[left - 1] == other[q - (p - left) - 1]:
                left -= 1
            while right < len(words) and q + right - p < len(other) and words[right] == other[q + right - p]:
                right += 1
            ok[left : right - length + 1] = True
            break
        else:
            ok[p] = bool(exact) and b" ".join(words[p : p + length]) in exact
    return ok, np.unique(prints[seen[~ok[seen]]])


def _cut(docs: DataFrame, info: DataFrame, length: int, outputs: tuple[str, ...], bits: int) -> DataFrame:
    """Each row of ``docs`` with what is left of it, and ``_odd``: prints whose words differ from those of the source.

    ``info(doc_id, _pieces, _copies, _exact)`` has the documents that may lose words. Only those are shuffled."""
    names = docs.columns
    may = sieve(docs, "doc_id", info)
    none = [F.lit(None).cast("array<binary>").alias(c) for c in ("_pieces", "_copies", "_exact")]
    joined = docs.where(may).join(info, "doc_id", "left").select(*names, "_pieces", "_copies", "_exact")
    joined = joined.unionByName(docs.where(~may).select(*names, *none))
    target = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    extra = "n_words long, n_removed long, spans array<array<long>>, " + "".join(f"{c} string, " for c in outputs) + "_odd array<long>"
    texts, need_words = "kept_text" in outputs, bool({"kept_words", "kept_sha256"} & {*outputs})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {c: batch.column(c) for c in ("_pieces", "_copies", "_exact")}
            column = batch.column("text")
            for s in slices(column):
                prints = None
                total, removed, spans, kept, left, odd = [], [], [], [], [], []
                for i in range(s.hi - s.lo):
                    a, b = int(s.first[i]), int(s.first[i + 1])
                    raw, row = _raw(s, i), s.lo + i
                    words = raw.split()  # of bytes: at the same six characters
                    off, out = np.zeros(b - a, bool), np.zeros(0, np.int64)
                    given, gone, exact = (lists[c][row].as_py() or [] for c in ("_pieces", "_copies", "_exact"))
                    if len(words) >= length:
                        if gone and _digest(raw) in gone:
                            off[:] = True
                        elif given or exact:
                            if prints is None:
                                w = Windows(s, length, bits)
                                prints, bounds = w.prints(), np.searchsorted(w.doc, np.arange(s.hi - s.lo + 1))
                            ok, out = extend(words, prints[bounds[i] : bounds[i + 1]], given, set(exact), length, bits)
                            hit = np.flatnonzero(ok)
                            delta = np.zeros(b - a + 1, np.int64)
                            np.add.at(delta, hit, 1)
                            np.add.at(delta, hit + length, -1)
                            off = np.cumsum(delta)[:-1] > 0
                    total.append(b - a)
                    removed.append(int(off.sum()))
                    odd.append(out)
                    step = np.flatnonzero(np.diff(np.concatenate([[False], off, [False]]).astype(np.int8))).reshape(-1, 2)
                    spans.append([[int(x), int(y)] for x, y in step])
                    if need_words:
                        kept.append(b" ".join(words) if not removed[-1] else b" ".join(words[j] for j in np.flatnonzero(~off)))
                    if texts:
                        parts, at = [], 0
                        for x, y in step:
                            parts.append(raw[at : s.starts[a + x] - s.offsets[i]])
                            at = s.ends[a + y - 1] - s.offsets[i]
                        left.append(b"".join([*parts, raw[at:]]) if column[row].is_valid else None)
                piece = batch.slice(s.lo, s.hi - s.lo)
                made = {
                    "kept_words": lambda: pa.array(kept, pa.binary()).cast(pa.string()),
                    "kept_text": lambda: pa.array(left, pa.binary()).cast(pa.string()),
                    "kept_sha256": lambda: pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                }
                result = [made[c]() for c in outputs]
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in names), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), *result, pa.array(odd, pa.list_(pa.int64()))],
                    [*names, "n_words", "n_removed", "spans", *outputs, "_odd"],
                )

    return joined.mapInArrow(run, f"{target}, {extra}")


def _by_words(docs: DataFrame, found: DataFrame, odd: DataFrame, length: int, bits: int) -> DataFrame:
    """(doc_id, _exact): of the windows whose print is in ``odd(value)``, those whose words a smaller doc_id has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asked = batch.column("doc_id").to_pylist(), batch.column("prints").to_pylist()
            for s in slices(batch.column("text")):
                w = Windows(s, length, bits)
                use = _among(w.doc, w.prints(), asked[s.lo : s.hi])
                rows = sorted({(ids[s.lo + d], b" ".join(s.word(j) for j in range(a, a + length))) for d, a in zip(w.doc[use], w.at[use], strict=True)})
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "words"])

    asked = found.select("doc_id", F.explode("found").alias("value")).join(odd, "value", "left_semi").groupBy("doc_id").agg(F.collect_set("value").alias("prints"))
    each = stage(_texts(docs, asked).select("doc_id", "text", "prints").mapInArrow(run, "doc_id long, words binary"), "odd")
    low = each.groupBy("words").agg(F.min("doc_id").alias("low"))
    return each.join(low, "words").where("doc_id > low").groupBy("doc_id").agg(F.collect_set("words").alias("_exact"))


def cut(docs: DataFrame, length: int = 50, seed: int = SEED, outputs: tuple[str, ...] = ("kept_words", "kept_text"), bits: int = 64) -> DataFrame:
    """Each row of ``docs(doc_id, text, ...)`` with n_words, n_removed, spans, and ``outputs``: some of kept_words, kept_text
    and kept_sha256, the SHA-256 of kept_words.

    Every word goes that is covered by a window of ``length`` words whose word sequence also starts in a document with
    a smaller doc_id. spans are the maximal repeats: [first word, end) runs of removed words. kept_words joins the
    words left by one space; kept_text is the text without the bytes of removed spans, with its white space as it
    was.

    ``bits`` of a print: fewer than 64 make more windows look equal, which changes no result.

    Null texts have no words: kept_words is empty, kept_text null. Empty texts and texts shorter than ``length`` words
    stay whole, as do rows without doc_id. Repeats inside one document stay; repeated rows of one doc_id are the same
    document, also if their texts differ. Very long texts are one slice each and are never cut. Other columns pass
    through, but those named as an output are replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    seed = min(seed, (length + 1) // 2)
    taken = {"n_words", "n_removed", "spans", "kept_words", "kept_text", "kept_sha256", "_pieces", "_copies", "_exact", "_odd"}
    docs = docs.select(*[F.col(f"`{c}`") if c != "doc_id" else F.col(c).cast("long").alias(c) for c in docs.columns if c not in taken])
    plain = docs.select("doc_id", "text").where("doc_id is not null and text is not null")

    found = stage(seeds(plain, length, seed), "anchors")
    first = found.groupBy("digest").agg(F.min("doc_id").alias("low"))
    copied = found.select("doc_id", "digest").join(first, "digest").withColumn("copy", F.col("doc_id") > F.col("low"))
    copies = stage(copied.groupBy("doc_id").agg(F.collect_set(F.when(F.col("copy"), F.col("digest"))).alias("copies"), F.min("copy").alias("whole")).where("size(copies) > 0"), "copies")
    shared = _in_parts(found, lambda met: met.groupBy("doc_id").agg(F.collect_set("value").alias("anchors")), "shared")
    together = shared.groupBy("doc_id").agg(F.flatten(F.collect_list("anchors")).alias("anchors"))
    together = stage(together.join(copies.where("whole"), "doc_id", "left_anti"), "shared")
    drop(found, *shared._parts)
    release(spark)

    around = stage(windows(plain, together, copies.drop("whole"), length, seed, bits), "windows")
    drop(together)
    release(spark)
    met = _in_parts(around, lambda met: met.where("doc_id > low").select("doc_id", "low", "value"), "met")
    wanted = stage(met.select("low", "value").distinct().groupBy("low").agg(F.collect_list("value").alias("prints")).withColumnRenamed("low", "doc_id"), "wanted")
    sent = stage(pieces(plain, wanted, length, bits), "pieces")
    release(spark)
    asked = met.join(sent.select("low", "piece", F.explode("found").alias("value")), ["low", "value"]).select("doc_id", "low", "piece").distinct()
    got = asked.join(sent.select("low", "piece", "words"), ["low", "piece"]).groupBy("doc_id").agg(F.collect_set("words").alias("_pieces"))
    info = got.join(copies.select("doc_id", F.col("copies").alias("_copies")), "doc_id", "full")
    info = stage(info.withColumn("_exact", F.lit(None).cast("array<binary>")), "info")
    drop(wanted, sent, copies, *met._parts)
    release(spark)

    out = stage(_cut(docs, info, length, outputs, bits), "cut")
    odd = stage(out.select(F.explode("_odd").alias("value")).distinct(), "odd")
    if not odd.isEmpty():
        info = stage(info.drop("_exact").join(_by_words(plain, around, odd, length, bits), "doc_id", "left"), "info")
        drop(out)
        out = stage(_cut(docs, info, length, outputs, bits), "cut")
    drop(info, odd, around)
    return out.drop("_odd")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words over all of ``documents``: doc_id, n_words, n_removed, kept_sha256."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cut(docs, length=13, outputs=("kept_sha256",)).select("doc_id", "n_words", "n_removed", "kept_sha256")
