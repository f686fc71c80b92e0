"""Operator 10: quality by voting of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import release, table
from .text import U64, mix, slices

#: Hashed features of words, of byte-class triples, and binned shares.
WORD_DIMS, CLASS_COUNT, SHARE_BINS = 4096, 16, 12
CLASS_DIMS = CLASS_COUNT**3
#: Latent dimensions, voters for a document, and the bound on labelled rows that are fitted (per label).
LATENT, VOTERS, SAMPLE = 48, 25, 1000
#: Rows of the fitted sample whose norms are taken at a time.
ROWS = 64


def _classes() -> np.ndarray:
    """A class for each byte: letters, digits, spaces, line ends, kinds of punctuation, bytes of other scripts."""
    kinds = np.full(256, 11, np.int64)
    for i, chars in enumerate((b" ", b"\n\r\t\x0b\x0c", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:", b"!?", b"|/\\_", b"#$%&*@^~+=<>", b"\"'()[]{}`", b"-")):
        kinds[list(chars)] = i
    kinds[128:192] = 12
    kinds[192:224] = 13
    kinds[224:] = 14
    return kinds


_KINDS = _classes()
DIMS = WORD_DIMS + CLASS_DIMS + 4 * SHARE_BINS


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of rows as dense rows of damped counts: words and byte-class triples of the whole text, and the bins of
    four shares (distinct words, commonest word, distinct lines, mean word length). Empty texts give zeros."""
    for s in slices(column, limit=1 << 18, rows=256):
        n = s.hi - s.lo
        out = np.zeros((n, DIMS), np.float32)
        words = s.hashes()
        count = np.diff(s.first)
        doc = np.repeat(np.arange(n), count)
        slot = mix(words) % U64(WORD_DIMS)
        out[:, :WORD_DIMS] = np.log1p(np.bincount(doc * WORD_DIMS + slot.astype(np.int64), minlength=n * WORD_DIMS)).reshape(n, WORD_DIMS)
        size = np.diff(s.offsets)
        kinds = _KINDS[s.data]
        if len(kinds) > 2:
            triple = (kinds[:-2] * CLASS_COUNT + kinds[1:-1]) * CLASS_COUNT + kinds[2:]
            owner = np.repeat(np.arange(n), size)
            same = owner[:-2] == owner[2:]
            made = np.bincount(owner[:-2][same] * CLASS_DIMS + triple[same], minlength=n * CLASS_DIMS).reshape(n, CLASS_DIMS)
            out[:, WORD_DIMS : WORD_DIMS + CLASS_DIMS] = np.sqrt(made / np.maximum(size, 1)[:, None]) * 8
        at = WORD_DIMS + CLASS_DIMS
        for i in range(n):
            own = words[s.first[i] : s.first[i + 1]]
            if not len(own):
                continue
            _, times = np.unique(own, return_counts=True)
            lines = bytes(s.data[s.offsets[i] : s.offsets[i + 1]]).split(b"\n")
            shares = (len(times) / len(own), times.max() / len(own), len(set(lines)) / len(lines), min(1.0, size[i] / len(own) / 20))
            for j, share in enumerate(shares):
                out[i, at + j * SHARE_BINS + min(SHARE_BINS - 1, int(share * SHARE_BINS))] = 2
        yield s.lo, out


def packed(row: np.ndarray) -> bytes:
    """A row of features in half floats: the places that aren't zero and their values, or all values if that is shorter."""
    row = row.astype(np.float16)
    at = np.flatnonzero(row)
    return row.tobytes() if 2 * len(at) >= DIMS else at.astype(np.uint16).tobytes() + row[at].tobytes()


def unpack(raw: bytes | pa.Buffer, out: np.ndarray) -> None:
    """Fill ``out``, a row of zeros, from ``packed``."""
    half = np.frombuffer(raw, np.float16)
    if len(half) == DIMS:
        out[:] = half
    else:
        n = len(half) // 2
        out[half[:n].view(np.uint16)] = half[n:]


@dataclass
class Model:
    """Weights of features, the latent basis, and the labelled vectors: at most 2 * SAMPLE by LATENT numbers."""

    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, rows: np.ndarray) -> np.ndarray:
        x = (rows * self.weights) @ self.basis
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The share of label 1 among the VOTERS labelled vectors of largest cosine, weighted by it. All cosines of
        the block are computed. Rows without features get the prior of the labels."""
        if not len(self.vectors):
            return np.full(len(rows), self.prior)
        near = self.latent(rows) @ self.vectors.T
        k = min(VOTERS, near.shape[1])
        # ties go to the voter of smaller doc_id: a step below what single precision tells apart
        top = np.argpartition(np.arange(near.shape[1]) * 1e-11 - near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, 1).astype(np.float64), 0) ** 8
        # the sample holds as many rows of either label as it can; a vote counts as many labelled rows as it stands for
        share = min(max(self.labels.mean(), 1e-6), 1 - 1e-6)
        weight *= np.where(self.labels[top] == 1, self.prior / share, (1 - self.prior) / (1 - share))
        total = weight.sum(1)
        vote = (weight * self.labels[top]).sum(1)
        scored = (vote + self.prior * 1e-6) / (total + 1e-6)
        return np.where(rows.any(axis=1), scored, self.prior)


def fit(rows: np.ndarray, labels: np.ndarray, prior: float) -> Model:
    """``prior``: the share of label 1 among all labelled rows. No rows give a model that answers the prior.

    Beside ``rows`` one array of their shape is held at a time, in single precision."""
    if not len(rows):
        return Model(np.zeros(DIMS, np.float32), np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), prior)
    weights = np.log1p(len(rows) / (1 + (rows > 0).sum(0))).astype(np.float32)
    x = rows * weights
    for lo in range(0, len(x), ROWS):
        x[lo : lo + ROWS] /= np.maximum(np.linalg.norm(x[lo : lo + ROWS], axis=1, keepdims=True), 1e-9)
    rng = np.random.default_rng(7)
    k = min(LATENT, len(x))
    y = x @ rng.standard_normal((DIMS, k + 8)).astype(np.float32)  # the range of x, by power iteration
    for _ in range(4):
        q, _ = np.linalg.qr(y)
        y = x @ (x.T @ q)
    q, _ = np.linalg.qr(y)
    _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    del x
    basis = np.ascontiguousarray(vt[:k].T)
    model = Model(weights, basis, np.zeros((0, k), np.float32), labels.astype(np.float64), prior)
    model.vectors = model.latent(rows)
    return model


def held_out() -> Column:
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5) == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` rows of either label, chosen by a hash of doc_id among those that are not held out. A
    doc_id with both labels counts as label 0.

    Features are worked out where the texts are; the driver gets at most 2 * sample rows of DIMS half floats, packed,
    and unpacks them into one array of half floats.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
    some = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    chosen = docs.select("doc_id", "text").join(F.broadcast(some[0].unionByName(some[1])), "doc_id")  # 2 * sample rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, rows in features(batch.column("text")):
                piece = batch.slice(lo, len(rows))
                made = pa.array([packed(x) for x in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("quality"), made], ["doc_id", "quality", "features"])

    rows = chosen.select(F.col("doc_id").cast("long"), "text", "quality").mapInArrow(run, "doc_id long, quality int, features binary").toArrow()
    release(docs.sparkSession)  # what the JVM held for these jobs goes before the arrays of the fit come
    order = pc.sort_indices(rows, [("doc_id", "ascending")])
    quality = rows.column("quality").take(order).to_numpy().astype(np.float64)
    x = np.zeros((len(order), DIMS), np.float16)
    for i, at in enumerate(order.to_pylist()):
        unpack(rows.column("features")[at].as_buffer(), x[i])
    del rows
    return fit(x, quality, ones / n if n else 0.5)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score and predicted (1 from 0.3 up). Other columns pass through; ones of these two names are
    replaced. Null and empty texts get the prior of the labels; equal texts get equal scores. Whole texts are read.
    Without usable labels every score is 0.5. An empty table gives no rows."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(names)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMS * LATENT and 2 * SAMPLE * LATENT floats: 2 MB
    target = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sent.value.score(rows) for _, rows in features(batch.column("text"))]
            score = np.clip(np.concatenate(got), 0, 1).astype(np.float64) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.3).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(run, f"{target}, score double, predicted int")


def op10_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: doc_id, held_out, score, predicted; labels of held-out rows are never learnt."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
