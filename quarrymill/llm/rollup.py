"""Operator 6: token totals kept by signed deltas, in batches that commit once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import public_vocabulary
from .shared import new_path, stage, table
from .text import slices

KEYS = ("source", "lang", "version")
WORDS_VERSION, BPE_VERSION = "words-1", "byte_bpe_50k-1"


class Rollup:
    """Additive totals by source, language and tokenizer version, in a folder of committed batches.

    A batch is written to a draft folder and renamed to its name, which fails where the name is taken: of two writers
    of one batch, and of a driver that doesn't know whether its last attempt went through, one commits and the other
    changes nothing. Drafts of failed attempts are never read. Each batch holds one row a key; ``compact`` puts
    batches together, so that totals read no more than the batches since.
    """

    SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, batch: str) -> str:
        if not batch or batch[0] in "_." or not all(c.isalnum() or c in "-_." for c in batch):
            raise ValueError(f"not a batch name: {batch!r}")
        return f"{self.root}/{batch}"

    def _folders(self) -> list[str]:
        top = self._path(self.root)
        if not self._fs.exists(top):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(top)) if self._fs.exists(self._path(f"{self.root}/{n}/_SUCCESS")))

    def _base(self) -> tuple[str | None, set[str]]:
        """The last compaction and the batches in it."""
        name = next((n for n in reversed(self._folders()) if n.startswith("_base-")), None)
        if name is None:
            return None, set()
        return name, {r[0] for r in self.spark.read.parquet(f"{self.root}/{name}/names").collect()}

    def committed(self) -> list[str]:
        return sorted(self._base()[1] | {n for n in self._folders() if not n.startswith("_")})

    def _put(self, draft: str, name: str) -> bool:
        """Rename ``draft``, in one step, unless the name is taken."""
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(draft), self._path(f"{self.root}/{name}"), none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            self._fs.delete(self._path(draft), True)
            return False
        return True

    def compact(self) -> None:
        """Put all batches so far into one base, and delete them. Their names stay committed; a reader that began before
        reads again if its folders go."""
        last, known = self._base()
        own = [n for n in self._folders() if not n.startswith("_") and n not in known]
        if not own:
            return
        draft = f"{self.root}/_draft-{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{draft}/totals")
        self.spark.createDataFrame([(n,) for n in sorted(known | set(own))], "name string").coalesce(1).write.parquet(f"{draft}/names")
        self._fs.create(self._path(f"{draft}/_SUCCESS")).close()
        if self._put(draft, f"_base-{int(last[6:]) + 1 if last else 1:09d}"):
            for n in [*own, *([last] if last else [])]:
                self._fs.delete(self._path(f"{self.root}/{n}"), True)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add ``changes(op, source, lang, version, n_tokens, old_tokens)``: insert, delete or revise.

        An insert adds a document and its tokens, a delete takes them off, a revision moves the tokens from
        old_tokens to n_tokens. Null counts are 0 and null keys are keys. Any other op fails the batch. False if the
        batch was there already. Partial sums come before the shuffle, so a hot source costs one row a task.
        """
        self._at(batch)
        if batch in self.committed():
            return False
        n, old = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("n_tokens", "old_tokens"))
        docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))))
        tokens = F.when(F.col("op") == "insert", n).when(F.col("op") == "delete", -n).otherwise(n - old)
        delta = changes.groupBy(*KEYS).agg(F.sum(docs.cast("long")).alias("n_docs"), F.sum(tokens).alias("n_tokens"))
        draft = f"{self.root}/_draft-{uuid.uuid4().hex}"
        delta.write.parquet(draft)
        return self._put(draft, batch)

    def totals(self) -> DataFrame:
        """Keys that have documents left, and their totals. No batches give no rows."""
        base, known = self._base()
        places = [self._at(n) for n in self._folders() if not n.startswith("_") and n not in known] + ([f"{self.root}/{base}/totals"] if base else [])
        parts = self.spark.read.schema(self.SCHEMA).parquet(*places) if places else self.spark.createDataFrame([], self.SCHEMA)
        return parts.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")


@cache
def _encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, source, lang, digest, words, tokens) of each row; null texts have no words and no tokens."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path, pattern)
        for batch in batches:
            for s in slices(batch.column("text")):
                piece = batch.slice(s.lo, s.hi - s.lo)
                texts = [t or "" for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(piece.column(c) for c in ("doc_id", "source", "lang")),
                        pa.array([xxhash.xxh3_128_digest(t.encode()) for t in texts], pa.binary()),
                        pa.array([int(x) for x in s.first[1:] - s.first[:-1]], pa.int64()),
                        pa.array([len(encoding.encode_ordinary(t)) for t in texts], pa.int64()),
                    ],
                    ["doc_id", "source", "lang", "digest", "words", "tokens"],
                )

    docs = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), "text")
    return docs.mapInArrow(run, "doc_id long, source string, lang string, digest binary, words long, tokens long")


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert every document with its word count under both versions, revise the second version to real token
    counts, delete later copies of a text, and commit the first batch a second time. One row a key."""
    counted = stage(counts(table(spark, sf_dir, "documents"), *public_vocabulary()), "counts")
    book = Rollup(spark, new_path(spark, "rollup"))
    none = F.lit(None).cast("long").alias("old_tokens")
    keys = [F.col("source"), F.col("lang")]
    versions = F.explode(F.array(F.lit(WORDS_VERSION), F.lit(BPE_VERSION))).alias("version")
    load = counted.select(F.lit("insert").alias("op"), *keys, versions, F.col("words").alias("n_tokens"), none)
    book.commit("load", load)
    book.commit("revise", counted.select(F.lit("revise").alias("op"), *keys, F.lit(BPE_VERSION).alias("version"), F.col("tokens").alias("n_tokens"), F.col("words").alias("old_tokens")))
    first = counted.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = counted.join(first, "digest").where("doc_id > first")
    now = F.explode(F.array(F.struct(F.lit(WORDS_VERSION).alias("version"), F.col("words").alias("n")), F.struct(F.lit(BPE_VERSION).alias("version"), F.col("tokens").alias("n")))).alias("now")
    book.commit("copies", copies.select(F.lit("delete").alias("op"), *keys, now).select("op", "source", "lang", "now.version", F.col("now.n").alias("n_tokens"), none))
    if book.commit("load", load):
        raise AssertionError("a batch was committed twice")
    return book.totals()
