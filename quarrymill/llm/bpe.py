"""Operator 7: byte-level BPE by prefix dynamic programming, and its decoding."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .shared import table
from .text import slices

#: A text may be cut before a space that follows a non-space and precedes one: no match of the split patterns in
#: use crosses such a place, and what they match on either side is the same with and without the other side.
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Chunks of text whose encoding a worker keeps at hand, and the longest such chunk.
MEMO, MEMO_CHARS = 600_000, 64
#: Pieces of at most so many bytes are looked up directly.
SHORT = 24
#: Pairs of adjacent tokens whose fit a worker keeps.
MEMO_FITS = 1_000_000


class Vocabulary:
    """Ranks of a byte-level BPE, with what the prefix dynamic program needs.

    Every token but the single bytes is made by one last merge of two earlier tokens (``parts``). Two adjacent
    tokens may stand side by side in an encoding only if no merge across their border would have come before the
    merges that made them (``fits``). A byte prefix then has exactly one valid last token: the one that fits the
    last token of the prefix before it.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.bytes_of = {r: b for b, r in self.rank.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.find = ahocorasick.Automaton()
        for token, r in sorted(self.rank.items(), key=lambda x: x[1]):
            pair = self._last_merge(token, r)
            if pair is None:
                continue  # no order of merges makes this token
            self.parts[r] = pair
            if pair[0] != r:
                self.merged[pair] = r
            self.find.add_word(token.decode("latin-1"), (r, len(token)))
        self.find.make_automaton()
        self._memo: dict[str, bytes] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._longest = max(map(len, self.rank))
        self.length = {r: len(b) for r, b in self.bytes_of.items()}
        size = max(self.bytes_of) + 1
        self._bytes = _strings([self.bytes_of.get(i, b"") for i in range(size)])
        self._digits = _strings([b"%d " % i for i in range(size)])

    def _last_merge(self, token: bytes, r: int) -> tuple[int, int] | None:
        if len(token) == 1:
            return r, r
        for i in range(1, len(token)):
            a, b = self.rank.get(token[:i], r), self.rank.get(token[i:], r)
            if a < r and b < r and a in self.parts and b in self.parts and self.fits(a, b):
                return a, b
        return None

    def fits(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' bytes together is just these two tokens.

        Undo the merges of both from the latest on. At each point the two pieces at the border could merge, if at
        all, into a token; if that token comes before the merge that was undone last, the border is gone.
        """
        before = len(self.rank) + 1  # no merge was undone yet
        while True:
            joint = self.merged.get((a, b))
            if joint is not None and joint < before:
                return False
            left, right = self.parts[a], self.parts[b]
            single_a, single_b = left[0] == a, right[0] == b
            if single_a and single_b:
                return True
            if single_b or (not single_a and a > b):  # a was made after b
                before, a = a, left[1]
            else:  # at equal ranks the left one is made first
                before, b = b + 1, right[0]

    def last_tokens(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """For each prefix of ``piece`` its last token; ``known`` are those of a prefix of it, and are kept."""
        last = list(known or ())
        done = len(last)
        if len(piece) > SHORT:
            return self._last_tokens_long(piece, last)
        rank, fits, add = self.rank, self._fits, last.append
        for i in range(done + 1, len(piece) + 1):
            for j in range(i):
                r = rank.get(piece[j:i])
                if r is not None and r in self.parts:
                    if not j:
                        break
                    pair = last[j - 1], r
                    fit = fits.get(pair)
                    if fit if fit is not None else self._fit(pair):
                        break
            add(r)
        return last

    def _last_tokens_long(self, piece: bytes, last: list[int]) -> list[int]:
        """The same by an automaton that lists the tokens which end at each place, in time linear in the length."""
        done = len(last)
        begin = max(0, done - self._longest + 1)  # matches that end later may begin before
        ends: list[list[tuple[int, int]]] = [[] for _ in range(len(piece))]
        for end, hit in self.find.iter(piece[begin:].decode("latin-1")):
            ends[end + begin].append(hit)
        for i in range(done, len(piece)):
            last.append(next(r for r, n in ends[i] if n == i + 1 or self._fit((last[i - n], r))))
        return last

    def _fit(self, pair: tuple[int, int]) -> bool:
        fit = self._fits.get(pair)
        if fit is None:
            fit = self.fits(*pair)
            if len(self._fits) >= MEMO_FITS:
                self._fits.clear()
            self._fits[pair] = fit
        return fit

    def path(self, last: list[int]) -> list[int]:
        """Walk back from the end over last tokens."""
        out, at, length = [], len(last), self.length
        while at:
            r = last[at - 1]
            out.append(r)
            at -= length[r]
        return out[::-1]

    def pieces(self, raws: set[bytes]) -> dict[bytes, list[int]]:
        """The ids of each piece. In sorted order a piece begins as the one before it does, and that one's last
        tokens are good for the prefix they share: only the rest is worked out."""
        out, before, last = {}, b"", []
        for raw in sorted(raws):
            same = 0
            for x, y in zip(before, raw):
                if x != y:
                    break
                same += 1
            last = self.last_tokens(raw, last[:same])
            before = raw
            out[raw] = self.path(last)
        return out

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks as the bytes of 32-bit numbers."""
        split = {c: [x.encode() for x in self.pattern.findall(c)] for c in chunks}
        ids = self.pieces({x for xs in split.values() for x in xs})
        return {c: array("i", [r for x in xs for r in ids[x]]).tobytes() for c, xs in split.items()}

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [_CUT.split(t) for t in texts]
        memo = self._memo
        missing = {c for c in set().union(*cut) if c not in memo}
        if missing:
            if len(memo) + len(missing) > MEMO:
                memo.clear()
                missing = set().union(*cut)
            learned = self._learn(missing)
            memo.update((c, x) for c, x in learned.items() if len(c) <= MEMO_CHARS)
            long = {c: x for c, x in learned.items() if len(c) > MEMO_CHARS}
            if long:
                return [np.frombuffer(b"".join([memo.get(c) or long.get(c, b"") for c in chunks]), np.int32) for chunks in cut]
        return [np.frombuffer(b"".join(map(memo.__getitem__, chunks)), np.int32) for chunks in cut]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        """The bytes of ``ids``."""
        return _gather(np.asarray(ids, np.int64), *self._bytes)

    def decimal(self, ids: np.ndarray | list[int]) -> bytes:
        """The ids as decimal numbers joined by one space."""
        return _gather(np.asarray(ids, np.int64), *self._digits)[:-1]


def _strings(all_of: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array(list(map(len, all_of)), np.int64)
    return n, np.cumsum(n) - n, np.frombuffer(b"".join(all_of), np.uint8)


def _gather(ids: np.ndarray, lengths: np.ndarray, places: np.ndarray, flat: np.ndarray) -> bytes:
    """The strings of ``ids`` one after the other, in one pass."""
    n = lengths[ids]
    ends = np.cumsum(n)
    shift = np.repeat(places[ids] - ends + n, n)
    shift += np.arange(len(shift))
    return flat[shift].tobytes()


class Piece:
    """One piece of text that grows at its end or is edited, with the last token of every prefix."""

    def __init__(self, vocabulary: Vocabulary, raw: bytes = b""):
        self.vocabulary, self.raw = vocabulary, b""
        self.last: list[int] = []
        self.append(raw)

    def append(self, raw: bytes) -> None:
        """Exact: the last tokens of the prefixes so far don't change."""
        self.raw += raw
        self.last = self.vocabulary.last_tokens(self.raw, self.last)

    def edit(self, at: int, removed: int, put: bytes) -> None:
        """Replace ``removed`` bytes at ``at``; prefixes that end before the edit keep their last tokens."""
        self.raw = self.raw[:at] + put + self.raw[at + removed :]
        self.last = self.vocabulary.last_tokens(self.raw, self.last[:at])

    def ids(self) -> list[int]:
        return self.vocabulary.path(self.last)


@cache
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each row of ``docs(doc_id, text)``.

    Whole texts, without special tokens; null and empty texts give no ids. Equal texts give equal ids, and repeated
    rows stay. An empty table gives no rows. The vocabulary is read once in a worker, from ``path``, which is to be
    the same file on every machine. A very long piece takes time and memory in proportion to its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        for batch in batches:
            for s in slices(batch.column("text")):
                piece = batch.slice(s.lo, s.hi - s.lo)
                ids = bpe.encode_all([t or "" for t in piece.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array([hashlib.sha256(bpe.decimal(x)).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
                )

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), *public_vocabulary()).drop("ids")
