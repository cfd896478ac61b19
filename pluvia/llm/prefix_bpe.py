"""Byte-level BPE by dynamic programming over prefixes.

The BPE encoding of a byte string, cut after any of its tokens, is the encoding of the
bytes so far. So every prefix has one last token, and the tokens of the whole are read
off backwards. The last token of a prefix is the one token that ends there and forms a
valid pair with the last token of the prefix before it: a pair is valid if its joined
bytes encode to just that pair. Pairs and single tokens are judged by merging their
few bytes in rank order, and remembered.

With the last tokens stored, bytes can be appended without looking at the start again,
and an edit is re-encoded only from its place to where the old last tokens come back.

Nulls and other cases: a null or empty text has no tokens and the hashes of the empty
string; any other bytes are encoded whole, however long, and decoding the ids gives
them back; repeated rows give repeated results, in any order; an empty table gives no
rows. Other columns are never read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.batches import small_batches
from pluvia.llm.chunks import Memory

REMEMBERED = 250_000
SHORT = 48


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of lines ``base64 rank``."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class Coder:
    """Encodes and decodes byte strings by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._whole: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}
        self._width = max(ranks.values(), default=0) + 1
        self._last: dict[bytes, int] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The definition: join the neighbours of least rank, the first of equals, while any can be joined."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes encode to it."""
        if (known := self._whole.get(token)) is None:
            known = self._whole[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def pair(self, left: int, right: int) -> bool:
        """Whether the two tokens can stand next to each other."""
        key = left * self._width + right
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) >= REMEMBERED:
                self._pairs.clear()
            known = self._pairs[key] = (
                self.whole(right) and self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right])
        return known

    def last_token(self, piece: bytes, last: list[int], end: int) -> int:
        """The last token of ``piece[:end]``, given those of all shorter prefixes."""
        ranks = self.ranks
        for start in range(max(0, end - self.longest), end):
            token = ranks.get(piece[start:end])
            if token is not None and self.whole(token) and (start == 0 or self.pair(last[start - 1], token)):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def prefixes(self, piece: bytes, last: list[int] | None = None) -> list[int]:
        """The last token of every prefix; ``last`` has those that are known."""
        last = list(last or [])
        for end in range(len(last) + 1, len(piece) + 1):
            last.append(self.last_token(piece, last, end))
        return last

    def read_off(self, piece: bytes, last: list[int]) -> list[int]:
        out, end = [], len(piece)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return out[::-1]

    def last_of(self, prefix: bytes) -> int:
        """The last token of a short prefix; those found are stored and shared by all texts."""
        known = self._last.get(prefix)
        if known is None:
            end = len(prefix)
            for start in range(end):
                known = self.ranks.get(prefix[start:])
                if known is not None and (self.pair(self.last_of(prefix[:start]), known) if start else self.whole(known)):
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            if len(self._last) >= REMEMBERED:
                self._last.clear()
            self._last[prefix] = known
        return known

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one match of the split pattern."""
        token = self.ranks.get(piece)
        if token is not None:
            return [token]
        if len(piece) > SHORT:
            return self.read_off(piece, self.prefixes(piece))
        out = []
        while piece:
            out.append(self.last_of(piece))
            piece = piece[:-len(self.bytes_of[out[-1]])]
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Growing:
    """A byte string (one match of the split pattern) whose encoding follows its changes."""

    def __init__(self, coder: Coder, piece: bytes = b"") -> None:
        self.coder, self.piece = coder, piece
        self.last = coder.prefixes(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.last = self.coder.prefixes(self.piece, self.last)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of ``piece[start:stop]``; returns how many prefixes were computed.

        After the new bytes the old last tokens hold again as soon as they have come back
        for as many prefixes as the longest token has bytes, shorter ones included.
        """
        tail, old = self.piece[stop:], self.last[stop:]
        self.piece = self.piece[:start] + new + tail
        last, done, same = self.last[:start], 0, 0
        while len(last) < len(self.piece) and same < self.coder.longest:
            last.append(self.coder.last_token(self.piece, last, len(last) + 1))
            done += 1
            at = len(last) - 1 - start - len(new)
            same = same + 1 if at >= 0 and last[-1] == old[at] else 0
        self.last = last + old[len(last) - start - len(new):] if len(last) < len(self.piece) else last
        return done

    def tokens(self) -> list[int]:
        token = self.coder.ranks.get(self.piece)
        return [token] if token is not None else self.coder.read_off(self.piece, self.last)


@functools.lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(read_ranks(path))


@functools.lru_cache(maxsize=2)
def memory(path: str, pattern: str) -> Memory:
    own, compiled = coder(path), regex.compile(pattern)

    def encode(parts: list[str]) -> Iterator[np.ndarray]:
        for part in parts:
            # a space and a word, or a word, is one match
            found = [part] if (part[1:] if part[0] == " " else part).isalpha() else compiled.findall(part)
            yield np.array([i for m in found for i in own.encode(m.encode("utf-8", "surrogatepass"))], np.uint32)

    return Memory(encode)


def encode_texts(texts: list[str], path: str, pattern: str) -> Iterator[np.ndarray]:
    """The ids of each text."""
    return memory(path, pattern).encoded(texts)


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        decimal = {token: str(token) for token in own.bytes_of}
        for batch in batches:
            counts, ids_hash, text_hash = [], [], []
            for found in encode_texts([t or "" for t in batch.column("text").to_pylist()], path, pattern):
                ids = found.tolist()
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document.

    ``path`` is a rank file that every executor can read, ``pattern`` splits the text
    before encoding. The ids are hashed in decimal, joined by single spaces; the second
    hash is of the bytes that decoding the ids gives.
    """
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _digests(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ids(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = list(encode_texts([t or "" for t in batch.column("text").to_pylist()], path, pattern))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.uint32())).cast(pa.list_(pa.int32()))],
                                             ["doc_id", "ids"])

    return run


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every document: the ids themselves."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _ids(path, pattern), "doc_id long, ids array<int>")


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([own.decode(ids or []) for ids in batch.column("ids").to_pylist()], pa.binary())],
                ["doc_id", "bytes"])

    return run


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes) from (doc_id, ids); null ids are empty bytes."""
    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(_texts(path), "doc_id long, bytes binary")
