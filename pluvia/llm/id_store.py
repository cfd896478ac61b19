"""Token ids in raw binary files, found by key through minimal perfect hashing.

Files in one folder that all executors share:

* ``ids-<shard>``: the ids of the shard's documents one after the other, little-endian
  unsigned, two bytes each if the vocabulary allows, else four. Shards are ranges of
  ascending ``doc_id``; inside one the documents ascend too.
* ``off-<shard>``: where each record of the shard starts, in ids, as unsigned 64-bit
  numbers, with the end as one more.
* ``key-<part>``: the index of the keys of one hash part. A minimal perfect hash over a
  few bit arrays (a key takes the first array in which it has a bit of its own; the
  rank of that bit is its slot) leads to the slot's fingerprint, shard, record and
  number of records. A lookup reads a bounded number of words, however many keys there
  are. The fingerprint rejects keys that are not there but for a chance of 2^-32.

Texts are dealt by ranges of ``doc_id``, encoded in the task that writes the shard, and
never held but one batch at a time. A task writes under a name of its own attempt and
renames at the end, so a repeated task leaves one whole file.

Nulls and other cases: a null or empty text is a record with the end id only; null ids
sort first, share one key, and are stored and found like any other; rows that repeat an
id are consecutive records under one key; an empty table makes no files and no rows.
Other columns are never read.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvia.llm.batches import small_batches
from pluvia.llm.chunks import Memory
from pluvia.llm.words import mixed
from pluvia.session import materialise, scratch_path

KEYS_PER_PART = 1 << 14
MAGIC = b"KEYINDX1"
NULL_KEY = 0x9E3779B97F4A7C15
TOGETHER = 4096


# ---- encoding -------------------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a JSON file, and the bytes of each of its ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    lengths = np.zeros(own.get_vocab_size(with_added_tokens=True), np.int64)
    for token, at in own.get_vocab(with_added_tokens=True).items():
        lengths[at] = len(token)  # byte-level tokens are written with one character a byte
    return own, lengths


def _encode_together(parts: list[str], path: str, between: str) -> list[np.ndarray]:
    """The ids of parts that may be encoded as one text with ``between`` before each."""
    own, lengths = tokenizer(path)
    ids = np.array(own.encode("".join(between + p for p in parts), add_special_tokens=False).ids, np.uint32)
    ends = np.concatenate([[0], np.cumsum(lengths[ids])])
    sizes = np.array([len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass")) for p in parts])
    stops = np.cumsum(sizes + len(between))
    lo, hi = np.searchsorted(ends, stops - sizes), np.searchsorted(ends, stops)
    if not (np.array_equal(ends[lo], stops - sizes) and np.array_equal(ends[hi], stops)):
        return [np.array(e.ids, np.uint32) for e in own.encode_batch(parts, add_special_tokens=False)]
    return [ids[i:j] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]


@functools.lru_cache(maxsize=2)
def memory(path: str) -> Memory:
    """Parts that were not met before go to the library, many at a time."""
    own, _ = tokenizer(path)

    def kind(part: str) -> str | None:
        """What may stand before the part without a change of its ids; None if it goes alone."""
        if part[0] == " " and len(part) > 1 and not part[1].isspace():
            return ""
        return "\n" if part[0].isascii() and part[0].isalpha() else None

    def encode(parts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(parts)
        groups: dict[str | None, list[int]] = {"": [], "\n": [], None: []}
        for i, p in enumerate(parts):
            groups[kind(p)].append(i)
        for i, e in zip(groups[None], own.encode_batch([parts[i] for i in groups[None]], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        for between in ("", "\n"):
            some = groups[between]
            for lo in range(0, len(some), TOGETHER):
                for i, ids in zip(some[lo:lo + TOGETHER], _encode_together([parts[i] for i in some[lo:lo + TOGETHER]], path, between), strict=True):
                    out[i] = ids
        return out

    return Memory(encode)


def encode_texts(texts: list[str], path: str) -> Iterator[np.ndarray]:
    return memory(path).encoded(texts)


# ---- minimal perfect hash index ---------------------------------------------------------


def key_hashes(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """64-bit hashes of long keys; null keys share one."""
    out = mixed(ids.astype(np.int64).view(np.uint64) + np.uint64(0xA0761D6478BD642F))
    out[null] = np.uint64(NULL_KEY)
    return out


def _place(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mixed(hashes ^ mixed(np.uint64([level + 1]))) % np.uint64(bits)).astype(np.int64)


def build_index(hashes: np.ndarray, columns: list[np.ndarray], spread: float = 2.0) -> bytes:
    """The index of distinct key hashes; ``columns`` are (shard, record, records)."""
    levels, order, left, at = [], [], np.arange(len(hashes)), 0
    while len(left):
        bits = max(64, int(spread * len(left)) + 63 & ~63)
        places = _place(hashes[left], len(levels), bits)
        alone = np.bincount(places, minlength=bits) == 1
        mine = alone[places]
        order.append(left[mine][np.argsort(places[mine])])
        levels.append(np.packbits(alone, bitorder="little"))
        left = left[~mine]
        at += 1
        if at > 200:
            raise ValueError("keys of an index must differ")
    words = np.concatenate(levels).view("<u8") if levels else np.zeros(0, "<u8")
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype("<u8")
    slots = np.concatenate(order) if order else np.zeros(0, np.int64)
    prints = (mixed(hashes[slots] ^ np.uint64(0x1234567)) >> np.uint64(32)).astype("<u4")
    head = MAGIC + struct.pack("<QI", len(hashes), len(levels)) + b"".join(struct.pack("<Q", len(b) * 8) for b in levels)
    body = [words, ranks, prints, *(c[slots].astype("<u8") for c in columns)]
    return head + b"".join(x.tobytes() for x in body)


class KeyIndex:
    """Lookups in the bytes of an index."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a key index")
        self.n, count = struct.unpack_from("<QI", data, 8)
        self.levels = struct.unpack_from(f"<{count}Q", data, 20)
        at = 20 + 8 * count
        size = sum(self.levels) // 64

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.words, self.ranks = take("<u8", size), take("<u8", size + 1)
        self.prints = take("<u4", self.n)
        self.columns = [take("<u8", self.n) for _ in range(3)]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(whether each key is there, [shard, record, records] where it is)."""
        slot = np.full(len(hashes), -1, np.int64)
        left, base = np.arange(len(hashes)), 0
        for level, bits in enumerate(self.levels):
            places = base + _place(hashes[left], level, bits)
            word, bit = places >> 6, (places & 63).astype(np.uint64)
            set_ = (self.words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            slot[left[set_]] = (self.ranks[word] + below)[set_]
            left = left[~set_]
            base += bits
        there = slot >= 0
        prints = (mixed(hashes ^ np.uint64(0x1234567)) >> np.uint64(32)).astype(np.uint32)
        there[there] = self.prints[slot[there]] == prints[there]
        return there, [c[slot[there]].astype(np.int64) for c in self.columns]


# ---- files ------------------------------------------------------------------------------


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _put(uri: str, name: str, data: Iterable[bytes]) -> None:
    """Write a file under a name of this attempt, then give it its name."""
    system, folder = _open(uri)
    system.create_dir(folder, recursive=True)
    own = f"{folder}/.{name}-{TaskContext.get().taskAttemptId()}"
    with system.open_output_stream(own) as out:
        for x in data:
            out.write(x)
    system.move(own, f"{folder}/{name}")


def _get(uri: str, name: str) -> bytes:
    system, folder = _open(uri)
    with system.open_input_file(f"{folder}/{name}") as file:
        return file.read()


ENTRY = "doc_id long, shard long, record long, records long, tokens long"


def _write_shard(uri: str, path: str, end_id: int):
    """Function for mapInArrow: encode a sorted partition into a shard; yields its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        own, _ = tokenizer(path)
        kind = "<u2" if own.get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else "<u4"
        end = np.array([end_id], np.uint32)
        offsets: list[np.ndarray] = [np.zeros(1, np.int64)]
        entries: list[list[int | None]] = []  # of the batch; the last one goes on into the next
        ready: list[list[list[int | None]]] = []

        def payload() -> Iterator[bytes]:
            total = record = 0
            for batch in batches:
                lengths = []
                ids = batch.column("doc_id").to_pylist()
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for key, found in zip(ids, encode_texts(texts, path), strict=True):
                    lengths.append(len(found) + 1)
                    yield np.concatenate([found, end]).astype(kind).tobytes()
                    if entries and entries[-1][0] == key:
                        entries[-1][3] += 1
                        entries[-1][4] += lengths[-1]
                    else:
                        entries.append([key, shard, record, 1, lengths[-1]])
                    record += 1
                offsets.append(total + np.cumsum(lengths))
                total += sum(lengths)

        _put(uri, f"ids-{shard:06d}", payload())
        if not entries:
            return
        _put(uri, f"off-{shard:06d}", [np.concatenate(offsets).astype("<u8").tobytes()])
        ready.append(entries)
        names = ["doc_id", "shard", "record", "records", "tokens"]
        for rows in ready:
            for lo in range(0, len(rows), 10_000):
                columns = list(zip(*rows[lo:lo + 10_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def _by_group(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.Table]:
    """Rows sorted by a column, as one table for each of its values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(name).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi == lo:
                continue
            if held and held[-1].column(name)[0].as_py() != values[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _hashes_of(column: pa.ChunkedArray) -> np.ndarray:
    null = column.is_null().to_numpy()
    return key_hashes(column.fill_null(0).to_numpy(), null)


def _write_index(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(batches, "part"):
            part = table.column("part")[0].as_py()
            data = build_index(_hashes_of(table.column("doc_id")), [table.column(c).to_numpy() for c in ("shard", "record", "records")])
            _put(uri, f"key-{part:06d}", [data])
            yield pa.RecordBatch.from_pydict({"part": [part], "keys": [len(table)], "bytes": [len(data)]})

    return run


def _look_up(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(batches, "part"):
            index = KeyIndex(_get(uri, f"key-{table.column('part')[0].as_py():06d}"))
            there, columns = index.find(_hashes_of(table.column("doc_id")))
            found = table.column("doc_id").combine_chunks().filter(pa.array(there))
            yield pa.RecordBatch.from_arrays([found, *(pa.array(c) for c in columns)], ["doc_id", "shard", "record", "records"])

    return run


def _read(uri: str, kind: str):
    """Function for mapInArrow: the records that the index names, read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _open(uri)
        width = np.dtype(kind).itemsize
        for table in _by_group(batches, "shard"):
            shard = table.column("shard")[0].as_py()
            offsets = np.frombuffer(_get(uri, f"off-{shard:06d}"), "<u8").astype(np.int64)
            out: list[tuple] = []
            with system.open_input_file(f"{folder}/ids-{shard:06d}") as file:
                for key, record, records in zip(*(table.column(c).to_pylist() for c in ("doc_id", "record", "records")), strict=True):
                    for at in range(record, record + records):
                        start, n = int(offsets[at]), int(offsets[at + 1] - offsets[at])
                        ids = np.frombuffer(file.read_at(n * width, start * width), kind)
                        out.append((key, shard, start, n, zlib.crc32(ids.astype("<u4").tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                                             ["doc_id", "shard", "at", "n_tokens", "ids_crc32"])

    return run


class Store:
    """A written folder: payload shards, index parts, and where each shard starts."""

    def __init__(self, uri: str, kind: str, parts: int, shards: int, starts: DataFrame) -> None:
        self.uri, self.kind, self.parts, self.shards, self.starts = uri, kind, parts, shards, starts

    def located(self, keys: DataFrame) -> DataFrame:
        """(doc_id, shard, record, records) of the keys (column doc_id) that are stored."""
        own = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        return (own.withColumn("part", _part(self.parts)).repartition(self.parts, "part").sortWithinPartitions("part")
                .mapInArrow(_look_up(self.uri), "doc_id long, shard long, record long, records long"))

    def read(self, keys: DataFrame) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) of every record of the keys, from the files."""
        got = (self.located(keys).repartition(self.shards, "shard").sortWithinPartitions("shard", "record")
               .mapInArrow(_read(self.uri, self.kind), "doc_id long, shard long, at long, n_tokens long, ids_crc32 long"))
        return got.join(self.starts, "shard").select(
            "doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _part(parts: int):
    return F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1))), F.lit(parts)).cast("long")


def write(docs: DataFrame, path: str, end_id: int, uri: str | None = None) -> Store:
    """Encode and store all documents; ``uri`` is a new folder that all executors share."""
    spark = docs.sparkSession
    uri = uri or scratch_path(spark, "id-store")
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    entries = materialise(
        texts.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
        .mapInArrow(_write_shard(uri, path, end_id), ENTRY), "id-entries")
    by_shard = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    starts = materialise(
        entries.groupBy("shard").agg(F.sum("tokens").alias("tokens"))
        .select("shard", F.coalesce(F.sum("tokens").over(by_shard), F.lit(0)).alias("start")), "id-starts")
    keys = entries.count()
    parts = max(shards, -(-keys // KEYS_PER_PART))
    index = entries.withColumn("part", _part(parts)).repartition(parts, "part").sortWithinPartitions("part")
    materialise(index.mapInArrow(_write_index(uri), "part long, keys long, bytes long"), "id-index")
    own, _ = tokenizer(path)
    small = own.get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16
    return Store(uri, "<u2" if small else "<u4", parts, shards, starts)
