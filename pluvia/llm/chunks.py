"""Texts cut where byte-level BPE never merges across, with remembered encodings.

The split pattern of the byte-level tokenizers starts a match at a space before something
that is not white space, at a stop or comma after a letter, at a newline after a visible
character, and at a letter after that newline. So a text may be cut there and the parts
encoded one by one. Natural text repeats its words: a bounded table of encoded parts
saves most of the work and changes no result.

Cutting, hashing, looking up and joining are array operations over a megabyte of
text at a time; only parts that are not in the table become Python strings. Parts are looked
up by 64-bit hashes and compared byte by byte with what the table has there; one that differs
is encoded by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

from pluvia.llm.words import byte_sums, mixed

BATCH = 1 << 20
ENTRIES = 300_000
HELD = 1 << 26  # bytes of parts in the table
LONGEST = 48


def _flags(*groups: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[b for g in groups for b in g]] = True
    return out


_LETTER = _flags(range(65, 91), range(97, 123))
# no cut before what may be white space: control characters, and the first bytes of
# all multi-byte characters that can be
_AFTER_SPACE = ~_flags(range(9, 14), range(28, 33), (0xC2, 0xE1, 0xE2, 0xE3))
_STOP = _flags((44, 46))
_VISIBLE = _flags(range(33, 127))


def cuts(buf: np.ndarray) -> np.ndarray:
    """Places at which the bytes may be cut, for every byte but the first and last."""
    here, before, after = buf[1:-1], buf[:-2], buf[2:]
    newline = here == 10
    cut = (here == 32) & _AFTER_SPACE[after]
    cut |= _STOP[here] & _LETTER[before]
    cut |= newline & _VISIBLE[before]
    # only after a single newline: the last of several is a match of its own before a letter
    cut[1:] |= _LETTER[here[1:]] & (before[1:] == 10) & _VISIBLE[buf[:-3]]
    return np.flatnonzero(cut) + 1


def pieces(text: bytes, size: int) -> Iterator[bytes]:
    """A long text in pieces of about ``size`` bytes, cut at such places."""
    at = 0
    while len(text) - at > size:
        reach = size
        while not len(found := cuts(np.frombuffer(text, np.uint8, min(reach, len(text) - at), at))) and at + reach < len(text):
            reach *= 2
        if not len(found):
            break
        yield text[at:at + int(found[-1])]
        at += int(found[-1])
    yield text[at:]


class Memory:
    """Encodes texts by parts; ``encode`` gives the ids (unsigned 32-bit) of new parts."""

    def __init__(self, encode: Callable[[list[str]], Iterable[np.ndarray]], entries: int = ENTRIES) -> None:
        self.encode, self.entries = encode, entries
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.text_starts = np.zeros(0, np.int64)
        self.text_sizes = np.zeros(0, np.int64)
        self.text = np.zeros(0, np.uint8)
        self.clock = 0

    def encoded(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            data = text.encode("utf-8", "surrogatepass")
            if len(data) > BATCH:
                yield from self._some(held)
                held, size = [], 0
                yield np.concatenate([next(self._some([p])) for p in pieces(data, BATCH)])
                continue
            held.append(data)
            size += len(data)
            if size > BATCH:
                yield from self._some(held)
                held, size = [], 0
        yield from self._some(held)

    def _some(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        lengths = np.array([len(t) for t in texts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        blob = b"".join(texts)
        if not blob:
            yield from (np.zeros(0, np.uint32) for _ in texts)
            return
        buf = np.frombuffer(blob, np.uint8)
        edge = np.zeros(len(buf), bool)
        edge[cuts(buf)] = True
        there = lengths > 0
        edge[bounds[1:][there] - 1] = False  # a cut needs a byte after it in its own text
        edge[bounds[:-1][there]] = True
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(buf))
        hashes = mixed(byte_sums(buf, starts, ends) + (ends - starts).astype(np.uint64))
        unique, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        entry = self._entries(blob, unique, starts[first], ends[first])[place]

        begin, sizes, pool = self.starts[entry], self.sizes[entry], self.pool
        other = np.flatnonzero(~self._equal(buf, starts, ends, entry))
        if len(other):
            found = self._new([blob[lo:hi] for lo, hi in zip(starts[other].tolist(), ends[other].tolist(), strict=True)])
            sizes[other] = [len(f) for f in found]
            begin[other] = len(pool) + np.cumsum(sizes[other]) - sizes[other]
            pool = np.concatenate([pool, *found])
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = pool[np.repeat(begin - upto[:-1], sizes) + np.arange(upto[-1])]
        cut = upto[np.searchsorted(starts, bounds)].tolist()
        for lo, hi in zip(cut, cut[1:], strict=False):
            yield ids[lo:hi]

    def _new(self, parts: list[bytes]) -> list[np.ndarray]:
        return [np.asarray(f, np.uint32) for f in self.encode([p.decode("utf-8", "surrogatepass") for p in parts])]

    def _equal(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Whether the parts, which follow one another without a gap, are those of their entries."""
        sizes = ends - starts
        there = np.repeat(self.text_starts[entry] - starts, sizes) + np.arange(len(buf))
        same = self.text[np.minimum(there, len(self.text) - 1)] == buf
        return np.logical_and.reduceat(same, starts) & (self.text_sizes[entry] == sizes)

    def _entries(self, blob: bytes, unique: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table's entries of sorted hashes; new ones are encoded and put in."""
        self.clock += 1
        if len(self.hashes) > self.entries or len(self.text) > HELD:
            self._drop_old()
        at = np.searchsorted(self.hashes, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        if len(new):
            parts = [blob[lo:hi] for lo, hi in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            found = self._new(parts)
            sizes = np.array([len(f) for f in found], np.int64)
            begin = len(self.pool) + np.cumsum(sizes) - sizes
            self.pool = np.concatenate([self.pool, *found])
            lengths = ends[new] - starts[new]
            text_begin = len(self.text) + np.cumsum(lengths) - lengths
            self.text = np.concatenate([self.text, np.frombuffer(b"".join(parts), np.uint8)])
            # long parts are seldom met again: they are the first to be dropped
            used = np.where(lengths > LONGEST, -1, self.clock)
            for name, more in (("starts", begin), ("sizes", sizes), ("text_starts", text_begin), ("text_sizes", lengths),
                               ("used", used), ("hashes", unique[new])):
                setattr(self, name, np.insert(getattr(self, name), at[new], more))
            at = np.searchsorted(self.hashes, unique)
        self.used[at] = np.where(self.used[at] < 0, -1, self.clock)
        return at

    def _drop_old(self) -> None:
        """Keep the half of the entries that were met last."""
        half = min(self.entries, len(self.hashes)) // 2
        keep = np.sort(np.argsort(-self.used, kind="stable")[:half])
        self.pool, self.starts = _gathered(self.pool, self.starts[keep], self.sizes[keep])
        self.text, self.text_starts = _gathered(self.text, self.text_starts[keep], self.text_sizes[keep])
        for name in ("hashes", "sizes", "text_sizes", "used"):
            setattr(self, name, getattr(self, name)[keep])


def _gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of the pool one after another, and where each begins."""
    upto = np.cumsum(sizes) - sizes
    return pool[np.repeat(starts - upto, sizes) + np.arange(sizes.sum())], upto
