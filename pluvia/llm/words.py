"""Word hashes of many texts at once, and hashes of runs of words.

Words are what lies between the ASCII white space characters (space, 9 to 13). A word's
hash is the sum of a 64-bit number for each (place, byte), mixed with its length, taken from
running sums over up to a megabyte of text at a time, so that memory does not grow with the
length of a text. A polynomial of the bytes modulo 2^64 would not do: words in Thue-Morse
order and their mirrors agree in it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SEGMENT = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (shift and multiply)."""
    x = np.asarray(x, np.uint64).copy()
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(odd)
    return x ^ (x >> np.uint64(31))


def odd_numbers(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_NEAR = 64  # places in a word whose numbers are kept


def _numbers(keys: np.ndarray) -> np.ndarray:
    """A 64-bit number for each (place, byte), given as ``place * 256 + byte``."""
    return mixed(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93))


_TABLE = _numbers(np.arange(_NEAR * 256))


def _hash_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of the bytes."""
    buf = np.frombuffer(blob, np.uint8)
    blank = np.ones(len(buf) + 2, bool)
    blank[1:-1] = _BLANK[buf]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    return mixed(byte_sums(buf, starts, ends) + (ends - starts).astype(np.uint64)), starts


def byte_sums(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of the numbers of each range's bytes, which depend on their places in the range."""
    place = np.arange(len(buf))
    if len(starts):
        place[starts[0]:] -= np.repeat(starts, np.diff(np.append(starts, len(buf))))
    keys = (place << 8) | buf
    numbers = _TABLE[np.minimum(keys, len(_TABLE) - 1)]
    far = np.flatnonzero(keys >= len(_TABLE))
    numbers[far] = _numbers(keys[far])
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(numbers, out=sums[1:])
    return sums[ends] - sums[starts]


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts of about a megabyte, cut after a white space character."""
    at = 0
    while len(text) - at > SEGMENT:
        end = at + SEGMENT
        window = np.frombuffer(text, np.uint8, count=SEGMENT, offset=at)
        cuts = np.flatnonzero(_BLANK[window])
        if len(cuts):
            end = at + int(cuts[-1]) + 1
        else:  # a word longer than a part is kept whole
            while end < len(text) and not _BLANK[text[end]]:
                end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
    """The hashes of each text's words, in order; none for a null text."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        text = text or b""
        if len(text) > SEGMENT:
            yield from _together(held)
            held, size = [], 0
            yield np.concatenate([_hash_blob(p)[0] for p in _pieces(text)])
            continue
        held.append(text)
        size += len(text) + 1
        if size >= SEGMENT:
            yield from _together(held)
            held, size = [], 0
    yield from _together(held)


def _together(texts: list[bytes]) -> Iterator[np.ndarray]:
    if texts:
        hashes, starts = _hash_blob(b" ".join(texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        yield from np.split(hashes, np.searchsorted(starts, ends[:-1]))


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words; of the whole where there are fewer, none for no word."""
    n = len(words)
    if n == 0:
        return words
    size = min(k, n)
    factors = odd_numbers(7, k)
    out = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        out += words[j:n - size + 1 + j] * factors[j]
    return mixed(out)
