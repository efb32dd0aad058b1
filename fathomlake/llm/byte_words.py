"""Words of UTF-8 texts, found, hashed and looked up as arrays.

A word is a run of digits, letters a-z (A-Z are lowered) and characters beyond
ASCII: `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lowering.  All bytes of a
character beyond ASCII are 0x80 or more, so bytes decide alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from hashlib import blake2b
from typing import NamedTuple

import numpy as np

#: A word's first bytes are hashed as arrays, longer words one by one.
ARRAY_BYTES = 256
#: Rows are read in slices of about so many bytes.
SLICE_BYTES = 1 << 22
SLICE_ROWS = 512


def _normal() -> np.ndarray:
    """Of each byte: itself, lowered, or 0 for a separator."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    table[: ord("0")] = table[ord("9") + 1 : ord("A")] = table[ord("Z") + 1 : ord("a")] = table[ord("z") + 1 : 128] = 0
    return table


NORMAL = _normal()
MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


class Words(NamedTuple):
    """The words of some texts, in order."""

    data: np.ndarray  # the lowered words with one space after each
    starts: np.ndarray  # of each word in data
    ends: np.ndarray
    raw_starts: np.ndarray  # of each word in its own text
    raw_ends: np.ndarray
    row: np.ndarray  # the place of its text
    keys: np.ndarray  # a hash of each word; words of up to 8 bytes never share one


def slices(values: Iterable[bytes | None]) -> Iterator[list[bytes]]:
    """Rows in lists of bounded size; a longer text stands alone, null is empty."""
    held: list[bytes] = []
    size = 0
    for value in values:
        value = value or b""
        if held and (size + len(value) > SLICE_BYTES or len(held) == SLICE_ROWS):
            yield held
            held, size = [], 0
        held.append(value)
        size += len(value)
    if held:
        yield held


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all (in place)."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(33)
    return h


def _chunk(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
    """The k-th eight bytes of each word as a number; bytes past its end are 0."""
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    return eights[starts + 8 * k] & MASKS[np.clip(lengths - 8 * k, 0, 8)]


def _keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    lengths = ends - starts
    keys = mix(_chunk(data, starts, lengths, 0) ^ np.uint64(seed))
    some = np.flatnonzero(lengths > 8)
    for k in range(1, ARRAY_BYTES // 8):
        some = some[lengths[some] > 8 * k]
        if not len(some):
            return keys
        keys[some] = mix(keys[some] * np.uint64(0x9E3779B97F4A7C15) ^ _chunk(data, starts[some], lengths[some], k))
    for i in some[lengths[some] > ARRAY_BYTES]:
        digest = blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
        keys[i] = int.from_bytes(digest.digest(), "little")
    return keys


def read(texts: Sequence[bytes], seed: int = 0) -> Words:
    """The words of all texts; no word crosses from one to the next."""
    lowered = NORMAL[np.frombuffer(b"\0" + b"\0".join(texts) + b"\0", np.uint8)]
    inside = lowered != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    raw_starts, raw_ends = edges[::2], edges[1::2]
    inside[raw_ends] = True
    lowered[raw_ends] = 32
    data = np.concatenate([lowered[inside], np.zeros(8, np.uint8)])
    lengths = raw_ends - raw_starts
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    first = np.cumsum([1, *[len(t) + 1 for t in texts]])[:-1] if texts else np.zeros(0, np.int64)
    row = np.searchsorted(first, raw_starts, side="right") - 1
    keys = _keys(data, starts, ends, seed)
    return Words(data, starts, ends, raw_starts - first[row], raw_ends - first[row], row, keys)


def windows(keys: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words."""
    n = len(keys) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + keys[k : k + n]
    return mix(out)


class HashSet:
    """Sorted 64-bit hashes behind a table of their leading bits."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.sort(hashes)
        bits = min(24, max(10, len(hashes).bit_length() + 5))
        self.shift = np.uint64(64 - bits)
        self.leading = np.zeros(1 << bits, bool)
        self.leading[hashes >> self.shift] = True

    def find(self, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in ``sought`` whose hash is here, and the first place here of each."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        spots = np.flatnonzero(self.leading[sought >> self.shift])
        places = np.searchsorted(self.hashes, sought[spots])
        same = self.hashes[np.minimum(places, len(self.hashes) - 1)] == sought[spots]
        return spots[same], places[same]


class Terms:
    """A list of distinct words in which the words of texts are looked up."""

    def __init__(self, terms: Sequence[bytes]) -> None:
        self.terms, self.seed = list(terms), 0
        while True:
            own = read([*self.terms], self.seed)
            if len(np.unique(own.keys)) == len(self.terms):
                break
            self.seed += 1  # two terms with one key: other keys
        order = np.argsort(own.keys)
        self.places = order
        self.set = HashSet(own.keys)
        self.lengths = (own.ends - own.starts)[order]
        self.longest = int(self.lengths.max(initial=0))
        self.chunks = [_chunk(own.data, np.minimum(own.starts[order], len(own.data) - 8 - 8 * k), np.where(self.lengths > 8 * k, self.lengths, 0), k)
                       for k in range((self.longest + 7) // 8)] if self.longest <= ARRAY_BYTES else None

    def match(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The words (read with ``seed``) that are terms, and the place of each one's term; exact."""
        spots, found = self.set.find(words.keys)
        lengths = (words.ends - words.starts)[spots]
        same = lengths == self.lengths[found]
        spots, found, lengths = spots[same], found[same], lengths[same]
        same = np.ones(len(spots), bool)
        if self.chunks is not None:
            for k, chunk in enumerate(self.chunks):
                some = np.flatnonzero(lengths > 8 * k)
                if not len(some):
                    break
                same[some] &= _chunk(words.data, words.starts[spots[some]], lengths[some], k) == chunk[found[some]]
        else:
            for i, (spot, place) in enumerate(zip(spots, found, strict=True)):
                same[i] = words.data[words.starts[spot] : words.ends[spot]].tobytes() == self.terms[self.places[place]]
        return spots[same], self.places[found[same]]
