"""Vectorised helpers over batches of whole texts: words, letter runs, 64-bit hashes.

A *word* is a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D`` of the
UTF-8 text after A-Z lower-casing.  All of those separators are single ASCII
bytes, so working on UTF-8 bytes is exact.  Batches are cut into chunks of a few
megabytes (a memory bound; a longer text is a chunk of its own), so a task's
memory does not grow with the table.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 3 << 20
LETTER_BYTES = 1 << 18  # for work on code points: about twenty times as much memory, and faster in small pieces
_KEPT_POWERS = 1 << 18

_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_U = np.uint64
_SURROGATE = re.compile("[\ud800-\udfff]")


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))


class _Powers:
    """Powers of the hash multiplier and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _MULT), ("down", _INV)):
                a = np.full(size, _U(base), np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up, self.down


_POWERS = _Powers()


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Running polynomial sums of 64-bit symbol codes; input of :func:`segment_hash`."""
    up, _ = _POWERS.get(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.add.accumulate(codes * up[: len(codes)], out=out[1:])
    return out


def segment_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the symbol runs [start, end); equal runs have equal hashes."""
    _, down = _POWERS.get(len(prefix) + 1)
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def release() -> None:
    """Give back what earlier tasks left in this worker process.

    Workers are used again by later stages: the tokenizer's pieces, the powers for a long
    text and freed memory that the allocators still hold would count against the next one.
    """
    if tokens := sys.modules.get("plotrows.llm.tokens"):
        tokens.encoder.cache_clear()
    if len(_POWERS.up) > _KEPT_POWERS:
        _POWERS.__init__()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives its memory back before and after each task: an idle worker counts, too."""
    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        release()
        yield from run(batches)
        release()
    return task


def strings(texts: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 texts of an Arrow array, one at a time."""
    return (t.as_py() for t in texts.cast(pa.binary()))


def utf8(text: str | bytes | None) -> bytes:
    """UTF-8 bytes of a text (bytes are taken as they are); null is empty, lone surrogates become U+FFFD."""
    if not text:
        return b""
    if isinstance(text, bytes):
        return text
    try:
        return text.encode()
    except UnicodeEncodeError:
        return _SURROGATE.sub("�", text).encode()


def chunks(texts: Iterable[str | bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Yield (index of the first text, UTF-8 texts) with about ``limit`` bytes each."""
    first, part, size = 0, [], 0
    for i, t in enumerate(texts):
        b = utf8(t)
        if part and size + len(b) > limit:
            yield first, part
            first, part, size = i, [], 0
        part.append(b)
        size += len(b)
    if part:
        yield first, part


@dataclass
class Words:
    """The words of a chunk: ``hash``, byte range in ``buf``, and per-text word offsets."""

    buf: np.ndarray
    raw: bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    offset: np.ndarray  # len = number of texts + 1


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def words(texts: list[bytes], lower: bool = True, gap: np.ndarray = _SPACE) -> Words:
    """Words of every text, in order; hashes are of the (lower-cased) bytes.

    ``gap`` marks the separator bytes; a space is one.
    """
    raw = b" ".join([b"", *texts, b""])
    if lower:
        raw = raw.lower()
    buf = np.frombuffer(raw, np.uint8)
    gap = gap[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1  # starts and ends alternate: the buffer begins and ends with a space
    start, end = edge[0::2], edge[1::2]
    h = segment_hash(prefix_hash(_byte_codes()[buf]), start, end)
    at = np.cumsum([1] + [len(t) + 1 for t in texts])
    return Words(buf, raw, start, end, h, np.searchsorted(start, at))


def shingles(w: Words | Runs, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, per-text offset) of the k-word shingles in order.

    A text with 1 to k-1 words has one shingle, the whole sequence; a text
    without words has none.
    """
    n = len(w.hash)
    count = np.diff(w.offset)
    last = np.repeat(w.offset[1:], count)
    pos = np.arange(n)
    size = np.minimum(k, count)
    keep = pos + np.repeat(size, count) <= last
    p = prefix_hash(w.hash)
    at = pos[keep]
    h = segment_hash(p, at, at + np.repeat(size, count)[keep])
    per = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    return h, at, np.concatenate([[0], np.cumsum(per)])


@lru_cache(maxsize=2)
def _letters(digits: bool) -> np.ndarray:
    """Per code point: is it a letter (or, if asked for, a digit)?"""
    kind = str.isalnum if digits else str.isalpha
    return np.fromiter((kind(chr(c)) for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def char_codes() -> np.ndarray:
    """64-bit code of every code point."""
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * _U(0xA24BAED4963EE407))


@dataclass
class Runs:
    """Letter runs (lower-cased) of a chunk in code points."""

    cp: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    offset: np.ndarray  # runs before each text
    at: np.ndarray      # code points before each text (in ``cp``)


def letter_runs(texts: list[bytes], digits: bool = False) -> Runs:
    """Maximal runs of letters (with ``digits``: letters and digits) of every text.

    Lower-casing keeps the number of code points (a character whose lower case
    is longer stays as it is), so offsets hold for the original text.
    """
    strs = [t.decode() for t in texts]
    low = []
    for s in strs:
        v = s.lower()
        low.append(v if len(v) == len(s) else "".join(c.lower() if len(c.lower()) == 1 else c for c in s))
    joined = " " + " ".join(low) + " "
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    letter = _letters(digits)[cp]
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    h = segment_hash(prefix_hash(char_codes()[cp]), start, end)
    at = np.cumsum([1] + [len(s) + 1 for s in low])
    return Runs(cp, start, end, h, np.searchsorted(start, at), at)


def lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, found) of keys in a sorted hash array."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    i = np.searchsorted(table, keys)
    i[i == len(table)] = 0
    return i, table[i] == keys
