"""An n-gram trie in compact flat levels: Elias-Fano sequences and one-byte probabilities.

The trie is keyed by the middle word of a trigram (*root*), because both shorter
contexts of a prediction share it:

* level A: the successors of each root, as (root rank, word) in one monotone sequence,
  with the probability of the pair;
* level B: the words before each root, as (root rank, word), with the weight that the
  context (word, root) leaves to the pair;
* level C: the successors of each context.  A successor is written as its *rank among the
  successors of the root*, made monotone by the sizes of the earlier contexts' ranges;
  with the probability of the trigram.

Pointers (where a root's or context's children begin) are Elias-Fano sequences, too.
A lookup finds the root, the pair and the context, and then searches the pair's rank
among the context's successors.  All levels are plain arrays of one buffer: ``pack``
writes it, ``Trie(buffer)`` maps it -- bytes, or an ``np.memmap`` of a file -- and
answers batches of queries without unpacking anything.

Probabilities and weights are quantised to one byte: eighths of a power of two, 255
for zero.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

DISCOUNT = 0.75
WORD_BITS = 32  # of a word's hash inside a root, whose size is bounded; the root itself has all 64
NEVER = 255
_STEPS = 8
_U = np.uint64


def quantise(p: np.ndarray) -> np.ndarray:
    """One-byte codes of values in 0..1."""
    with np.errstate(divide="ignore"):
        code = np.rint(-np.log2(p) * _STEPS)
    return np.where(p > 0, np.clip(code, 0, NEVER - 1), NEVER).astype(np.uint8)


VALUES = np.append(np.exp2(-np.arange(NEVER) / _STEPS), 0.0)


def _select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the one number ``rank`` (from 0) in each 64-bit word."""
    x, r, at = words.copy(), rank.astype(np.int64), np.zeros(len(words), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(x & _U((1 << width) - 1)).astype(np.int64)
        go = r >= ones
        r -= ones * go
        at += width * go
        x >>= (width * go).astype(np.uint64)
    return at


class Monotone:
    """Elias-Fano form of a non-decreasing sequence: packed low bits, unary high parts."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @staticmethod
    def of(values: np.ndarray, universe: int) -> Monotone:
        """Of values below ``universe``."""
        n = len(values)
        values = values.astype(np.uint64)
        bits = min(max((universe // max(n, 1)).bit_length() - 1, 0), 62)
        top = (values >> _U(bits)).astype(np.int64)
        flags = np.zeros(-(-(n + ((universe - 1) >> bits) + 2) // 64) * 64, np.uint8)
        flags[top + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            part = values & _U((1 << bits) - 1)
            place = np.arange(n, dtype=np.int64) * bits
            word, off = place >> 6, (place & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << off)
            over = off > 64 - bits
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (_U(64) - off[over]))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))]).astype(np.uint32)
        return Monotone(n, bits, low, high, ones)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        place = i * self.low_bits
        word, off = place >> 6, (place & 63).astype(np.uint64)
        got = self.low[word] >> off
        # a shift by 64 is not defined: shift twice
        got |= (self.low[word + 1] << _U(1)) << (_U(63) - off)
        return got & _U((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values number ``i``."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        top = word * 64 + _select(self.high[word], i - self.ones[word]) - i
        return (top.astype(np.uint64) << _U(self.low_bits)) | self.lows(i)

    def _before(self, top: np.ndarray) -> np.ndarray:
        """How many values have a high part below ``top``: ones before zero number top - 1."""
        zero = np.maximum(top - 1, 0)
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        word = np.minimum(np.searchsorted(zeros, zero, side="right") - 1, len(self.high) - 1)
        return np.where(top > 0, word * 64 + _select(~self.high[word], zero - zeros[word]) - zero, 0)

    def find(self, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of values among the places [lo, hi)."""
        top = (q >> _U(self.low_bits)).astype(np.int64)
        want = q & _U((1 << self.low_bits) - 1)
        a, b = np.maximum(self._before(top), lo), np.minimum(self._before(top + 1), hi)
        end = b.copy()
        left = np.flatnonzero(a < b)
        while len(left):
            mid = (a[left] + b[left]) >> 1
            up = self.lows(mid) < want[left]
            a[left] = np.where(up, mid + 1, a[left])
            b[left] = np.where(up, b[left], mid)
            left = left[a[left] < b[left]]
        ok = a < end
        ok[ok] = self.lows(a[ok]) == want[ok]
        return a, ok


_LEVELS = ("roots", "pair", "pair_at", "before", "before_at", "next", "next_at")
_FLAT = ("base", "root_weight", "pair_code", "before_weight", "next_code")


class Shared(NamedTuple):
    """Pair level of roots whose contexts lie in several tries: per root its total and number of pairs, per pair its words before, all > 0."""

    root: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    pair_root: np.ndarray
    pair_word: np.ndarray
    spread: np.ndarray


def pack(root: np.ndarray, before: np.ndarray, word: np.ndarray, count: np.ndarray, discount: float = DISCOUNT, shared: Shared | None = None) -> bytes:
    """The trie of distinct trigrams: 64-bit roots, ``WORD_BITS`` hashes of the word before and after, counts > 0.

    Interpolated Kneser-Ney: trigrams by their counts, pairs by the number of
    distinct words before them, both less ``discount``.  For the roots of ``shared``
    the pair level is taken from there; it has all of the trigrams' pairs.
    """
    shift = _U(WORD_BITS)
    if shared is None:
        shared = Shared(*(np.zeros(0, np.uint64) for _ in Shared._fields))
    n = len(root)
    roots, r = np.unique(np.concatenate([root, shared.pair_root, shared.root]), return_inverse=True)
    r, shared_at = r[:n + len(shared.pair_root)], r[n + len(shared.pair_root):]
    pairs, a = np.unique((r.astype(np.uint64) << shift) | np.concatenate([word, shared.pair_word]), return_inverse=True)
    r, a, shared_pair = r[:n], a[:n], a[n:]
    contexts, b = np.unique((r.astype(np.uint64) << shift) | before, return_inverse=True)
    order = np.lexsort((a, b))
    a, b, count = a[order], b[order], count[order].astype(float)
    root_of_pair, root_of_context = (pairs >> shift).astype(np.int64), (contexts >> shift).astype(np.int64)
    pair_at = np.searchsorted(root_of_pair, np.arange(len(roots) + 1))
    before_at = np.searchsorted(root_of_context, np.arange(len(roots) + 1))
    width, held = np.diff(pair_at), np.diff(before_at)
    base = np.concatenate([[0], np.cumsum(width * held)])
    start = base[root_of_context] + (np.arange(len(contexts)) - before_at[root_of_context]) * width[root_of_context]

    total, kinds = np.bincount(b, count, len(contexts)), np.bincount(b, minlength=len(contexts))
    spread = np.bincount(a, minlength=len(pairs)).astype(float)
    spread[shared_pair] = shared.spread
    root_total, root_kinds = np.bincount(root_of_pair, spread, len(roots)), width.copy()
    root_total[shared_at], root_kinds[shared_at] = shared.total, shared.kinds
    parts = {
        "roots": Monotone.of(roots, 1 << 64), "pair": Monotone.of(pairs, max(len(roots), 1) << WORD_BITS),
        "pair_at": Monotone.of(pair_at, len(pairs) + 1), "before": Monotone.of(contexts, max(len(roots), 1) << WORD_BITS),
        "before_at": Monotone.of(before_at, len(contexts) + 1),
        "next": Monotone.of(start[b] + a - pair_at[root_of_context[b]], int(base[-1]) + 1),
        "next_at": Monotone.of(np.searchsorted(b, np.arange(len(contexts) + 1)), len(b) + 1),
        "base": base, "root_weight": quantise(discount * root_kinds / np.maximum(root_total, 1)),
        "pair_code": quantise((spread - discount) / root_total[root_of_pair]),
        "before_weight": quantise(discount * kinds / np.maximum(total, 1)), "next_code": quantise((count - discount) / total[b]),
    }
    head, body = [], []
    for name in _LEVELS:
        m = parts[name]
        head += [m.n, m.low_bits, len(m.low), len(m.high)]
        body += [m.low, m.high, np.append(m.ones, np.zeros(len(m.ones) % 2, np.uint32))]
    for name in _FLAT:
        head += [len(parts[name])]
        body += [parts[name], np.zeros(-parts[name].nbytes % 8, np.uint8)]
    return b"".join([np.array(head, np.int64).tobytes(), *(x.tobytes() for x in body)])


class Trie:
    """A packed trie, mapped from a buffer; words are 64-bit hashes."""

    def __init__(self, buffer: bytes | np.ndarray) -> None:
        head = np.frombuffer(buffer, np.int64, 4 * len(_LEVELS) + len(_FLAT))
        at = head.nbytes

        def take(kind: type, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(buffer, kind, n, at)
            at += -(-got.nbytes // 8) * 8
            return got

        for i, name in enumerate(_LEVELS):
            n, bits, low, high = head[4 * i:4 * i + 4].tolist()
            setattr(self, name, Monotone(n, bits, take(np.uint64, low), take(np.uint64, high), take(np.uint32, high + 1)))
        sizes = head[4 * len(_LEVELS):].tolist()
        self.base = take(np.int64, sizes[0])
        self.root_weight, self.pair_code, self.before_weight, self.next_code = (take(np.uint8, n) for n in sizes[1:])

    def find_root(self, root: np.ndarray) -> np.ndarray:
        """Ranks of roots; -1 for unknown ones."""
        r, ok = self.roots.find(root, np.zeros(len(root), np.int64), np.full(len(root), self.roots.n))
        return np.where(ok, r, -1)

    def _child(self, level: Monotone, pointer: Monotone, r: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.full(len(r), -1)
        i = np.flatnonzero(r >= 0)
        if len(i):
            lo, hi = (pointer.get(r[i] + d).astype(np.int64) for d in (0, 1))
            at, ok = level.find((r[i].astype(np.uint64) << _U(WORD_BITS)) | word[i], lo, hi)
            out[i[ok]] = at[ok]
        return out

    def find_pair(self, r: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self._child(self.pair, self.pair_at, r, word)

    def find_context(self, r: np.ndarray, before: np.ndarray) -> np.ndarray:
        return self._child(self.before, self.before_at, r, before)

    def find_next(self, r: np.ndarray, context: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Places of trigrams: the pair's rank among the context's successors; -1 if there is none."""
        out = np.full(len(r), -1)
        i = np.flatnonzero((context >= 0) & (pair >= 0))
        if len(i):
            ri, first = r[i], self.pair_at.get(r[i]).astype(np.int64)
            width = self.pair_at.get(ri + 1).astype(np.int64) - first
            start = self.base[ri] + (context[i] - self.before_at.get(ri).astype(np.int64)) * width
            lo, hi = (self.next_at.get(context[i] + d).astype(np.int64) for d in (0, 1))
            at, ok = self.next.find((start + pair[i] - first).astype(np.uint64), lo, hi)
            out[i[ok]] = at[ok]
        return out

    def probabilities(self, r: np.ndarray, context: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(A, G): a trigram's probability is A + G * its last word's own probability."""
        trigram = self.find_next(r, context, pair)

        def value(codes: np.ndarray, at: np.ndarray, other: float) -> np.ndarray:
            return np.where(at >= 0, VALUES[codes[np.maximum(at, 0)]], other) if len(codes) else np.full(len(at), other)

        two, rest = value(self.pair_code, pair, 0.0), value(self.root_weight, r, 1.0)
        weight = value(self.before_weight, context, 1.0)
        return value(self.next_code, trigram, 0.0) + weight * two, weight * rest
