"""Byte-level BPE of whole texts, with the work per distinct piece.

The vocabulary's pre-tokeniser cuts a text into pieces that are encoded on their
own.  Pieces are found for a whole chunk of texts at once; each distinct piece is
encoded by the tokenizers library's BPE model once, and its ids are copied to all
its places.  The result equals ``Tokenizer.encode(text, add_special_tokens=False)``
with special strings taken as ordinary text.
"""

from __future__ import annotations

import unicodedata
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from plotrows.llm import text as X

DEFAULT = "byte_bpe_50k.json"
# Fixed values of the vocabulary's pre-tokeniser: white space, and the endings that an apostrophe starts.
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


def default_path() -> str:
    """Where the 50k byte-level vocabulary lies (a parameter of the operators)."""
    import public_tokenizers
    return public_tokenizers.path(DEFAULT)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    kind = np.zeros(0x110000, np.int8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        kind[c] = _LETTER if k == "L" else _NUMBER if k == "N" else _OTHER
    kind[_WHITE] = _SPACE
    return kind


@dataclass
class Pieces:
    """Pieces of a chunk: code point ranges of ``cp``, hashes, pieces before each text."""

    cp: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    offset: np.ndarray
    at: np.ndarray  # code points before each text
    text: str       # the texts, joined


def pieces(texts: list[bytes]) -> Pieces:
    """Pre-tokenise: optional space + letters / numbers / others; apostrophe endings; white space."""
    strs = [t.decode() for t in texts]
    at = np.cumsum([0] + [len(s) for s in strs])
    joined = "".join(strs)
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(cp)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Pieces(cp, z, z, z.astype(np.uint64), np.zeros(len(texts) + 1, np.int64), at, "")
    kind = _kinds()[cp]
    head = np.zeros(n + 1, bool)  # a text begins here
    head[at] = True
    cut = head.copy()
    cut[1:n] |= kind[1:] != kind[:-1]
    # the last of several white spaces before something else stands alone ...
    ends = cut[1:].copy()          # a run ends with this character
    ends[-1] = True
    final = np.zeros(n, bool)      # ... unless the text ends there
    final[at[1:][at[1:] > 0] - 1] = True
    tail = (kind == _SPACE) & ends & ~final
    cut[:n] |= tail
    # ... and a plain space joins what follows
    joins = np.flatnonzero(tail & (cp == 0x20)) + 1
    cut[joins] = False
    # an apostrophe by itself, right after a piece, takes an ending
    lone = np.flatnonzero((cp[:-1] == 0x27) & cut[:n - 1] & cut[1:n] & (kind[1:] == _LETTER) & ~head[1:n])
    if len(lone):
        nxt = np.minimum(lone + 2, n - 1)
        more = (lone + 2 < n) & ~cut[nxt]
        first, second = cp[lone + 1], np.where(more, cp[nxt], 0)
        size = np.zeros(len(lone), np.int64)
        for e in _ENDINGS:
            same = (first == ord(e[0])) if len(e) == 1 else (first == ord(e[0])) & (second == ord(e[1]))
            size = np.where((size == 0) & same, len(e), size)
        ok = size > 0
        cut[lone[ok] + 1] = False
        cut[lone[ok] + 1 + size[ok]] = True
    cut[n] = True
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    h = X.segment_hash(X.prefix_hash(X.char_codes()[cp]), start, end)
    return Pieces(cp, start, end, h, np.searchsorted(start, at), at, joined)


@lru_cache(maxsize=1)
def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of the tokens of texts; keeps the ids of the pieces it has met.

    A piece's hash names its slot in a table, and the last piece of a slot stays: a frequent
    piece that a rare one put out is back at its next place, and nothing is sorted or listed
    but what is new.
    """

    def __init__(self, path: str, bits: int = 20, room: int = 8 << 20) -> None:
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        self.model = tok.model
        vocab = tok.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each token
        for token, i in vocab.items():
            self.width[i] = len(token)
        self.table = _byte_symbols()
        self.kind = np.min_scalar_type(len(self.width))
        self.bits, self.room = bits, room
        self._forget()

    def _forget(self) -> None:
        self.hash = np.zeros(1 << self.bits, np.uint64)
        self.hash[0] = ~np.uint64(0)  # an empty slot holds a hash of another slot
        self.first, self.size = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int32)
        self.ids, self.used = np.empty(self.room, self.kind), 0

    def _compact(self) -> None:
        """Keep the ids that slots refer to; nothing, if these take most of the room (costs time only)."""
        live = np.flatnonzero(self.size)
        first, size = self.first[live], self.size[live]
        if size.sum() > self.room // 4 * 3:
            return self._forget()
        ids = self.ids[_places(first, size)]
        self.ids, self.used = np.empty(self.room, self.kind), len(ids)
        self.ids[:len(ids)] = ids
        self.first[live] = np.cumsum(size) - size

    def _piece(self, s: str) -> bytes:
        if s.isascii() and s.isprintable():
            s = s.replace(" ", self.table[32])
        else:
            s = s.encode().decode("latin-1").translate(self.table)
        return array(self.kind.char, [t.id for t in self.model.tokenize(s)]).tobytes()

    def _add(self, p: Pieces, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode the pieces ``at``, of different sorted hashes: (place of the first id, number of ids)."""
        found = [self._piece(p.text[a:b]) for a, b in zip(p.start[at].tolist(), p.end[at].tolist(), strict=True)]
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        ids = np.frombuffer(b"".join(found), self.kind)
        first = self.used + np.cumsum(size) - size
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], ids])
        else:
            self.ids[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        slot = hashes >> np.uint64(64 - self.bits)
        last = np.append(slot[1:] != slot[:-1], True)
        slot = slot[last]
        self.hash[slot], self.first[slot], self.size[slot] = hashes[last], first[last], size[last]
        return first, size

    def encode(self, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """(ids, tokens before each text)."""
        if self.used > self.room // 8 * 7:
            self._compact()
        slot = p.hash >> np.uint64(64 - self.bits)
        first, size = self.first[slot], self.size[slot]
        new = np.flatnonzero(self.hash[slot] != p.hash)
        if len(new):
            u, one, back = np.unique(p.hash[new], return_index=True, return_inverse=True)
            f, n = self._add(p, u, new[one])
            first[new], size[new] = f[back], n[back]
        before = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        return self.ids[_places(first, size)].astype(np.uint32), before[p.offset]


def _places(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run, ``size`` places each."""
    end = np.cumsum(size, dtype=np.int64)
    return np.repeat(first - (end - size), size) + np.arange(end[-1] if len(end) else 0)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker process's encoder of a vocabulary; later tasks find its pieces."""
    return Encoder(path)
