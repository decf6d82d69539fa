"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming search.

Tokens are lower-cased runs of letters and digits; features are 5-token shingles
with their multiplicity as weight (an item of less than five tokens is one shingle,
its whole sequence).  An item of L tokens is compared with every window of L tokens:

1. Both get a 128-bit SimHash of their weighted shingles.
2. Fingerprints are cut into 16 blocks of 8 bits.  Two fingerprints within
   ``RADIUS`` (40) differ by at most 40 // 16 = 2 bits in some block, so tables of
   all block values within 2 bits of an item's find every item within the radius;
   the whole distance filters what they find.
3. The weighted Jaccard similarity of the shingles (sum of least over sum of
   largest weights) decides: 0.8 or more is a match.

At similarity 0.8 the expected distance is 20 with a deviation of 4, so that the
radius misses a match with a probability of about 1e-6.  A window without any of
the items' shingles has similarity 0 and gets no fingerprint.

Items are taken in blocks of at most ``BLOCK_ITEMS``; only a block's index is ever
broadcast, whatever the size of the benchmark, and documents are never grouped.

Defined results: null or tokenless items and texts match nothing; a document with
fewer tokens than the item is one window; ties of windows go to the first; items
with equal texts all match; repeated rows match alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotrows.llm import text as X

SHINGLE = 5
RADIUS = 40
BLOCKS = 16
SIMILARITY = 0.8
BLOCK_ITEMS = 20_000


@dataclass
class Lengths:
    """The items with one number of shingles."""

    items: list[int]
    prints: np.ndarray       # [items, 16] bytes
    near: np.ndarray         # [block, value, items]: within the block radius
    weights: list[Counter]


@dataclass
class Index:
    grams: np.ndarray        # sorted shingle hashes
    first: np.ndarray        # per shingle: its range in ``kind``
    kind: np.ndarray         # numbers of shingles of the items that have it
    by: dict[int, Lengths]


def _bits(h: np.ndarray) -> np.ndarray:
    """128 signs (+1, -1) of every shingle hash."""
    two = np.stack([h, X.mix(h + np.uint64(0x51ED27))], axis=1)
    return np.unpackbits(two.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def fingerprints(h: np.ndarray, size: int) -> np.ndarray:
    """SimHash [windows, 16 bytes] of all windows of ``size`` shingles (one, if there are fewer)."""
    size = min(size, len(h))
    run = np.concatenate([np.zeros((1, 128), np.int32), np.cumsum(_bits(h), axis=0)])
    return np.packbits(run[size:] - run[:-size] > 0, axis=1)


def index(items: pd.DataFrame) -> Index:
    """Index of (item_id, text) rows."""
    h, _, at = X.shingles(X.letter_runs([X.utf8(t) for t in items["text"]], digits=True), SHINGLE)
    own = [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    by: dict[int, Lengths] = {}
    sizes = np.array([len(x) for x in own], np.int64)
    for size in np.unique(sizes[sizes > 0]):
        which = np.flatnonzero(sizes == size)
        prints = np.concatenate([fingerprints(own[i], int(size)) for i in which])
        values = np.arange(256, dtype=np.uint8)[None, :, None]
        near = np.bitwise_count(values ^ prints.T[:, None, :]) <= RADIUS // BLOCKS
        by[int(size)] = Lengths([int(items["item_id"].iloc[i]) for i in which], prints, near, [Counter(own[i].tolist()) for i in which])
    gram, kind = np.concatenate([np.zeros(0, np.uint64), *own]), np.repeat(sizes, sizes)
    pairs = np.unique(np.stack([gram, kind.astype(np.uint64)]), axis=1)
    grams, first = np.unique(pairs[0], return_index=True)
    return Index(grams, np.append(first, pairs.shape[1]), pairs[1].astype(np.int64), by)


def _matches(ix: Index, h: np.ndarray, hits: np.ndarray, size: int) -> Iterator[tuple[int, int, int, float]]:
    """(item, first shingle, distance, similarity): the best window per item among those with a hit."""
    items = ix.by[size]
    span = min(size, len(h))
    last = len(h) - span
    cover = np.zeros(last + 2, np.int32)  # windows that contain a hit
    np.add.at(cover, np.maximum(hits - span + 1, 0), 1)
    np.add.at(cover, np.minimum(hits, last) + 1, -1)
    starts = np.flatnonzero(np.cumsum(cover)[: last + 1] > 0)
    groups = np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1)
    best: dict[int, tuple[float, int, int]] = {}
    for g in groups:
        prints = fingerprints(h[g[0]:g[-1] + span], span)
        found = np.zeros((len(g), len(items.items)), bool)
        for b in range(BLOCKS):
            found |= items.near[b][prints[:, b]]
        w, i = np.nonzero(found)
        distance = np.bitwise_count(prints[w] ^ items.prints[i]).sum(1)
        for s, k, d in zip(g[w[distance <= RADIUS]], i[distance <= RADIUS], distance[distance <= RADIUS], strict=True):
            window = Counter(h[s:s + span].tolist())
            common = sum(min(n, window[x]) for x, n in items.weights[k].items())
            likeness = common / (size + span - common)
            if likeness >= SIMILARITY and (k not in best or likeness > best[k][0]):
                best[k] = (likeness, int(s), int(d))
    for k, (likeness, s, d) in best.items():
        yield items.items[k], s, d, likeness


def _search(docs: DataFrame, ix: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ix)

    @X.tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        for f in frames:
            out = []
            for first, part in X.chunks(f["text"], X.LETTER_BYTES):
                r = X.letter_runs(part, digits=True)
                h, at, off = X.shingles(r, SHINGLE)
                if any(size == 1 for size in ix.by):  # short items: whole sequences of less than five tokens
                    out += _short(ix, r, f["doc_id"].iloc[first:first + len(part)].tolist())
                i, ok = X.lookup(ix.grams, h)
                pos = np.flatnonzero(ok)
                if not len(pos):
                    continue
                lo, hi = ix.first[i[pos]], ix.first[i[pos] + 1]
                n = hi - lo
                place = np.repeat(pos, n)
                kind = ix.kind[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
                doc = np.searchsorted(off, place, side="right") - 1
                order = np.lexsort((place, kind, doc))
                doc, kind, place = doc[order], kind[order], place[order]
                cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(kind) != 0)) + 1
                for g in np.split(np.arange(len(doc)), cuts):
                    j, size = int(doc[g[0]]), int(kind[g[0]])
                    a, b = int(off[j]), int(off[j + 1])
                    for item, s, d, likeness in _matches(ix, h[a:b], place[g] - a, size):
                        t = at[a + s]  # its first and last token
                        e = min(t + size + SHINGLE - 2, int(r.offset[j + 1]) - 1)
                        out.append((f["doc_id"].iloc[first + j], item, int(r.start[t] - r.at[j]), int(r.end[e] - r.at[j]), d, likeness))
            yield pd.DataFrame(dict(zip(_COLUMNS, map(list, zip(*out, strict=True)), strict=True)) if out else {c: [] for c in _COLUMNS})
    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, item_id long, start long, end long, distance int, similarity double")


_COLUMNS = ["doc_id", "item_id", "start", "end", "distance", "similarity"]


def _short(ix: Index, r: X.Runs, ids: list[int]) -> list[tuple]:
    """Matches of items of one to four tokens: the same sequence of tokens in a longer text."""
    out = []
    items = ix.by[1]
    for k in range(1, SHINGLE):
        n = np.maximum(np.diff(r.offset) - k + 1, 0)
        at = np.repeat(r.offset[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        h = X.segment_hash(X.prefix_hash(r.hash), at, at + k)
        doc = np.repeat(np.arange(len(n)), n)
        for i, weights in enumerate(items.weights):
            same = np.flatnonzero(h == np.uint64(next(iter(weights))))
            _, one = np.unique(doc[same], return_index=True)
            for s in same[one]:
                j = int(doc[s])
                if r.offset[j + 1] - r.offset[j] > k:  # a text of just these tokens is found by its fingerprint
                    out.append((ids[j], items.items[i], int(r.start[at[s]] - r.at[j]), int(r.end[at[s] + k - 1] - r.at[j]), 0, 1.0))
    return out


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, distance, similarity): the best window of each matching pair.

    ``start`` and ``end`` are code points of the text.
    """
    items = benchmark.where("text is not null and item_id is not null").select("item_id", "text").distinct()
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    found = []
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        found.append(_search(docs, index(part.orderBy("item_id", "text").toPandas())))
    return reduce(DataFrame.union, found)
