"""Substring dedup: words inside stretches that occur more than once, by FM-indexes.

A window is ``least`` consecutive words of a document.  Words that a window covers
are removed if its word sequence starts anywhere else, too.

1. *Segments*.  A window's anchor is the smallest of its ``GRAM``-word hashes (the first
   of equal ones), so equal windows have equal anchors wherever they stand.  Consecutive
   windows with one anchor at one place form a segment; two segments of a document share
   fewer words than a window has, so every window lies in exactly one, and no window
   occurs twice in a segment.  Equal segments of a chunk of texts are counted there, and
   only the first goes on.
2. *Candidates*.  Segments meet at their anchor.  A segment that occurs twice repeats as a
   whole; one whose anchor occurs nowhere else has no repeated window.  The others -- with
   one copy of every repeated segment of their anchor -- are candidates.  An anchor of very
   many segments (a common line in ever new contexts) is not gathered: its segments meet
   by their own hash, are all candidates, and are cut anew with such anchors avoided
   (windows that have no other go by their own hash, one for each chunk).
3. *Shards*.  Candidates' words are dealt by anchor to shards of about ``SHARD_WORDS`` words.
   Each shard builds a compressed FM-index of its segments, streams the open ones through it
   and reports the stretches of ``least`` words or more that its backward search finds twice.
4. Stretches are gathered for each document, and its words outside them are kept.

Results are exact for all windows: anchors only say where windows meet.  Words are told
apart by 64-bit hashes.  Documents are keyed by doc_id and a hash of the text; repeated
rows have equal results, and their windows count as often as the rows.

Memory: a task holds a chunk of texts (a text is never cut), one partition of segment
headers, or one shard.

Defined results: null, empty and wordless texts have no words, and the hash of an empty
string; a null ``doc_id`` stays null; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotrows.llm import text as X
from plotrows.llm.fmindex import FMIndex
from plotrows.session import scratch_path

LEAST = 35
GRAM = 3
SHARD_WORDS = 1_000_000
HEADERS = 500_000          # of a partition
HOT = 20_000               # segments of one anchor that a task takes
MOST_HOT = 10_000          # anchors above the limit, which grows if there could be more
_U = np.uint64
_TOP = _U(1) << _U(63)
KNOWN, OPEN, COPY = 0, 1, 2  # repeated as a whole; to be searched; repeated and part of the index


@dataclass
class Segments:
    """Segments of a chunk: document (in the chunk), first window, number of windows, anchor, hash of the words."""

    doc: np.ndarray
    start: np.ndarray
    n: np.ndarray
    anchor: np.ndarray
    hash: np.ndarray


def anchors(w: X.Words, least: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of the window that starts at each word, and the word it stands at (of no use where no window starts)."""
    n = len(w.hash)
    prefix = X.prefix_hash(w.hash)
    at = np.arange(max(0, n - GRAM + 1))
    small = X.segment_hash(prefix, at, at + GRAM) >> _U(1)
    if len(hot):
        small = np.where(X.lookup(hot, small)[1], small | _TOP, small)

    def least_of(small: np.ndarray, at: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """Minima of neighbours at a distance, the left one among equals."""
        if len(small) <= shift:
            return small[:0], at[:0]
        left = small[:-shift] <= small[shift:]
        return np.where(left, small[:-shift], small[shift:]), np.where(left, at[:-shift], at[shift:])

    width, span = least - GRAM + 1, 1
    while span * 2 <= width:  # minima of 2, 4, 8 ... neighbours
        small, at = least_of(small, at, span)
        span *= 2
    if width > span:
        small, at = least_of(small, at, width - span)
    if len(hot):  # nothing but hot grams: the window itself
        s = np.flatnonzero(small & _TOP)
        small, at = small.copy(), at.copy()
        small[s] = X.segment_hash(prefix, s, s + least) | _TOP
        at[s] = s
    anchor, place = np.zeros(n, _U), np.zeros(n, np.int64)
    anchor[: len(small)], place[: len(at)] = small, at
    return anchor, place


def segments(w: X.Words, least: int, anchored: tuple[np.ndarray, np.ndarray], inside: np.ndarray) -> Segments:
    """Runs of windows with one anchor at one place, among those marked ``inside`` (by first word)."""
    anchor, place = anchored
    at = np.flatnonzero(inside)
    if not len(at):
        return Segments(*(np.zeros(0, np.int64),) * 3, np.zeros(0, _U), np.zeros(0, _U))
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (place[at[1:]] != place[at[:-1]])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    start = at[first]
    doc = np.searchsorted(w.offset, start, side="right") - 1
    return Segments(doc, start - w.offset[doc], n, anchor[start], X.segment_hash(X.prefix_hash(w.hash), start, start + n + least - 1))


def _windows(w: X.Words, least: int) -> np.ndarray:
    """Does a window start at the word?"""
    n = np.diff(w.offset)
    return np.arange(len(w.hash)) + least <= np.repeat(w.offset[1:], n)


_NO_HOT = np.zeros(0, _U)


def _headers(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Segments of whole texts; ``times`` is 0 for all but the first of equal ones in a chunk."""
    for b in batches:
        for at, part in X.chunks(b["text"].to_pylist()):
            w = X.words(part, lower=False)
            s = segments(w, least, anchors(w, least, _NO_HOT), _windows(w, least))
            _, first, back, count = np.unique(s.hash, return_index=True, return_inverse=True, return_counts=True)
            times = np.zeros(len(s.hash), np.int64)
            times[first] = count
            near = np.zeros(len(s.hash), np.int64)  # different segments of the anchor in the chunk
            if len(first):
                _, group, size = np.unique(s.anchor[first], return_inverse=True, return_counts=True)
                near[first] = size[group]
            ids, key = (b[c].to_numpy()[at + s.doc] for c in ("id", "key"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (ids, key, s.start.astype(np.int32), s.n.astype(np.int32), s.anchor.view(np.int64), s.hash.view(np.int64), times.astype(np.int32), (count[back] > 1 if len(back) else np.zeros(0, bool)), near.astype(np.int32))],
                ["id", "key", "start", "n", "anchor", "hash", "times", "known", "near"])


_HEADERS = "id long, key long, start int, n int, anchor long, hash long, times int, known boolean, near int"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which segments of a partition repeat, and which are candidates."""
    t = pa.Table.from_batches(list(batches)).combine_chunks() if (batches := [b for b in batches if b.num_rows]) else None
    if t is None:
        return
    col = {c: t[c].to_numpy() for c in ("id", "key", "anchor", "hash", "packed")}
    packed = col["packed"]
    start, n, twice, hot = packed >> 16, packed >> 2 & 0x3FFF, packed >> 1 & 1, (packed & 1).astype(bool)
    _, first, back = np.unique(col["hash"], return_index=True, return_inverse=True)
    same = np.bincount(back, 1 + twice)[back] >= 2
    _, group, size = np.unique(col["anchor"][first], return_inverse=True, return_counts=True)
    shared = (size[group] >= 2)[back] | hot
    one = np.zeros(len(same), bool)
    one[first] = True
    kind = np.where(same, np.where(shared & one, COPY, KNOWN), OPEN)
    keep = same | shared
    found = (col["id"], col["key"], start.astype(np.int32), n.astype(np.int32), kind.astype(np.int32))
    yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in found], ["id", "key", "start", "n", "kind"])


_CANDIDATES = "id long, key long, start int, n int, kind int"


def _payload(batches: Iterator[pa.RecordBatch], least: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The words of candidates, with the anchor they meet at; without words: a known stretch."""
    for b in batches:
        for at, part in X.chunks(b["text"].to_pylist()):
            w = X.words(part, lower=False)
            lists = b["candidates"].slice(at, len(part))
            n = lists.value_lengths().to_numpy()
            flat = lists.flatten()
            start, size, kind = (flat.field(c).to_numpy() for c in ("start", "n", "kind"))
            doc = np.repeat(np.arange(len(part)), n)
            first = w.offset[doc] + start
            plain = anchors(w, least, _NO_HOT)[0][first]
            cut = X.lookup(hot, plain)[1]
            parts = [(doc[~cut], start[~cut], size[~cut], kind[~cut], plain[~cut])]
            if cut.any():
                kinds = np.full(len(w.hash), -1, np.int64)
                for i in np.flatnonzero(cut):
                    kinds[first[i]:first[i] + size[i]] = kind[i]
                again = anchors(w, least, hot)
                for k in (OPEN, COPY):
                    s = segments(w, least, again, kinds == k)
                    parts.append((s.doc, s.start, s.n, np.full(len(s.doc), k), s.anchor))
            doc, start, size, kind, anchor = (np.concatenate(p) for p in zip(*parts, strict=True))
            # windows that go by their own hash: one of each chunk, the others are known to repeat
            alone = np.flatnonzero(anchor & _TOP)
            if len(alone):
                _, one, count = np.unique(anchor[alone], return_index=True, return_counts=True)
                more = np.isin(anchor, anchor[alone[one[count > 1]]])
                kind = np.where(more, KNOWN, kind)
                kind[alone[one[count > 1]]] = COPY
            ids, key = (b[c].to_numpy()[at + doc] for c in ("id", "key"))
            known = kind == KNOWN
            place = np.where(known, key, anchor.view(np.int64))
            begin = (w.offset[doc] + start).astype(np.int64)
            length = np.where(known, 0, size + least - 1)
            limit = np.concatenate([[0], np.cumsum(length)])
            inner = np.repeat(begin - limit[:-1], length) + np.arange(limit[-1])
            words = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer((8 * limit).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(w.hash[inner]))])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(key), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(kind.astype(np.int32)), pa.array(place), words],
                                             ["id", "key", "start", "n", "kind", "place", "words"])


_PAYLOAD = "id long, key long, start int, n int, kind int, place long, words binary"
_STRETCHES = "id long, key long, `from` int, `to` int"


def _shard(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Stretches of a shard's open segments that occur twice in the shard."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    ids, key, start, n, kind = (t[c].to_numpy() for c in ("id", "key", "start", "n", "kind"))

    def out(row: np.ndarray, first: np.ndarray, limit: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(key[row]), pa.array(first.astype(np.int32)), pa.array(limit.astype(np.int32))], ["id", "key", "from", "to"])

    whole = np.flatnonzero(kind != OPEN)
    yield out(whole, start[whole], start[whole] + n[whole] + least - 1)
    raw = np.frombuffer(b"".join(t["words"].to_pylist()), _U)
    length = np.where(kind == KNOWN, 0, n + least - 1).astype(np.int64)
    rows = np.flatnonzero(length)
    if not len(rows):
        return
    names, symbols = np.unique(raw, return_inverse=True)
    symbols += 1
    limit = np.concatenate([[0], np.cumsum(length[rows])])
    index = FMIndex(symbols, limit, len(names))
    search = np.flatnonzero(kind[rows] == OPEN)
    run, first, end = index.repeats(symbols, limit[search], limit[search + 1], least)
    row = rows[search[run]]
    base = start[row] - limit[search[run]]
    yield out(row, base + first, base + end)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_words, n_removed, sha = [], [], []
        for text, found in zip(b["text"], b["found"], strict=True):
            words = X.utf8(text.as_py()).split()  # splits bytes at \x20 and \x09-\x0D only
            n_words.append(len(words))
            if found.is_valid:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, found.values.field("from").to_numpy(), 1)
                np.add.at(edge, found.values.field("to").to_numpy(), -1)
                words = list(itertools.compress(words, np.cumsum(edge[:-1]) == 0))
            n_removed.append(n_words[-1] - len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def stretches(docs: DataFrame, least: int = LEAST, hot_segments: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """id, key, from, to: the stretches of words [from, to) of every document that repeat; they may overlap.

    ``docs`` has id, key (together of one text) and text.
    """
    spark = docs.sparkSession
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    headers = stored(docs.mapInArrow(lambda it: _headers(it, least), _HEADERS), "segment-headers")
    sent = headers.where(F.col("times") > 0)
    total = sent.count()
    # An anchor left out has at most this many segments, and one more for each chunk.
    most = max(hot_segments, total // MOST_HOT)
    hot = sent.where(F.col("near") > 1).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("anchor").collect()
    hot_set = np.sort(np.array([r["anchor"] for r in hot], np.int64).view(_U))
    is_hot = spark.createDataFrame([(r["anchor"], True) for r in hot], "anchor long, hot boolean")
    marked = sent.join(F.broadcast(is_hot), "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    # first window, number of windows, seen twice in its chunk, hot: one number in the shuffle
    packed = F.shiftleft(F.col("start").cast("long"), 16) + F.shiftleft("n", 2) + F.when(F.col("times") > 1, 2).otherwise(0) + F.col("hot").cast("int")
    met = (marked.select("id", "key", "anchor", "hash", packed.alias("packed"))
           .repartition(max(at_least, -(-total // HEADERS)), F.when(F.col("packed") % 2 == 1, F.col("hash")).otherwise(F.col("anchor")))
           .mapInArrow(_meet, _CANDIDATES))
    more = headers.where((F.col("times") == 0) & F.col("known")).select("id", "key", "start", "n", F.lit(KNOWN).alias("kind"))
    candidates = stored(met.unionByName(more), "segment-candidates")

    indexed = candidates.where(F.col("kind") != KNOWN)
    words = indexed.agg(F.sum(F.col("n") + least - 1).alias("n")).first()["n"] or 0
    lists = indexed.groupBy("id", "key").agg(F.collect_list(F.struct("start", "n", "kind")).alias("candidates"))
    texts = docs.join(lists, ["id", "key"])
    payload = texts.select("id", "key", "text", "candidates").mapInArrow(lambda it: _payload(it, least, hot_set), _PAYLOAD)
    found = payload.repartition(max(at_least, -(-words // shard_words)), "place").mapInArrow(lambda it: _shard(it, least), _STRETCHES)
    known = candidates.where(F.col("kind") != OPEN).select("id", "key", F.col("start").alias("from"), (F.col("start") + F.col("n") + least - 1).alias("to"))
    return known.unionByName(found)


def dedupe(docs: DataFrame, least: int = LEAST, hot_segments: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs``."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    keyed = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(0)).cast("long").alias("id"), F.xxhash64(doc_id.isNull(), text).alias("key"), text.alias("text"))
    found = stretches(keyed.where(text.isNotNull()).select("id", "key", "text"), least, hot_segments, shard_words)
    by_doc = found.groupBy("id", "key").agg(F.collect_list(F.struct("from", "to")).alias("found"))
    return (keyed.join(by_doc, ["id", "key"], "left").select("doc_id", "text", "found")
            .mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string"))
