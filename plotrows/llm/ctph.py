"""Context-triggered piecewise hashing: document fingerprints that survive local edits.

A rolling hash over the last 7 bytes triggers a boundary wherever its low k bits are
zero; the expected chunk is 2**k bytes.  Every chunk gives one of 64 letters (a hash
of its bytes); runs of more than three equal letters are cut to three.  k is found from
the least one with at most 64 chunks, less as long as at most 64 letters stay.  The fingerprint is
``block:letters at k:at k + 1:at k + 2`` with block = 2**k, so texts whose block sizes
differ by a factor of two or four still share a level.

Likeness compares the letters at the finest common block size by insert-delete distance
d: 1 - d / (letters of both); 0 without a common level or without a common run of
letters (five; less for short ones).

Defined results: null is empty; the empty text has the fingerprint ``2:::``; equal
texts have equal fingerprints and likeness 1; a repeated row is its own successor;
rows without ``doc_id`` come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotrows.llm import text as X

WINDOW = 7
MOST_CHUNKS = 64
RUN = 5
LEVELS = 3
CHUNK_BYTES = 1 << 20
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def fingerprints(texts: list[bytes]) -> list[str]:
    """Fingerprints of UTF-8 texts, at once for a chunk."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    at = np.cumsum([0] + [len(t) for t in texts])
    sizes = np.diff(at)
    doc = np.repeat(np.arange(len(texts)), sizes)
    prefix = X.prefix_hash(X._byte_codes()[buf])
    pos = np.arange(len(buf))
    begin = np.maximum(pos + 1 - WINDOW, at[:-1][doc])
    _, down = X._POWERS.get(len(buf) + 2)
    rolled = ((prefix[1:] - prefix[begin]) * down[begin]) >> np.uint64(20)
    level = np.bitwise_count((rolled & (~rolled + np.uint64(1))) - np.uint64(1)).astype(np.int8)  # trailing zeros
    # a boundary after the last byte is no boundary: the text ends there
    level[at[1:][sizes > 0] - 1] = 0
    k = np.zeros(len(texts), np.int64)
    many, left = np.ones(len(texts), bool), np.flatnonzero(level)
    step = 0
    while many.any():
        step += 1
        left = left[level[left] >= step]
        many = np.bincount(doc[left], minlength=len(texts)) >= MOST_CHUNKS
        k = np.where((k == 0) & ~many, step, k)
        many &= k == 0
    # texts that repeat themselves have long runs of equal letters: count the letters that stay
    trial = k > 1
    while trial.any():
        found = _signatures(prefix, level, doc, at, np.where(trial, k - 1, 100))
        trial &= np.array([len(x) <= MOST_CHUNKS for x in found])
        k = k - trial
        trial &= k > 1
    levels = [_signatures(prefix, level, doc, at, k + i) for i in range(LEVELS)]
    return [":".join([str(1 << int(b)), *letters]) for b, *letters in zip(k, *levels, strict=True)]


def _signatures(prefix: np.ndarray, level: np.ndarray, doc: np.ndarray, at: np.ndarray, k: np.ndarray) -> list[str]:
    cut = np.flatnonzero(level > 0)
    cut = cut[level[cut] >= k[doc[cut]]]
    full = np.flatnonzero(np.diff(at))
    start = np.sort(np.concatenate([cut + 1, at[full]]))
    end = np.append(start[1:], at[-1]) if len(start) else start
    letter = (X.segment_hash(prefix, start, end) & np.uint64(63)).astype(np.int64)
    own = doc[start] if len(start) else start
    # the fourth and later letters of a run go
    same = np.zeros((3, len(letter)), bool)
    for i in (1, 2, 3):
        same[i - 1, i:] = (letter[i:] == letter[:-i]) & (own[i:] == own[:-i])
    keep = ~same.all(0)
    raw, own = _LETTERS[letter[keep]].tobytes().decode(), own[keep]
    edge = np.searchsorted(own, np.arange(len(at)))
    return [raw[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    all_ones = (1 << len(a)) - 1
    s = all_ones
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & all_ones
    return len(a) - s.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    short = min(len(a), len(b))
    if not short:
        return 0.0
    run = min(RUN, max(2, short // 2))
    if {a[i:i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i:i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(one: str, two: str) -> float:
    """0 to 1: how alike two fingerprints are."""
    if one == two:
        return 1.0
    (p, *x), (q, *y) = one.split(":"), two.split(":")
    apart = int(p).bit_length() - int(q).bit_length()
    if abs(apart) >= LEVELS:
        return 0.0
    return _alike(x[max(-apart, 0)], y[max(apart, 0)])  # the finest common block size


def _fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, size (bytes) and the zstd-compressed text."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for first, part in X.chunks(f["text"], CHUNK_BYTES):
                yield pd.DataFrame({"doc_id": f["doc_id"].iloc[first:first + len(part)].to_numpy(), "fingerprint": fingerprints(part),
                                    "size": [len(t) for t in part], "packed": [pa.compress(t, codec="zstd", asbytes=True) for t in part]})
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fingerprint string, size long, packed binary")


def _with_next(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows in parts by descending doc_id, each part followed by the first row of the next (``extra``).

    The parts' borders come from a quantile digest of the ids; one id per part goes
    to the driver, no text does.
    """
    spark = rows.sparkSession
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    cuts = np.unique(np.array(ids.agg(F.percentile_approx(order, shares, 20 * parts).alias("c")).first()["c"] or [0], np.int64))

    @F.pandas_udf("int")
    def part(x: pd.Series) -> pd.Series:
        return pd.Series((len(cuts) - np.searchsorted(cuts, x.to_numpy(), side="left")).astype(np.int32))

    heads = sorted((r["part"], r["head"]) for r in
                   ids.select(order.alias("o")).groupBy(part("o").alias("part")).agg(F.max("o").alias("head")).collect())
    before = [(h, heads[i - 1][0]) for i, (_, h) in enumerate(heads)]  # the first part's head follows the last part
    marks = spark.createDataFrame(before, "o long, before int")
    placed = rows.withColumn("o", order).withColumn("part", part("o")).join(F.broadcast(marks), "o", "left")
    places = F.when(F.col("before").isNull(), F.array(F.struct(F.col("part"), F.lit(0).alias("extra")))).otherwise(
        F.array(F.struct(F.col("part"), F.lit(0).alias("extra")), F.struct(F.col("before").alias("part"), F.lit(1).alias("extra"))))
    return (placed.withColumn("place", F.explode(places)).select("doc_id", "o", "fingerprint", "size", "packed", "place.part", "place.extra")
            .repartitionById(parts, "part").sortWithinPartitions("part", "extra", F.desc("o"), "fingerprint", "packed"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last floor(n / 2) code points replaced by the first as
    many (or all) of the next document by descending doc_id; the first follows the last.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for f in frames:
                yield from zip(f["doc_id"], f["fingerprint"], f["size"], f["packed"], f["part"], f["extra"], strict=True)

        def text(row: tuple) -> str:
            return pa.decompress(row[3], decompressed_size=row[2], codec="zstd", asbytes=True).decode()

        def emit(batch: list[tuple]) -> pd.DataFrame:
            edited = [e for *_, e in batch]
            prints = fingerprints(edited)
            return pd.DataFrame({
                "doc_id": [r[0] for r, *_ in batch], "n_chars": [n for _, _, n, _ in batch],
                "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
                "fingerprint": [r[1] for r, *_ in batch], "edited_fingerprint": prints,
                "near_edited": [likeness(r[1], p) for (r, *_), p in zip(batch, prints, strict=True)],
                "near_next": [likeness(r[1], s[1]) for r, s, *_ in batch]})

        batch, size, now, own = [], 0, None, ""
        for row in rows():
            if now is not None and row[4] == now[4] and now[5] == 0:
                follow = text(row)
                half = len(own) // 2
                edit = (own[:len(own) - half] + follow[:half]).encode()
                batch.append((now[:2], row[:2], len(own), edit))
                size += len(edit)
                own = follow
            else:
                own = text(row)
            now = row
            if size > CHUNK_BYTES:
                yield emit(batch)
                batch, size = [], 0
        if batch:
            yield emit(batch)

    rows = _with_next(_fingerprinted(docs), docs.select("doc_id"))
    return rows.select("doc_id", "fingerprint", "size", "packed", "part", "extra").mapInPandas(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
