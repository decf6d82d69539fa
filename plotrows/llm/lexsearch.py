"""Ranked lexical search: the best documents of every query item, by norm buckets.

A document is its impact vector over the items' terms: a term's coordinate is its
weight times its saturated frequency, an integer; an item is the vector of its terms'
multiplicities, and a score is their inner product.  Items are searched in blocks of
``BLOCK_ITEMS`` that the driver reads one at a time; all documents are searched for each.

1. Documents are tokenised once a block; their counts of the block's terms go to a table
   in the shared folder.  Document frequencies are summed from it, then the vectors and
   their lengths (Euclidean norms) are written.
2. The ``SEED_ROWS`` longest vectors are scored: an item's ``top``-th score there is a lower
   bound of its last score, the threshold.  Any rows would give a valid bound.
3. Vectors are range-sorted by descending length; a batch of a sorted partition is a
   bucket.  For an item, a bucket whose longest vector times the item's length stays
   below the threshold is skipped (Cauchy-Schwarz); so is the rest of a bucket from the
   first such vector on.
4. Inside a bucket a share ``FOCUS`` of the item's coordinates, those with the shortest
   inverted lists (rare terms, so the largest weights), is summed; the rest is bounded
   by Cauchy-Schwarz on what is left of both vectors.  A vector whose bound stays below
   the threshold goes.
5. Survivors are scored again over all coordinates in 64-bit integers.  The partition's
   best raise its own threshold; its ``top`` rows of each item go on to the final ranking.

Bounds are floating-point with a margin (``SLACK``), so no vector at the threshold is lost.
Terms are told apart by 64-bit hashes.

Defined results: null and empty texts have no terms and are not ranked; an item without
terms has no rows; repeated rows are documents (or items) each; among equal scores a null
``doc_id`` comes last; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotrows.llm import text as X
from plotrows.session import scratch_path

TOP = 10
BLOCK_ITEMS = 1000
SEED_ROWS = 20_000
FOCUS = 0.5               # share of an item's terms that is summed before the bound
SLACK = 1 + 1e-9
PARTITION_ROWS = 200_000

_GAP = np.zeros(256, bool)
_GAP[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def terms(texts: list[bytes]) -> X.Words:
    """The terms of texts: runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return X.words(texts, gap=_GAP)


@dataclass
class Block:
    """A block of items: ``term`` sorted hashes; per item its terms (ranks in ``term``) and multiplicities."""

    term: np.ndarray
    items: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, texts: list[str | None]) -> Block:
        w = terms([X.utf8(t) for t in texts])
        term = np.unique(w.hash)
        return cls(term, [np.unique(np.searchsorted(term, w.hash[a:b]), return_counts=True) for a, b in zip(w.offset[:-1], w.offset[1:], strict=True)])


def weight(documents: int, frequency: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(f) + 1))) for f in frequency], np.int64)


def damping(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents with n terms; exact beyond 64 bits."""
    if len(n) and 75 * int(n.max()) * documents >= 1 << 63:
        return np.array([25 + 75 * int(x) * documents // total for x in n], np.int64)
    return 25 + 75 * n * documents // total


def _counts(batches: Iterator[pa.RecordBatch], term: np.ndarray) -> Iterator[pa.RecordBatch]:
    """doc_id, n, and the sorted known terms with their counts of every document."""
    for batch in batches:
        for first, part in X.chunks(batch["text"].to_pylist()):
            w = terms(part)
            rank, known = X.lookup(term, w.hash)
            doc = np.repeat(np.arange(len(part)), np.diff(w.offset))[known]
            key, tf = np.unique(doc * max(1, len(term)) + rank[known], return_counts=True)
            at = np.searchsorted(key, np.arange(len(part) + 1) * max(1, len(term))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].slice(first, len(part)), pa.array(np.diff(w.offset)), pa.ListArray.from_arrays(at, (key % max(1, len(term))).astype(np.int32)),
                 pa.ListArray.from_arrays(at, tf.astype(np.int64))], ["doc_id", "n", "terms", "tf"])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls, also of a slice."""
    at = column.offsets.to_numpy()
    return column.values.to_numpy()[at[0]:at[-1]], at - at[0]


class _Best:
    """The best (score, doc_id) of one item so far, and its threshold."""

    def __init__(self, top: int, floor: int):
        self.top, self.floor = top, floor
        self.rows: list[tuple[int, bool, int]] = []   # negative score, doc_id is null, doc_id

    def add(self, score: np.ndarray, null: np.ndarray, doc_id: np.ndarray) -> None:
        keep = score >= max(1, self.floor)
        if keep.any():
            self.rows = sorted([*self.rows, *zip((-score[keep]).tolist(), null[keep].tolist(), doc_id[keep].tolist(), strict=True)])[: self.top]
            if len(self.rows) == self.top:
                self.floor = max(self.floor, -self.rows[-1][0])


def search_bucket(block: Block, norm: np.ndarray, at: np.ndarray, term: np.ndarray, impact: np.ndarray, null: np.ndarray, doc_id: np.ndarray, best: list[_Best]) -> int:
    """Search vectors in descending length for every item; returns the number of exact scores."""
    doc = np.repeat(np.arange(len(norm)), np.diff(at))
    order = np.argsort(term, kind="stable")
    start = np.searchsorted(term[order], np.arange(len(block.term) + 1))
    post_doc, post_impact = doc[order], impact[order].astype(np.float64)
    dense = np.zeros(len(block.term), np.int64)
    scored = 0
    for (own, times), b in zip(block.items, best, strict=True):
        if not len(own):
            continue
        length = math.sqrt(float((times.astype(np.float64) ** 2).sum()))
        size = int(np.searchsorted(-norm, -b.floor / (length * SLACK), side="right")) if b.floor > 0 else len(norm)
        if not size:
            continue
        # the rarest terms have the largest impacts: their lists are short as well
        by = np.argsort(start[own + 1] - start[own], kind="stable")
        focus = by[: max(1, math.ceil(len(by) * FOCUS))] if b.floor > 0 else by
        partial, square = np.zeros(len(norm)), np.zeros(len(norm))
        for k in focus:
            s = slice(start[own[k]], start[own[k] + 1])
            partial[post_doc[s]] += times[k] * post_impact[s]
            square[post_doc[s]] += post_impact[s] ** 2
        if b.floor > 0:
            left = math.sqrt(float((times[np.setdiff1d(by, focus)].astype(np.float64) ** 2).sum()))
            bound = partial[:size] + left * np.sqrt(np.maximum(0, norm[:size] ** 2 * SLACK - square[:size]))
            rows = np.flatnonzero(bound * SLACK >= b.floor)
        else:
            rows = np.flatnonzero(partial[:size])
        if not len(rows):
            continue
        scored += len(rows)
        dense[own] = times
        n = at[rows + 1] - at[rows]
        inner = np.repeat(at[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        score = np.add.reduceat(dense[term[inner]] * impact[inner], np.concatenate([[0], np.cumsum(n)[:-1]]))
        dense[own] = 0
        b.add(score, null[rows], doc_id[rows])
    return scored


def _search(batches: Iterator[pa.RecordBatch], block: Block, floors: np.ndarray, top: int) -> Iterator[pa.RecordBatch]:
    best = [_Best(top, int(f)) for f in floors]
    for b in batches:
        norm = b["norm"].to_numpy()
        order = np.argsort(-norm, kind="stable")
        b = b.take(pa.array(order))
        (term, at), (impact, _) = _flat(b["terms"]), _flat(b["impact"])
        ids = b["doc_id"]
        search_bucket(block, norm[order], at, term, impact, ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), best)
    rows = [(i, None if null else doc, -score) for i, x in enumerate(best) for score, null, doc in x.rows]
    item, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])


_FOUND = "item int, doc_id long, score long"


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _block_top(spark: SparkSession, docs: DataFrame, block: Block, top: int) -> DataFrame:
    """item (index in the block), rank, doc_id, score."""
    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    counts = stored(docs.mapInArrow(lambda it: _counts(it, block.term), "doc_id long, n long, terms array<int>, tf array<long>"), "search-counts")
    sums = counts.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("total")).first()
    documents, total = sums["documents"], sums["total"] or 0

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(block.term), np.int64)
        for b in batches:
            seen += np.bincount(_flat(b["terms"])[0], minlength=len(seen))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], ["term", "n"])

    frequency = np.zeros(len(block.term), np.int64)
    for r in counts.select("terms").mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        frequency[r["term"]] = r["n"]  # at most one row for each term of the block
    weights = weight(documents, frequency)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (term, at), (tf, _) = _flat(b["terms"]), _flat(b["tf"])
            m = np.repeat(damping(b["n"].to_numpy(), documents, total), np.diff(at))
            impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            square = np.add.reduceat(impact.astype(np.float64) ** 2, at[:-1])  # every row has a term
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.sqrt(square)), b["terms"], pa.ListArray.from_arrays(at.astype(np.int32), impact)], ["doc_id", "norm", "terms", "impact"])

    found = counts.where((F.col("n") > 0) & (F.size("terms") > 0))
    table = stored(found.mapInArrow(vectors, "doc_id long, norm double, terms array<int>, impact array<long>"), "search-vectors").where(F.col("norm") > 0)
    n = table.count()
    cut = table.agg(F.percentile_approx("norm", max(0.0, 1 - SEED_ROWS / n), 10_000).alias("c")).first()["c"] if n else 0.0
    seeds = table.where(F.col("norm") >= cut).mapInArrow(lambda it: _search(it, block, np.zeros(len(block.items), np.int64), top), _FOUND)
    floors = np.zeros(len(block.items), np.int64)
    for r in _ranked(seeds, top).where(F.col("rank") == top).select("item", "score").collect():
        floors[r["item"]] = r["score"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PARTITION_ROWS))
    buckets = table.repartitionByRange(parts, F.col("norm").desc(), F.col("doc_id")).sortWithinPartitions(F.col("norm").desc())
    return _ranked(buckets.mapInArrow(lambda it: _search(it, block, floors, top), _FOUND), top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` documents with a score above 0."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType
    out = []

    def block(rows: list) -> DataFrame:
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]))
        found = _block_top(spark, docs, Block.of([r["text"] for r in rows]), top)
        return found.join(ids, "item").select("item_id", "rank", "doc_id", "score")

    rows: list = []
    for r in items.select("item_id", "text").toLocalIterator():
        rows.append(r)
        if len(rows) == block_items:
            out.append(block(rows))
            rows = []
    if rows or not out:
        out.append(block(rows))
    return reduce(DataFrame.unionByName, out)
