"""Packing along a space-filling curve: neighbours of a Hilbert curve share sequences.

A document is its token ids and an end id.  Its hashed token vector is projected to
``DIMS`` signs sums (seeded signs per token id, divided by the length); the cell of
the projection on a grid gives the Hilbert key.  Documents are range-partitioned by
key -- boundaries come from a quantile digest, the key's low bits from a hash, so
that copies with one key spread over partitions -- and laid end to end in key order.
Every ``length`` ids are a sequence: a document crosses into the next one where the
border falls, so no sequence but the last has room left, and that rest is cut into
powers of two, which need no padding.

The texts are encoded once; the ids lie compressed in a table in the shared folder.
Only the token count of each partition goes to the driver.

Defined results: null and empty texts are the end id alone; an empty table gives no
piece; repeated rows are packed each; a null ``doc_id`` sorts first among equals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotrows.llm import text as X
from plotrows.llm import tokens as K
from plotrows.session import scratch_path

LENGTH = 1024
END_ID = 0
DIMS = 4
BITS = 10
ROOM = 4.0            # projections beyond 1 / ROOM share the outermost cells
PARTITION_TOKENS = 16 << 20


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of grid cells [n, dims] (Skilling's transform)."""
    x = [c.astype(np.uint64) for c in cells.T]
    one, dims = np.uint64(1), len(x)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        low = q - one
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        t = np.where((x[-1] & q) != 0, t ^ (q - one), t)
    key = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | (((x[i] ^ t) >> np.uint64(b)) & one)
    return key


def _signs(vocabulary: int) -> np.ndarray:
    n = np.arange(vocabulary * DIMS, dtype=np.uint64).reshape(-1, DIMS)
    return (X.mix(n + np.uint64(77)) & np.uint64(1)).astype(np.int32) * 2 - 1


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, key, n, print (crc32 of the ids), ids (zstd of little-endian 32-bit ids)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = K.encoder(path)
        signs = _signs(len(enc.width))
        for f in frames:
            for first, part in X.chunks(f["text"], X.LETTER_BYTES):
                ids, at = enc.encode(K.pieces(part))
                ids = np.insert(ids, at[1:], END_ID).astype("<u4")
                at = at + np.arange(len(at))
                n = np.diff(at)
                flat = np.add.reduceat(signs[ids], at[:-1], axis=0) / n[:, None]
                cells = np.clip((flat * ROOM + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1)
                own = f["doc_id"].iloc[first:first + len(part)]
                salt = X.mix(own.fillna(-1).astype(np.int64).to_numpy().view(np.uint64)) >> np.uint64(64 - 63 + DIMS * BITS)
                key = (hilbert(cells.astype(np.uint64), BITS) << np.uint64(63 - DIMS * BITS)) | salt
                raw = [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pd.DataFrame({"doc_id": own.to_numpy(), "key": key.view(np.int64), "n": n, "print": [zlib.crc32(r) for r in raw],
                                    "ids": [pa.compress(r, codec="zstd", asbytes=True) for r in raw]})
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, key long, n long, print long, ids binary")


def _ends(total: int, length: int) -> np.ndarray:
    """Ends of the sequences after the last full one: the rest in powers of two."""
    full = total // length * length
    rest = total - full
    return full + np.cumsum([1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1] or [0])


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    where = scratch_path(spark, "token-ids")
    encoded(docs, path or K.default_path()).write.parquet(where)
    table = spark.read.parquet(where)
    total = table.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_TOKENS))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    cuts = np.array(table.agg(F.percentile_approx("key", shares, 20 * parts).alias("c")).first()["c"] or [0], np.int64)

    @F.pandas_udf("int")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), side="right").astype(np.int32))

    table = table.withColumn("bucket", bucket("key"))
    sums = {r["bucket"]: r["n"] for r in table.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    base, at = {}, 0
    for b in sorted(sums):
        base[b], at = at, at + sums[b]
    ends = _ends(total, length)
    full = total // length * length

    def lay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, place = None, 0
        for f in frames:
            out = []
            for doc_id, b, raw, n in zip(f["doc_id"], f["bucket"], f["ids"], f["n"], strict=True):
                if b != now:
                    now, place = b, base[b]
                ids = memoryview(pa.decompress(raw, decompressed_size=4 * n, codec="zstd", asbytes=True))
                start = 0
                while start < n:
                    if place < full:
                        seq, offset = divmod(place, length)
                        end = place - offset + length
                    else:
                        k = int(np.searchsorted(ends, place, side="right"))
                        seq, offset = full // length + k, place - (int(ends[k - 1]) if k else full)
                        end = int(ends[k])
                    size = min(n - start, end - place)
                    out.append((doc_id, start, size, zlib.crc32(ids[4 * start:4 * (start + size)]), n, seq, offset))
                    start, place = start + size, place + size
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return (table.repartitionById(parts, "bucket").sortWithinPartitions("bucket", "key", "doc_id", "n", "print")
            .select("doc_id", "bucket", "ids", "n")
            .mapInPandas(lay, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))
