"""Toxicity: a linear-chain CRF tags toxic spans; marginals give scores and offsets.

Tokens are letter runs.  A token's states are toxic or other; its features are
hashes of the lower-cased run, of its prefixes of 4 to 7 and its suffix of 3
letters, and of its length; a transition weight joins neighbours.

Labels are per document, so token labels are derived first: in a toxic document
of the learning sample a token is toxic if one of its features is *evidence*: a
feature that occurs in at least 4 (``SUPPORT``) toxic documents, and at least 20
times as often in toxic documents as in others.  Exact copies of a text count as one
document, so that the words of a text with many copies don't become evidence.  The CRF is fitted by gradient on
windows of those tokens.  A document's marginals give its largest toxic log odds,
its expected number of toxic tokens; a logistic curve over the two and the length, fitted on the sample's documents (each class at its true share), is the score.

Learning uses about ``rows_per_class`` (3,000) labelled rows of each class, chosen
by a hash of ``doc_id``, and of each row at most ``windows_per_row`` (4) windows of
16 tokens, at hashed places of the whole text; everything is scored whole.

Defined results: null and letterless texts score like a text without any toxic
token; repeated rows score alike; without labelled rows of both classes every
score is the share of the class that there is (0 without rows); spans are
half-open code point ranges of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotrows.llm import crf
from plotrows.llm import text as X
from plotrows.session import reliable_checkpoint

ROWS_PER_CLASS = 3000
WINDOWS_PER_ROW = 4
WINDOW = 16
BUCKETS = 1 << 18
THRESHOLD = 0.3
EVIDENCE = 3.0   # log of 20
SUPPORT = 4      # toxic documents
_MARKS = [0, 1, 2, 3, 4]  # features that can be evidence: the run and its prefixes
_PARTS = 8


@dataclass
class Model:
    chain: crf.Chain                   # state 1 is toxic
    curve: np.ndarray | None = None    # logistic weights of (largest log odds, count, tokens, 1)
    longest: int = 10                  # about the tokens of the longest learning row: the curve says nothing about more


def _features(r: X.Runs, which: np.ndarray) -> np.ndarray:
    """64-bit feature hashes [run, part]: whole, prefixes 4-7, suffix 3, length, constant."""
    p = X.prefix_hash(X.char_codes()[r.cp])
    s, e = r.start[which], r.end[which]
    cuts = [(s, e), *((s, np.minimum(s + k, e)) for k in (4, 5, 6, 7)), (np.maximum(e - 3, s), e)]
    cols = [X.mix(X.segment_hash(p, a, b) + np.uint64(i)) for i, (a, b) in enumerate(cuts)]
    cols += [X.mix(np.minimum(e - s, 20).astype(np.uint64) + np.uint64(1 << 40)), np.full(len(s), 7, np.uint64)]
    return np.stack(cols, axis=1)


def sample(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """About ``rows_per_class`` labelled rows of each class (doc_id, text, toxic, stands: rows of its class per row here)."""
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(1.0)
    for kind, n in sizes.items():
        share = F.when(F.col("toxic") == kind, F.lit(min(1.0, rows_per_class / n))).otherwise(share)
    spot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = known.where(spot < share).withColumn("stands", 1 / share)  # about 2 * rows_per_class narrow rows: a bounded broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


@X.tidy
def _seen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(feature, toxic, doc_id): the features of each document that can be evidence."""
    for f in frames:
        toxic, ids = f["toxic"].to_numpy(int), f["doc_id"].to_numpy(np.int64)
        for first, part in X.chunks(f["text"], X.LETTER_BYTES):
            r = X.letter_runs(part)
            n, per = len(r.hash), np.diff(r.offset)
            feats = _features(r, np.arange(n))[:, _MARKS]
            feats[(r.end - r.start) < 4] = 0  # a run of three letters or less is no evidence
            seen = pd.DataFrame({"feature": feats.ravel().view(np.int64),
                                 "toxic": np.repeat(np.repeat(toxic[first:first + len(part)], per), len(_MARKS)).astype(np.int32),
                                 "doc_id": np.repeat(np.repeat(ids[first:first + len(part)], per), len(_MARKS))})
            yield seen[seen["feature"] != 0].drop_duplicates()


def _evidence(rows: DataFrame) -> np.ndarray:
    """Sorted feature hashes that mark toxic tokens."""
    rows = (rows.groupBy(F.sha2("text", 256).alias("same"), "toxic").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
            .select("doc_id", "text", "toxic"))
    places = rows.mapInPandas(_seen, "feature long, toxic int, doc_id long")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0) + 1, n.get(0, 0) + 1
    odds = F.log((F.col("t") + 0.5) / n1) - F.log((F.col("c") + 0.5) / n0)
    found = (places.groupBy("feature", "toxic").agg(F.countDistinct("doc_id").alias("n"))
             .groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"),
                                     F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
             .where((F.col("t") >= SUPPORT) & (odds >= EVIDENCE)).select("feature").toPandas())
    return np.sort(found["feature"].to_numpy(np.int64).view(np.uint64))


def _windows(rows: DataFrame, evidence: np.ndarray, per_row: int) -> tuple[np.ndarray, ...]:
    """(feature buckets, token labels, lengths, weights: a clean row's windows stand for all its runs) of the learning windows."""
    @X.tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            toxic, ids = f["toxic"].to_numpy(int), f["doc_id"].to_numpy(np.int64)
            for first, part in X.chunks(f["text"], X.LETTER_BYTES):
                r = X.letter_runs(part)
                feats = _features(r, np.arange(len(r.hash)))
                hits = X.lookup(evidence, feats[:, _MARKS].ravel())[1].reshape(-1, len(_MARKS)).any(1)
                out = []
                for j in range(len(part)):
                    a, b = int(r.offset[j]), int(r.offset[j + 1])
                    if a == b:
                        continue
                    # from a toxic text windows around toxic tokens, from any other windows at hashed places
                    if toxic[first + j]:
                        spots = np.flatnonzero(hits[a:b])
                    else:
                        spots = (X.mix(np.arange(per_row, dtype=np.uint64) + np.uint64(ids[first + j] & 0xFFFFFFFF)) % np.uint64(b - a)).astype(int)
                    blocks = np.unique(spots // WINDOW)
                    at = np.argsort(X.mix(blocks.astype(np.uint64) + (np.uint64(ids[first + j] & 0xFFFFFFFF) << np.uint64(32))), kind="stable")
                    for block in blocks[at[:per_row]]:
                        lo = a + int(block) * WINDOW
                        hi = min(b, lo + WINDOW)
                        label = hits[lo:hi] & (toxic[first + j] == 1)
                        out.append(((feats[lo:hi] % np.uint64(BUCKETS)).astype(np.int32).tobytes(),
                                    label.astype(np.uint8).tobytes(), hi - lo,
                                    1.0 if toxic[first + j] else max(1.0, (b - a) / (per_row * WINDOW))))
                yield pd.DataFrame(out, columns=["x", "y", "n", "weight"])
    got = rows.mapInPandas(run, "x binary, y binary, n int, weight double").toPandas()
    n = got["n"].to_numpy(int)
    x = np.zeros((len(got), WINDOW, _PARTS), np.int32)
    y = np.zeros((len(got), WINDOW))
    for i, (a, b, k) in enumerate(zip(got["x"], got["y"], n, strict=True)):
        x[i, :k] = np.frombuffer(a, np.int32).reshape(k, _PARTS)
        y[i, :k] = np.frombuffer(b, np.uint8)
    return x, y, n, got["weight"].to_numpy()


def _spans(model: Model, texts: list[bytes], known: dict[int, float]) -> Iterator[tuple[list[float], list[tuple[int, int]]]]:
    """(largest toxic log odds, log of the toxic count, log of the tokens; spans of the tokens that are rather toxic) of each text."""
    r = X.letter_runs(texts)
    u, one, back = np.unique(r.hash, return_index=True, return_inverse=True)
    if len(known) > 150_000:  # costs time only
        known.clear()
    listed = u.tolist()
    new = np.array([j for j, h in enumerate(listed) if h not in known], np.int64)
    if len(new):
        score = model.chain.weight[(_features(r, one[new]) % np.uint64(BUCKETS)).astype(np.int64)].sum(1)
        known.update(zip((listed[j] for j in new), score.tolist(), strict=True))
    emission = np.array([known[h] for h in listed])[back] if listed else np.zeros(0)
    for j in range(len(texts)):
        a, b = int(r.offset[j]), int(r.offset[j + 1])
        odds = crf.odds(model.chain, emission[a:b])
        hits = a + np.flatnonzero(odds > 1)
        cut = np.flatnonzero(np.diff(hits) > 1) + 1
        spans = [(int(r.start[g[0]] - r.at[j]), int(r.end[g[-1]] - r.at[j])) for g in np.split(hits, cut) if len(g)]
        count = float((odds / (1 + odds))[odds > 0.1].sum())
        yield [float(np.log(np.clip(odds.max(initial=0.0), 1e-4, 1e4))), float(np.log1p(count)),
               float(np.log(np.clip(b - a, 10, model.longest)))], spans


def _scored(model: Model, docs: DataFrame, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    # Only the text goes to Python and only scores and spans come back: rows stay on the JVM side.
    @F.arrow_udf("score double, marks array<double>, spans array<struct<start:int,end:int>>")
    @X.tidy
    def verdict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m, known = shared.value, {}
        for texts in batches:
            score, every, spans = [np.zeros(0)], [], []
            for _, part in X.chunks(X.strings(texts), X.LETTER_BYTES):
                found = list(_spans(m, part, known))
                marks = np.array([[*x, 1.0] for x, _ in found]).reshape(-1, 4)
                score.append(np.zeros(len(part)) if m.curve is None else 1 / (1 + np.exp(-np.clip(marks @ m.curve, -30, 30))))
                every += list(marks)
                spans += [[{"start": a, "end": b} for a, b in s] for _, s in found]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(score)), pa.array(every, pa.list_(pa.float64())), pa.array(spans, span)],
                                             ["score", "marks", "spans"])

    found = docs.select(*keep, verdict(F.col("text").cast("string")).alias("_verdict"))
    return found.select(*keep, *[F.col("_verdict")[c].alias(c) for c in ("score", "marks", "spans")])


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, windows_per_row: int = WINDOWS_PER_ROW) -> Model:
    """Learn from the labelled documents (docs: doc_id, text; labels: doc_id, toxic)."""
    rows = reliable_checkpoint(sample(docs, labels, rows_per_class))  # a bounded sample, read five times
    x, y, n, heavy = _windows(rows, _evidence(rows), windows_per_row)
    longest = rows.agg(F.max(F.length("text")).alias("n")).first()["n"] or 0
    model = Model(crf.train(x, y, n, heavy, BUCKETS), longest=max(longest // 6, 10))
    seen = _scored(model, rows, ["doc_id", "toxic", "stands"]).select("marks", "toxic", "stands").toPandas()
    kinds, stands = seen["toxic"].to_numpy(float), seen["stands"].to_numpy(float)
    if len(kinds) == 0 or kinds.min() == kinds.max():
        model.curve = np.array([0, 0, 0, 30.0 * (2 * kinds[0] - 1) if len(kinds) else -30.0])
        return model
    a = np.stack(seen["marks"].to_numpy())
    target = np.where(kinds == 1, 1 - 1 / (kinds.sum() + 2), 1 / ((1 - kinds).sum() + 2))
    b, prior = np.zeros(4), np.diag([0.1, 0.1, 1.0, 0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        hess = (a * (stands * p * (1 - p))[:, None]).T @ a + prior + 1e-6 * np.eye(4)
        b -= np.clip(np.linalg.solve(hess, a.T @ (stands * (p - target)) + prior @ b), -1, 1)
    model.curve = b
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: the columns ``keep``, score and toxic spans."""
    return _scored(model, docs, keep or ["doc_id"]).drop("marks")
