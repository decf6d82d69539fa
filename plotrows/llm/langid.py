"""Language ID: interpolated Kneser-Ney character models in sorted hash arrays.

One order-``ORDER`` character model per language over letter runs (``^run$``, lower
case).  All languages share one sorted array of 64-bit n-gram hashes per order;
next to it lie, per language, the discounted probability of the n-gram and the
weight it gives, as a context, to the next lower order.  A text's cross-entropy
is the mean over its letters and run ends; the language with the least wins.

Learning uses a sample of at most about ``rows_per_lang`` labelled rows of each
language, chosen by a hash of ``doc_id`` (a parameter; 1,200).  The counts are
taken by Spark; the model is a few megabytes and goes to the tasks as a
broadcast.  Rejection is calibrated on the same rows: a text is rejected if it
has no letter, or if its cross-entropy exceeds its language's median by more than
``tolerance`` times the largest excess among the labelled rows of that language
(excesses are compared at equal length: short texts vary more).

Defined results: null or letterless texts get ``und``, score 0 and rejection;
ties go to the alphabetically first language; without any labelled row every
text is ``und``; repeated rows are scored alike; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotrows.llm import text as X

ORDER = 4
ROWS_PER_LANG = 1200
TOLERANCE = 1.5
LEAST_EXCESS = 1.5
_START, _END = 0x5E, 0x24
UNKNOWN = "und"


@dataclass
class Model:
    """Sorted hash arrays per order, values per language, and calibration."""

    langs: list[str]
    keys: list[np.ndarray]     # per order 1..n: sorted uint64
    alpha: list[np.ndarray]    # per order: [n-grams, languages]
    gamma: list[np.ndarray]    # per order: weight left to the lower order when the n-gram is a context
    floor: np.ndarray          # per language: probability of an unseen character
    start: np.ndarray          # per language: weight left to single characters at the start of a run
    mean: np.ndarray | None = None
    worst: np.ndarray | None = None


def _padded(r: X.Runs, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of ^run$ one after another, position in the run, first position of each run)."""
    start, size = r.start[which], r.end[which] - r.start[which]
    first = np.concatenate([[0], np.cumsum(size + 2)])
    place = np.arange(first[-1]) - np.repeat(first[:-1], size + 2)
    src = np.repeat(start - 1, size + 2) + place
    cp = r.cp[np.minimum(src, len(r.cp) - 1)].copy()
    cp[first[:-1]] = _START
    cp[first[1:] - 1] = _END
    return cp, place, first


def _grams(cp: np.ndarray, place: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, end positions, hashes) of the n-grams that end after ``^``."""
    p = X.prefix_hash(X.char_codes()[cp])
    pos = np.arange(len(cp))
    for k in range(1, order + 1):
        at = pos[place >= max(k - 1, 1)]
        yield k, at, X.segment_hash(p, at - k + 1, at + 1)


def _count(order: int):
    @X.tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, list] = {}
        for f in frames:
            for lang, g in f.groupby("lang"):
                for _, part in X.chunks(g["text"], X.LETTER_BYTES):
                    r = X.letter_runs(part)
                    _, one, n = np.unique(r.hash, return_index=True, return_counts=True)
                    cp, place, first = _padded(r, one)
                    weight = np.repeat(n, np.diff(first))
                    codes = X.char_codes()[cp]
                    p = X.prefix_hash(codes)
                    for k, at, h in _grams(cp, place, order):
                        u, i, back = np.unique(h, return_index=True, return_inverse=True)
                        e = at[i]
                        total.setdefault(str(lang), []).append(pd.DataFrame({
                            "lang": str(lang), "k": k, "gram": u.view(np.int64),
                            "context": X.segment_hash(p, e - k + 1, e).view(np.int64),
                            "suffix": X.segment_hash(p, np.minimum(e - k + 2, e + 1), e + 1).view(np.int64),
                            "initial": place[e] == k - 1,
                            "n": np.bincount(back, weight[at]).astype(np.int64)}))
        for parts in total.values():
            yield pd.concat(parts).groupby(["lang", "k", "gram", "context", "suffix", "initial"], as_index=False)["n"].sum()
    return run


def sample(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """About ``rows_per_lang`` labelled rows of each language (lang, text), the same on every run."""
    known = docs.where(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share: Column = F.lit(0.0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, rows_per_lang / n))).otherwise(share)
    spot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return known.where(spot < share).select("lang", "text")


def fit(docs: DataFrame, order: int = ORDER, rows_per_lang: int = ROWS_PER_LANG) -> Model:
    """Learn from ``docs`` (doc_id, text, lang); rows without a language are not used."""
    rows = sample(docs, rows_per_lang)
    table = (rows.mapInPandas(_count(order), "lang string, k int, gram long, context long, suffix long, initial boolean, n long")
             .groupBy("lang", "k", "gram", "context", "suffix", "initial").agg(F.sum("n").alias("n")).toPandas())
    model = _smooth(table, order)
    if model.langs:
        _calibrate(model, rows)
    return model


def _smooth(table: pd.DataFrame, order: int) -> Model:
    langs = sorted(table["lang"].unique())
    table = table.assign(l=table["lang"].map({x: i for i, x in enumerate(langs)}).astype(int),
                         **{c: table[c].to_numpy(np.int64).view(np.uint64) for c in ("gram", "context", "suffix")})
    by = {k: table[table["k"] == k] for k in range(1, order + 1)}
    keys = [np.unique(by[k]["gram"].to_numpy()) for k in range(1, order + 1)]
    alpha, gamma = [], [np.ones((len(x), len(langs))) for x in keys]
    root, begin = np.ones(len(langs)), np.ones(len(langs))
    caret = X.segment_hash(X.prefix_hash(X.char_codes()[[_START]]), np.array([0]), np.array([1]))[0]
    chars = len(keys[0]) + 1
    for k in range(1, order + 1):
        t, size = by[k], (len(keys[k - 1]), len(langs))
        i, l, raw = np.searchsorted(keys[k - 1], t["gram"]), t["l"].to_numpy(), t["n"].to_numpy(float)
        c = np.zeros(size)
        c[i, l] = raw
        if k < order:  # lower orders count distinct left neighbours; a run's first n-gram has none
            up = by[k + 1]
            left = np.zeros(size)
            at, ok = X.lookup(keys[k - 1], up["suffix"].to_numpy())
            np.add.at(left, (at[ok], up["l"].to_numpy()[ok]), 1.0)
            keep = np.zeros(size, bool)
            keep[i, l] = t["initial"].to_numpy() & (k > 1)
            c = np.where(keep | (left == 0), c, left)
        once, twice = (c == 1).sum(0), (c == 2).sum(0)
        d = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.95)
        val, disc = c[i, l], d[l]
        a = np.zeros(size)
        if k == 1:
            sums, kinds = np.maximum(c.sum(0), 1), (c > 0).sum(0)
            root = d * kinds / sums
            a[i, l] = np.maximum(val - disc, 0) / sums[l]
        else:
            ctx = t["context"].to_numpy()
            group, inv = np.unique(np.stack([ctx, l.astype(np.uint64)]), axis=1, return_inverse=True)
            sums = np.bincount(inv.ravel(), val)
            kinds = np.bincount(inv.ravel(), (val > 0).astype(float))
            a[i, l] = np.maximum(val - disc, 0) / np.maximum(sums[inv.ravel()], 1e-9)
            gl = group[1].astype(int)
            at, ok = X.lookup(keys[k - 2], group[0])
            left = np.minimum(d[gl] * kinds / np.maximum(sums, 1e-9), 1.0)
            gamma[k - 2][at[ok], gl[ok]] = left[ok]
            if k == 2:
                begin[gl[group[0] == caret]] = left[group[0] == caret]
        alpha.append(a)
    return Model(langs, keys, alpha, gamma, np.maximum(root, 1e-3) / chars, begin)


def run_scores(model: Model, r: X.Runs, which: np.ndarray) -> np.ndarray:
    """-log2 probability of the runs ``which``, per language."""
    cp, place, first = _padded(r, which)
    prob = np.tile(model.floor, (len(cp), 1))
    weight = np.ones((len(cp) + 1, len(model.langs)))  # of the context that ends before each position
    for k, at, h in _grams(cp, place, len(model.keys)):
        i, ok = X.lookup(model.keys[k - 1], h)
        a, g = model.alpha[k - 1][i], model.gamma[k - 1][i]
        a[~ok], g[~ok] = 0.0, 1.0
        prob[at] = a + (weight[at] * prob[at] if k > 1 else prob[at])
        weight = np.ones((len(cp) + 1, len(model.langs)))
        weight[at + 1] = g
        if k == 1:
            weight[first[:-1] + 1] = model.start
    bits = -np.log2(np.maximum(prob, 1e-12))
    bits[place == 0] = 0.0
    return np.add.reduceat(bits, first[:-1], axis=0) if len(first) > 1 else np.zeros((0, len(model.langs)))


def entropies(model: Model, texts: list[bytes], known: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bits per symbol per language, number of letters) of each text.

    ``known`` keeps the scores of runs already met; it is emptied when it holds
    150,000, which costs time only.
    """
    r = X.letter_runs(texts)
    u, one, back = np.unique(r.hash, return_index=True, return_inverse=True)
    if len(known) > 150_000:
        known.clear()
    listed = u.tolist()
    new = np.array([j for j, h in enumerate(listed) if h not in known], np.int64)
    if len(new):
        for j, s in zip(new, run_scores(model, r, one[new])):
            known[listed[j]] = s.tobytes()
    scores = np.frombuffer(b"".join([known[h] for h in listed])).reshape(-1, len(model.langs))
    size = r.end - r.start
    total = np.concatenate([np.zeros((1, len(model.langs))), np.cumsum(scores[back], axis=0)])
    letters = np.concatenate([[0], np.cumsum(size)])
    n = letters[r.offset[1:]] - letters[r.offset[:-1]]
    symbols = n + np.diff(r.offset)
    return (total[r.offset[1:]] - total[r.offset[:-1]]) / np.maximum(symbols, 1)[:, None], n


def _spread(letters: np.ndarray) -> np.ndarray:
    """How much wider the cross-entropy of a text with so many letters varies."""
    return np.sqrt(1 + 200 / np.maximum(letters, 1))


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Median and largest excess of the own-language cross-entropy, from the learning rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @X.tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, bytes] = {}
        for f in frames:
            own = f["lang"].map({x: i for i, x in enumerate(shared.value.langs)}).to_numpy(int)
            for first, part in X.chunks(f["text"], X.LETTER_BYTES):
                bits, n = entropies(shared.value, part, known)
                mine = own[first:first + len(part)]
                out = pd.DataFrame({"l": mine, "h": bits[np.arange(len(part)), mine], "n": n})
                yield out[out["n"] > 0]

    seen = rows.mapInPandas(run, "l int, h double, n long").toPandas()
    mean, worst = np.zeros(len(model.langs)), np.full(len(model.langs), LEAST_EXCESS / TOLERANCE)
    for i in range(len(model.langs)):
        own = seen[seen["l"] == i]
        if len(own):
            mean[i] = own["h"].median()
            worst[i] = max(float(((own["h"] - mean[i]) / _spread(own["n"])).max()), LEAST_EXCESS / TOLERANCE)
    model.mean, model.worst = mean, worst
    shared.unpersist()


def predict(docs: DataFrame, model: Model, tolerance: float = TOLERANCE, keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs`` (text and the columns ``keep``): lang_pred, score, bits, rejected."""
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ["lang_pred", "score", "bits", "rejected"]
    kind = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("bits", pa.float64()), ("rejected", pa.bool_())])

    # Only the text goes to Python and only the verdict comes back: rows stay on the JVM side.
    @F.arrow_udf("lang_pred string, score double, bits double, rejected boolean")
    @X.tidy
    def verdict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m, known = shared.value, {}
        for texts in batches:
            out = [pd.DataFrame({"lang_pred": [], "score": [], "bits": [], "rejected": []}).astype({"lang_pred": object, "rejected": bool})]
            for _, part in X.chunks(X.strings(texts), X.LETTER_BYTES):
                if not m.langs:
                    out.append(pd.DataFrame({"lang_pred": [UNKNOWN] * len(part), "score": 0.0, "bits": 0.0, "rejected": True}))
                    continue
                bits, n = entropies(m, part, known)
                best = bits.argmin(1)
                low = bits[np.arange(len(best)), best]
                symbols = np.minimum(n, 10_000)[:, None]
                posterior = 1 / np.exp2(np.minimum((low[:, None] - bits) * symbols, 0)).sum(1)
                limit = m.mean[best] + tolerance * m.worst[best] * _spread(n)
                out.append(pd.DataFrame({"lang_pred": np.where(n > 0, np.array(m.langs, object)[best], UNKNOWN),
                                         "score": np.where(n > 0, posterior, 0.0), "bits": low, "rejected": (n == 0) | (low > limit)}))
            yield pa.RecordBatch.from_pandas(pd.concat(out, ignore_index=True), kind, preserve_index=False).to_struct_array()

    found = docs.select(*keep, verdict(F.col("text").cast("string")).alias("_verdict"))
    return found.select(*keep, *[F.col("_verdict")[c].alias(c) for c in fields])
