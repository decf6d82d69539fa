"""Language ID: held-out accuracy, a brute-force Kneser-Ney model, and rejection."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from plotrows.llm import langid, queries
from plotrows.llm import text as X
from tests_llm_common import EDGES, table

EN = ["the quick brown fox jumps over the lazy dog", "a stitch in time saves nine and then some", "this is what the weather was like"] * 5
DE = ["der schnelle braune fuchs springt über den faulen hund", "morgenstund hat gold im mund sagt man", "das wetter war schön und warm"] * 5


def plain(texts: list[str], order: int, chars: int):
    """Probability function (context, symbol) of an interpolated Kneser-Ney character model over ^run$."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        for run in t.split():
            s = f"^{run}$"
            for k in range(1, order + 1):
                for e in range(max(k, 2), len(s) + 1):
                    counts[k][s[e - k:e]] += 1
    used = [None] * (order + 1)
    for k in range(1, order + 1):
        if k == order:
            used[k] = {g: float(n) for g, n in counts[k].items()}
            continue
        left = Counter(g[1:] for g in counts[k + 1])
        used[k] = {g: float(n) if (g[0] == "^" and k > 1) or not left[g] else float(left[g]) for g, n in counts[k].items()}
    d = [0.0]
    for k in range(1, order + 1):
        one, two = (sum(v == x for v in used[k].values()) for x in (1, 2))
        d.append(min(max(one / max(one + 2 * two, 1), 0.1), 0.95))
    sums, kinds = defaultdict(float), Counter()
    for k in range(1, order + 1):
        for g, v in used[k].items():
            sums[k, g[:-1]] += v
            kinds[k, g[:-1]] += 1

    def p(context: str, c: str) -> float:
        out = max(d[1] * kinds[1, ""] / sums[1, ""], 1e-3) / chars
        for k in range(1, order + 1):
            if len(context) < k - 1:
                break
            ctx = context[len(context) - k + 1:]
            if not sums[k, ctx]:
                continue
            g = ctx + c
            own = max(used[k].get(g, 0) - d[k], 0) / sums[k, ctx]
            out = own + (min(d[k] * kinds[k, ctx] / sums[k, ctx], 1.0) * out if k > 1 else out)
        return out
    return p


def test_cross_entropy_matches_a_plain_model(spark):
    docs = table(spark, [(i, t) for i, t in enumerate(EN + DE)], ["en"] * 15 + ["de"] * 15)
    model = langid.fit(docs, rows_per_lang=10_000)
    assert model.langs == ["de", "en"]
    texts = ["the fox sprang", "über das wetter", "zzz the", "dog"]
    bits, n = langid.entropies(model, [t.encode() for t in texts], {})
    for j, own in enumerate((DE, EN)):
        p = plain(own, langid.ORDER, len(set("".join(EN + DE)) - {" "}) + 2)
        for i, t in enumerate(texts):
            total, symbols = 0.0, 0
            for run in t.split():
                s = f"^{run}$"
                for e in range(1, len(s)):
                    total -= math.log2(p(s[max(0, e - langid.ORDER + 1):e], s[e]))
                    symbols += 1
            assert bits[i, j] == pytest.approx(total / symbols, rel=1e-6)
            assert n[i] + len(t.split()) == symbols


def test_held_out_accuracy(spark, sf_small):
    docs = {r.doc_id: r for r in queries.table(spark, sf_small, "documents").collect()}
    got = queries.op10_language_id(spark, sf_small).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.rejected for r in got if docs[r.doc_id].lang]) < 0.02


def test_edges_and_rejection(spark):
    docs = table(spark, [(i, t) for i, t in enumerate(EN + DE)], ["en"] * 15 + ["de"] * 15)
    model = langid.fit(docs)
    got = langid.predict(table(spark, [*EDGES, (90, "!! 123 ???"), (91, "жзщ" * 40), (92, "The fox is lazy")]), model, keep=["doc_id", "lang", "text"]).collect()
    assert len(got) == len(EDGES) + 3
    by = {r.doc_id: r for r in got}
    for i in (1, 2, 3, 90):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[91].rejected and by[92].lang_pred == "en" and not by[92].rejected
    assert langid.predict(table(spark, []), model).collect() == []


def test_no_labels(spark):
    model = langid.fit(table(spark, ["a b"]))
    assert [(r.lang_pred, r.rejected) for r in langid.predict(table(spark, ["a b"]), model).collect()] == [("und", True)]


def test_sorted_hash_arrays():
    keys = np.sort(X.mix(np.arange(100)))
    i, ok = X.lookup(keys, np.concatenate([keys[::-1], [np.uint64(5)]]))
    assert ok.tolist() == [True] * 100 + [False] and (keys[i[:100]] == keys[::-1]).all()
