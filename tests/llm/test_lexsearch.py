"""Ranked search against scores of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from plotrows.llm import lexsearch, queries
from tests_llm_common import EDGES, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, total = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in items:
        q = Counter(terms(text))
        scores = [(-sum(k * w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // total))) for t, k in q.items() if t in c), i is None, i or 0)
                  for i, c, n in counts]
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(s for s in scores if s[0] < 0)[:top], 1)]
    return Counter(out)


def result(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def corpus(seed, n=400):
    """Zipf words, texts that hold items, copies (ties), very long texts."""
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(300)]
    share = [1 / (i + 1) for i in range(300)]
    items = [(i, " ".join(rng.choices(pool, share, k=rng.choice([1, 5, 30])))) for i in range(25)]
    docs = []
    for i in range(n):
        t = rng.choices(pool, share, k=rng.choice([1, 10, 60, 400]))
        if rng.random() < 0.2:
            t[len(t) // 2:len(t) // 2] = rng.choice(items)[1].split()
        docs.append((i, rng.choice([" ", "-", "\n, "]).join(t).title()))
    docs += [(n + i, docs[3][1]) for i in range(30)]
    return docs, items


@pytest.mark.parametrize("seed_rows", [20, 20_000])
def test_equals_scores_of_all_documents(spark, monkeypatch, seed_rows):
    monkeypatch.setattr(lexsearch, "SEED_ROWS", seed_rows)
    docs, items = corpus(seed_rows)
    assert result(lexsearch.search(table(spark, docs).repartition(5), benchmark(spark, items), block_items=11)) == plain(docs, items)


def test_edges(spark):
    docs = [*EDGES, (9007199254740993, "one more"), (12, "ONE-two_THREE four4 ünï\u0080x"), (13, "漢字 ÀB àb"), (14, "漢字 ÀB àb")]
    items = [(1, "one"), (2, None), (3, "  ..."), (None, "long words"), (5, "ünï 漢字 a-null id"), (5, "four4 TWO"), (6, "absent"), (7, "àb Àb ÀB x\u0080")]
    assert result(lexsearch.search(table(spark, docs), benchmark(spark, items))) == plain(docs, items)
    assert lexsearch.search(table(spark, []), benchmark(spark, items)).collect() == []
    assert lexsearch.search(table(spark, docs), benchmark(spark, [])).collect() == []
    extra = table(spark, docs).selectExpr("doc_id", "text", "1 AS score", "'x' AS item", "2 AS rank")
    assert result(lexsearch.search(extra, benchmark(spark, [(1, "one")]))) == plain(docs, [(1, "one")])


def test_bounds_never_lose_a_row_and_do_prune():
    rng = np.random.default_rng(1)
    n, v = 3000, 2000
    block = lexsearch.Block(np.arange(v), [(np.unique(rng.integers(0, v, 25)), None) for _ in range(20)])
    block.items = [(t, rng.integers(1, 3, len(t))) for t, _ in block.items]
    rows = [np.unique(rng.zipf(1.3, rng.integers(1, 60)) % v) for _ in range(n)]
    for i in range(300):  # 15 vectors hold each item
        rows[i] = np.union1d(rows[i], block.items[i % 20][0])
    impact = [rng.integers(500_000, 1_000_000, len(r)) * (1 + r) for r in rows]
    norm = np.sqrt([float((x.astype(float) ** 2).sum()) for x in impact])
    order = np.argsort(-norm)
    at = np.concatenate([[0], np.cumsum([len(rows[i]) for i in order])])
    exact = np.zeros((20, n), np.int64)
    for q, (t, k) in enumerate(block.items):
        full = np.zeros(v, np.int64)
        full[t] = k
        exact[q] = [int((full[rows[i]] * impact[i]).sum()) for i in order]
    best = [lexsearch._Best(10, int(np.sort(e)[-10])) for e in exact]
    scored = lexsearch.search_bucket(block, norm[order], at, np.concatenate([rows[i] for i in order]), np.concatenate([impact[i] for i in order]),
                                     np.zeros(n, bool), np.arange(n), best)
    for b, e in zip(best, exact, strict=True):
        assert b.rows == sorted((-int(s), False, i) for i, s in enumerate(e))[:10]
    assert scored < 0.5 * 20 * n


def test_damping_beyond_64_bits():
    n = np.array([10 ** 9, 5])
    assert lexsearch.damping(n, 10 ** 9, 10 ** 12).tolist() == [25 + 75 * int(x) * 10 ** 9 // 10 ** 12 for x in n]


def test_registered(spark, sf_small):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf_small, "documents").collect()]
    items = [(r.item_id, r.text) for r in queries.table(spark, sf_small, "benchmark").collect()]
    assert result(queries.op13_ranked_search(spark, sf_small)) == plain(docs, items)
