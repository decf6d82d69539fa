"""Substring dedup against all windows of all documents, and the index against plain counting."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from plotrows.llm import fmindex, queries, substring
from tests_llm_common import EDGES, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, least=35):
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[j:j + least]) for _, w in docs for j in range(len(w) - least + 1))
    out = []
    for i, w in docs:
        gone = set()
        for j in range(len(w) - least + 1):
            if seen[tuple(w[j:j + least])] > 1:
                gone.update(range(j, j + least))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return Counter(out)


def result(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def corpus(seed, n=80, size=300):
    """Copies, passages in other contexts, passages of one word less than a window, repeats inside a text."""
    rng = random.Random(seed)
    pool = [f"w{i}é" for i in range(size)]
    text = lambda k: rng.choices(pool, k=k)
    passages = [text(k) for k in (34, 35, 36, 50, 120)]
    line = text(12)
    rows = []
    for i in range(n):
        w = text(rng.choice([0, 5, 34, 35, 80, 300]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        if rng.random() < 0.4:
            at = rng.randrange(len(w) + 1)
            w[at:at] = line
        if rows and rng.random() < 0.2:
            w = WORD.findall(rng.choice(rows)[1])
            for _ in range(rng.choice([0, 1, 3])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(pool)
        rows.append((i, rng.choice([" ", "  ", "\n", "\t "]).join(w)))
    rows.append((n, " ".join(["again"] * 500)))
    rows.append((n + 1, " ".join(["a", "b", "c"] * 40)))
    return rows


@pytest.mark.parametrize("hot", [20_000, 3])
def test_equals_all_windows(spark, monkeypatch, hot):
    rows = corpus(hot)
    got = result(substring.dedupe(table(spark, rows).repartition(5), hot_segments=hot, shard_words=3000))
    assert got == plain(rows)
    assert 0 < sum(r[2] > 0 for r in got) < len(got)


def test_one_very_common_passage_goes_by_its_windows(spark):
    """All grams of the passage are hot: its windows have no other anchor."""
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"x{rng.random()}" for _ in range(20)] + passage + [f"y{rng.random()}" for _ in range(20)])) for i in range(60)]
    rows += [(100 + i, " ".join([f"z{rng.random()}", *passage[10:30], f"z{rng.random()}"] * 3)) for i in range(60)]
    assert result(substring.dedupe(table(spark, rows).repartition(4), hot_segments=2)) == plain(rows)


def test_edges(spark):
    rows = [*EDGES, (7, "alone " + " ".join(map(str, range(40)))), (8, " ".join(map(str, range(40))) + "\x0b end\x85 stays"), (None, None), (0, "a null id")]
    rows += [(9, " ".join(f"r{i}" for i in range(36)))] * 2 + [(None, " ".join(f"n{i}" for i in range(40)))] * 2 + [(10, "ONE " * 20 + "one " * 20)]
    assert result(substring.dedupe(table(spark, rows))) == plain(rows)
    assert substring.dedupe(table(spark, [])).collect() == []
    extra = table(spark, rows).selectExpr("doc_id", "text", "1 AS id", "2 AS key", "'x' AS found", "3 AS n_words")
    assert result(substring.dedupe(extra)) == plain(rows)


def test_registered(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf_small, "documents").collect()]
    assert result(queries.op11_substring_dedup(spark, sf_small)) == plain(rows)


@pytest.mark.parametrize("seed", range(6))
def test_index_counts_patterns(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(1, 40))
    runs = [rng.integers(1, size + 1, rng.integers(1, 30)) for _ in range(rng.integers(1, 30))]
    flat, offset = np.concatenate(runs), np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    index = fmindex.FMIndex(flat, offset, size)
    for _ in range(60):
        r = runs[rng.integers(len(runs))]
        a = rng.integers(len(r))
        p = r[a:a + rng.integers(1, 6)] if rng.random() < 0.7 else rng.integers(1, size + 1, 3)
        low, high = np.array([0]), np.array([index.length])
        for s in p[::-1]:
            low, high = index.extend(np.array([s]), low, high)
        want = sum(np.array_equal(x[i:i + len(p)], p) for x in runs for i in range(len(x) - len(p) + 1))
        assert max(0, int(high[0] - low[0])) == want


@pytest.mark.parametrize("seed", range(4))
def test_index_reports_all_repeated_stretches(seed):
    rng = np.random.default_rng(seed)
    runs = [rng.integers(1, 4, rng.integers(3, 60)) for _ in range(12)]
    flat, offset = np.concatenate(runs), np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    least = 5
    seen = Counter(tuple(r[i:i + least]) for r in runs for i in range(len(r) - least + 1))
    index = fmindex.FMIndex(flat, offset, 3)
    run, first, end = index.repeats(flat, offset[:-1], offset[1:], least)
    got, want = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
    for a, b in zip(first, end, strict=True):
        got[a:b] = True
    for o, r in zip(offset, runs, strict=False):
        for i in range(len(r) - least + 1):
            if seen[tuple(r[i:i + least])] > 1:
                want[o + i:o + i + least] = True
    assert (got == want).all() and (np.searchsorted(offset, first, side="right") - 1 == run).all()


def test_bits_and_wavelet_count():
    rng = np.random.default_rng(1)
    bits = rng.random(1000) < 0.3
    at = np.arange(1001)
    assert (fmindex.Bits(bits).rank(at) == np.concatenate([[0], np.cumsum(bits)])).all()
    symbols = rng.integers(0, 11, 500)
    w = fmindex.Wavelet(symbols, 11)
    for s in range(11):
        full = np.full(501, s)
        assert (w.descend(full, np.arange(501)) - w.descend(full, np.zeros(501, np.int64)) == np.concatenate([[0], np.cumsum(symbols == s)])).all()
