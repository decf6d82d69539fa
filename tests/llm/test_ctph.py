"""Piecewise fingerprints: edited texts by hand, and what likeness has to tell."""

from __future__ import annotations

import hashlib
import random

import pytest

from plotrows.llm import ctph, queries
from tests_llm_common import EDGES, table


def edited(rows: list[tuple[int, str | None]]) -> dict[int, str]:
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    out = {}
    for n, (i, t) in enumerate(order):
        follow = order[(n + 1) % len(order)][1]
        half = len(t) // 2
        out[i] = t[:len(t) - half] + follow[:half]
    return out


def verify(got, rows):
    assert len(got) == len(rows)
    want, texts = edited(rows), dict(rows)
    order = sorted(texts, reverse=True)
    prints = {r.doc_id: r.fingerprint for r in got}
    for r in got:
        assert r.n_chars == len(texts[r.doc_id] or "")
        assert r.edited_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        assert r.fingerprint == ctph.fingerprints([(texts[r.doc_id] or "").encode()])[0]
        assert r.edited_fingerprint == ctph.fingerprints([want[r.doc_id].encode()])[0]
        after = order[(order.index(r.doc_id) + 1) % len(order)]
        assert r.near_edited == ctph.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == ctph.likeness(r.fingerprint, prints[after])


def test_given_documents(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf_small, "documents").collect()]
    got = queries.op3_piecewise_fingerprints(spark, sf_small).collect()
    verify(got, rows)
    long = [r for r in got if r.n_chars > 400]
    assert sum(r.near_edited for r in long) / len(long) > 0.45
    texts = dict(rows)
    order = sorted(texts, reverse=True)
    other = [r.near_next for r in long if (texts[order[(order.index(r.doc_id) + 1) % len(order)]] or "") != texts[r.doc_id]]
    assert sum(other) / len(other) < 0.15


def test_edges(spark):
    verify(ctph.compare_edited(table(spark, rows := [(1, None), (2, ""), (3, "x"), (5, "ünï 漢字 😀 mixed"), (6, "long words " * 40_000)])).collect(), rows)
    assert ctph.compare_edited(table(spark, [])).collect() == []
    one = ctph.compare_edited(table(spark, [(7, "abcdef")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one[0].near_next == 1.0
    assert len(ctph.compare_edited(table(spark, EDGES)).collect()) == len(EDGES)


def test_many_parts_meet_at_their_borders(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(10 ** 12), "".join(rng.choices("abc ", k=rng.randrange(80)))) for _ in range(500)]
    verify(ctph.compare_edited(table(spark, dict(rows).items())).collect(), list(dict(rows).items()))


def test_likeness():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(2000)]
    text = " ".join(rng.choices(words, k=1500))
    other = " ".join(rng.choices(words, k=1500))
    cut = text[:len(text) // 3] + " some new words here " + text[len(text) // 3:]
    moved = " ".join(rng.choices(words, k=20)) + text
    p, q, c, m, double = ctph.fingerprints([x.encode() for x in (text, other, cut, moved, text + text)])
    assert ctph.likeness(p, p) == 1.0 and ctph.likeness(p, q) < 0.2
    assert ctph.likeness(p, c) > 0.9 and ctph.likeness(p, m) > 0.85
    assert ctph.likeness(p, double) > 0.5
    assert ctph.likeness(p, c) == ctph.likeness(c, p)
    assert ctph.fingerprints([text.encode()]) == [p]


def test_common_letters():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
        return row[-1]
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcd", k=rng.randrange(1, 70))) for _ in range(2))
        assert ctph._common(a, b) == plain(a, b)


@pytest.mark.parametrize("text", [b"", b"a", b"aaaa" * 5000, bytes(range(128)) * 400])
def test_fingerprints_are_short(text):
    block, *levels = ctph.fingerprints([text])[0].split(":")
    assert int(block) >= 2 and len(levels) == ctph.LEVELS and all(len(x) <= ctph.MOST_CHUNKS for x in levels)
