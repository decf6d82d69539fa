"""Decontamination against every window of every document."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from plotrows.llm import decontaminate, queries
from plotrows.llm import text as X
from tests_llm_common import EDGES, table


def runs(text: str | None) -> list[str]:
    out, now = [], ""
    for c in text or "":
        if c.isalnum():
            now += c.lower() if len(c.lower()) == 1 else c
        elif now:
            out.append(now)
            now = ""
    return [*out, now] if now else out


def grams(w: list[str]) -> Counter:
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def plain(docs, items) -> set[tuple[int, int]]:
    out = set()
    for i, t in docs:
        w = runs(t)
        for k, item in items:
            own = runs(item)
            if not own or not w:
                continue
            want = grams(own)
            size = min(len(own), len(w))
            vocabulary = set(own)
            for s in range(len(w) - size + 1):
                if len(vocabulary.intersection(w[s:s + size])) * 2 < len(vocabulary):
                    continue
                got = grams(w[s:s + size])
                if sum((want & got).values()) >= 0.8 * sum((want | got).values()):
                    out.add((i, k))
                    break
    return out


def bench(spark, items):
    return spark.createDataFrame([(k, t, 0) for k, t in items], "item_id long, text string, doc_id int")


def test_planted_items(spark):
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.choices(pool, k=rng.choice([1, 3, 5, 6, 12, 40, 90])))) for k in range(40)]
    docs = []
    for i in range(150):
        w = rng.choices(pool, k=rng.choice([2, 20, 200]))
        if i % 3:
            item = rng.choice(items)[1].split()
            if i % 3 == 2:
                for _ in range(rng.choice([1, 1, 2, 8])):
                    item[rng.randrange(len(item))] = rng.choice(pool)
            at = rng.randrange(len(w))
            w[at:at] = item
        docs.append((i, " ".join(w).title() + "."))
    got = decontaminate.find(table(spark, docs), bench(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == plain(docs, items)
    text = dict(docs)
    own = dict(items)
    for r in got:
        window = runs(text[r.doc_id][r.start:r.end])
        want = grams(runs(own[r.item_id]))
        seen = grams(window)
        assert abs(sum((want & seen).values()) / sum((want | seen).values()) - r.similarity) < 1e-9
        assert r.distance <= decontaminate.RADIUS


def test_given_documents(spark, sf_small):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf_small, "documents").collect()]
    items = [(r.item_id, r.text) for r in queries.table(spark, sf_small, "benchmark").collect()]
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, sf_small).collect()}
    assert got == plain(docs, items)


def test_blocks_guarantee_the_radius():
    """Any two fingerprints within the radius agree up to 2 bits in some block."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        flips = rng.choice(128, decontaminate.RADIUS, replace=False)
        per = np.bincount(flips // 8, minlength=16)
        assert per.min() <= decontaminate.RADIUS // decontaminate.BLOCKS


def test_fingerprints_of_windows():
    h = X.mix(np.arange(50))
    whole = decontaminate.fingerprints(h, 7)
    assert len(whole) == 44
    for s in (0, 13, 43):
        assert (decontaminate.fingerprints(h[s:s + 7], 7)[0] == whole[s]).all()


def test_edges(spark):
    items = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "long words long words long"), (4, "a null id"), (5, "not there at all in any")]
    got = decontaminate.find(table(spark, EDGES), bench(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(4, 3), (None, 4)}
    assert sum(r.doc_id == 4 for r in got) == 2
    assert decontaminate.find(table(spark, []), bench(spark, items)).collect() == []
    assert decontaminate.find(table(spark, EDGES), bench(spark, [])).collect() == []


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    items = [(k, " ".join(rng.choices("abcdefgh", k=9))) for k in range(30)]
    docs = [(i, f"x {t} y") for i, t in enumerate(t for _, t in items)]
    one = sorted(map(tuple, decontaminate.find(table(spark, docs), bench(spark, items)).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    assert sorted(map(tuple, decontaminate.find(table(spark, docs), bench(spark, items)).collect())) == one
