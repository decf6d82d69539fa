"""Toxicity: held-out quality, the chain against all paths, spans, and edge tables."""

from __future__ import annotations

import random

import numpy as np

from plotrows.llm import crf, queries, toxicity
from tests_llm_common import EDGES, table

BAD = ["zorgling", "frutzkopf", "snarfhead"]


def corpus(n: int, seed: int = 1) -> tuple[list[tuple[int, str]], list[tuple[int, int]]]:
    rng = random.Random(seed)
    pool = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("na", "so", "vi", "xe", "yu", "ba")]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = rng.choices(pool, k=rng.choice([5, 30, 200]))
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


def fitted(spark):
    docs, labels = corpus(300)
    return toxicity.fit(table(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_documents(spark, sf_small):
    labels = {r.doc_id: r.toxic for r in queries.table(spark, sf_small, "labels").collect()}
    got = queries.op7_toxicity(spark, sf_small).collect()
    assert len(got) == queries.table(spark, sf_small, "documents").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    right = [r.predicted == labels[r.doc_id] for r in held]
    assert np.mean(right) > 0.9


def test_spans_and_scores(spark):
    model = fitted(spark)
    docs, labels = corpus(200, seed=9)
    got = {r.doc_id: r for r in toxicity.score(table(spark, docs), model).collect()}
    toxic = dict(labels)
    assert np.mean([(got[i].score >= 0.3) == bool(toxic[i]) for i, _ in docs]) > 0.98
    for i, t in docs:
        found = {w for s in got[i].spans for w in t[s.start:s.end].split()}
        assert found == (set(t.split()) & set(BAD))


def test_edges(spark):
    model = fitted(spark)
    got = toxicity.score(table(spark, [*EDGES, (70, "KA NA Zorgling frutzkopf"), (71, "kana loso mivi ruxe teyu " * 20_000)]), model, keep=["doc_id", "text", "lang"]).collect()
    assert len(got) == len(EDGES) + 2
    by = {r.doc_id: r for r in got}
    assert by[1].score == by[2].score == by[3].score and by[1].spans == []
    assert by[70].score >= 0.3 and by[71].score < 0.3
    assert toxicity.score(table(spark, []), model).collect() == []


def test_one_class_or_no_labels(spark):
    docs = table(spark, [(1, "a b"), (2, "c d")])
    for labels, want in (([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0), ([], 0.0), ([(1, None)], 0.0)):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert all(abs(r.score - want) < 1e-6 for r in toxicity.score(docs, model).collect())


def test_training_prefers_marked_places():
    x = np.array([[[1], [2], [1], [0]], [[1], [1], [0], [0]]], np.int32)
    y = np.array([[0, 1, 0, 0], [0, 0, 0, 0]], float)
    c = crf.train(x, y, np.array([3, 2]), np.ones(2), 8, rounds=200)
    odds = crf.odds(c, c.weight[[1, 2, 1]])
    assert odds[1] > 1 > max(odds[0], odds[2])


def test_rare_terms_and_fixed_phrases_are_learned(spark):
    docs, labels = corpus(1000)
    rare = [i for i, toxic in labels if toxic][:24]
    clean = {i: " ".join(w for w in t.split() if w not in BAD) for i, t in docs}
    # six toxic documents of 200 have a rare term only, eighteen a term after the same word each time
    docs = [(i, clean[i] + (" quixblat" if k < 6 else " kana wumpledorf") * 3) if (k := rare.index(i) if i in rare else -1) >= 0 else (i, t) for i, t in docs]
    model = toxicity.fit(table(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(table(spark, [(1, "lona quixblat mivi"), (2, "loso kana wumpledorf mina"), (3, "lona loso kana mivi mina")]), model).collect()
    assert [bool(r.spans) for r in sorted(got, key=lambda r: r.doc_id)] == [True, True, False]
