"""Memory of the Python workers: small pieces of text, nothing kept after a task, and a learning sample that is read once or twice."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from plotrows.llm import langid, toxicity
from plotrows.llm import text as X
from test_toxicity import corpus
from tests_llm_common import table


@pytest.fixture(scope="module")
def frame() -> pd.DataFrame:
    rng = random.Random(5)
    pool = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru") for b in ("na", "so", "vi", "xe") for c in ("yu", "ba", "te")]
    texts = [" ".join(rng.choices(pool, k=5000)) for _ in range(100)]  # 3.5 MB
    return pd.DataFrame({"doc_id": np.arange(len(texts)), "text": texts, "toxic": np.arange(len(texts)) % 2, "lang": "en"})


@pytest.mark.parametrize("run", [toxicity._seen, langid._count(4)], ids=["toxicity", "language"])
def test_learning_works_on_small_pieces(frame, run):
    X.letter_runs([b"warm"])
    X.release()
    tracemalloc.start()
    rows = sum(len(f) for f in run(iter([frame])))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert rows and peak < 60  # 307 and 177 in pieces of 3 MB


def test_powers_of_a_long_text_are_given_back():
    codes = np.arange(1, 1 << 20, dtype=np.uint64)
    before = X.segment_hash(X.prefix_hash(codes), np.array([5, 900_000]), np.array([900, 1_000_000]))
    X.release()
    assert len(X._POWERS.up) < 1 << 20
    assert (X.segment_hash(X.prefix_hash(codes), np.array([5, 900_000]), np.array([900, 1_000_000])) == before).all()


def test_a_task_gives_back_what_it_kept(monkeypatch):
    said = []

    class Kept:
        def __del__(self):
            said.append("freed")

    @X.tidy
    def run(batches):
        kept = Kept()
        for b in batches:
            said.append(b)
            yield b
        del b
        assert kept

    monkeypatch.setattr(X, "release", lambda: said.append("release"))
    assert list(run(iter([1, 2]))) == [1, 2]
    assert said == ["release", 1, 2, "freed", "release"]


def test_the_learning_sample_is_not_made_for_each_step(spark):
    docs, labels = corpus(300)
    made = spark.sparkContext.accumulator(0)

    def run(frames):
        for f in frames:
            made.add(len(f))
            yield f
    counted = table(spark, docs)
    counted = counted.mapInPandas(run, counted.schema)
    toxicity.fit(counted, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert 300 <= made.value <= 600  # five times before
