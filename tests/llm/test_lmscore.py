"""LM scoring against a plain Kneser-Ney model, and the trie's sequences against sorted arrays."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotrows.llm import lmscore
from plotrows.llm import trie as T

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower()) + [b"</s>"]


def plain(rows: list[tuple[str | None, bool]]) -> list[tuple]:
    """(n_tokens, n_known, train_tokens, base, score) of texts by an unquantised model."""
    one, three = Counter(), Counter()
    for text, learn in rows:
        if learn:
            seq = tokens(text)
            one.update(seq)
            padded = [b"<s>", b"<s>", *seq]
            three.update(zip(padded, padded[1:], padded[2:]))
    n, v = sum(one.values()), len(one)
    total, kinds, spread, root_total, root_kinds = Counter(), Counter(), Counter(), Counter(), Counter()
    for (a, b, c), k in three.items():
        total[a, b] += k
        kinds[a, b] += 1
        spread[b, c] += 1
        root_total[b] += 1
    for b, _ in spread:
        root_kinds[b] += 1

    def p1(w):
        return (one[w] + 0.5) / (n + 0.5 * (v + 1))

    def p(a, b, c):
        two = p1(c)
        if root_total[b]:
            two = max(spread[b, c] - 0.75, 0) / root_total[b] + 0.75 * root_kinds[b] / root_total[b] * two
        if not total[a, b]:
            return two
        return max(three[a, b, c] - 0.75, 0) / total[a, b] + 0.75 * kinds[a, b] / total[a, b] * two

    out = []
    for text, _ in rows:
        seq = tokens(text)
        padded = [b"<s>", b"<s>", *seq]
        out.append((len(seq), sum(one[t] > 0 for t in seq), n, sum(math.log10(p1(t)) for t in seq),
                    sum(math.log10(p(*g)) for g in zip(padded, padded[1:], padded[2:]))))
    return out


def scored(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, learn, "x") for i, (t, learn) in enumerate(rows)], "doc_id long, text string, l boolean, learn string")
    got = lmscore.score(df.repartition(3), F.col("l"), **kw).orderBy("doc_id").collect()
    return [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got]


def agree(got, want, per_token=0.05):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3]
        assert g[3] == pytest.approx(w[3], abs=1e-6)
        assert abs(g[4] - w[4]) <= per_token * w[0] + 0.02


def test_monotone_sequences():
    rng = np.random.default_rng(1)
    for n, top in ((0, 9), (1, 1 << 64), (500, 40), (3000, 1 << 45), (2000, 1 << 64)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=False) if top < 1 << 64 else rng.integers(0, 1 << 63, n, dtype=np.uint64) * 2)
        m = T.Monotone.of(values, top)
        assert (m.get(np.arange(n)) == values).all()
        some = np.unique(values)
        asked = np.concatenate([some, some + np.uint64(1)])
        at, ok = m.find(asked, np.zeros(len(asked), np.int64), np.full(len(asked), n))
        assert (ok == np.isin(asked, values)).all()
        assert (values[at[ok]] == asked[ok]).all()


def test_trie_keeps_every_trigram(tmp_path):
    rng = np.random.default_rng(2)
    rows = np.unique(rng.zipf(1.5, (4000, 3)) % 300, axis=0).astype(np.uint64)
    count = rng.integers(1, 9, len(rows))
    path = tmp_path / "trie"
    path.write_bytes(T.pack(rows[:, 0], rows[:, 1], rows[:, 2], count))
    trie = T.Trie(np.memmap(path, np.uint8, "r"))
    r = trie.find_root(rows[:, 0])
    pair, context = trie.find_pair(r, rows[:, 2]), trie.find_context(r, rows[:, 1])
    at = trie.find_next(r, context, pair)
    assert (r >= 0).all() and (pair >= 0).all() and (context >= 0).all()
    assert sorted(at) == list(range(len(rows)))
    assert (trie.find_root(np.array([301], np.uint64)) == -1).all()
    known = {tuple(x) for x in rows.tolist()}
    other = np.array([x for x in rng.integers(0, 300, (3000, 3)).astype(np.uint64).tolist() if tuple(x) not in known], np.uint64)
    r = trie.find_root(other[:, 0])
    assert (trie.find_next(r, trie.find_context(r, other[:, 1]), trie.find_pair(r, other[:, 2])) == -1).all()


def test_scores_match_a_plain_model(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.4, rng.integers(0, 60)) % 50) for _ in range(120)]
    rows = [(t, i % 5 != 1) for i, t in enumerate(texts)]
    rows += [(None, True), ("", False), ("  \t\n ", True), ("Never SEEN words", False), (texts[0], True), (texts[0], True), ("é ｗ  x", True)]
    agree(scored(spark, rows), plain(rows))
    agree(scored(spark, rows, shard_tokens=50), plain(rows))


def test_hot_words_are_split_into_classes(spark):
    rows = [(" ".join(f"a{i % 7} the b{j % 5}" for j in range(30)), i % 4 != 1) for i in range(40)]
    whole, split = scored(spark, rows), scored(spark, rows, hot=100)
    agree(whole, plain(rows))
    assert [x[:3] for x in split] == [x[:3] for x in whole]
    assert [x[3] for x in split] == pytest.approx([x[3] for x in whole])
    assert all(a[4] > a[3] for a in split)  # still a better model than single words


def test_the_split_of_hot_words_does_not_change_a_score(spark):
    rng = np.random.default_rng(6)
    rows = [(" ".join(f"a{rng.integers(300)} the b{rng.zipf(1.5) % 40}" for _ in range(20)), i % 4 != 1) for i in range(60)]
    whole = scored(spark, rows, hot=1 << 40)
    agree(whole, plain(rows))
    for hot in (100, 7):  # 7: the pairs of "the" lie in several parts, too
        split = scored(spark, rows, hot=hot, shard_tokens=200)
        assert [x[:3] for x in split] == [x[:3] for x in whole]
        assert [x[4] for x in split] == pytest.approx([x[4] for x in whole], abs=1e-9)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(4)
    rows = np.unique(rng.integers(0, 12, (300, 3)), axis=0).astype(np.uint64)
    trie = T.Trie(T.pack(rows[:, 0], rows[:, 1], rows[:, 2], rng.integers(1, 5, len(rows))))
    words = np.arange(12, dtype=np.uint64)
    for root, before in ((3, 4), (3, 99), (77, 1)):
        r = trie.find_root(np.full(12, root, np.uint64))
        a, g = trie.probabilities(r, trie.find_context(r, np.full(12, before, np.uint64)), trie.find_pair(r, words))
        assert (a + g / 12).sum() == pytest.approx(1, abs=0.06)


def test_no_training_rows_and_no_rows(spark):
    assert scored(spark, [("a b", False)])[0][:3] == (3, 0, 0)
    assert scored(spark, []) == []


def test_a_null_id_and_one_long_text(spark):
    df = spark.createDataFrame([(None, "a b c"), (5, "x y " * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in lmscore.score(df, F.col("doc_id").isNotNull()).collect()}
    assert got[5].n_tokens == 600_001 and got[None].n_known == 1 and not got[None].learn
