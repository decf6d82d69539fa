"""Near-duplicates against all pairs of sets."""

from __future__ import annotations

import random

import numpy as np
import pytest

from plotrows.llm import neardup, queries
from tests_llm_common import EDGES, table, words


def plain(rows: list[tuple[int, str | None]], k: int, percent: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component)."""
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(seed: int) -> list[tuple[int, str]]:
    """Texts with exact and near copies, chains of copies, shared passages and short texts."""
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(pool, k=40))
    texts = []
    for _ in range(40):
        base = rng.choices(pool, k=rng.choice([3, 4, 8, 30, 120, 600]))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 4])):
            for _ in range(rng.choice([0, 1, 1, max(1, len(base) // 40)])):
                base = list(base)
                base[rng.randrange(len(base))] = rng.choice(pool)
            texts.append(" ".join(base).upper() if rng.random() < 0.2 else " ".join(base))
        if rng.random() < 0.4:
            texts.append(f"{' '.join(rng.choices(pool, k=60))} {passage}")
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize(("seed", "k"), [(1, 4), (2, 5)])
def test_components_match_all_pairs(spark, seed, k):
    rows = copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.dedupe(table(spark, rows), words=k).collect()}
    assert got == plain(rows, k)


def test_query_matches_all_pairs_of_short_texts(spark, sf_small):
    """The query's rows on the given documents of up to 3,000 characters."""
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf_small, "documents").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op6_minhash_dedup(spark, sf_small).collect()}
    want = plain(rows, 4)
    assert got == {i: (*v, v[1] == i) for i, v in want.items()}


def test_threshold_is_inclusive(spark):
    """8 of 10 shingles in common is a link, 7 of 9 none."""
    a, b, c = (" ".join(x) for x in ("abcdefghijkl", "abcdefghijkx", "abcdefghijxy"))
    rows = [(1, a), (2, b), (3, c)]
    assert plain(rows, 4)[2][1] == 1
    assert {r.doc_id: r.component_id for r in neardup.dedupe(table(spark, rows), words=4).collect()} == {i: v[1] for i, v in plain(rows, 4).items()}


def test_a_large_group_of_copies_and_a_common_line(spark):
    rng = random.Random(5)
    line = " ".join(f"c{i}" for i in range(30))
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        t = list(base)
        t[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, " ".join(base)) for i in range(100)]
    rows += [(2000 + i, line + " " + " ".join(f"y{i}_{j}" for j in range(60))) for i in range(200)]
    got = {r.doc_id: r.component_id for r in neardup.dedupe(table(spark, rows), words=5).collect()}
    assert got == {i: v[1] for i, v in plain(rows, 5).items()}


def edited(rng: random.Random, base: list[str], edits: int, tag: str) -> str:
    """A copy with words of its own at ``edits`` places."""
    t = list(base)
    for j in rng.sample(range(len(base)), edits):
        t[j] = f"{tag}_{j}"
    return " ".join(t)


def test_a_group_of_copies_that_are_no_links_makes_few_pairs(spark, monkeypatch):
    """Copies of long texts, a third of each other's shingles apart, are told apart before their pairs are listed."""
    rng = random.Random(8)
    rows = []
    for n in (450, 520, 1100):  # parities as long as their fold, on both sides of a step, and longer
        base = [f"b{n}_{i}" for i in range(n)]
        rows += [(n * 1000 + i, edited(rng, base, n // 30, f"x{n}_{i}")) for i in range(60)]
        rows += [(n * 1000 + 100 + i, edited(rng, base, n // 90, f"y{n}_{i}")) for i in range(6)]
    listed, links = [], neardup._links
    monkeypatch.setattr(neardup, "_links", lambda pairs, *rest: listed.append(pairs.count()) or links(pairs, *rest))
    got = {r.doc_id: r.component_id for r in neardup.dedupe(table(spark, rows), words=4).collect()}
    assert got == {i: v[1] for i, v in plain(rows, 4).items()}
    assert listed[-1] < len(rows)  # of more than 5,000 pairs in common lists


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for n, gone, new in ((1, 0, 1), (500, 60, 3), (513, 20, 40), (1000, 0, 200), (9000, 1500, 10), (40_000, 5000, 4000)):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64)]))
        differ = len(np.setxor1d(a, b))
        x, y = neardup._parity(a), neardup._parity(b)
        for p, q in ((x, y), (neardup._fold(x, neardup.LOW_WORDS), y)):
            assert neardup._apart(p, q) <= differ and (differ - neardup._apart(p, q)) % 2 == 0
        assert neardup._apart(x, y) >= 0.7 * differ or n > neardup.PARITY_BITS


def test_edges(spark):
    got = neardup.dedupe(table(spark, EDGES), words=4).collect()
    assert len(got) == len(EDGES)
    by = {r.doc_id: r for r in got}
    assert [(by[i].n_shingles, by[i].component_id, by[i].kept) for i in (1, 2, 3)] == [(0, i, True) for i in (1, 2, 3)]
    assert by[4].kept and by[6].n_shingles == 2 and by[6].component_id == 6
    assert neardup.dedupe(table(spark, []), words=4).collect() == []


def plain_rows(rows, k, percent=80):
    """(doc_id, set size, component) of every row, rows with one id apart."""
    by_row = plain([(j, t) for j, (_, t) in enumerate(rows)], k, percent)
    groups = {}
    for j, (n, c) in by_row.items():
        groups.setdefault((c, n > 0 or j), []).append(j)
    out = []
    for members in groups.values():
        ids = [rows[j][0] for j in members if rows[j][0] is not None]
        out += [(rows[j][0], by_row[j][0], min(ids) if ids else None) for j in members]
    return sorted(out, key=str)


def test_rows_with_one_id_keep_their_own_links(spark):
    words_ = [f"w{i}" for i in range(50)]
    near = [*words_[:25], "x", *words_[25:]]
    rows = [(1, " ".join(words_)), (2, "something else that is linked with nothing at all"), (2, " ".join(near)), (2, "a third text of this id"), (None, " ".join(words_)),
            (None, "two rows without id are copies"), (None, "two rows without id are copies"), (3, None), (None, None), (9007199254740993, " ".join(near)), (7, "a third text of this id")]
    got = neardup.dedupe(table(spark, rows), words=4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain_rows(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_keep_one_row_of_each_group(spark):
    rows = copies(3)[:60]
    rows += [(i, t) for i, t in rows[:10]] + [(None, t) for _, t in rows[5:9]] + [(None, "only rows without an id have this text"), (None, "only rows without an id have this text"), (1000, None), (1000, None), (None, "")]
    kept = neardup.keep_one(table(spark, rows).repartition(5), words=4).collect()
    want = {}
    for (i, t), (n, c) in zip(rows, (plain([(j, t) for j, (_, t) in enumerate(rows)], 4)[j] for j in range(len(rows))), strict=True):
        key = c if n else ("alone", i, t)
        want[key] = min(want.get(key, (i is None, i or 0)), (i is None, i or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(want.values())
