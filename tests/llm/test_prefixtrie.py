"""The prefix trie against a plain trie of all rebuilt conversations."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from plotrows.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Counter of result rows."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v, key=lambda t: t[:3])] for c, v in turns.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items())


def result(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def conversations(seed, n=400):
    """Copies, shared first turns, prefixes of one another, long and short ones."""
    rng = random.Random(seed)
    pool = [("user" if i % 2 else "assistant", f"text {i} é😀"[: rng.randrange(12)]) for i in range(9)]
    rows = []
    for c in range(n):
        c = c * rng.choice([1, 1, 7]) + rng.choice([0, 0, 1000])
        k = rng.choice([1, 2, 3, 5, 8, 30])
        turns = [pool[0]] * k if rng.random() < 0.3 else [pool[0], pool[1]] + rng.choices(pool, k=k)
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    return list({(c, i): (c, i, r, t) for c, i, r, t in rows}.values())


@pytest.mark.parametrize("fanin", [2, 64])
def test_equals_a_plain_trie(spark, fanin):
    rows = conversations(fanin, 120)
    df = prefixtrie.trie(spark.createDataFrame(rows, SCHEMA).repartition(5), fanin=fanin, partition_turns=60)
    assert result(df) == plain(rows)


def test_edges(spark):
    rows = [(None, 0, "user", "lost"), (5, None, None, None), (5, 1, "user", ""), (5, 1, "user", ""), (100, 0, "user", "a"), (104, 0, "user", "b"),
            (-7, 0, "user", "neg"), (200, 3, "", "x" * 100_000), (201, 3, None, "x" * 100_000), (9007199254740993, 0, "user", "big id")]
    assert result(prefixtrie.trie(spark.createDataFrame(rows, SCHEMA))) == plain([r if r[0] is None or r[0] >= 0 else r for r in rows])
    assert prefixtrie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    extra = spark.createDataFrame([(1, 0, "user", "a", "k", 9)], SCHEMA + ", key string, depth int")
    assert result(prefixtrie.trie(extra)) == plain([(1, 0, "user", "a")])


def test_large_groups_of_copies_span_partitions(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CHUNK_IDS", 10)  # of the driver only; chunks are cut by the workers' value
    rows = [(c, t, "user", f"same {t}") for c in range(300) for t in range(3)] + [(2000 + c, 0, "user", f"other {c}") for c in range(50)]
    assert result(prefixtrie.trie(spark.createDataFrame(rows, SCHEMA), fanin=6, partition_turns=100)) == plain(rows)


def test_a_turnless_conversation_is_a_member_of_the_root(spark):
    """Conversation 101 takes its first turns from the absent 100: it ends at the root."""
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6)
    rows = [(c, 0, "user", "gone")]
    found = prefixtrie.trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_leaves) for r in found] == [(c, 0, 1, 1)] and result(prefixtrie.trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_common_prefix():
    a, b = b"x" * 32 + b"y" * 16, b"x" * 32 + b"z" * 16
    assert [prefixtrie.common(a, b), prefixtrie.common(a, a[:32]), prefixtrie.common(b"", a)] == [2, 2, 0]
