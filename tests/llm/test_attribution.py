"""Token counts against a plain walk over the library's offsets."""

from __future__ import annotations

import random
import re

import pytest
from tokenizers import Tokenizer

from plotrows.llm import attribution, queries, tokens
from tests_llm_common import EDGES, table


def ranges(tok, text: str) -> list[tuple[int, int]]:
    """Code point ranges of the tokens; a part of a character covers it."""
    raw = text.encode()
    char = [i for i, c in enumerate(text) for _ in c.encode()]
    out, at = [], 0
    vocab = {i: t for t, i in tok.get_vocab().items()}
    for t in tok.encode(text, add_special_tokens=False).ids:
        size = len(vocab[t])
        out.append((char[at], char[at + size - 1] + 1))
        at += size
    assert at == len(raw)
    return out


def sections(text: str, kind: str) -> list[tuple[int, int]]:
    pattern = r"\n" if kind == "lines" else r"(?<=[.!?])[\t\n\v\f\r \xa0]+|[\t\n\v\f\r \xa0]*\n[\t\n\v\f\r \xa0]*"
    edge = [0]
    for m in re.finditer(pattern, text):
        if m.end() > edge[-1] and m.end() < len(text):
            edge.append(m.end())
    return list(zip(edge, [*edge[1:], len(text)], strict=True))


def plain(tok, text: str, parts: list[tuple[int, int]], rule: str) -> list[tuple[float, int]]:
    out = [[0.0, 0] for _ in parts]
    for s, e in ranges(tok, text):
        held = [(max(0, min(e, b) - max(s, a)), -k) for k, (a, b) in enumerate(parts)]
        met = [-k for n, k in held if n]
        if len(met) > 1:
            for k in met:
                out[k][1] += 1
        if rule == "first":
            out[met[0]][0] += 1
        elif rule == "last":
            out[met[-1]][0] += 1
        elif rule == "most":
            out[-max(held)[1]][0] += 1
        else:
            for n, k in held:
                out[-k][0] += n / (e - s)
    return [tuple(x) for x in out]


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return t


TEXTS = ["One two. Three!  Four?\nFive", "a\n\nb\n", "e.g. 3.14 is pi.\tYes", "漢字. 😀😀! ñ\u00a0x", "no end", ".\n.\n.", "   lead. trail   ", "x" * 50 + ". " + "y\n" * 20]


@pytest.mark.parametrize("rule", attribution.RULES)
@pytest.mark.parametrize("kind", ["sentences", "lines"])
def test_sections(spark, tok, rule, kind):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choices("ab .!?\n\té漢", k=60)) for _ in range(60)]
    got = {}
    for r in attribution.attribute(table(spark, texts), rule, kind).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        rows = sorted(got[i], key=lambda r: r.section)
        parts = sections(t, kind)
        assert [(r.start, r.end) for r in rows] == parts, repr(t)
        for r, (n, crossing) in zip(rows, plain(tok, t, parts, rule), strict=True):
            assert r.n_tokens == pytest.approx(n) and r.n_crossing == crossing


def test_given_ranges(spark, tok):
    text = "alpha beta gamma delta"
    df = spark.createDataFrame([(1, text, [(0, 3), (3, 12), (15, 99)]), (2, text, None), (3, None, [(0, 4)]), (4, text, [(0, 10), (5, 12)])],
                               "doc_id long, text string, spans array<struct<start:long,end:long>>")
    got = attribution.attribute(df, "most", "spans").collect()
    by = {(r.doc_id, r.section, r.start): r for r in got}
    assert (by[1, 0, 0].end, by[1, 2, 15].end) == (3, len(text))
    assert by[2, -1, 0].n_tokens == len(tok.encode(text).ids)
    assert (by[3, 0, 0].end, by[3, 0, 0].n_tokens) == (0, 0)
    assert (by[4, 1, 10].start, by[4, 1, 10].end) == (10, 12)
    for i in (1, 4):
        assert sum(r.n_tokens for r in got if r.doc_id == i) == len(tok.encode(text).ids)


def test_query_counts_every_token(spark, sf_small, tok):
    docs = {r.doc_id: r.text for r in queries.table(spark, sf_small, "documents").collect()}
    sums, ends = {}, {}
    for r in queries.op9_token_counts(spark, sf_small).collect():
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.n_tokens
        ends[r.doc_id] = max(ends.get(r.doc_id, 0), r.end)
    assert sums == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in docs.items()}
    assert ends == {i: len(t or "") for i, t in docs.items()}


def test_edges(spark):
    got = attribution.attribute(table(spark, EDGES)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.start, r.end, r.n_tokens) for r in by[1]] == [(0, 0, 0.0)] == [(r.start, r.end, r.n_tokens) for r in by[2]]
    assert len(by[4]) == 2 and len(by[None]) == 1
    assert attribution.attribute(table(spark, [])).collect() == []
    with pytest.raises(ValueError):
        attribution.attribute(table(spark, []), "other")
