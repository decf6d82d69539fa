"""Packing: an exact round trip of the ids, and the layout of the sequences."""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from plotrows.llm import packing, queries, tokens
from tests_llm_common import EDGES, table


def ids_of(tok, text):
    return [*tok.encode(text or "", add_special_tokens=False).ids, 0]


def tokenizer():
    tok = Tokenizer.from_file(tokens.default_path())
    tok.encode_special_tokens = True
    return tok


def check(rows, docs, length=1024):
    """Every id in exactly one piece; sequences gapless; all but the last few full, the rest powers of two."""
    tok = tokenizer()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, text in docs:
        ids = ids_of(tok, text)
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            part = ids[at:at + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
        assert at == len(ids)
    sizes = []
    for s in sorted(by_seq):
        at = 0
        for r in sorted(by_seq[s], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        sizes.append(at)
    odd = [s for s in sizes if s != length]
    assert all(s & (s - 1) == 0 for s in odd) and len(odd) <= 10
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_round_trip_of_the_given_documents(spark, sf_small):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf_small, "documents").collect()]
    check(queries.op2_hilbert_packing(spark, sf_small).collect(), docs)


def test_edges(spark):
    rows = [(i, t) for i, t in EDGES if i != 4]
    check([r for r in packing.pack(table(spark, rows)).collect()], rows)
    assert packing.pack(table(spark, [])).collect() == []
    one = packing.pack(table(spark, [(7, None)])).collect()
    assert [(r.doc_id, r.length, r.doc_tokens, r.offset) for r in one] == [(7, 1, 1, 0)]
    twice = packing.pack(table(spark, [(4, "one"), (4, "one")])).collect()
    assert sum(r.length for r in twice) == 4


def test_other_lengths_and_partitions(spark):
    rows = [(i, f"text {i} " * (i % 90)) for i in range(300)]
    check(packing.pack(table(spark, rows), length=64).collect(), rows, 64)


def test_hilbert_is_a_path_through_every_cell():
    for bits, dims in ((3, 2), (2, 3), (2, 4)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert(cells, bits)
        assert sorted(key.tolist()) == list(range(side ** dims))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_neighbours_share_sequences(spark):
    """Copies of a text lie next to each other."""
    rows = [(i, f"subject {i % 10} " * 20 + "abcdefghij"[i % 10] * 30) for i in range(200)]
    seqs = defaultdict(set)
    for r in packing.pack(table(spark, rows), length=256).collect():
        seqs[r.doc_id % 10].add(r.sequence_id)
    assert max(len(s) for s in seqs.values()) < 20  # scattered over all, a subject would meet up to 40


@pytest.mark.parametrize("text", ["", "it's we'll I'M 'tis ''s", "a  b   c\n\n d \t", "x y  z", "１２ ⅷ² 12a", "é́ ñ 漢字 😀😀", "<|endoftext|> a",
                                  "\x00\x01 \x85 don''t", "   ", "a\n", "'", "'re", " 's"])
def test_encoder_equals_the_library(text):
    enc, tok = tokens.Encoder(tokens.default_path()), tokenizer()
    ids, at = enc.encode(tokens.pieces([text.encode(), b"", text.encode()]))
    want = tok.encode(text, add_special_tokens=False).ids
    assert ids[:at[1]].tolist() == want and ids[at[2]:].tolist() == want


def test_pieces_met_again_are_not_encoded_again():
    """The pieces kept are more than 200,000, and running out of them does not lose them all."""
    enc = tokens.Encoder(tokens.default_path())
    calls, piece = [], enc._piece
    enc._piece = lambda s: calls.append(s) or piece(s)
    parts = [tokens.pieces([" ".join(f"w{chr(97 + a)}{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}q" for i in range(17_576)).encode()])
             for a in range(16)]
    first = [enc.encode(p)[0] for p in parts]
    met = len(calls)
    again = [enc.encode(p)[0] for p in parts]
    assert met == 16 * 17_576 and len(calls) - met < met // 2
    assert all((a == b).all() for a, b in zip(first, again, strict=True))


def test_encoder_with_little_room():
    """Pieces of one slot, slots given up and the moving of kept ids change no id."""
    tok, rng = tokenizer(), np.random.default_rng(5)
    for bits, room in ((1, 8), (4, 256), (9, 1 << 13)):
        enc = tokens.Encoder(tokens.default_path(), bits, room)
        for _ in range(40):
            texts = [" ".join("".join(rng.choice(list("abcdeé漢 1"), 6)) for _ in range(n)) for n in rng.integers(0, 60, 5)]
            ids, at = enc.encode(tokens.pieces([t.encode() for t in texts]))
            for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
                assert ids[a:b].tolist() == tok.encode(t, add_special_tokens=False).ids
