"""Token counts by offset-mapped attribution to sections.

A text is encoded once, whole.  Every token covers a range of code points (a token
that holds part of a character's bytes covers that character); an interval join of
the token ranges with the sections -- both sorted, so one binary search per token --
gives each section its tokens.  A token that crosses a border goes by ``rule``:

* ``first``: to the section of its first code point,
* ``last``: to the section of its last one,
* ``most``: to the section that holds most of its code points (ties: the first),
* ``shared``: to all, in proportion to its code points.

Sections are the sentences of the text (up to a full stop, exclamation or question
mark and the white space after it, or up to white space with a line feed), its lines,
or the ranges in an array column (start and end in code points, sorted); the gaps
between those that hold tokens are rows with section -1.

Defined results: a null or empty text is one empty section without tokens (for
given ranges: those, without tokens); ranges are clipped to the text and to what
earlier ranges leave; a null array counts as no ranges; repeated rows give repeated
results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from plotrows.llm import text as X
from plotrows.llm import tokens as K

RULES = ("first", "last", "most", "shared")
_BLANK = [9, 10, 11, 12, 13, 32, 0xA0]
_STOPS = [ord(c) for c in ".!?"]


def token_ranges(texts: bytes, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point ranges [start, end) of tokens that hold ``widths`` bytes of the joined texts."""
    starts = (np.frombuffer(texts, np.uint8) & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(starts)])
    end = np.cumsum(widths)
    return chars[end - widths + 1] - 1 if len(end) else end, chars[end]


def cuts(cp: np.ndarray, kind: str, at: np.ndarray) -> np.ndarray:
    """Code points after which a section ends: lines, or sentences with the white space after them; texts begin at ``at``."""
    if kind == "lines" or not len(cp):
        return np.flatnonzero(cp == 10) + 1
    head = np.zeros(len(cp) + 1, bool)
    head[at] = True
    gap = np.concatenate([[False], np.isin(cp, _BLANK), [False]])
    lo = np.flatnonzero(gap[1:-1] & (~gap[:-2] | head[:-1]))
    hi = np.flatnonzero(gap[1:-1] & (~gap[2:] | head[1:])) + 1
    stop = np.isin(cp[np.maximum(lo - 1, 0)], _STOPS) & ~head[lo]
    feeds = np.concatenate([[0], np.cumsum(cp == 10)])
    return hi[stop | (feeds[hi] > feeds[lo])]


def allocate(start: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section; the sections are sorted and cover every token."""
    count, crossing = np.zeros(len(lo)), np.zeros(len(lo), np.int64)
    a = np.searchsorted(lo, start, side="right") - 1
    b = np.searchsorted(lo, end - 1, side="right") - 1
    np.add.at(count, a[a == b], 1.0)
    over = np.flatnonzero(a != b)
    a, b, start, end = a[over], b[over], start[over], end[over]
    np.add.at(crossing, a, 1)
    np.add.at(crossing, b, 1)
    for t in np.flatnonzero(b > a + 1):  # sections inside one token: at most as many as its characters
        np.add.at(crossing, [k for k in range(a[t] + 1, b[t]) if hi[k] > lo[k]], 1)
    if rule == "first":
        np.add.at(count, a, 1.0)
    elif rule == "last":
        np.add.at(count, b, 1.0)
    else:
        left, right, size = hi[a] - start, end - lo[b], end - start
        two = left + right == size
        if rule == "shared":
            np.add.at(count, a, left / size)
            np.add.at(count, b, right / size)
        else:
            np.add.at(count, np.where(left >= right, a, b)[two], 1.0)
        for t in np.flatnonzero(~two):
            held = {k: int(min(hi[k], end[t]) - max(lo[k], start[t])) for k in range(a[t], b[t] + 1)}
            if rule == "shared":
                for k in list(held)[1:-1]:
                    count[k] += held[k] / size[t]
            else:
                count[max(held, key=lambda k: (held[k], -k))] += 1
    return count, crossing


def _given(rows: pd.Series, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, number, start, end) of given ranges and, numbered -1, of the gaps between them."""
    out = []
    for j, given in enumerate(rows):
        here, size = 0, int(at[j + 1] - at[j])
        for k, r in enumerate(given if given is not None else []):
            lo, hi = max(here, min(int(r["start"]), size)), max(here, min(int(r["end"]), size))
            out += [(j, -1, here, lo)] * (lo > here) + [(j, k, lo, max(lo, hi))]
            here = max(lo, hi)
        out += [(j, -1, here, size)] * (size > here)
    doc, number, lo, hi = np.array(out, np.int64).reshape(-1, 4).T
    return doc, number, lo + at[doc], hi + at[doc]


def attribute(docs: DataFrame, rule: str = "most", sections: str = "sentences", path: str | None = None) -> DataFrame:
    """Per section: doc_id, section, start, end, n_tokens, n_crossing.

    ``sections`` is ``sentences``, ``lines`` or the name of an array column.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or K.default_path()
    own = sections in ("sentences", "lines")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = K.encoder(path)
        for f in frames:
            for first, part in X.chunks(f["text"]):
                p = K.pieces(part)
                ids, _ = enc.encode(p)
                start, end = token_ranges(b"".join(part), enc.width[ids])
                if own:
                    inner = cuts(p.cp, sections, p.at)
                    inner = inner[~np.isin(inner, p.at)]
                    lo = np.sort(np.concatenate([p.at[:-1], inner]), kind="stable")
                    head = np.searchsorted(lo, p.at[:-1], side="left") + _earlier(p.at[:-1])
                    doc = np.repeat(np.arange(len(part)), np.diff(np.append(head, len(lo))))
                    number = np.arange(len(lo)) - head[doc]
                    hi = np.append(lo[1:], p.at[-1])
                else:
                    doc, number, lo, hi = _given(f[sections].iloc[first:first + len(part)], p.at)
                count, crossing = allocate(start, end, lo, hi, rule)
                keep = (number >= 0) | (count > 0) | (crossing > 0)
                yield pd.DataFrame({
                    "doc_id": f["doc_id"].iloc[first:first + len(part)].to_numpy()[doc], "section": number, "start": lo - p.at[doc],
                    "end": hi - p.at[doc], "n_tokens": count, "n_crossing": crossing})[keep]
    cols = ["doc_id", "text"] + ([] if own else [sections])
    return docs.select(*cols).mapInPandas(run, "doc_id long, section int, start long, end long, n_tokens double, n_crossing long")


def _earlier(at: np.ndarray) -> np.ndarray:
    """How many places before each one hold the same value (of a sorted array)."""
    return np.arange(len(at)) - np.searchsorted(at, at, side="left")
