"""Small tables that every operator has to take."""

from __future__ import annotations

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def table(spark, texts, langs=None):
    """documents of (doc_id, text) pairs or texts."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    langs = langs or [None] * len(rows)
    return spark.createDataFrame([(i, t, x, "web", None) for (i, t), x in zip(rows, langs, strict=True)], SCHEMA)


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased words."""
    return WORD.findall((text or "").encode().lower())


EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "a null id"), (5, "ünï ﷽ 漢字 😀 \x00 mixed"), (6, "long words " * 40_000)]
