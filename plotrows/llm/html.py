"""HTML main text: a linear-chain CRF over a page's leaf blocks, decoded by Viterbi.

A leaf block is the text between two borders of block elements; comments, scripts,
styles and markup are no text.  Features of a block: the tags of its ancestors, the
words in their class, id and role, its own tag, the size of its text, its share of
link text, its punctuation and its place in the page.

Labelled pages are those that mark their main text themselves (``article`` or
``main``): blocks inside it are main text unless an ancestor is a navigation, footer,
aside or form or has a boilerplate word in its class.  About ``pages`` (1,500) of
them, chosen by a hash of ``page_id``, are learned from, each three times: as it is;
with the marking elements hidden, so that the other features have to carry pages
without them; and with its other blocks moved into the middle of the main text, so that
notices and adverts inside it stand out.  Weights start from, and are drawn to, priors for well-known tags and
class words.

Defined results: null or empty html, and pages without a main block, give the empty
text; a table without labelled pages is decoded by the priors; a character reference
cut short stays as it is; a tag cut short at the end of a page is no text; repeated
rows give repeated results.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotrows.llm import crf

PAGES = 1500
BUCKETS = 1 << 16
PLACES = 64  # blocks of a learning chain; longer pages give several

# Elements that break lines, elements without text of the page, and words of boilerplate.
_BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split())
_VOID = frozenset(["hr"])
_SILENT = "script|style|template|noscript|svg|iframe|textarea|select|title|object"
_AGAIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"form"}}
_BOILERPLATE = frozenset("""ad ads advert advertisement adverts banner breadcrumb breadcrumbs byline comment comments cookie cookies consent copyright
disclaimer dialog discussion disqus feedback footer form gdpr header legal login masthead menu menubar meta modal nav navbar navigation newsletter notice notices
pagination pager popup promo promotion related reply replies respond search share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe
subscription tags toolbar topbar widget widgets""".split())
_MAIN = frozenset("article body content entry main post story text".split())
_OUTSIDE = frozenset(["nav", "footer", "aside", "form", "header", "menu", "button", "label", "legend", "dialog"])

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_SILENT})(?=[\s/>]|\Z)(?:[^>]*/>|[^>]*+(?:>.*?(?:</\1\s*>|\Z)|\Z))"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-z][^>]*\Z", re.I | re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    path: str       # ancestors, outermost first: tag.word.word/...
    text: str
    linked: int     # characters inside links


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    path, parts, linked, in_link, at = "", [], 0, False, 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(path, text, linked))
        parts, linked = [], 0

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            piece = unescape(html[at:m.start()])
            parts.append(piece)
            linked += len(piece.strip()) if in_link else 0
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        end = m[2] or m[5]
        if name == "a":
            in_link = not end
        elif name == "br":
            parts.append(" ")
        elif name in _BLOCK:
            close()
            if end:
                if any(t == name for t, _ in stack):
                    while stack.pop()[0] != name:
                        pass
            else:
                if stack and stack[-1][0] == "p":
                    stack.pop()
                if name in _AGAIN:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == name:
                            del stack[i:]
                            break
                        if stack[i][0] in _AGAIN[name]:
                            break
                if name not in _VOID:
                    attributes = m[4] or m[7]
                    words = [w for _, v in _NAMES.findall(attributes) for w in _WORD.findall(v.lower())] if attributes else []
                    stack.append((name, ".".join([name, *sorted(set(words))])))
            in_link = False
            path = "/".join(p for _, p in stack)
    if at < len(html):
        parts.append(unescape(html[at:]))
    close()
    return out


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % (BUCKETS - 1) + 1


def _path_features(path: str, hidden: bool = False) -> list[int]:
    """Features of a block's ancestors; ``hidden`` leaves out the elements that mark main text."""
    steps = [s.split(".") for s in path.split("/") if s]
    if hidden:
        steps = [s for s in steps if s[0] not in ("article", "main")]
    found = {f"in:{s[0]}" for s in steps} | {f"word:{w}" for s in steps for w in s[1:]}
    found.add(f"own:{steps[-1][0] if steps else ''}")
    return sorted(_bucket(f) for f in found)


def _text_features(b: Block, place: float) -> list[int]:
    n = len(b.text)
    words = b.text.count(" ") + 1
    return [_bucket(f) for f in (
        "always", f"words:{min(int(math.log2(words)), 8)}", f"links:{math.ceil(3 * min(b.linked / n, 1.0))}",
        f"stop:{b.text[-1] in '.!?…'}", f"commas:{min(b.text.count(','), 3)}", f"place:{int(4 * place)}",
        f"mark:{any(c in b.text for c in '©®™|»·')}", f"capital:{b.text[0].isupper()}")]


def _prior() -> dict[int, float]:
    """Where the weights start."""
    # an aside inside a marked article must outweigh the marks, its text and its neighbours
    prior = {_bucket(f"in:{t}"): -12.0 for t in _OUTSIDE}
    prior |= {_bucket(f"word:{w}"): -12.0 for w in _BOILERPLATE}
    prior |= {_bucket("in:header"): -4.0, _bucket("word:header"): -4.0}
    prior |= {_bucket(f"word:{w}"): 0.7 for w in _MAIN}
    prior |= {_bucket(f"in:{t}"): 2.0 for t in ("article", "main")}
    prior |= {_bucket(f"own:{t}"): 0.7 for t in ("p", "h1", "h2", "h3", "blockquote", "pre")}
    prior |= {_bucket("links:3"): -2.0, _bucket("links:2"): -1.0, _bucket("stop:True"): 0.3, _bucket("mark:True"): -0.7, _bucket("always"): -0.5}
    return prior


def _labels(page: list[Block]) -> list[int] | None:
    """1 for main text; None if the page does not mark any."""
    marked = [bool(re.search(r"(^|/)(article|main)\b", b.path)) for b in page]
    if not any(marked):
        return None
    out = []
    for b, m in zip(page, marked, strict=True):
        # what stands outside the marking element says nothing about what stands inside
        inside = re.split(r"(?:^|/)(?:article|main)\b", b.path, maxsplit=1)[-1] if m else ""
        steps = [s.split(".") for s in inside.split("/")]
        out.append(int(m and not any(s[0] in _OUTSIDE - {"header"} or set(s[1:]) & _BOILERPLATE for s in steps)))
    return out


def _variants(page: list[Block], labels: list[int]) -> list[list[tuple[Block, str, bool, int]]]:
    """(block, path, marks hidden, label) of a page: as it is, without its marks, and with what is not main text in its middle."""
    plain = list(zip(page, labels, strict=True))
    main = [(b, b.path, False, 1) for b, y in plain if y]
    rest = [(b, f"article/{b.path}", False, 0) for b, y in plain if not y]
    k = len(main) // 2
    return [[(b, b.path, False, y) for b, y in plain], [(b, b.path, True, y) for b, y in plain], main[:k] + rest + main[k:]]


def fit(pages: DataFrame, sample: int = PAGES) -> crf.Chain:
    """Learn from the pages (page_id, html) that mark their main text."""
    total = pages.count()
    share = min(1.0, sample / total) if total else 0.0
    spot = F.pmod(F.xxhash64("page_id", F.lit("html")), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for html in f["html"]:
                page = blocks(html or "")
                labels = _labels(page)
                for variant in _variants(page, labels) if labels else ():
                    rows = [_path_features(path, hidden) + _text_features(b, i / len(page)) for i, (b, path, hidden, _) in enumerate(variant)]
                    states = [y for *_, y in variant]
                    for a in range(0, len(page), PLACES):
                        part = rows[a:a + PLACES]
                        out.append((np.concatenate(part).astype(np.int32).tobytes(), [len(r) for r in part], states[a:a + PLACES]))
            yield pd.DataFrame(out, columns=["x", "sizes", "y"])

    got = pages.where(spot < share).select("html").mapInPandas(run, "x binary, sizes array<int>, y array<int>").toPandas()
    widest = max((max(s) for s in got["sizes"]), default=1)
    x, y = np.zeros((len(got), PLACES, widest), np.int32), np.zeros((len(got), PLACES))
    n = np.array([len(s) for s in got["sizes"]], int)
    for i, (raw, sizes, states) in enumerate(zip(got["x"], got["sizes"], got["y"], strict=True)):
        flat, at = np.frombuffer(raw, np.int32), 0
        for j, k in enumerate(sizes):
            x[i, j, :k] = flat[at:at + k]
            at += k
        y[i, :len(sizes)] = states
    return crf.train(x, y, n, np.ones(len(got)), BUCKETS, mean=_prior(), rounds=40, decay=2e-4, step=0.1)


def main_text(html: str | None, chain: crf.Chain, paths: dict[str, float]) -> str:
    """The main blocks of a page joined by empty lines; ``paths`` keeps the scores of ancestors met."""
    page = blocks(html or "")
    scores = []
    for i, b in enumerate(page):
        s = paths.get(b.path)
        if s is None:
            s = paths[b.path] = float(chain.weight[_path_features(b.path)].sum())
        scores.append(s + float(chain.weight[_text_features(b, i / len(page))].sum()))
    return "\n\n".join(b.text for b, state in zip(page, crf.viterbi(chain, scores), strict=True) if state)


def extract(pages: DataFrame, chain: crf.Chain, keep: list[str]) -> DataFrame:
    """The columns ``keep``, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(chain)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths: dict[str, float] = {}
        for f in frames:
            for a in range(0, len(f), 500):
                part = f.iloc[a:a + 500]
                if len(paths) > 100_000:  # costs time only
                    paths.clear()
                texts = [main_text(h, shared.value, paths) for h in part["html"]]
                out = part[keep].reset_index(drop=True)
                out["text"], out["n_chars"] = texts, [len(t) for t in texts]
                yield out

    pages = pages.select(*dict.fromkeys([*keep, "html"]))
    fields = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep]
    return pages.mapInPandas(run, ", ".join(fields) + ", text string, n_chars long")
