"""LM scoring: an interpolated Kneser-Ney trigram model in Elias-Fano tries, spread over shards.

Tokens are the words of a text (A-Z lower-cased) and one end.  A token's probability is

    p(w | u, v) = A(u, v, w) + G(u, v) * p1(w),   p1(w) = (c + 0.5) / (N + 0.5 (V + 1))

with A and G from the trie of the shard that the middle word v falls into (``trie.py``),
and c, N and V counted over all training tokens.  Nothing is sampled, pruned or capped.

1. *Chunks*: texts become rows of a few megabytes -- the sorted vocabulary's hashes and
   the token numbers -- in a table bucketed by chunk, so that later steps meet a chunk
   without moving it.
2. *Words*: each chunk's word counts go to the shard of the word's hash; the shard adds
   them up and answers every chunk with the sums.
3. *Trigrams*: each chunk's distinct trigrams (with their training counts) go to the
   shard of their middle word.  The shard builds its trie from those that occur in
   training and answers every chunk with one byte each for A and G.
4. Each chunk adds the logarithms up per text.

A middle word that occurs more than ``HOT`` times is split by a hash class of the word
before it, in classes of about ``HOT`` occurrences, so that no shard grows with one word.
A context lies in one class; the pairs (v, w) do not, so before the tries are built each
class sends its number of words before every pair to the *part* of the pair's last word
and gets the sums over all classes back, with the totals of the middle word: the split
does not change a score.  A part serves about ``PART_CLASSES`` classes.  (A context (u, v)
is never split: its class grows with its distinct trigrams.)  32 bits tell the words of
one root apart: another one is taken for it with a probability of its distinct successors
in 2^32, about 1e-4 for 500,000.  Shards hold about ``SHARD_TOKENS`` tokens.

Defined results: a null or empty text is the end alone; a null ``learn`` is false; without
training tokens every token has p1 = 1; repeated rows count and are scored each; other
columns do not matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotrows.llm import text as X
from plotrows.llm import trie as T
from plotrows.session import scratch_path

CHUNK_TOKENS = 1_200_000
SHARD_TOKENS = 1_000_000
HOT = 500_000
PART_CLASSES = 8
START, END = (int(X.mix(np.array([k]))[0]) for k in (0x5354415254, 0x454E44))
_CUT = np.uint64(64 - T.WORD_BITS)
_BLOCK = 400_000  # queries looked up at once


def _squeeze(x: np.ndarray, width: int | None = None) -> bytes:
    """Compressed planes of an array's low ``width`` bytes."""
    raw = x.view(np.uint8).reshape(len(x), x.itemsize)[:, :width].T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _expand(data: bytes, kind: type, width: int | None = None) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    out = np.zeros((n, size), np.uint8)
    raw = pa.decompress(memoryview(data)[8:], decompressed_size=n * (width or size), codec="zstd", asbytes=True)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width or size, n).T
    return out.view(kind).ravel()


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash."""
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of about ``CHUNK_TOKENS`` tokens, made of whole texts."""
    task, made, waiting = TaskContext.get().partitionId(), 0, []

    def row() -> pd.DataFrame:
        ids, learn, sizes, h = (np.concatenate(x) for x in zip(*waiting, strict=True))
        vocab, tokens = np.unique(np.append(h, [np.uint64(START), np.uint64(END)]), return_inverse=True)
        return pd.DataFrame({
            "chunk": [(task << 32) + made], "doc_ids": [[None if x is pd.NA else x for x in ids]], "learn": [learn.tolist()], "sizes": [sizes],
            "n": [len(h)], "n_learn": [int(sizes[learn].sum())],
            "vocab": [_squeeze(np.diff(vocab, prepend=np.uint64(0)))], "ids": [_squeeze(tokens[:-2].astype(np.uint32))]})

    for f in frames:
        ids, learn = f["doc_id"].astype("Int64").to_numpy(object), f["learn"].to_numpy(bool)
        for first, part in X.chunks(f["text"]):
            w = X.words(part)
            at = w.offset + np.arange(len(w.offset))  # with an end after every text
            h = np.full(at[-1], np.uint64(END))
            h[np.arange(len(w.hash)) + np.repeat(np.arange(len(part)), np.diff(w.offset))] = w.hash
            here = slice(first, first + len(part))
            waiting.append((ids[here], learn[here], np.diff(at), h))
            if sum(len(x[3]) for x in waiting) >= CHUNK_TOKENS:
                yield row()
                made, waiting = made + 1, []
    if waiting:
        yield row()


class _Chunk:
    """A chunk's tokens and distinct trigrams (numbers in its sorted vocabulary)."""

    def __init__(self, row: pd.Series) -> None:
        self.doc_ids, self.sizes = row["doc_ids"], np.asarray(row["sizes"], np.int64)
        self.vocab = np.cumsum(_expand(row["vocab"], np.uint64), dtype=np.uint64)
        self.ids = _expand(row["ids"], np.uint32).astype(np.int64)
        self.learn = np.repeat(np.asarray(row["learn"], bool), self.sizes)

    def trigrams(self) -> None:
        """Sets before, root, word and count of the distinct trigrams and, per token, its trigram."""
        v = len(self.vocab)
        begin = np.cumsum(self.sizes) - self.sizes
        start = int(np.searchsorted(self.vocab, np.uint64(START)))
        root = np.concatenate([[start], self.ids[:-1]])
        root[begin] = start
        before = np.concatenate([[start], root[:-1]])
        before[begin] = start
        contexts, c = np.unique(root * v + before, return_inverse=True)
        keys, self.at = np.unique(c * v + self.ids, return_inverse=True)
        c, self.word = np.divmod(keys, v)
        self.root, self.before = np.divmod(contexts[c], v)
        self.count = np.bincount(self.at, self.learn, len(keys)).astype(np.uint32)

    def places(self, total: np.ndarray, shards: int, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(root key of each trigram, their order by shard, first place of each shard, root's classes); ``total``: occurrences of each word."""
        key = self.vocab[self.root]
        split = -(-total[self.root] // hot)
        i = np.flatnonzero(split > 1)
        kind = X.mix(self.vocab[self.before[i]] ^ np.uint64(START)) % split[i].astype(np.uint64)
        key[i] = X.mix(key[i] + kind * np.uint64(END | 1))
        shard = _shard(key, shards)
        order = np.argsort(shard, kind="stable")
        return key[order], order, np.searchsorted(shard[order], np.arange(shards + 1)), np.maximum(split, 1)[order]


def _word_packets(shards: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, row in f.iterrows():
                c = _Chunk(row)
                seen = np.bincount(c.ids, minlength=len(c.vocab)).astype(np.uint32)
                taught = np.bincount(c.ids, c.learn, len(c.vocab)).astype(np.uint32)
                start = int(np.searchsorted(c.vocab, np.uint64(START)))
                seen[start] = len(c.sizes)  # a context, once per text; never a token
                edge = np.searchsorted(_shard(c.vocab, shards), np.arange(shards + 1))
                out = [(s, row["chunk"], _squeeze(np.diff(c.vocab[a:b], prepend=np.uint64(0))), _squeeze(seen[a:b]), _squeeze(taught[a:b]))
                       for s, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if a < b]
                yield pd.DataFrame(out, columns=["shard", "chunk", "words", "seen", "taught"])
    return run


def _by_shard(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list]]:
    """(shard, its rows) of frames sorted by shard."""
    now, rows = None, []
    for f in frames:
        for row in f.itertuples(index=False):
            if rows and row.shard != now:
                yield now, rows
                rows = []
            now = row.shard
            rows.append(row)
    if rows:
        yield now, rows


def _add_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Answers every chunk's packet with the sums; the shard's first row has its number of training words."""
    for shard, rows in _by_shard(frames):
        words = [np.cumsum(_expand(r.words, np.uint64), dtype=np.uint64) for r in rows]
        known, back = np.unique(np.concatenate(words), return_inverse=True)
        sums = [np.bincount(back, np.concatenate([_expand(x, np.uint32) for x in part]), len(known))[back].astype(np.uint64)
                for part in ([r.seen for r in rows], [r.taught for r in rows])]
        v = len(np.unique(back[sums[1] > 0]))
        edge = np.cumsum([0] + [len(w) for w in words])
        yield pd.DataFrame({
            "chunk": [r.chunk for r in rows], "shard": shard, "v": [v] + [0] * (len(rows) - 1),
            "one": [_squeeze(sums[0][a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)],
            "two": [_squeeze(sums[1][a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]})


def _joined(answers: pd.DataFrame, kind: type) -> tuple[np.ndarray, np.ndarray]:
    rows = answers.sort_values("shard")
    return tuple(np.concatenate([np.zeros(0, kind), *(_expand(x, kind) for x in rows[c])]) for c in ("one", "two"))


def _runs(x: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """First places of the runs of equal values."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    if other is not None:
        new[1:] |= other[1:] != other[:-1]
    return np.flatnonzero(new)


def _trigram_packets(shards: int, hot: int):
    def run(chunks: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in chunks.iterrows():
            c = _Chunk(row)
            c.trigrams()
            key, order, edge, split = c.places(_joined(words, np.uint64)[0].astype(np.int64), shards, hot)
            before, word = c.vocab[c.before[order]] >> _CUT, c.vocab[c.word[order]] >> _CUT
            count, middle, split = c.count[order], c.vocab[c.root[order]], split.astype(np.uint32)
            for s in np.flatnonzero(np.diff(edge)):
                k, b = key[edge[s]:edge[s + 1]], before[edge[s]:edge[s + 1]]
                context = _runs(k, b)
                root = _runs(k[context])
                first = edge[s] + context[root]
                hot_root = first[split[first] > 1]
                out.append((s, row["chunk"], _squeeze(split[first]) if len(hot_root) else None, _squeeze(middle[hot_root]) if len(hot_root) else None,
                            _squeeze(k[context[root]]), _squeeze(np.diff(root, append=len(context)).astype(np.uint32)),
                            _squeeze(b[context], T.WORD_BITS // 8), _squeeze(np.diff(context, append=len(k)).astype(np.uint32)),
                            _squeeze(word[edge[s]:edge[s + 1]], T.WORD_BITS // 8), _squeeze(count[edge[s]:edge[s + 1]])))
        return pd.DataFrame(out, columns=["shard", "chunk", "classes", "middle", *_PACKET])
    return run


_PACKET = ["root", "contexts", "before", "words", "word", "count"]


def _unpacked(rows: list) -> tuple[np.ndarray, ...]:
    """(root, contexts per root, before, words per context, word, count) of a shard's packets."""
    kinds = [(np.uint64, None), (np.uint32, None), (np.uint64, T.WORD_BITS // 8), (np.uint32, None), (np.uint64, T.WORD_BITS // 8), (np.uint32, None)]
    return tuple(np.concatenate([_expand(getattr(r, c), *k) for r in rows]) for c, k in zip(_PACKET, kinds, strict=True))


def _merged(root: np.ndarray, contexts: np.ndarray, before: np.ndarray, words: np.ndarray, word: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """(roots, contexts, pairs, distinct trigrams as context * pairs + pair, number of each packet's, training counts) of unpacked packets."""
    shift = np.uint64(T.WORD_BITS)
    roots, r = np.unique(root, return_inverse=True)
    r = np.repeat(r, contexts).astype(np.uint64)
    context, b = np.unique((r << shift) | before, return_inverse=True)
    r, b = np.repeat(r, words), np.repeat(b, words)
    pair, a = np.unique((r << shift) | word, return_inverse=True)
    trigram, back = np.unique(b * len(pair) + a, return_inverse=True)
    return roots, context, pair, trigram, back, np.bincount(back, count, len(trigram))


def _split_roots(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(root, middle word, parts of its pairs) of the split roots of packets that have some."""
    found = [np.zeros((3, 0), np.uint64)]
    for r in rows:
        classes = _expand(r.classes, np.uint32)
        hot = classes > 1
        found.append(np.stack([_expand(r.root, np.uint64)[hot], _expand(r.middle, np.uint64), -(-classes[hot].astype(np.int64) // PART_CLASSES).astype(np.uint64)]))
    root, middle, parts = np.concatenate(found, axis=1)
    root, first = np.unique(root, return_index=True)
    return root, middle[first], parts[first].astype(np.int64)


def _by_part(pair: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the split roots' pairs by root, part and word; their parts); ``parts`` of each root, 0 if it is not split."""
    of = parts[(pair >> np.uint64(T.WORD_BITS)).astype(np.int64)]
    i = np.flatnonzero(of)
    part = (X.mix(pair[i] & np.uint64((1 << T.WORD_BITS) - 1)) % of[i].astype(np.uint64)).astype(np.int64)
    order = np.lexsort((part, pair[i] >> np.uint64(T.WORD_BITS)))
    return i[order], part[order]


def _pair_packets(shards: int):
    """Each class's pairs, with the number of training words before each, to the shard of their part."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard, rows in _by_shard(f[f["classes"].notna()] for f in frames):
            known, middle, parts = _split_roots(rows)
            root, contexts, before, words, word, count = _unpacked(rows)
            hot = np.isin(root, known)
            inner = np.repeat(hot, contexts)
            last = np.repeat(inner, words)
            _, _, pair, trigram, _, total = _merged(root[hot], contexts[hot], before[inner], words[inner], word[last], count[last])
            spread = np.bincount(trigram[total > 0] % max(len(pair), 1), minlength=len(pair)).astype(np.uint32)
            place, part = _by_part(pair, parts)
            base = np.cumsum(parts) - parts  # a packet for each part of each root, even without pairs
            number = base[(pair[place] >> np.uint64(T.WORD_BITS)).astype(np.int64)] + part
            edge = np.searchsorted(number, np.arange(parts.sum() + 1))
            word, spread = pair[place] & np.uint64((1 << T.WORD_BITS) - 1), spread[place]
            of = np.repeat(np.arange(len(known)), parts)
            part = np.arange(len(of)) - base[of]
            owner = _shard(X.mix(middle[of] + part.astype(np.uint64) * np.uint64(START | 1)), shards)
            yield pd.DataFrame({
                "owner": owner.astype(np.int32), "shard": shard, "root": known[of].view(np.int64), "middle": middle[of].view(np.int64), "part": part,
                "word": [_squeeze(np.diff(word[i:j], prepend=np.uint64(0)), T.WORD_BITS // 8) for i, j in zip(edge[:-1], edge[1:], strict=True)],
                "spread": [_squeeze(spread[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)]})
    return run


def _add_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Answers every class with the sums over all classes: of each of its pairs, and the part's total and number of pairs met in training."""
    for _, rows in _by_shard(f.rename(columns={"owner": "shard", "shard": "back"}) for f in frames):
        groups = pd.DataFrame({"middle": [r.middle for r in rows], "part": [r.part for r in rows]})
        group = groups.groupby(["middle", "part"]).ngroup().to_numpy(np.int64)
        words = [np.cumsum(_expand(r.word, np.uint64, T.WORD_BITS // 8), dtype=np.uint64) for r in rows]
        sizes = np.array([len(w) for w in words])
        pair, back = np.unique((np.repeat(group, sizes).astype(np.uint64) << np.uint64(T.WORD_BITS)) | np.concatenate(words), return_inverse=True)
        sums = np.bincount(back, np.concatenate([_expand(r.spread, np.uint32) for r in rows]), len(pair))
        of = (pair >> np.uint64(T.WORD_BITS)).astype(np.int64)
        total, kinds = np.bincount(of, sums, group.max() + 1), np.bincount(of, sums > 0, group.max() + 1)
        sums, edge = sums[back].astype(np.uint32), np.cumsum([0, *sizes])
        yield pd.DataFrame({
            "shard": [r.back for r in rows], "root": [r.root for r in rows], "part": [r.part for r in rows],
            "total": total[group].astype(np.int64), "kinds": kinds[group].astype(np.int64),
            "spread": [_squeeze(sums[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)]})


def _elsewhere(pair: np.ndarray, roots: np.ndarray, rows: list, sums: pd.DataFrame) -> T.Shared | None:
    """The pair level of the split roots over all of their classes."""
    known, _, parts = _split_roots([r for r in rows if r.classes is not None])
    if not len(known):
        return None
    number = np.searchsorted(roots, known)
    parts_of = np.zeros(len(roots), np.int64)
    parts_of[number] = parts
    sums = sums.assign(at=np.searchsorted(roots, sums["root"].to_numpy(np.int64).view(np.uint64))).sort_values(["at", "part"])
    if len(sums) != parts.sum():
        raise RuntimeError("pair sums of a class are missing")
    total, kinds = (np.bincount(sums["at"], sums[c], len(roots))[number] for c in ("total", "kinds"))
    place, _ = _by_part(pair, parts_of)
    spread = np.concatenate([_expand(x, np.uint32) for x in sums["spread"]])
    met = spread > 0
    of = pair[place[met]]
    return T.Shared(known[total > 0], total[total > 0], kinds[total > 0], roots[(of >> np.uint64(T.WORD_BITS)).astype(np.int64)],
                    of & np.uint64((1 << T.WORD_BITS) - 1), spread[met])


def _answer(packets: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
    """Builds a shard's trie from its training trigrams and the sums of split words' pairs; answers all of its packets."""
    shift = np.uint64(T.WORD_BITS)
    out = []
    for shard, rows in _by_shard([packets]):
        sizes = [int.from_bytes(r.word[:8], "little") for r in rows]
        roots, context, pair, trigram, back, total = _merged(*_unpacked(rows))
        b, a = np.divmod(trigram, len(pair))
        low = (np.uint64(1) << shift) - np.uint64(1)
        taught = np.flatnonzero(total)
        model = T.Trie(T.pack(roots[(pair[a[taught]] >> shift).astype(np.int64)], context[b[taught]] & low, pair[a[taught]] & low, total[taught],
                              shared=_elsewhere(pair, roots, rows, sums)))
        rank = model.find_root(roots)
        found = [np.concatenate([np.zeros(0, np.int64), *(
            look(rank[(x[i:i + _BLOCK] >> shift).astype(np.int64)], x[i:i + _BLOCK] & low) for i in range(0, len(x), _BLOCK))])
            for x, look in ((context, model.find_context), (pair, model.find_pair))]
        one, two = np.zeros(len(trigram), np.uint8), np.zeros(len(trigram), np.uint8)
        for i in range(0, len(trigram), _BLOCK):
            s = slice(i, i + _BLOCK)
            own, rest = model.probabilities(rank[(pair[a[s]] >> shift).astype(np.int64)], found[0][b[s]], found[1][a[s]])
            one[s], two[s] = T.quantise(own), T.quantise(rest)
        one, two = one[back], two[back]
        edge = np.cumsum([0, *sizes])
        out.append(pd.DataFrame({
            "chunk": [x.chunk for x in rows], "shard": shard,
            "one": [_squeeze(one[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)],
            "two": [_squeeze(two[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)]}))
    return pd.concat(out) if out else pd.DataFrame(columns=["chunk", "shard", "one", "two"])


def _total(shards: int, hot: int, n: int, v: int):
    def run(chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in chunks.iterrows():
            c = _Chunk(row)
            c.trigrams()
            seen, taught = _joined(answers[answers["kind"] == 1], np.uint64)
            _, order, _, _ = c.places(seen.astype(np.int64), shards, hot)
            own, rest = _joined(answers[answers["kind"] == 3], np.uint8)
            base = (taught + 0.5) / (n + 0.5 * (v + 1))
            p = np.zeros(len(order))
            p[order] = T.VALUES[own] + T.VALUES[rest] * base[c.word[order]]
            begin = np.cumsum(c.sizes) - c.sizes
            out.append(pd.DataFrame({
                "doc_id": pd.array(c.doc_ids, "Int64"), "learn": [bool(x) for x in row["learn"]], "n_tokens": c.sizes,
                "n_known": np.add.reduceat((taught[c.ids] > 0).astype(np.int64), begin), "train_tokens": n,
                "base_score": np.add.reduceat(np.log10(base)[c.ids], begin),
                "score": np.add.reduceat(np.log10(np.minimum(p, 1.0))[c.at], begin)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "learn", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def _chunk_table(spark: SparkSession, docs: DataFrame, learn: Column) -> DataFrame:
    """Encoded chunks in the shared folder, bucketed by chunk."""
    name = f"lm_chunks_{uuid.uuid4().hex}"
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    (docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))
     .mapInPandas(_encode, "chunk long, doc_ids array<long>, learn array<boolean>, sizes array<long>, n long, n_learn long, vocab binary, ids binary")
     .write.format("parquet").option("path", scratch_path(spark, "lm-chunks")).option("compression", "none")
     .bucketBy(buckets, "chunk").saveAsTable(name))
    return spark.table(name)


def score(docs: DataFrame, learn: Column, shard_tokens: int = SHARD_TOKENS, hot: int = HOT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, learn, n_tokens, n_known, train_tokens, base_score, score (log10).

    The model learns from the rows where ``learn`` holds.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = _chunk_table(spark, docs, learn)
    sums = chunks.agg(F.sum("n").alias("n"), F.sum("n_learn").alias("learn")).first()
    shards = max(parts, -(-(sums["n"] or 0) // shard_tokens))
    n = sums["learn"] or 0

    where = scratch_path(spark, "lm-words")
    (chunks.mapInPandas(_word_packets(shards), "shard int, chunk long, words binary, seen binary, taught binary")
     .repartition(shards, "shard").sortWithinPartitions("shard", "chunk")
     .mapInPandas(_add_words, "chunk long, shard int, v long, one binary, two binary").write.parquet(where))
    words = spark.read.parquet(where)
    v = words.agg(F.sum("v").alias("v")).first()["v"] or 0

    types = "shard int, chunk long, classes binary, middle binary, " + ", ".join(f"{c} binary" for c in _PACKET)
    packets = (chunks.groupBy("chunk").cogroup(words.select("chunk", "shard", "one", "two").groupBy("chunk"))
               .applyInPandas(_trigram_packets(shards, hot), types))
    packets = packets.repartition(shards, "shard")  # read twice, shuffled once: the plans are the same
    sums = (packets.sortWithinPartitions("shard")
            .mapInPandas(_pair_packets(shards), "owner int, shard int, root long, middle long, part int, word binary, spread binary")
            .repartition(shards, "owner").sortWithinPartitions("owner")
            .mapInPandas(_add_pairs, "shard int, root long, part int, total long, kinds long, spread binary"))
    codes = (packets.groupBy("shard").cogroup(sums.groupBy("shard"))
             .applyInPandas(_answer, "chunk long, shard int, one binary, two binary"))
    answers = (words.select("chunk", "shard", "one", "two", F.lit(1).alias("kind"))
               .union(codes.select("chunk", "shard", "one", "two", F.lit(3).alias("kind"))))
    return (chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
            .applyInPandas(_total(shards, hot, n, v), "doc_id long, learn boolean, n_tokens long, n_known long, train_tokens long, "
                                                     "base_score double, score double"))
