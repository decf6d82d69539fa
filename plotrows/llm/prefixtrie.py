"""Prefix trie of conversations: one row per distinct sequence of first turns.

A conversation is the string of its turns' 128-bit hashes (role and text), so equal
prefixes are equal bytes.  The trie is built in four steps.

1. *Order*: conversations are range-partitioned and sorted by (string, conv_id); a
   large group of copies, or of conversations with one first turn, spans partitions.
2. *Forests*: in a partition the edges between sorted neighbours, weighted by their
   longest common prefix, are joined by union-find in descending depth.  A component
   is a run of neighbours that share a prefix; a merge of components at one depth is a
   branching node there, and lifting a component to the next merge walks its unary chain.
3. *Contraction*: only prefixes of a partition's first and last conversation can have
   members elsewhere.  They stay open: a forest goes on as these two spines, with the
   totals of all closed subtrees folded into the spine node they hang from.
4. *Boundaries*: the spines of ``FANIN`` neighbouring forests are the sorted strings of
   a next, much smaller forest, joined in the same way, until one is left and closes.
   A closed node below an open one keeps a pointer to it, which later levels resolve.

A node's members that end there are hashed in its partition if it is closed there;
else their ids travel in compressed chunks, sorted, and are hashed as a stream.

Memory: a task holds one range partition (about ``PARTITION_TURNS`` turn hashes) or
the spines of ``FANIN`` forests.  One conversation's turn hashes are one row.

Defined results: a null role or text is empty; turns are ordered by turn (null first),
then role, then hash; rows without ``conv_id`` belong to no conversation; repeated rows
are turns each; an empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotrows.session import scratch_path

WIDTH = 16                 # bytes of a turn's hash
SHARED = 100               # conversations that begin with the turns of one
HEADS = 6
FANIN = 64
PARTITION_TURNS = 400_000
CHUNK_IDS = 1 << 16
NONE = (1 << 63) - 1       # smallest member of a node without closed members
NO_IDS = hashlib.sha256(b"").hexdigest()

_NODE = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
_OWN = ["own_n", "own_low", "own_kids", "own_leaves", "own_saved"]
_FIELDS = ([("kind", "string")] + [(c, "long") for c in [*_NODE, "parent_conv_id"]] + [("ends_sha256", "string"), ("key", "binary")]
           + [(c, "long") for c in ["part", "side", "at", "to_part", "to_side", "to_at", "base"]]
           + [("seq", "binary"), ("sizes", "array<long>")] + [(c, "array<long>") for c in _OWN] + [("own_ends", "array<boolean>"), ("ids", "binary")])
SCHEMA = ", ".join(f"{n} {t}" for n, t in _FIELDS)
_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}


def rebuild(turns: DataFrame) -> DataFrame:
    """conv_id, seq (turn hashes), sizes (code points of the turns' texts).

    Conversation c begins with the first h turns of conversation c - c % 100, then its
    own turns after the first h; h is crc32 of the decimal c, modulo 6.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    code = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    own = (turns.where(F.col("conv_id").isNotNull())
           .select(F.col("conv_id").cast("long").alias("conv_id"),
                   F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), code.alias("code"), F.char_length(text).cast("long").alias("size")).alias("t"))
           .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
           .select("conv_id", F.transform("t", lambda t: F.struct(t.code.alias("code"), t.size.alias("size"))).alias("t")))
    head = own.select(F.col("conv_id").alias("head_id"), F.slice("t", 1, HEADS - 1).alias("head")).where(F.col("head_id") % SHARED == 0)
    h: Column = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    begun = F.coalesce(F.slice("head", 1, h), F.slice("t", 1, 0))
    rest = F.slice("t", h + 1, F.size("t"))
    return (own.withColumn("head_id", F.col("conv_id") - F.col("conv_id") % SHARED)
            .join(head, "head_id", "left")
            .select("conv_id", F.concat(begun, rest).alias("t"))
            .select("conv_id", F.unhex(F.array_join(F.transform("t", lambda t: t.code), "")).alias("seq"), F.transform("t", lambda t: t.size).alias("sizes")))


class Own:
    """What a node has of its own: closed children's totals and members that end here."""

    __slots__ = ("ends", "kids", "leaves", "low", "n", "saved", "sources")

    def __init__(self, n: int = 0, low: int = NONE, kids: int = 0, leaves: int = 0, saved: int = 0, ends: bool = False, sources: Iterable[tuple[int, int, int]] = ()):
        self.n, self.low, self.kids, self.leaves, self.saved, self.ends, self.sources = n, low, kids, leaves, saved, ends, list(sources)

    def add(self, o: Own) -> None:
        self.n += o.n
        self.low = min(self.low, o.low)
        self.kids += o.kids
        self.leaves += o.leaves
        self.saved += o.saved
        self.ends |= o.ends
        self.sources += o.sources


class Item:
    """A sorted string of a forest: a conversation's, or a spine with its open nodes' own totals by depth."""

    __slots__ = ("own", "seq", "sizes")

    def __init__(self, seq: bytes, sizes: list[int], own: dict[int, Own]):
        self.seq, self.sizes, self.own = seq, sizes, own

    @property
    def depth(self) -> int:
        return len(self.seq) // WIDTH


def common(a: bytes, b: bytes) -> int:
    """Turns of the longest common prefix."""
    d = 0
    while (x := a[d:d + WIDTH]) and x == b[d:d + WIDTH]:
        d += WIDTH
    return d // WIDTH


class Forest:
    """The trie over sorted items; ``part`` None closes every node, else those on the outer spines stay open."""

    def __init__(self, items: list[Item], part: int | None):
        self.items, self.part = items, part
        self.nodes: list[list] = []                   # _NODE values, parent_conv_id, item that ends here or None, pointer
        self.spines: tuple[dict[int, Own], ...] = ({}, {})
        self.resolved: list[tuple] = []               # source pointer, conv_id, target pointer
        self.ended: list[tuple[int, int]] = []        # (item, depth) of open nodes where members end
        self._root = list(range(len(items)))
        self._last = list(range(len(items)))
        self._depth = [i.depth for i in items]
        self._rest = [i.own for i in items]
        self._acc: list[Own] = [i.own.pop(i.depth, None) or Own() for i in items]
        self._below: list[list[int]] = [[] for _ in items]   # closed children waiting for their parent's id
        lcp = [0] + [common(a.seq, b.seq) for a, b in zip(items, items[1:], strict=False)]
        for i in sorted(range(1, len(items)), key=lambda i: -lcp[i]):  # stable: from left to right at one depth
            self._merge(self._find(i - 1), i, lcp[i])
        if items:
            self._lift(0, 0)
            self._finish(0)

    def _find(self, i: int) -> int:
        root = self._root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def _merge(self, a: int, b: int, depth: int) -> None:
        """Components a and b (to its right) share a node at ``depth``."""
        self._lift(a, depth)
        self._lift(b, depth)
        self._acc[a].add(self._acc[b])
        self._below[a] += self._below[b]
        rest, more = self._rest[a], self._rest[b]
        if len(more) > len(rest):
            rest, more = more, rest
        for d, o in more.items():
            if d in rest:
                rest[d].add(o)
            else:
                rest[d] = o
        self._rest[a], self._root[b], self._last[a] = rest, a, self._last[b]

    def _lift(self, c: int, depth: int) -> None:
        while self._depth[c] > depth:
            up = self._finish(c)
            self._depth[c] -= 1
            if own := self._rest[c].pop(self._depth[c], None):
                up.add(own)
            self._acc[c] = up

    def _finish(self, c: int) -> Own:
        """Complete the component's node; returns what its parent has from it."""
        acc, depth = self._acc[c], self._depth[c]
        below, self._below[c] = self._below[c], []
        side = None if self.part is None else 0 if c == 0 else 1 if self._last[c] == len(self.items) - 1 else None
        if side is not None:
            here = (self.part, side, depth)
            for row in below:
                self.nodes[row][-1] = here
            self.resolved += [(s, None, here) for s in acc.sources]
            acc.sources = []
            self.spines[side][depth] = acc
            if acc.ends:
                self.ended.append((c, depth))
            return Own()
        saved = acc.saved + ((acc.n - 1) * self.items[c].sizes[depth - 1] if depth else 0)
        leaves = acc.leaves if acc.kids else 1
        for row in below:
            self.nodes[row][6] = acc.low
        self.resolved += [(s, acc.low, None) for s in acc.sources]
        self._below[c] = [len(self.nodes)]
        self.nodes.append([acc.low, depth, acc.n, acc.kids, leaves, saved, None, c if acc.ends else None, None])
        return Own(acc.n, acc.low, 1, leaves, saved)


def _batch(kind: str, n: int, **columns: list) -> pa.RecordBatch:
    arrays = [pa.array([kind] * n if c == "kind" else columns[c], _ARROW[t]) if c == "kind" or c in columns else pa.nulls(n, _ARROW[t]) for c, t in _FIELDS]
    return pa.RecordBatch.from_arrays(arrays, [c for c, _ in _FIELDS])


def _pointers(names: tuple[str, str, str], at: list[tuple[int, int, int] | None]) -> dict[str, list]:
    return {c: [p and p[i] for p in at] for i, c in enumerate(names)}


def _key(seq: bytes, depth: int) -> bytes:
    return hashlib.md5(seq[:depth * WIDTH]).digest()


def _forest_rows(f: Forest, sha: list[str | None], key: list[bytes | None]) -> Iterator[pa.RecordBatch]:
    if f.nodes:
        columns = list(zip(*f.nodes, strict=True))
        yield _batch("node", len(f.nodes), **dict(zip([*_NODE, "parent_conv_id"], columns, strict=False)), ends_sha256=sha, key=key, **_pointers(("part", "side", "at"), columns[-1]))
    if f.resolved:
        source, found, target = zip(*f.resolved, strict=True)
        yield _batch("map", len(source), conv_id=found, **_pointers(("part", "side", "at"), source), **_pointers(("to_part", "to_side", "to_at"), target))
    for side, item in ((0, f.items[0]), (1, f.items[-1])) if f.part is not None else ():
        if spine := f.spines[side]:
            own = [spine[d] for d in sorted(spine)]
            yield _batch("spine", 1, part=[f.part], side=[side], base=[min(spine)], seq=[item.seq], sizes=[item.sizes], own_n=[[o.n for o in own]], own_low=[[o.low for o in own]],
                         own_kids=[[o.kids for o in own]], own_leaves=[[o.leaves for o in own]], own_saved=[[o.saved for o in own]], own_ends=[[o.ends for o in own]])


def _decimal(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def _sorted_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition's forest: closed nodes, its two spines, ids that end at open nodes."""
    items: list[Item] = []
    ids: list[list[int]] = []
    for b in batches:
        for seq, conv_id, sizes in zip(b["seq"].to_pylist(), b["conv_id"].to_pylist(), b["sizes"], strict=True):
            if not items or items[-1].seq != seq:
                items.append(Item(seq, sizes.as_py(), {}))
                ids.append([])
            ids[-1].append(conv_id)
    if not items:
        return
    for item, own in zip(items, ids, strict=True):
        item.own[item.depth] = Own(len(own), own[0], ends=True)
    f = Forest(items, TaskContext.get().partitionId())
    sha = [NO_IDS if n[7] is None else hashlib.sha256(_decimal(np.array(ids[n[7]]))).hexdigest() for n in f.nodes]
    yield from _forest_rows(f, sha, [None] * len(f.nodes))
    for i, depth in f.ended:
        own = np.array(ids[i], np.int64)
        parts = [own[a:a + CHUNK_IDS] for a in range(0, len(own), CHUNK_IDS)]
        yield _batch("ends", len(parts), key=[_key(items[i].seq, depth)] * len(parts), conv_id=[int(p[0]) for p in parts],
                     ids=[pa.compress(np.diff(p, prepend=np.int64(0)).tobytes(), codec="zstd", asbytes=True) for p in parts], n_convs=[len(p) for p in parts])


def _joined(last: bool):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        """The forest of neighbouring forests' spines."""
        items = []
        for r in t.sort_by([("part", "ascending"), ("side", "ascending")]).to_pylist():
            own = {r["base"] + j: Own(*v, sources=[(r["part"], r["side"], r["base"] + j)]) for j, v in enumerate(zip(*(r[c] for c in _OWN), r["own_ends"], strict=True))}
            items.append(Item(r["seq"], r["sizes"], own))
        f = Forest(items, None if last else key[0].as_py())
        keys = [None if n[7] is None else _key(items[n[7]].seq, n[1]) for n in f.nodes]
        return pa.Table.from_batches(_forest_rows(f, [None if k else NO_IDS for k in keys], keys), schema=_batch("node", 0).schema)
    return run


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of every key, from chunks in order."""
    now, digest = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_found"])
    for b in batches:
        for key, raw, n in zip(b["key"].to_pylist(), b["ids"].to_pylist(), b["n_convs"].to_pylist(), strict=True):
            text = _decimal(np.cumsum(np.frombuffer(pa.decompress(raw, decompressed_size=8 * n, codec="zstd", asbytes=True), np.int64)))
            if key != now:
                if digest:
                    yield out()
                now, digest = key, hashlib.sha256(text)
            else:
                digest.update(b"," + text)
    if digest:
        yield out()


def trie(turns: DataFrame, fanin: int = FANIN, partition_turns: int = PARTITION_TURNS) -> DataFrame:
    """One row per node of the rebuilt conversations' trie (see the module's docstring)."""
    spark = turns.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    convs = stored(rebuild(turns), "trie-conversations")
    total = convs.agg(F.sum(F.size("sizes") + 1).alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // partition_turns))
    ordered = convs.repartitionByRange(parts, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    rows = stored(ordered.mapInArrow(_sorted_partition, SCHEMA), "trie-forests")
    ends = (rows.where(F.col("kind") == "ends").select("key", "conv_id", "ids", "n_convs").repartition("key").sortWithinPartitions("key", "conv_id")
            .mapInArrow(_streamed, "key binary, ends_found string"))
    columns = [*_NODE, "parent_conv_id", "ends_sha256", "key", "part", "side", "at"]
    here = ["part", "side", "at"]
    nodes = lambda rows: rows.where(F.col("kind") == "node").select(*columns)
    pending = nodes(rows).where(F.col("part").isNotNull())
    done = [nodes(rows).where(F.col("part").isNull())]
    parts = 1 + (rows.where(F.col("kind") == "spine").agg(F.max("part").alias("n")).first()["n"] or 0)
    while True:
        last = parts <= fanin
        joined = rows.where(F.col("kind") == "spine").groupBy(F.floor(F.col("part") / fanin).alias("group")).applyInArrow(_joined(last), SCHEMA)
        rows = stored(joined, "trie-forests")
        maps = rows.where(F.col("kind") == "map").select(*here, F.col("conv_id").alias("found"), "to_part", "to_side", "to_at")
        met = pending.join(maps, here).withColumn("parent_conv_id", F.col("found"))
        done += [met.where(F.col("found").isNotNull()).select(*columns), nodes(rows).where(F.col("part").isNull())]
        if last:
            break
        met = met.where(F.col("found").isNull()).withColumns({c: F.col(f"to_{c}") for c in here}).select(*columns)
        pending = met.unionByName(nodes(rows).where(F.col("part").isNotNull()))
        parts = -(-parts // fanin)
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    keyed = every.where(F.col("key").isNotNull()).join(ends, "key", "left").withColumn("ends_sha256", F.col("ends_found"))
    return every.where(F.col("key").isNull()).select(*out).unionByName(keyed.select(*out))
