"""MinHash near-dedup by bottom-k sketches from one hash function.

A document's set holds the distinct ``words``-word shingles (64-bit hashes); its
sketch is the ``SKETCH`` (96) smallest of them -- the whole set if it is no larger
than twice that.  Two documents are linked if the Jaccard similarity of their sets reaches
``percent`` / 100, always decided on the full sets.

1. *Classes*: documents with equal sets are one class; only one document of it goes on,
   under a number of the class.
2. *Inverted lists* of retained values.  Linked documents share at least t values
   of their sketches (exactly known when the sketches are whole sets, else all but
   certain: the binomial tail is below 1e-9), so they share one among the
   m - t + 1 rarest values of either.  Lists hold those only, which keeps common
   lines and passages out of them without dropping a link.
3. *Stars*: in every list each document is compared with one leader of its size,
   first the one with the fewest values of its own; links contract components.  A few
   rounds with other leaders shrink large groups of copies at linear cost.
4. *The rest*: pairs from different components in a common list are compared unless
   the value's ranks exclude a link: whole sets of a and b values need a common part of
   o = percent (a + b) / (100 + percent), and the first common value, by rarity, has at
   least o - 1 values behind it in both; truncated sketches likewise, with a bound from
   the binomial tail for their sizes' ratio.  Pairs inside a component need no comparison.
   What is left in groups of edited copies is told apart inside the join by *parities* of
   the full sets: every value flips one bit of 2n or more, so two sets differ in at least
   as many values as their parities in bits, and linked ones in a + b - 2 o at most.  No
   link is excluded, and the join lists few pairs but those that are (almost) links.

Comparing: the union's bottom-k estimates the similarity; pairs far below the
threshold go, pairs of whole sets are decided at once, all others are verified on
the shingles of their whole texts.  Components are found by repeated contraction
in Spark; no link, component or sketch goes to the driver.

Defined results: null and wordless texts have empty sets, are linked with nothing
and are kept; rows with one ``doc_id`` are documents each, with the component of their own
text; rows without ``doc_id`` are linked like others, and a component of such rows alone
has a null ``component_id``.
"""

from __future__ import annotations

import gc
import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotrows.llm import text as X
from plotrows.session import reliable_checkpoint, scratch_path

SKETCH = 96
PERCENT = 80
STAR_ROUNDS = 1
CHUNK_BYTES = 1 << 19
LOW_WORDS = 16              # of 64 bits: the least parity, and the fold that is compared first
PARITY_BITS = 1 << 15       # at most; larger sets share bits, which excludes fewer pairs
NO_ID = -(1 << 63)          # stands for a null id


def shared_values(size: int = SKETCH, percent: int = PERCENT, ratio: float | None = None, risk: float = 1e-9) -> int:
    """Values that two truncated sketches of linked documents share, but for ``risk``.

    Their sets hold at least ``ratio`` (``percent`` / 100 or more) times as many values
    as each other.  The larger set then has a share p = percent (1 + ratio) / (100 +
    percent) in common with the other, and so has, by the binomial tail, its sketch.
    """
    p, tail = percent * (1 + (ratio or percent / 100)) / (100 + percent), 0.0
    for x in range(size + 1):
        tail += math.comb(size, x) * p ** x * (1 - p) ** (size - x)
        if tail > risk:
            return x
    return size


def _sets(part: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted shingle hashes of every text."""
    h, _, at = X.shingles(X.words(part), words)
    return [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _sums(s: np.ndarray) -> tuple[int, int, int]:
    """Size and a 128-bit sum of a set: equal for equal sets."""
    return len(s), int(s.sum(dtype=np.uint64).view(np.int64)), int(X.mix(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64))


def _parity(s: np.ndarray) -> np.ndarray:
    """For each of at least 2n bits: is the number of values that end in it odd?"""
    bits = min(PARITY_BITS, max(64 * LOW_WORDS, 1 << (2 * len(s) - 1).bit_length()))
    odd = np.bincount((s & np.uint64(bits - 1)).view(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def _fold(x: np.ndarray, size: int) -> np.ndarray:
    """The parity of the same set with fewer words."""
    return np.bitwise_xor.reduce(x.reshape(-1, size))


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    """In how many bits two parities differ, the longer one folded: never more than the values that one set has and the other not."""
    size = min(len(x), len(y))
    return int(np.bitwise_count((_fold(x, size) ^ _fold(y, size)).view(np.uint64)).sum())


def _apart_sql() -> tuple[str, str]:
    """``_apart`` as expressions of two documents' columns ``low`` (a fold to ``LOW_WORDS``) and, longer by one fold at most, ``parity``.

    The first one compiles to plain arithmetic; the other is for the pairs that pass it.
    """
    def fold(p: str, q: str) -> str:
        return f"if(size({p}) > size({q}), zip_with(slice({p}, 1, size({q})), slice({p}, size({q}) + 1, size({q})), (x, y) -> x ^ y), {p})"
    low = " + ".join(f"bit_count(get(lowa, {i}) ^ get(lowb, {i}))" for i in range(LOW_WORDS))
    whole = f"aggregate(zip_with({fold('paritya', 'parityb')}, {fold('parityb', 'paritya')}, (x, y) -> bit_count(x ^ y)), 0, (s, c) -> s + c)"
    return low, f"if(least(size(paritya), size(parityb)) <= {LOW_WORDS}, 0, {whole})"


def sums(docs: DataFrame, words: int, keep: Sequence[str] = ("id",)) -> DataFrame:
    """The columns ``keep``, n (set size), s1, s2 (128-bit sum of the set)."""
    kept = list(keep)

    @X.tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for first, part in X.chunks(f["text"], CHUNK_BYTES):
                n, s1, s2 = (list(x) for x in zip(*map(_sums, _sets(part, words)), strict=True))
                yield f[kept].iloc[first:first + len(part)].reset_index(drop=True).assign(n=n, s1=s1, s2=s2)
    types = ", ".join(f"{c} long" for c in kept)
    return docs.select(*kept, "text").mapInPandas(run, f"{types}, n long, s1 long, s2 long")


def sketches(docs: DataFrame, words: int, size: int = SKETCH, keep: Sequence[str] = ("id",)) -> DataFrame:
    """The columns of ``sums``, sketch (the smallest hashes, or all), parity (of the whole set), low (its fold to ``LOW_WORDS``)."""
    kept = list(keep)

    @X.tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for first, part in X.chunks(f["text"], CHUNK_BYTES):
                sets = _sets(part, words)
                n, s1, s2 = (list(x) for x in zip(*map(_sums, sets), strict=True))
                odd = [_parity(s) for s in sets]
                yield f[kept].iloc[first:first + len(part)].reset_index(drop=True).assign(
                    n=n, s1=s1, s2=s2, sketch=[(s if len(s) <= 2 * size else s[:size]).view(np.int64) for s in sets],
                    parity=odd, low=[_fold(p, LOW_WORDS) for p in odd])
    types = ", ".join(f"{c} long" for c in kept)
    return docs.select(*kept, "text").mapInPandas(run, f"{types}, n long, s1 long, s2 long, sketch array<long>, parity array<long>, low array<long>")


def _tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps that a checkpoint has closed.

    They stay on the executors' disks until the driver collects its garbage, which a
    driver with little to do puts off.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b), for nodes with an edge."""
    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    left = reliable_checkpoint(edges.where("a <> b").distinct())
    found = None
    while found is None or not left.isEmpty():
        near = both(left).groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        over = near.select(F.col("a").alias("p"), F.col("p").alias("q"))
        up = reliable_checkpoint(near.join(over, "p").select("a", F.col("q").alias("p")))
        if found is None:
            found = up.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            found = (found.join(up.select(F.col("a").alias("root"), "p"), "root", "left")
                     .select("node", F.coalesce("p", "root").alias("root")))
        ends = up.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        left = reliable_checkpoint(left.join(up, "a").join(ends, "b").where("p <> pb")
                                   .select(F.least("p", "pb").alias("a"), F.greatest("p", "pb").alias("b")).distinct())
        _tidy(edges.sparkSession)
    return found


def _compare(pairs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b, sure): pairs that are linked (sure) or may be (not sure), judged on sketches."""
    slack = 6 * math.sqrt(percent / 100 * (1 - percent / 100) / size)

    @X.tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep, sure = [], []
            for i, (na, nb, x, y, p, q) in enumerate(zip(f["na"], f["nb"], f["xa"], f["xb"], f["pa"], f["pb"], strict=True)):
                if _apart(p, q) > na + nb - 2 * -(-percent * (na + nb) // (100 + percent)):
                    continue
                whole = max(na, nb) <= 2 * size
                x, y = (np.asarray(z if whole else z[:size]).view(np.uint64) for z in (x, y))
                common = np.intersect1d(x, y, assume_unique=True)
                if whole:
                    ok = 100 * len(common) >= percent * (na + nb - len(common))
                else:
                    union = np.union1d(x, y)[:size]
                    inside = np.searchsorted(common, union[-1], side="right")
                    ok = inside >= (percent / 100 - slack) * len(union)
                if ok:
                    keep.append(i)
                    sure.append(whole)
            yield pd.DataFrame({"a": f["a"].to_numpy()[keep], "b": f["b"].to_numpy()[keep], "sure": np.array(sure, bool)})

    xa = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("xa"), F.col("parity").alias("pa"))
    xb = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("xb"), F.col("parity").alias("pb"))
    return pairs.join(xb, "b").join(xa, "a").mapInPandas(run, "a long, b long, sure boolean")


def _exact(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): the pairs whose full sets reach the similarity."""
    @X.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

        def full(packed: pa.Scalar) -> np.ndarray:
            return _sets([zlib.decompress(packed.as_py())], words)[0]
        last: tuple[int, np.ndarray] | None = None  # rows come sorted by a: a leader's set is made once
        for f in batches:
            keep = []
            for i, a in enumerate(f["a"].to_pylist()):
                if last is None or last[0] != a:
                    last = (a, full(f["ta"][i]))
                x, y = last[1], full(f["tb"][i])
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            yield f.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    @X.tidy
    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of the texts under one id, those of the class that was asked for, compressed: a pair holds two of them."""
        for f in frames:
            for first, part in X.chunks(f["text"], CHUNK_BYTES):
                rows = f.iloc[first:first + len(part)]
                sums = [_sums(x) for x in _sets(part, words)]
                same = [x == y for x, y in zip(sums, zip(rows["n"], rows["s1"], rows["s2"], strict=True), strict=True)]
                yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[same], "text": [zlib.compress(t, 1) for t, ok in zip(part, same, strict=True) if ok]})

    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    asked = sets.select("doc_id", "id", "n", "s1", "s2").join(ids, "doc_id", "left_semi")
    some = (docs.select("id", "text").join(asked, "id").mapInPandas(own, "doc_id long, text binary")
            .groupBy("doc_id").agg(F.min("text").alias("text")))  # any text of a class has its set
    texts_a = some.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    texts_b = some.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(texts_b, "b").join(texts_a, "a").mapInArrow(run, "a long, b long")


def _links(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, size: int, percent: int) -> DataFrame:
    judged = reliable_checkpoint(_compare(pairs, sets, size, percent))
    return reliable_checkpoint(judged.where("sure").select("a", "b")
                               .union(_exact(judged.where("not sure"), sets, docs, words, percent)))


def lists(sets: DataFrame, size: int = SKETCH, percent: int = PERCENT) -> DataFrame:
    """(value, kind, doc_id, n, rank, own): the inverted lists of each document's rarest retained values.

    ``kind`` 0 ranks a value in the whole set, kind 1 among the ``size`` smallest (for
    pairs with a larger set); ``own`` is the share of values that no other document has.
    """
    t = shared_values(size, percent)
    posted = (sets.select("doc_id", F.posexplode("sketch").alias("pos", "value"))
              .select("doc_id", "value", (F.col("pos") < size).alias("low")))
    # a value retained once is rarest of all; it links nothing but takes up a rank
    often = posted.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    mine = (posted.join(often, "value").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "value", "low"))).alias("v"))
            .join(sets.select("doc_id", "n", F.least("n", F.when(F.col("n") <= 2 * size, F.col("n")).otherwise(size)).alias("m")), "doc_id")
            .withColumn("own", 1 - F.size("v") / F.col("m"))
            .withColumn("w", F.filter("v", lambda x: x["low"])))

    def ranked(v: str, values: Column, kind: int) -> DataFrame:
        """The values of a list with their ranks; the document's own ones come first."""
        rows = F.transform(v, lambda x, i: F.struct(x["value"].alias("value"), (values - F.size(v) + i).cast("int").alias("rank")))
        return mine.select("doc_id", "n", "own", F.lit(kind).alias("kind"), F.explode(rows).alias("r")).select(
            "r.value", "kind", "doc_id", "n", "r.rank", "own")

    # a partner has at least this part of a whole set
    whole = ranked("v", F.col("m"), 0).where(F.col("n") <= 2 * size).where(F.expr(f"100 * (n - rank) >= {percent} * n"))
    cut = ranked("w", F.least("m", F.lit(size)), 1).where(F.col("n") * 100 > 2 * size * percent).where(F.col("rank") <= size - t)
    return whole.union(cut)


def _rooted(rows: DataFrame, roots: DataFrame, of: str, name: str) -> DataFrame:
    """Add the root of the node ``of`` (itself, if it has no link)."""
    mark = roots.select(F.col("node").alias(of), F.col("root").alias("_r"))
    return rows.join(mark, of, "left").withColumn(name, F.coalesce("_r", of)).drop("_r")


def dedupe(docs: DataFrame, words: int = 5, percent: int = PERCENT, size: int = SKETCH) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest linked id), kept."""
    found = _grouped(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text"), words, percent, size, ["id"])
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return (found.select(real("id").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def keep_one(docs: DataFrame, words: int = 5, percent: int = PERCENT, size: int = SKETCH) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others), one of each group of linked documents.

    It is the row with the smallest id (rows without one come last), then the smallest hash
    of the row; repeated rows are one document, and so are wordless rows that are equal.
    """
    names = docs.columns
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_print": F.xxhash64(*names)})
    found = _grouped(keyed.select(F.col("_id").alias("id"), F.col("_print").alias("print"), "text"), words, percent, size, ["id", "print"])
    order = F.struct((F.col("id") == NO_ID).alias("last"), "id", "print")
    linked = found.where("root is not null").groupBy("root").agg(F.min(order).alias("first")).select("first.id", "first.print")
    chosen = linked.union(found.where("root is null").select("id", "print")).distinct().toDF("_id", "_print")
    return keyed.join(chosen, ["_id", "_print"]).dropDuplicates(["_id", "_print"]).select(*names)


def _grouped(docs: DataFrame, words: int, percent: int, size: int, keep: Sequence[str]) -> DataFrame:
    """Per row of ``docs`` (``keep`` with id, text): ``keep``, n, component (smallest linked id), root (number of the component; null for empty sets)."""
    spark = docs.sparkSession
    path = scratch_path(spark, "sets")
    sums(docs, words, keep).write.parquet(path)
    every = spark.read.parquet(path)
    path = scratch_path(spark, "classes")
    # numbered once, as written: the numbers stay the same if a task runs again later
    (every.where("n > 0").groupBy("n", "s1", "s2").agg(F.min(F.when(F.col("id") != NO_ID, F.col("id"))).alias("id"))
     .select("n", "s1", "s2", F.coalesce("id", F.lit(NO_ID)).alias("id"), F.monotonically_increasing_id().alias("doc_id")).write.parquet(path))
    classes = spark.read.parquet(path)
    path = scratch_path(spark, "unique")
    # made anew for one document of each class: a table of all sketches would be the largest one here
    (sketches(docs, words, size).join(classes, ["n", "s1", "s2", "id"])
     .dropDuplicates(["n", "s1", "s2", "id"]).select("doc_id", "id", "n", "s1", "s2", "sketch", "parity", "low").write.parquet(path))
    unique = spark.read.parquet(path)
    key = ["value", "kind"]
    posted = reliable_checkpoint(lists(unique, size, percent))
    again = posted.groupBy(*key).agg(F.count("*").alias("members")).where("members > 1").select(*key)
    posted = reliable_checkpoint(posted.join(again, key))
    _tidy(spark)
    path = scratch_path(spark, "candidates")
    unique.join(posted.select("doc_id").distinct(), "doc_id", "left_semi").write.parquet(path)
    sets = spark.read.parquet(path)
    _tidy(spark)

    roots = None
    for turn in range(STAR_ROUNDS + 1):
        here = posted
        if turn == STAR_ROUNDS:  # a parity as short as its fold is not carried twice
            longer = F.when(F.size("parity") > LOW_WORDS, F.col("parity")).otherwise(F.array().cast("array<long>"))
            here = posted.join(sets.select("doc_id", "low", longer.alias("parity")), "doc_id")
        if roots is None:
            here = here.withColumn("root", F.col("doc_id"))
        else:
            here = _rooted(here, roots, "doc_id", "root")
            mixed = here.groupBy(*key).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(*key)
            here = reliable_checkpoint(here.join(mixed, key))
        if turn < STAR_ROUNDS:
            # one leader per list and size class; a document is compared with the leader it meets most often
            here = here.withColumn("band", F.floor(F.log("n") / math.log(100 / percent) + 0.5 * turn))
            first = F.struct((F.col("own") if turn == 0 else F.lit(0.0)).alias("own"), F.xxhash64("doc_id", F.lit(turn)).alias("h"))
            lead = here.groupBy(*key, "band").agg(F.min_by(F.struct("doc_id", "root"), first).alias("lead"))
            met = (here.join(lead, [*key, "band"])
                   .where("root <> lead.root").groupBy("doc_id", F.col("lead.doc_id").alias("with")).agg(F.count("*").alias("c")))
            pairs = (met.groupBy("doc_id").agg(F.max_by("with", F.struct("c", -F.col("with"))).alias("with"))
                     .select(F.col("with").alias("a"), F.col("doc_id").alias("b")))
        else:
            one, two = (here.select(*key, F.col("doc_id").alias(x), *[F.col(c).alias(c + x) for c in ("n", "rank", "root", "low", "parity")]) for x in "ab")
            need = f"ceil({percent} * (na + nb) / {100 + percent})"
            steps = [percent + i * (100 - percent) / 10 for i in range(10)]
            shared = "case " + " ".join(f"when 100 * least(na, nb) >= {x} * greatest(na, nb) then {shared_values(size, percent, x / 100)}"
                                        for x in reversed(steps)) + " end"
            possible = (f"if(kind = 0, ranka + {need} <= na and rankb + {need} <= nb, "
                        f"greatest(na, nb) > {2 * size} and greatest(ranka, rankb) + {shared} <= {size})")
            near = " and ".join(f"{bits} <= na + nb - 2 * {need}" for bits in _apart_sql())
            sized = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
            pairs = one.join(two, key).where(F.expr(f"a < b and roota <> rootb and {sized} and {possible} and {near}")).select("a", "b").distinct()
        pairs = reliable_checkpoint(pairs)
        _tidy(spark)
        found = _links(pairs, sets, docs, words, size, percent)
        _tidy(spark)
        if roots is None:
            roots = reliable_checkpoint(components(found))
        else:
            # between components: the new links join whole components
            more = components(_rooted(_rooted(found, roots, "a", "ra"), roots, "b", "rb").select(
                F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")))
            nodes = roots.union(more.select("node", F.col("node").alias("root")).join(roots, "node", "left_anti"))
            roots = reliable_checkpoint(_rooted(nodes, more, "root", "now").select("node", F.col("now").alias("root")))

    linked = classes.select("doc_id", "id").join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id")
    least = F.coalesce(F.min(F.when(F.col("id") != NO_ID, F.col("id"))), F.lit(NO_ID))
    smallest = linked.join(linked.groupBy("root").agg(least.alias("component")), "root").select("doc_id", "root", "component")
    groups = classes.join(smallest, "doc_id", "left").select(
        "n", "s1", "s2", F.coalesce("component", "id").alias("component"), F.coalesce("root", "doc_id").alias("root"))
    return (every.join(groups, ["n", "s1", "s2"], "left")
            .select(*keep, "n", F.coalesce("component", "id").alias("component"), "root"))
