"""URL filter: allow and block rules, and gradient-boosted trees for what no rule fits.

A rule is a host and a path; it fits the host and its subdomains if the URL's path
starts with the rule's, and the longest rule wins.  URLs that a rule fits are the
labelled URLs.  They train Spark ML's gradient-boosted trees on lexical features --
length, depth, digit ratio, entropy, parameters, host shape, and the share of blocked
URLs among all labelled URLs with the same host suffix (one and two labels) and file
suffix.  The trees alone learn from a sample of at most about ``rows`` (20,000) rows:
distinct URLs chosen by a hash, each weighted by its share of the rows.  All other URLs
get the trees' verdict.

Defined results: a null URL or one without ``://`` has an empty host and path, no
rule, and the trees' verdict for an empty URL; labelled URLs of one class (or none)
give that class (allow) to everything; of equally long rules the alphabetically last
wins; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotrows.session import scratch_path

ROWS = 20_000
PRIOR = 5.0  # rows that a suffix's share starts with


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_rule(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Add host, path, rule and rule_verdict; ``rules`` are (verdict, host/path)."""
    urls = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    if not rules:
        return urls.withColumn("rule", F.lit(None).cast("string")).withColumn("rule_verdict", F.lit(None).cast("string"))
    known = F.array(*[F.struct(F.lit(len(r)).alias("size"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"),
                               F.lit(r.partition("/")[0]).alias("host"), F.lit("/" + r.partition("/")[2]).alias("path")) for v, r in rules])
    fits = F.filter(known, lambda r: ((F.col("host") == r["host"]) | F.col("host").endswith(F.concat(F.lit("."), r["host"])))
                    & F.col("path").startswith(r["path"]))
    return (urls.withColumn("_best", F.array_max(fits)).withColumn("rule", F.col("_best.rule"))
            .withColumn("rule_verdict", F.col("_best.verdict")).drop("_best"))


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, what, ""))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.greatest(F.length(text), F.lit(1))
    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    parts = F.transform(chars, lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a - p * F.log2(F.greatest(p, F.lit(1e-9))))


def _suffixes() -> dict[str, Column]:
    """Of host and path."""
    return {"s_one": F.regexp_extract("host", r"([^.]*)$", 1), "s_two": F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1),
            "s_file": F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})$", 1)}


def sample(labelled: DataFrame, rows: int, total: int) -> DataFrame:
    """Distinct URLs of ``total`` labelled rows, with weights that add up to about ``rows``: the copies of a URL, thinned out."""
    share = min(1.0, rows / total) if total else 0.0
    spot = F.pmod(F.xxhash64("url", F.lit("urls")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    counted = labelled.groupBy("url", "host", "path", "label").agg(F.count("*").alias("copies"))
    return counted.withColumn("weight", F.floor(F.col("copies") * share + spot).cast("double")).where("weight > 0").drop("copies")


def lexical(urls: DataFrame) -> DataFrame:
    """Add the lexical features (f_...) and the suffixes (s_...) of url, host and path."""
    u, h, p = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    features = {
        "f_length": F.length(u), "f_host": F.length(h), "f_path": F.length(p), "f_query": F.length(query),
        "f_depth": F.size(F.filter(F.split(p, "/"), lambda s: s != "")), "f_labels": _count(h, r"\."),
        "f_digits": _count(u, "[0-9]") / F.greatest(F.length(u), F.lit(1)), "f_host_digits": _count(h, "[0-9]"),
        "f_hyphens": _count(h, "-"), "f_params": F.when(F.length(query) > 0, _count(query, "&") + 1).otherwise(0),
        "f_equals": _count(query, "="), "f_fragment": u.contains("#").cast("int"), "f_secure": u.startswith("https").cast("int"),
        "f_slash_end": p.endswith("/").cast("int"), "f_entropy": _entropy(u), "f_host_entropy": _entropy(h),
    }
    return urls.select("*", *[c.cast("double").alias(k) for k, c in features.items()], *[c.alias(k) for k, c in _suffixes().items()])


class Filter:
    """Rules and trees; ``judge`` adds host, path, rule, score and verdict."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.rules = rules
        self.trees: GBTClassificationModel | None = None
        self.shares: dict[str, DataFrame] = {}
        self.small: set[str] = set()  # shares that fit a broadcast
        self.rate = 0.0

    def _vectors(self, rows: DataFrame) -> DataFrame:
        for k, table in self.shares.items():
            rows = rows.join(F.broadcast(table) if k in self.small else table, k, "left").withColumn(f"f_{k}", F.coalesce(f"f_{k}", F.lit(self.rate)))
        return VectorAssembler(inputCols=[c for c in rows.columns if c.startswith("f_")], outputCol="_features").transform(rows)

    def fit(self, urls: DataFrame, rows: int = ROWS, rounds: int = 20, depth: int = 4) -> Filter:
        labelled = (with_rule(urls.select("url"), self.rules).where(F.col("rule").isNotNull())
                    .withColumn("label", (F.col("rule_verdict") == "block").cast("double")))
        kinds = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
        total = sum(kinds.values())
        self.rate = kinds.get(1.0, 0) / max(total, 1)
        if len(kinds) == 2:
            spark = urls.sparkSession
            for k, suffix in _suffixes().items():
                path = scratch_path(spark, f"url-{k.replace('_', '-')}")
                (labelled.groupBy(suffix.alias(k)).agg(((F.sum("label") + PRIOR * self.rate) / (F.count("*") + PRIOR)).alias(f"f_{k}"))
                 .write.parquet(path))
                self.shares[k] = spark.read.parquet(path)
                if self.shares[k].count() <= ROWS:
                    self.small.add(k)
            learned = sample(labelled, rows, total).cache()
            self.trees = GBTClassifier(featuresCol="_features", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.2,
                                       seed=7).fit(self._vectors(lexical(learned)).select("_features", "label", "weight"))
            learned.unpersist()
        return self

    def judge(self, urls: DataFrame, keep: list[str]) -> DataFrame:
        """The columns ``keep``, host, path, rule, score (of block) and verdict."""
        # own columns apart from the caller's, whatever those are called
        held = F.struct(*[F.col(c) for c in keep]).alias("_kept") if keep else F.lit(None).alias("_kept")
        rows = with_rule(urls.select(F.col("url"), held), self.rules)
        if self.trees is None:
            rows = rows.withColumn("score", F.lit(self.rate))
        else:
            rows = self.trees.transform(self._vectors(lexical(rows))).withColumn("score", vector_to_array("probability")[1])
        guess = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
        return rows.select(*[F.col("_kept")[c].alias(c) for c in keep], "host", "path", "rule", "score",
                           F.coalesce("rule_verdict", guess).alias("verdict"))
