"""Registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotrows.llm import attribution, ctph, decontaminate, html, langid, lexsearch, lmscore, neardup, packing, prefixtrie, substring, toxicity, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(of: int) -> Column:
    """crc32 of doc_id as text, modulo ``of``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


@_query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every whole text; learn from two of three folds."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold(3) != 1))
    return (langid.predict(docs, model)
            .select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score", "bits", "rejected"))


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text for toxicity; learn from three of four folds."""
    docs = table(spark, sf_dir, "documents")
    known = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold(4) != 2)
    model = toxicity.fit(docs, known)
    return (toxicity.score(docs, model)
            .select("doc_id", (fold(4) == 2).alias("held_out"), "score",
                    (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "spans"))


@_query
def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets reach a similarity of 0.8."""
    return neardup.dedupe(table(spark, sf_dir, "documents"), words=4)


@_query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of documents that repeat a benchmark item, the best of each pair."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op2_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 1024 tokens along a Hilbert curve."""
    return packing.pack(table(spark, sf_dir, "documents"))


@_query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every sentence of every document; a crossing token goes where most of its characters are."""
    return (attribution.attribute(table(spark, sf_dir, "documents"), "most")
            .withColumn("n_tokens", F.col("n_tokens").cast("long")))


@_query
def op3_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piecewise hashes of every text and of its edited text, and their likeness."""
    return ctph.compare_edited(table(spark, sf_dir, "documents"))


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@_query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text by the trigram model of four of five folds."""
    docs = table(spark, sf_dir, "documents")
    return (lmscore.score(docs, fold(5) != 1)
            .select("doc_id", F.coalesce(fold(5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"))


@_query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's URL by the rules, else by trees that learned from the ruled URLs."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.Filter(URL_RULES).fit(pages).judge(pages, ["page_id"])


@_query
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages), ["page_id", "url"])


@_query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct sequence of first turns of the rebuilt conversations, with its members and savings."""
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


# crc32 of a short ASCII text, bit by bit
_CRC32 = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), "
          "lambda a, b: list_reduce(list_prepend(xor(a, b), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), "
          "lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)")

ORACLE["op12_prefix_trie"] = f"""
WITH turns AS (
  SELECT conv_id, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
sized AS (SELECT *, ({_CRC32.format("conv_id::VARCHAR")} % 6)::INT AS h FROM turns),
rebuilt AS (
  SELECT s.conv_id, coalesce(b.t[1:s.h], []) || s.t[s.h + 1:] AS t
  FROM sized s LEFT JOIN turns b ON b.conv_id = s.conv_id - s.conv_id % 100),
prefixes AS (SELECT conv_id, len(t) AS n, d AS depth, t[1:d] AS p FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT p, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY p),
kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (p)),
subtrees AS (
  SELECT p[1:d] AS p, sum((n_children = 0)::INT) AS n_leaves, sum(CASE WHEN depth > 0 THEN (n_convs - 1) * length(p[depth][2]) ELSE 0 END) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_nodes) GROUP BY 1)
SELECT a.conv_id::BIGINT AS conv_id, a.depth::BIGINT AS depth, b.conv_id::BIGINT AS parent_conv_id, a.n_convs::BIGINT AS n_convs,
       a.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, a.ends_sha256
FROM full_nodes a JOIN subtrees USING (p) LEFT JOIN full_nodes b ON a.depth > 0 AND b.p = a.p[1:a.depth - 1]
"""


@_query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexsearch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

ORACLE["op13_ranked_search"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
sums AS (SELECT count(*)::BIGINT AS big_n, sum(len(t))::BIGINT AS total FROM docs WHERE len(t) > 0),
freq AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM docs) GROUP BY 1, 2),
weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM freq, sums GROUP BY term, big_n),
items AS (SELECT i, item_id, term, count(*)::BIGINT AS times FROM
  (SELECT i, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS t FROM benchmark)) GROUP BY 1, 2, 3),
scores AS (
  SELECT i, item_id, r, docs.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(t) * big_n) // total))))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN freq USING (term) JOIN docs USING (r), sums GROUP BY 1, 2, 3, 4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@_query
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 35-word windows that occur more than once."""
    return substring.dedupe(table(spark, sf_dir, "documents"))


ORACLE["op11_substring_dedup"] = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, j, md5(array_to_string(w[j:j + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS j FROM docs)),
repeated AS (SELECT r, j FROM (SELECT r, j, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM docs),
marked AS (
  SELECT r, word, j, max((repeated.j IS NOT NULL)::INT) OVER (PARTITION BY r ORDER BY j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM words LEFT JOIN repeated USING (r, j)),
kept AS (SELECT r, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE gone = 0) AS t FROM marked GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""


ORACLE["op6_minhash_dedup"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[j:j + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS j FROM docs)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM docs UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.r)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""
