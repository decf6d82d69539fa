"""The pipeline: what each stage drops, and its whole result."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from plotrows.llm import queries
from tests_llm_common import table


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "decontamination", "packing"]


def test_every_stage_keeps_the_columns_and_a_part(spark, sf_small, tmp_path):
    docs = queries.table(spark, sf_small, "documents")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_small)
        assert out.columns == columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        rows = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(rows) and all(before[i] == r for i, r in rows.items())
        assert 0.5 * len(before) < len(rows) <= len(before)
        before = rows
    total = defaultdict(int)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_small).collect():
        total[r.doc_id, r.doc_tokens] += r.length
    assert {i for i, _ in total} == set(before) and all(n == k for (_, n), k in total.items())
    whole = corpus_pipeline.run(spark, sf_small)
    assert {r.doc_id for r in whole.select("doc_id").distinct().collect()} == set(before)


def test_extra_columns_nulls_and_no_rows(spark, sf_small):
    text = "The words of this document are plain and there is nothing wrong with them at all."
    rows = [(1, None), (2, ""), (3, text), (4, text), (None, text + " Twice."), (5, "!!!")]
    docs = table(spark, rows).withColumn("kept", F.lit("x")).withColumn("score", F.lit(1)).withColumn("n", F.lit(2))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_small).collect()
    near = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, sf_small)
    assert sorted(r.doc_id or 0 for r in near.collect()) == [1, 2, 3, 5]  # the row without an id is a copy of 3
    none = table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_small).count() == 0


def test_repeated_and_missing_ids(spark, sf_small):
    """Rows are told apart by id and text: one of each group stays, and only rows that repeat an item go."""
    item = queries.table(spark, sf_small, "benchmark").orderBy("item_id").first().text
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text), (1, text), (1, text), (None, text), (2, text + " more"), (2, "another text under the same id that nothing else repeats"), (None, "no id at all but a text of its own here"),
            (None, "before " + item + " after"), (3, "one id for a passage " + item), (3, "one id for a clean text without it")]
    stages = dict(corpus_pipeline.STAGES)
    near = stages["near_duplicates"](spark, table(spark, rows), sf_small).collect()
    assert sorted((r.doc_id or 0, r.text) for r in near if r.text.startswith("word")) == [(1, text)]
    assert sum(r.doc_id == 2 for r in near) == 1 and sum(r.doc_id is None for r in near) >= 1
    clean = stages["decontamination"](spark, table(spark, rows), sf_small).collect()
    assert sorted((r.doc_id or 0, r.text) for r in clean) == sorted((i or 0, t) for i, t in rows if item not in t)
