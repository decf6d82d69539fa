"""Distributed scoring around caller-supplied models.

Models are *factories* (zero-argument callables returning a scorer) so each
Python worker builds a model once and reuses it for every Arrow batch of its
partitions; nothing model-sized is captured in the closure of a row function.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotrows import constants as K
from plotrows.functions.numbers import argmax, softmax

ScorerFactory = Callable[[], Callable[[np.ndarray], np.ndarray]]

_WORKER_MODELS: dict[str, object] = {}


def _cached(name: str, factory: Callable[[], object]) -> object:
    """Build a model at most once per Python worker process and call (models of earlier calls are dropped)."""
    if name not in _WORKER_MODELS:
        call = name.split("/")[0]
        for old in [k for k in _WORKER_MODELS if k.split("/")[0] != call]:
            del _WORKER_MODELS[old]
        _WORKER_MODELS[name] = factory()
    return _WORKER_MODELS[name]


def rule_weights(n_classes: int, n_features: int, salt: int = 0) -> np.ndarray:
    """Deterministic linear-scorer weights ``((c*13 + j*7 + salt*5) % 11 - 5) / 10`` (test model)."""
    c = np.arange(n_classes)[:, None]
    j = np.arange(n_features)[None, :]
    return (((c * 13 + j * 7 + salt * 5) % 11) - 5) / 10.0


def linear_scorer_factory(n_classes: int = 5, n_features: int = 64, salt: int = 0) -> ScorerFactory:
    def factory():
        w = rule_weights(n_classes, n_features, salt)
        return lambda x: x @ w.T
    return factory


def score_classes(df: DataFrame, features: str, scorer: ScorerFactory, key: str = "id",
                  classes: list[str] = K.CHART_TYPES, model_name: str = "classifier") -> DataFrame:
    """M1: ``(key, pred_idx, pred_class, logits)`` via ``mapInPandas``; argmax takes the first maximum.

    The model is built once per Python worker and call: the cache key carries a
    token made on the driver for this call, so a reused worker never serves a
    model of an earlier query.
    """
    names = list(classes)
    token = f"{model_name}:{uuid.uuid4().hex}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _cached(token, scorer)
        for b in batches:
            if b.empty:
                continue
            x = np.stack(b[features].to_numpy()).astype(np.float64)
            logits = np.asarray(model(x), dtype=np.float64)
            idx = logits.argmax(axis=1)
            yield pd.DataFrame({key: b[key].to_numpy(), "pred_idx": idx.astype(np.int32),
                                "pred_class": [names[i] for i in idx], "logits": list(logits)})

    key_type = dict(df.dtypes)[key]
    schema = f"{key} {key_type}, pred_idx int, pred_class string, logits array<double>"
    return df.select(key, features).mapInPandas(run, schema)


def route_of(chart_type) -> Column:
    """which series model serves a class."""
    c = F.col(chart_type) if isinstance(chart_type, str) else chart_type
    return (F.when(c == "horizontal_bar", F.lit(K.ROUTE_HORIZONTAL))
            .when(c.isin("scatter", "line"), F.lit(K.ROUTE_SCATTER_LINE))
            .otherwise(F.lit(K.ROUTE_DEFAULT)))


def _score_isolating(model, inputs: pd.Series, kw: dict) -> tuple[list, list]:
    """Run ``model`` on a batch; on failure bisect so only the failing rows get an error.

    A batch with f bad rows costs O(f log n) model calls instead of n.
    """
    try:
        return list(model(inputs, **kw)), [None] * len(inputs)
    except Exception as e:  # noqa: BLE001 - isolate, as a per-image try would
        if len(inputs) == 1:
            return [None], [f"{type(e).__name__}: {e}"]
        mid = len(inputs) // 2
        lo = _score_isolating(model, inputs.iloc[:mid].reset_index(drop=True), kw)
        hi = _score_isolating(model, inputs.iloc[mid:].reset_index(drop=True), kw)
        return lo[0] + hi[0], lo[1] + hi[1]


def prepared_input(route_col: str, input_col: str, prepare: Mapping[str, Callable[[Column], Column]]) -> Column:
    """The model input of each route in one pass; routes without an entry take ``input_col`` as it is."""
    raw = F.col(input_col)
    out = None
    for route, step in prepare.items():
        own = F.col(route_col) == route
        out = F.when(own, step(raw)) if out is None else out.when(own, step(raw))
    return raw if out is None else out.otherwise(raw)


def routed_scoring(df: DataFrame, route_col: str, models: Mapping[str, Callable[[], Callable]],
                   input_col: str, key: str, out_col: str = "text", prompt: str | None = None,
                   prepare: Mapping[str, Callable[[Column], Column]] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """M2: rows dealt by (route, hash of the key), so that a task meets one route and a hot
    route spreads over many tasks; each worker builds only the models it meets.

    A model maps a pandas Series of inputs to a Series of output texts.  Errors
    do not fail the job: they land in ``error`` with ``out_col`` NULL.  With
    ``prompt`` (P14) every input row carries the same constant prompt column,
    passed to the model as its ``prompt`` keyword.  ``prepare`` maps a route to an
    expression over ``input_col`` (a resize, say) that only its rows go through;
    ``keep`` names columns to hand on beside the key.
    """
    factories = dict(models)
    token = uuid.uuid4().hex   # per call: reused workers never mix models of two calls

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            outs, errs = [], []
            for route, part in b.groupby(route_col, sort=False):
                try:
                    model = _cached(f"{token}/{route}", factories[route])
                except Exception as e:  # noqa: BLE001 - a model that cannot load fails its rows only
                    outs.append(pd.Series([None] * len(part), index=part.index, dtype=object))
                    errs.append(pd.Series([f"{type(e).__name__}: {e}"] * len(part), index=part.index))
                    continue
                kw = {"prompt": part["prompt"].iloc[0]} if "prompt" in part else {}
                o, r = _score_isolating(model, part[input_col].reset_index(drop=True), kw)
                outs.append(pd.Series(o, index=part.index, dtype=object))
                errs.append(pd.Series(r, index=part.index, dtype=object))
            text = pd.concat(outs).reindex(b.index) if outs else pd.Series([], dtype=object)
            err = pd.concat(errs).reindex(b.index) if errs else pd.Series([], dtype=object)
            yield pd.DataFrame({**{c: b[c] for c in names}, out_col: text, "error": err})

    names = [key, route_col, *keep]
    types = dict(df.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in names), f"{out_col} string, error string"])
    cols = [*names, prepared_input(route_col, input_col, prepare or {}).alias(input_col)] + ([F.lit(prompt).alias("prompt")] if prompt is not None else [])
    # each route has partitions of its own, placed by a hash of the key: no sampling pass over what feeds the model
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.lit(0)
    for i, route in enumerate(factories):
        number = F.when(F.col(route_col) == route, F.lit(i)).otherwise(number)
    place = number * spread + F.pmod(F.hash(key), F.lit(spread))
    return df.select(*cols).repartitionById(spread * max(1, len(factories)), place).mapInPandas(run, schema)


def softmax_ce(logits, label) -> dict[str, Column]:
    """Probabilities, predicted class, p[label], cross-entropy, and p[1].

    The cross-entropy is the log-sum-exp less the label's logit, which stays finite
    where p[label] underflows; a label outside the classes raises.
    """
    lg = F.col(logits) if isinstance(logits, str) else logits
    lb = F.col(label) if isinstance(label, str) else label
    p = softmax(lg)
    top = F.array_max(lg)
    total = F.aggregate(lg, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    own = F.coalesce(F.get(lg, lb), F.when(lg.isNull() | lb.isNull(), F.lit(None).cast("double")).otherwise(
        F.raise_error(F.lit("label outside the classes")).cast("double")))
    return {"probs": p, "pred": argmax(lg), "p_label": F.get(p, lb), "ce": top - own + F.log(total),
            "p1": F.get(p, 1)}


# Sums over rows are taken in whole multiples of 2 ** -40, so they do not depend on the order of the rows.
FIXED = float(1 << 40)


@dataclass
class TrainingRun:
    """M3: every epoch of one run: its weights (classes x (features, bias)), training loss and validation accuracy.

    ``kept`` is the epoch that W4 keeps: the first one with the highest accuracy.
    """

    weights: list[np.ndarray]
    losses: list[float]
    accuracies: list[float]
    kept: int | None

    def scorer(self, epoch: int | None = None) -> ScorerFactory:
        """A scorer factory of an epoch's state, the kept one by default."""
        w = self.weights[self.kept if epoch is None else epoch]
        return lambda: lambda x: x @ w[:, :-1].T + w[:, -1]


def _matrix(b: pa.RecordBatch, features: str) -> np.ndarray:
    x = np.stack(b[features].to_numpy(zero_copy_only=False)).astype(np.float64)
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def train_class_model(train: DataFrame, valid: DataFrame, features: str, label: str, n_classes: int, n_features: int,
                      epochs: int = 10, rate: float = 0.5) -> TrainingRun:
    """M3: softmax regression by full-batch gradient descent from zero weights, one run whose epochs are all kept.

    An epoch is one pass over ``train``: each Arrow batch sums its gradient, Spark sums the
    batches, and classes x features numbers come back to the driver.  One pass over
    ``valid`` then gives every epoch's accuracy.  Sums are exact in fixed point, so a run is the
    same under any partitioning.  Rows without label or features are left out; without
    validation rows no epoch is kept.
    """
    def rows(df: DataFrame) -> DataFrame:
        return df.where(F.col(features).isNotNull() & F.col(label).isNotNull()).select(features, F.col(label).cast("int").alias(label))

    def sums(weights: np.ndarray) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x, y = _matrix(b, features), b[label].to_numpy()
                lg = x @ weights.T
                e = np.exp(lg - lg.max(axis=1, keepdims=True))
                ce = np.log(e.sum(axis=1)) + lg.max(axis=1) - lg[np.arange(len(y)), y]
                p = e / e.sum(axis=1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                parts = [np.rint(p[:, c, None] * x * FIXED).sum(axis=0) for c in range(n_classes)]
                total = np.concatenate([*parts, [np.rint(ce * FIXED).sum(), len(y)]])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.astype(np.int64))], ["slot", "total"])
        return run

    known, held = rows(train), rows(valid)
    size = n_classes * (n_features + 1)
    weights, states, losses = np.zeros((n_classes, n_features + 1)), [], []
    for _ in range(epochs):
        found = np.zeros(size + 2)
        summed = known.mapInArrow(sums(weights), "slot long, total long").groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        for r in summed.collect():
            found[r["slot"]] = float(r["total"])
        n = max(found[-1], 1.0)
        weights = weights - rate * (found[:size] / FIXED / n).reshape(weights.shape)
        states.append(weights)
        losses.append(float(found[-2] / FIXED / n))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = _matrix(b, features), b[label].to_numpy()
                right = [int(((x @ w.T).argmax(axis=1) == y).sum()) for w in states]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(states)), pa.int64()), pa.array(right, pa.int64()), pa.array([len(y)] * len(states), pa.int64())], ["epoch", "hit", "n"])

    per_epoch = {r["epoch"]: r["hit"] / r["n"] for r in held.mapInArrow(hits, "epoch long, hit long, n long")
                 .groupBy("epoch").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n")).collect()}
    kept, best = None, K.INITIAL_BEST_ACCURACY
    for epoch in sorted(per_epoch):
        if per_epoch[epoch] > best:
            kept, best = epoch, per_epoch[epoch]
    return TrainingRun(states, losses, [per_epoch[e] for e in sorted(per_epoch)], kept)
