"""Reusable DuckDB SQL fragments for the oracle (kept next to the plans they check)."""

from __future__ import annotations


def folds_ctes(src: str, cls: str, key: str, k: int, name: str, order: str | None = None) -> str:
    """CTEs ending in ``name(key, fold)``: stratified k-fold over ``src``.

    ``order`` is the in-class order (default: ``key``); classes are ranked by
    first appearance in ``key`` order.
    """
    order = order or key
    return f"""
{name}_r AS (SELECT {key}, {cls} AS _c, row_number() OVER (PARTITION BY {cls} ORDER BY {order}) - 1 AS _r FROM {src}),
{name}_c AS (SELECT {cls} AS _c, count(*) AS _n, min({key}) AS _first FROM {src} GROUP BY {cls}),
{name}_s AS (SELECT _c, _n, coalesce(sum(_n) OVER (ORDER BY _first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _s FROM {name}_c),
{name}_a AS (SELECT _c, _fold, _n // {k} + CASE WHEN ((_fold - _s) % {k} + {k}) % {k} < _n % {k} THEN 1 ELSE 0 END AS _a
             FROM (SELECT _c, _n, _s, unnest(range({k})) AS _fold FROM {name}_s)),
{name}_b AS (SELECT _c, _fold, _a, sum(_a) OVER (PARTITION BY _c ORDER BY _fold ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _hi FROM {name}_a),
{name} AS (SELECT r.{key}, CAST(b._fold AS INTEGER) AS fold FROM {name}_r r JOIN {name}_b b
           ON r._c IS NOT DISTINCT FROM b._c AND r._r >= b._hi - b._a AND r._r < b._hi)"""


def md5_key(col: str, seed: int = 42) -> str:
    return f"md5(CAST({col} AS VARCHAR) || ':{seed}')"
