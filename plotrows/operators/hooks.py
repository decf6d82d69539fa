"""Caller-supplied functions inside the plan: per-row transforms and per-batch collates.

A hook is a *factory*: a callable without arguments that returns the function, so
whatever it loads (a model, a lookup, an augmentation library) is built once per
Python worker.  Only the columns a hook names go to Python, as Arrow batches; all other
columns stay on the JVM side.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plotrows.operators.scoring import _cached

ROWS_PER_CALL = 256
Hook = Callable[[], Callable[[pa.RecordBatch], "pa.RecordBatch | dict"]]


def _fields(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)


def _result(found: pa.RecordBatch | pa.Table | dict, schema: pa.Schema, rows: int | None) -> list[pa.Array]:
    """The hook's columns in the declared order and types; ``rows`` is the number they must have."""
    out = []
    for field in schema:
        column = found[field.name]
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        out.append(column.cast(field.type) if isinstance(column, pa.Array) else pa.array(column, field.type))
    sizes = {len(c) for c in out}
    if len(sizes) > 1 or (rows is not None and sizes != {rows}):
        raise ValueError(f"the hook returned {sorted(sizes)} rows for {rows}")
    return out


def _isolated(call: Callable, batch: pa.RecordBatch, schema: pa.Schema) -> list[tuple[list[pa.Array], str | None, int]]:
    """(columns, error, rows) of parts of the batch; a failing call is halved until single rows fail."""
    try:
        return [(_result(call(batch), schema, batch.num_rows), None, batch.num_rows)]
    except Exception as e:  # noqa: BLE001 - a failing row goes to the error column
        if batch.num_rows == 1:
            return [([pa.nulls(1, f.type) for f in schema], f"{type(e).__name__}: {e}", 1)]
        half = batch.num_rows // 2
        return _isolated(call, batch.slice(0, half), schema) + _isolated(call, batch.slice(half), schema)


def transform_rows(df: DataFrame, hook: Hook, columns: Sequence[str], schema: str | T.StructType,
                   error: str = "error", rows_per_call: int = ROWS_PER_CALL) -> DataFrame:
    """Add the columns of ``schema``, computed by a caller's function from ``columns``, and ``error``.

    The function takes a record batch of at most ``rows_per_call`` rows and returns as
    many rows (a record batch, a table, or a dict of lists or arrays).  If it raises, the
    batch is halved until only the failing rows are left: those get NULLs and the error's
    text, all others their values.  A function that cannot be built fails its rows alike.
    Columns of the same names are replaced.
    """
    declared = _fields(schema)
    arrow = to_arrow_schema(declared)
    names = list(columns)
    token = f"hook/{uuid.uuid4().hex}"
    out = T.StructType([*declared.fields, T.StructField(error, T.StringType())])
    struct = pa.struct([*arrow, pa.field(error, pa.string())])

    @F.arrow_udf(out)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arrays in batches:
            columns = list(arrays) if isinstance(arrays, tuple) else [arrays]  # one column comes bare
            batch = pa.RecordBatch.from_arrays(columns, names)

            def call(part: pa.RecordBatch):
                return _cached(token, hook)(part)

            parts = [p for at in range(0, batch.num_rows, rows_per_call) for p in _isolated(call, batch.slice(at, rows_per_call), arrow)]
            pieces = [pa.StructArray.from_arrays([*cols, pa.array([err] * n, pa.string())], fields=list(struct)) for cols, err, n in parts]
            yield pa.concat_arrays(pieces) if pieces else pa.array([], struct)

    done = df.withColumn("_hook", run(*[F.col(c) for c in names]))
    return done.withColumns({f: F.col("_hook")[f] for f in out.names}).drop("_hook")


def collate_batches(df: DataFrame, hook: Hook, batch: str, order_by: Sequence[str], columns: Sequence[str],
                    schema: str | T.StructType, max_rows: int = 4096) -> DataFrame:
    """One call of a caller's function for every batch: (``batch``, the columns of ``schema``).

    ``batch`` numbers bounded batches (``batch_assign``).  The rows of one are gathered in
    one task in the order of ``order_by``, whatever Arrow batches they came in, and handed
    over as a table of ``order_by`` and ``columns``; the function returns its rows, one or
    more.  A batch of more than ``max_rows`` rows is an error: it would not be bounded.
    """
    declared = _fields(schema)
    arrow = to_arrow_schema(declared)
    names = list(dict.fromkeys([*order_by, *columns]))
    key = df.schema[batch]
    out = T.StructType([T.StructField(batch, key.dataType), *declared.fields])
    full = to_arrow_schema(out)
    token = f"hook/{uuid.uuid4().hex}"

    def collated(key_value, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        found = _result(_cached(token, hook)(pa.Table.from_batches(parts)), arrow, None)
        return pa.RecordBatch.from_arrays([pa.array([key_value] * len(found[0]), full.field(0).type), *found], schema=full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, rows = None, [], 0
        for b in batches:
            keys = b[batch].to_pylist()
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if parts and keys[at] != now:
                    yield collated(now, parts)
                    parts, rows = [], 0
                now = keys[at]
                parts.append(b.select(names).slice(at, end - at))
                rows += end - at
                if rows > max_rows:
                    raise ValueError(f"batch {now} has more than {max_rows} rows")
                at = end
        if parts:
            yield collated(now, parts)

    return (df.select(batch, *names).repartition(batch).sortWithinPartitions(batch, *order_by)
            .mapInArrow(run, out))
