"""Ordered folds: rules whose state depends on what they did before."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Step = Callable[[Any, tuple], tuple[Any, Iterable[tuple]]]


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], fields: list[str], init: Callable[[], Any], step: Step, finish: Callable[[Any], Iterable[tuple]], schema: str) -> DataFrame:
    """Fold the rows of every key in order; rows of the keys and outputs.

    Rows are dealt by key, sorted, and streamed: a task holds one batch and one
    state, however many rows a key has.  ``step(state, values of fields)`` gives
    the next state and output rows; ``finish(state)`` what is left at the end of
    a key.  ``schema`` names the outputs, which follow the keys.
    """
    picked = df.select(*[F.col(k) for k in keys], *[F.col(f).alias(f"_f{i}") for i, f in enumerate(fields)], *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    dealt = picked.repartition(*keys).sortWithinPartitions(*keys, *[f"_o{i}" for i in range(len(order))]).drop(*[f"_o{i}" for i in range(len(order))])
    n = len(keys)
    outputs = _parse_datatype_string(schema)
    full = StructType([*[f for f in picked.select(*keys).schema.fields], *outputs.fields])
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:n] != key:
                    if key is not None:
                        out += [(*key, *r) for r in finish(state)]
                    key, state = row[:n], init()
                state, made = step(state, row[n:])
                out += [(*key, *r) for r in made]
            if out:
                yield _batch(out, arrow)
        if key is not None and (rest := [(*key, *r) for r in finish(state)]):
            yield _batch(rest, arrow)

    return dealt.mapInArrow(run, full)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
