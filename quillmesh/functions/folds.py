"""Folds over ordered rows of a group whose state starts anew at data-dependent places."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Fold(Protocol):
    def start(self) -> None: ...

    def step(self, *values) -> int: ...


def folded(rows: DataFrame, group: tuple[str, ...], order: tuple[str, ...], inputs: tuple[str, ...], name: str, fold: Callable[[], Fold]) -> DataFrame:
    """The rows with ``name``: what the fold's steps return over each group in order.

    Rows stream through Arrow batches, so a group's size does not matter; a task holds one
    batch and the fold's state. The rows must already be dealt by columns of the group, as
    they are after a window over the group; the sort costs nothing where that window's order holds.
    """
    columns = [c for c in rows.columns if c != name]
    where = {c: i for i, c in enumerate(columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, last = fold(), None
        for batch in batches:
            keys = zip(*(batch.column(where[c]).to_pylist() for c in group), strict=True)
            values = zip(*(batch.column(where[c]).to_pylist() for c in inputs), strict=True)
            out = []
            for key, value in zip(keys, values, strict=True):
                if key != last:
                    one.start()
                    last = key
                out.append(one.step(*value))
            yield batch.append_column(name, pa.array(out, pa.int32()))

    schema = rows.select(*columns).schema.add(name, T.IntegerType())
    return rows.select(*columns).sortWithinPartitions(*group, *order).mapInArrow(run, schema)
