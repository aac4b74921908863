"""Python over sorted groups: for what is sequential in one group by nature."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Columns = dict[str, list]


def ddl(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*columns).schema)


def per_group(df: DataFrame, keys: list[str], order: list[str], compute: Callable[[Columns], list[tuple]], schema: str) -> DataFrame:
    """Rows that compute makes of each group's columns, which come in order; schema names what it returns.

    Groups are shuffled to where they are sorted and then read one after another from Arrow batches, so many small groups cost
    no more than their rows. A group is held in memory by itself.
    """
    names = df.columns
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def changes(batch: pa.Table) -> np.ndarray:
        differ = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            column = np.array(batch.column(k).to_pylist(), object)
            differ |= column[1:] != column[:-1]
        return np.flatnonzero(differ) + 1

    def made(table: pa.Table, cuts: list[int]) -> pa.RecordBatch:
        columns = {c: table.column(c).to_pylist() for c in names}
        rows = [r for a, b in zip([0, *cuts], [*cuts, table.num_rows], strict=True) for r in compute({c: v[a:b] for c, v in columns.items()})]
        parts = list(zip(*rows, strict=True)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(p, f.type) for p, f in zip(parts, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = [batch.column(k)[batch.num_rows - 1] for k in keys]
            if [held[0].column(k)[0] for k in keys] == last:
                continue  # all of it one group so far
            table = pa.Table.from_batches(held)
            cuts = changes(table)
            yield made(table.slice(0, cuts[-1]), cuts[:-1].tolist())
            held = table.slice(cuts[-1]).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield made(table, changes(table).tolist())

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def listed(column: pa.Array) -> list:
    """A column's values, as to_pylist gives them; numbers are taken together, which is much quicker."""
    if not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return column.to_pylist()
    values = (column.fill_null(0) if column.null_count else column).to_numpy(zero_copy_only=False).tolist()
    for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist() if column.null_count else ():
        values[i] = None
    return values


class Folder(Protocol):
    """What a sequence leaves behind as it is read row by row."""

    def add(self, row: tuple) -> Iterable[tuple]:
        """Rows that are certain with this one."""

    def end(self) -> Iterable[tuple]:
        """What is left when the sequence ends."""


#: Rows of a fold's result that are handed on together.
FOLDED_ROWS = 8_192


def folded(df: DataFrame, keys: list[str], order: list[str], begin: Callable[[tuple], Folder], schema: str) -> DataFrame:
    """Rows that a folder makes of each group's rows, which come in order; begin gets the group's keys.

    Only the folder's state is held, never a group: a group may be of any length, but one task reads it.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    places = [df.columns.index(k) for k in keys]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        parts = list(zip(*rows, strict=True)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(p, f.type) for p, f in zip(parts, arrow, strict=True)], schema=arrow)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own, folder = None, None
        for b in batches:
            for row in zip(*map(listed, b.columns), strict=True):
                key = tuple(row[i] for i in places)
                if folder is None or key != own:
                    if folder is not None:
                        yield from folder.end()
                    own, folder = key, begin(key)
                yield from folder.add(row)
        if folder is not None:
            yield from folder.end()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in rows_of(batches):
            held.append(row)
            if len(held) >= FOLDED_ROWS:
                yield batch(held)
                held = []
        yield batch(held)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
