"""Sequential passes: the rows of a key in order, one after the other, with a state and nothing gathered."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

TAKE = 64
#: (rows of one key in order) -> rows of the output
Walk = Callable[[Iterator[tuple]], Iterator[tuple]]


def walked(rows: DataFrame, keys: list[str], order: list[str], walk: Walk, schema: str, give: int = 4096) -> DataFrame:
    """walk over the rows of each value of the keys, in order; keys precede the output's columns in the schema.

    A key's rows are one sequence, so one task goes through them; it holds what the walk holds and up to `give` output
    rows. The keys come first in the rows that a walk gets. A walk need not read its rows to the end.
    """
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return walked_there(dealt, keys, walk, schema, give)


def walked_there(rows: DataFrame, keys: list[str], walk: Walk, schema: str, give: int = 4096) -> DataFrame:
    """`walked` over partitions that are sorted by the keys already; a key that several of them hold is walked in each."""
    columns = keys + [c for c in rows.columns if c not in keys]
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    width = len(keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # few rows are Python objects at a time, whatever a batch holds
        slices = (b.slice(at, TAKE) for b in batches for at in range(0, b.num_rows, TAKE))
        source = (row for b in slices for row in zip(*(c.to_pylist() for c in b.columns)))
        ahead = next(source, None)

        def of_key(key: tuple) -> Iterator[tuple]:
            nonlocal ahead
            while ahead is not None and ahead[:width] == key:
                row, ahead = ahead, next(source, None)
                yield row

        out: list[tuple] = []
        while ahead is not None:
            key = ahead[:width]
            mine = of_key(key)
            for found in walk(mine):
                out.append((*key, *found))
                if len(out) >= give:
                    yield batch(out)
                    out = []
            for _ in mine:
                pass
        if out:
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

    return rows.select(*columns).mapInArrow(run, schema)
