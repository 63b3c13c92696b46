"""Rows of a stream as packs: many rows of one key as one row with an Arrow table in ``body``.

Spark hands rows to stateful steps in Python one by one, which costs far more than what most steps do with them, and
shuffles them as wide rows. So rows are packed by the tasks that read them, moved and handed over as packs, and
unpacked where rows are wanted. A pack holds ``PACK_ROWS`` rows at most; a key may have any number of packs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows that are packed at once: enough that what a pack costs is shared by many rows, few enough for a task's memory.
PACK_ROWS = 50_000
BODY = "body"


def dump(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def load(bodies: Iterable[bytes]) -> pa.Table:
    """All rows of some packs."""
    return pa.concat_tables(pa.ipc.open_stream(b).read_all() for b in bodies)


def rows_of(rows: Iterator[pd.DataFrame]) -> pa.Table:
    """What a stateful step is given of one key."""
    return load(b for part in rows for b in part[BODY])


def split(table: pa.Table, keys: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each key, in their order, as pieces of ``PACK_ROWS`` at most."""
    if not table.num_rows:
        return
    codes = np.zeros(table.num_rows, dtype=np.int64)
    for k in keys:
        found = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        # Codes are made dense after each column, so they stay below the number of rows.
        codes = np.unique(codes * (len(found.dictionary) + 1) + found.indices.to_numpy(), return_inverse=True)[1]
    if codes.any():
        order = np.argsort(codes, kind="stable")
        table, codes = table.take(pa.array(order)), codes[order]
    ends = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    for at, end in zip(ends[:-1], ends[1:]):
        key = tuple(table.column(k)[at].as_py() for k in keys)
        for low in range(at, end, PACK_ROWS):
            yield key, table.slice(low, min(PACK_ROWS, end - low))


def _pack(tables: list[pa.RecordBatch], keys: Sequence[str], schema: pa.Schema) -> pa.RecordBatch:
    found = [(*key, dump(piece)) for key, piece in split(pa.Table.from_batches(tables), keys)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def packed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys`` and ``body``; the bodies hold all columns. Nothing is shuffled."""
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField(BODY, T.BinaryType())])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= PACK_ROWS:
                yield _pack(held, keys, arrow)
                held = []
        if held:
            yield _pack(held, keys, arrow)

    return df.mapInArrow(run, schema)


def unpacked(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """The rows of packs, whose tables have the columns of ``schema``."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                yield from load([body.as_py()]).select(arrow.names).cast(arrow).to_batches()

    return df.select(BODY).mapInArrow(run, schema)


def bodies(table: pa.Table) -> pd.DataFrame:
    """A step's rows of one key as packs."""
    return pd.DataFrame({BODY: [dump(piece) for _, piece in split(table, [])]}, columns=[BODY])
