"""Keep a row only when enough time has passed since the last row kept."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clock import micros
from .timeline import SLICE, _slice, scan_in_order, values


def _entry_exit(ts: str, gap: int):
    """Per slice: for each row that could be kept first, the row that is kept last.

    Candidates whose paths meet share one entry from then on, so a slice costs about one step per
    row however many candidates it starts with.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: deque = deque()  # [time of the last kept row, entries leading there]
        open_end = False
        key = None

        def close():
            ends = sorted((entry, last) for last, entries in paths for entry in entries)
            # Of neighbours that end alike the latest stands for all.
            ends = [p for p, q in zip(ends, [*ends[1:], (None, None)]) if p[1] != q[1]]
            return key, [e for e, _ in ends], [last for _, last in ends]

        rows: list = []
        for batch in batches:
            times = values(batch.column(ts))
            fresh = batch.column("__new").to_pylist()
            limits = values(batch.column("__limit"))
            ids = batch.column("__id").to_pylist()
            for t, new, limit, ident in zip(times, fresh, limits, ids):
                if new:
                    if key is not None:
                        rows.append(close())
                    paths, open_end, key = deque(), False, ident
                met: list = []
                while paths and t - paths[0][0] >= gap:
                    met.extend(paths.popleft()[1])
                if not open_end:
                    met.append(t)
                    open_end = limit is None or t >= limit
                if met:
                    if paths and paths[-1][0] == t:
                        paths[-1][1].extend(met)
                    else:
                        paths.append([t, met])
            if len(rows) >= 4096:
                yield _summary_batch(rows)
                rows = []
        if key is not None:
            rows.append(close())
        if rows:
            yield _summary_batch(rows)

    return step


def _summary_batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.string()),
            pa.array([r[1] for r in rows], pa.list_(pa.int64())),
            pa.array([r[2] for r in rows], pa.list_(pa.int64())),
        ],
        ["__id", "enter", "leave"],
    )


def _chain(gap: int):
    """Walk the slices of a key and note the last kept time each one starts from."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("__new", "__linked", "__seed", "enter", "leave")]
            starts = []
            for new, linked, seed, enter, leave in zip(*cols):
                if new or not linked:
                    last = seed if new else None
                starts.append(last)
                at = 0 if last is None else bisect_left(enter, last + gap)
                if at < len(enter):
                    last = leave[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column(SLICE), pa.array(starts, pa.int64())],
                ["__id", SLICE, "__chained"],
            )

    return step


def _keep(ts: str, gap: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            times = values(batch.column(ts))
            fresh = batch.column("__new").to_pylist()
            carried = batch.column("__last").to_pylist()
            mask = []
            for t, new, before in zip(times, fresh, carried):
                if new:
                    last = before
                take = last is None or t - last >= gap
                if take:
                    last = t
                mask.append(take)
            out = batch.filter(pa.array(mask, pa.bool_()))
            names = [n for n in out.schema.names if n not in ("__new", "__last")]
            yield out.select(names)

    return step


def throttle(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    interval_s: float,
    tie: Sequence[Column | str] = (),
    width: int | None = None,
    seed: str | None = None,
) -> DataFrame:
    """Rows kept when each must come at least ``interval_s`` after the last one kept for its key.

    "Since the last kept row" is recursive, so no window frame can state it. A key's timeline is cut
    into slices. A slice that starts ``interval_s`` or more after the previous one ended depends on
    nothing before it. For slices that do, a first pass over only those rows finds where every
    possible first kept row leads; chaining these small tables along the key gives each slice its
    starting point, and one pass over all rows then marks the kept ones, slice by slice, in parallel.

    ``ts`` is microseconds, ``tie`` orders rows of equal time. ``seed`` names a column with the time
    of the key's last kept row from before this input, or null.
    """
    gap = micros(interval_s)
    if gap <= 0:
        return df
    keyed = [F.coalesce(F.to_json(F.struct(*[F.col(k) for k in keys])), F.lit(""))] if keys else [F.lit("")]
    cut = df.withColumn("__id", keyed[0]).withColumn(SLICE, _slice(ts, width))
    if seed:
        cut = cut.withColumn("__seed", F.col(seed).cast("bigint"))
    else:
        cut = cut.withColumn("__seed", F.lit(None).cast("bigint"))

    along = Window.partitionBy("__id").orderBy(SLICE)
    spans = cut.groupBy("__id", SLICE).agg(
        F.min(ts).alias("__lo"), F.max(ts).alias("__hi"), F.max("__seed").alias("__seed")
    )
    before = F.lag("__hi").over(along)
    spans = spans.withColumn("__before", before).withColumn(
        "__linked", F.coalesce(F.col("__lo") - before < gap, F.lit(False))
    )
    spans = spans.withColumn("__feeds", F.coalesce(F.lead("__linked").over(along), F.lit(False)))

    # Slices whose outcome passes on: a start, with what follows it.
    chained = spans.where(F.col("__linked") | F.col("__feeds"))
    limits = chained.select(
        F.col("__id"), F.col(SLICE),
        F.when(F.col("__linked"), F.col("__before") + gap)
        .when(F.col("__seed").isNotNull(), F.col("__seed") + gap).alias("__limit"),
    )
    narrow = cut.select("__id", SLICE, F.col(ts)).join(limits, ["__id", SLICE])
    tables = scan_in_order(
        narrow.withColumn("__row", F.concat_ws("#", F.col(SLICE).cast("string"), "__id"))
        .drop("__id", SLICE).withColumnRenamed("__row", "__id"),
        ["__id"], [ts], _entry_exit(ts, gap),
        "__id string, enter array<bigint>, leave array<bigint>",
    )
    tables = tables.select(
        F.substring_index("__id", "#", 1).cast("bigint").alias(SLICE),
        F.expr("substring(__id, instr(__id, '#') + 1)").alias("__id"),
        "enter", "leave",
    )

    starts = scan_in_order(
        chained.join(tables, ["__id", SLICE]).select(
            "__id", SLICE, "__linked", "__seed", "enter", "leave"
        ),
        ["__id"], [SLICE], _chain(gap), f"__id string, {SLICE} bigint, __chained bigint",
    )
    placed = cut.join(starts, ["__id", SLICE], "left").withColumn("__last", F.col("__chained"))
    if seed:
        # The seed starts the key's first slice; later slices get it through the chain.
        placed = placed.join(
            spans.where(F.col("__before").isNull()).select("__id", SLICE, F.lit(True).alias("__first")),
            ["__id", SLICE], "left",
        ).withColumn("__last", F.coalesce("__chained", F.when(F.col("__first"), F.col("__seed")))).drop("__first")
    placed = placed.drop("__chained", "__seed")
    out = T.StructType([*cut.drop("__seed", SLICE, "__id").schema.fields])
    kept = scan_in_order(
        placed, ["__id", SLICE], [F.col(ts), *tie], _keep(ts, gap),
        T.StructType([f for f in placed.schema.fields if f.name != "__last"]),
    )
    return kept.select(*[f.name for f in out.fields])
