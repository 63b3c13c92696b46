"""Ordered work along time that no single task has to do for a whole key.

A camera, a dedup key or a location may hold a large share of all rows, so no window here is
partitioned by such a key alone. The key's timeline is cut into slices of fixed width, the work is
done inside ``(key, slice)``, a summary of one row per slice carries the state over the cuts, and
the carried state is joined back. The summaries grow with the time span, not with the rows.

How wide a slice is, is a setting of the session: ``zonewatch.slice.seconds`` for times (an hour unless set) and
``zonewatch.slice.frames`` for sequence numbers. Take one that keeps a key's slice within what a task can do.

The input of these functions is read twice (once narrow, for the summaries). Where it is costly to
derive, or where one of them follows another, pass a staged input (``session.stage``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clock import SECOND
from ..session import stage

SLICE = "__slice"
AT = "__at"
# Rows of a measured table that are still handed to every executor, a few megabytes.
MOST_ABLE = 20_000


def slice_us() -> int:
    """Width of a slice of time in microseconds."""
    return int(SparkSession.active().conf.get("zonewatch.slice.seconds", "3600")) * SECOND


def slice_frames() -> int:
    """Width of a slice of frame numbers."""
    return int(SparkSession.active().conf.get("zonewatch.slice.frames", "20000"))


def _slice(ts: str, width: int | None) -> Column:
    return F.expr(f"`{ts}` div {int(width or slice_us())}L")


def _at(keys: Sequence[str], ts: str, width: int | None) -> Column:
    """Slice and key as one struct. Structs compare equal where their fields are null, so windows, sums and joins on
    it share one shuffle; a null-safe join on the columns would move all rows once more."""
    return F.struct(_slice(ts, width).alias("s"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def _along(keys: Sequence[str], descending: bool = False):
    """Window over the slices of a key."""
    order = F.col(AT)["s"]
    return Window.partitionBy(*[F.col(AT)[f"k{i}"] for i in range(len(keys))]).orderBy(order.desc() if descending else order)


def sessions(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    gap: int,
    mark: str | None = None,
    width: int | None = None,
    out: str = "first_us",
    carry: dict[str, str] | None = None,
) -> DataFrame:
    """Add ``out``, the time at which the row's session began.

    A row opens a session when ``mark - (previous ts of its key) > gap``, or when its key is new.
    ``mark`` defaults to the row's own ``ts``. ``carry`` maps columns of the opening row to names
    under which they are added to all rows of the session.
    """
    mark_col = F.col(mark or ts)
    opening = F.struct(F.col(ts).alias("__ts"), *[F.col(c).alias(n) for c, n in (carry or {}).items()])
    within = Window.partitionBy(AT).orderBy(ts)
    cut = df.withColumn(AT, _at(keys, ts, width))
    flagged = cut.withColumn("__prev", F.lag(ts).over(within)).withColumn(
        "__open", F.when(mark_col - F.col("__prev") > gap, opening)
    )
    heads = flagged.groupBy(AT).agg(
        F.min(opening).alias("__lo"),
        F.max(ts).alias("__hi"),
        F.min_by(mark_col, F.col(ts)).alias("__mark"),
        F.max("__open").alias("__last_open"),
    )
    along = _along(keys)
    before = F.lag("__hi").over(along)
    heads = heads.withColumn(
        "__first_open", F.when(before.isNull() | (F.col("__mark") - before > gap), F.col("__lo"))
    ).withColumn("__tail", F.coalesce("__last_open", "__first_open"))
    carried = F.last("__tail", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.select(AT, F.coalesce("__first_open", carried).alias("__head"))
    inner = F.last("__open", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    joined = flagged.withColumn("__inner", inner).join(heads, AT, "left")
    start = F.coalesce("__inner", "__head")
    added = {out: start["__ts"], **{n: start[n] for n in (carry or {}).values()}}
    return joined.withColumns(added).drop(AT, "__prev", "__open", "__inner", "__head")


def marked_sessions(
    df: DataFrame,
    marks: DataFrame,
    mark: str,
    on: Sequence[str],
    keys: Sequence[str],
    ts: str,
    gap: int,
    width: int | None = None,
    out: str = "first_us",
    carry: dict[str, str] | None = None,
    lasting: Column | None = None,
) -> DataFrame:
    """``sessions`` whose marks lie in a table of their own, one row for the values of ``on`` (of ``keys`` and ``ts``).

    A mark is never later than its row's ``ts``, so only rows more than ``gap`` after the one before can open a
    session, and only for those the mark is looked up. Two rows of one span of ``gap`` (which must be above 0) are never that
    far apart, so each span's first and last row tell all of them: sums that Spark keeps before it shuffles. Openings of a key are
    more than ``gap`` apart, so a slice's list of them is short; the rows themselves meet it in the one shuffle they need,
    with their keys only once. With ``lasting``, the least time of a row in its session (in units of ``ts``) that is asked for, keys
    that are never there so long are left out early; rows that don't reach it may still be among the result. Runs jobs when called.
    """
    names = [f"k{i}" for i in range(len(keys))]
    carry = carry or {}
    at = _at(keys, ts, width)
    least = [] if lasting is None else [F.min(lasting).alias("__least")]
    spans = df.where(F.col(ts).isNotNull()).groupBy(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], F.expr(f"(`{ts}` - pmod(`{ts}`, {int(gap)}L)) div {int(gap)}L").alias("__span")
    ).agg(
        F.min(ts).alias("__lo"), F.max(ts).alias("__hi"), *[F.min_by(c, F.col(ts)).alias(f"__c{i}") for i, c in enumerate(carry)], *least
    )
    of_key = Window.partitionBy(*names)
    spans = spans.withColumn("__prev", F.lag("__hi").over(of_key.orderBy("__span")))
    if least:
        spans = spans.withColumn("__for", F.max("__hi").over(of_key) - F.min("__lo").over(of_key)).withColumn(
            "__need", F.min("__least").over(of_key)).where("__for >= __need").drop("__for", "__need", "__least")
    spans = stage(spans, "spans")
    # A key's first row opens a session in any case.
    able = spans.where(F.col("__lo") - F.col("__prev") > gap).withColumns(
        {f"__on{i}": F.col("__lo") if k == ts else F.col(names[list(keys).index(k)]) for i, k in enumerate(on)})
    told = marks.select(*[F.col(k).alias(f"__on{i}") for i, k in enumerate(on)], F.col(mark).alias("__mark"))
    if able.limit(MOST_ABLE + 1).count() <= MOST_ABLE:
        able = F.broadcast(able)
    again = able.join(told, [f"__on{i}" for i in range(len(on))]).where(F.col("__mark") - F.col("__prev") > gap)
    opened = spans.where("__prev IS NULL").unionByName(again.select(*spans.columns))
    opened = opened.select(_at(names, "__lo", width).alias(AT), F.struct(
        F.col("__lo").alias("__ts"), *[F.col(f"__c{i}").alias(n) for i, n in enumerate(carry.values())]).alias("__o"))
    touched = F.sequence(_slice("__lo", width), _slice("__hi", width))
    slots = spans.select(F.explode(touched).alias("s"), *names).select(
        F.struct("s", *names).alias(AT), F.lit(None).cast(opened.schema["__o"].dataType).alias("__o"))
    # collect_list leaves the nulls out.
    starts = slots.unionByName(opened).groupBy(AT).agg(F.collect_list("__o").alias("__starts"))
    carried = F.last(F.array_max("__starts"), ignorenulls=True).over(_along(keys).rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.withColumn("__carry", carried)
    rows = df.withColumn(AT, at).drop(*keys)
    own = F.array_max(F.filter("__starts", lambda o: o["__ts"] <= F.col(ts)))
    joined = rows.join(starts, AT, "left" if lasting is None else "inner").withColumn("__start", F.coalesce(own, "__carry"))
    kept = [F.col(AT)[names[list(keys).index(c)]].alias(c) if c in keys else F.col(c) for c in df.columns if c not in (out, *carry.values())]
    return joined.select(*kept, F.col("__start")["__ts"].alias(out), *[F.col("__start")[n].alias(n) for n in carry.values()])


def previous(
    df: DataFrame, keys: Sequence[str], order: str, cols: dict[str, str], width: int | None = None, descending: bool = False,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Add the values of the key's row just before this one (after it when ``descending``).

    ``cols`` maps each value column to the name it gets. ``order`` and ``tie`` must be unique within a key.
    """
    pack = F.struct(*[F.col(c) for c in cols])
    direction = [F.col(c).desc() if descending else F.col(c).asc() for c in (order, *tie)]
    within = Window.partitionBy(AT).orderBy(*direction)
    cut = df.withColumn(AT, _at(keys, order, width))
    pick = F.min_by if descending else F.max_by
    tails = cut.groupBy(AT).agg(pick(pack, F.struct(order, *tie)).alias("__tail"))
    tails = tails.select(AT, F.lag("__tail").over(_along(keys, descending)).alias("__carry"))
    joined = cut.withColumn("__own", F.lag(pack).over(within)).join(tails, AT, "left")
    got = F.coalesce("__own", "__carry")
    return joined.withColumns({name: got[c] for c, name in cols.items()}).drop(AT, "__own", "__carry")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, width: int | None = None
) -> DataFrame:
    """Add the sum of ``value`` over the key's rows up to this one, ties in ``order`` included."""
    cut = df.withColumn(AT, _at(keys, order, width)).withColumn("__v", value.cast("bigint"))
    within = Window.partitionBy(AT).orderBy(order)
    totals = cut.groupBy(AT).agg(F.sum("__v").alias("__total"))
    before = F.sum("__total").over(_along(keys).rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(AT, F.coalesce(before, F.lit(0)).alias("__before"))
    joined = cut.withColumn("__sum", F.sum("__v").over(within)).join(totals, AT, "left")
    return joined.withColumn(out, F.col("__sum") + F.col("__before")).drop(AT, "__v", "__sum", "__before")


def epochs(df: DataFrame, keys: Sequence[str], order: str, ts: str, out: str = "epoch", width: int | None = None) -> DataFrame:
    """Number the stretches of a key in which ``ts`` never goes back along ``order``.

    ``ts`` seldom goes back: the few rows at which it does are found from order and time alone, gathered by slice before they are
    shuffled, and handed to all tasks. Only where they are many are the rows themselves put in order. Runs jobs when called.
    """
    width = width or slice_frames()
    # Two lists of one aggregate lie alike. They leave nulls out, so a missing time is the least one there is; the place in a slice is a short number.
    least = -(1 << 63)
    place = F.coalesce(F.expr(f"int(`{order}` - (`{order}` div {width}L) * {width}L)"), F.lit(0))
    slices = df.groupBy(_at(keys, order, width).alias(AT)).agg(
        F.collect_list(place).alias("o"), F.collect_list(F.coalesce(F.col(ts), F.lit(least))).alias("t"))
    point = lambda x: F.struct((F.col(AT)["s"] * width + x["o"]).alias("o"), F.nullif(x["t"], F.lit(least)).alias("t"))
    slices = slices.select(AT, F.transform(F.array_sort(F.arrays_zip("o", "t")), point).alias("__p"))
    p = F.col("__p")
    inner = F.filter(F.transform(p, lambda x, i: F.when(x["t"] < F.get(p, i - 1)["t"], x["o"])), lambda o: o.isNotNull())
    heads = slices.select(AT, F.get(p, F.lit(0)).alias("__head"), F.element_at(p, -1)["t"].alias("__tail"), inner.alias("__back"))
    first = F.when(F.col("__head.t") < F.lag("__tail").over(_along(keys)), F.array(F.col("__head.o")))
    back = heads.withColumn("__back", F.concat(F.coalesce(first, F.array().cast(heads.schema["__back"].dataType)), "__back"))
    back = stage(back.where(F.size("__back") > 0).select(
        F.struct(*[F.col(AT)[f"k{i}"].alias(f"k{i}") for i in range(len(keys))]).alias("__of"), F.explode("__back").alias("__o")), "back")
    found = back.limit(MOST_ABLE + 1).count()
    if not found:
        return df.withColumn(out, F.lit(0).cast("bigint"))
    if found <= MOST_ABLE:
        turns = back.groupBy("__of").agg(F.collect_list("__o").alias("__turns"))
        of = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
        joined = df.withColumn("__key", of).join(F.broadcast(turns), F.col("__key") == F.col("__of"), "left")
        passed = F.coalesce(F.size(F.filter("__turns", lambda o: o <= F.col(order))), F.lit(0)).cast("bigint")
        return joined.withColumn(out, passed).drop("__key", "__of", "__turns")
    stepped = stage(previous(df, keys, order, {ts: "__before_ts"}, width), "epochs")
    again = F.when(F.col(ts) < F.col("__before_ts"), 1).otherwise(0)
    return running_sum(stepped, keys, order, again, out, width).drop("__before_ts")


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    cols: dict[str, str],
    forward: bool = False,
    inclusive: bool = True,
    width: int | None = None,
) -> DataFrame:
    """For each left row the nearest right row of its key, backward or forward in time.

    Both sides go through one shuffle on ``(key, slice)``; ``cols`` maps right columns to output
    names. Among right rows at the same time any one may be taken, so make them unique if it matters.
    """
    pack = F.struct(*[F.col(c) for c in cols])
    keep = list(left.columns)
    l = left.select(
        *[F.col(k).alias(f"__a{i}") for i, k in enumerate(keys)],
        F.col(left_ts).alias("__t"),
        F.struct(*[F.col(c) for c in keep]).alias("__row"),
        F.lit(None).cast(right.select(pack.alias("p")).schema["p"].dataType).alias("__got"),
        F.lit(1 if inclusive else 0).alias("__rank"),
    )
    r = right.select(
        *[F.col(k).alias(f"__a{i}") for i, k in enumerate(keys)],
        F.col(right_ts).alias("__t"),
        F.lit(None).cast(l.schema["__row"].dataType).alias("__row"),
        pack.alias("__got"),
        F.lit(0 if inclusive else 1).alias("__rank"),
    )
    names = [f"__a{i}" for i in range(len(keys))]
    both = l.unionByName(r).withColumn(AT, _at(names, "__t", width))
    turn = (lambda c: F.col(c).desc()) if forward else (lambda c: F.col(c).asc())
    within = Window.partitionBy(AT).orderBy(turn("__t"), F.col("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__near", F.last("__got", ignorenulls=True).over(within))
    pick = F.min_by if forward else F.max_by
    ends = r.withColumn(AT, _at(names, "__t", width)).groupBy(AT).agg(pick("__got", "__t").alias("__end"))
    # Slices without right rows need a carried value too, so take every slice of either side.
    slots = l.select(_at(names, "__t", width).alias(AT)).distinct()
    slots = slots.withColumn("__end", F.lit(None).cast(ends.schema["__end"].dataType))
    marks = ends.unionByName(slots).groupBy(AT).agg(F.first("__end", ignorenulls=True).alias("__end"))
    along = _along(names, forward).rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select(AT, F.last("__end", ignorenulls=True).over(along).alias("__carry"))
    hit = F.coalesce("__near", "__carry")
    joined = seen.where(F.col("__row").isNotNull()).join(marks, AT, "left")
    return joined.select("__row.*", *[hit[c].alias(name) for c, name in cols.items()])


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    lo: str,
    hi: str,
    right_ts: str,
    width: int,
    how: str = "inner",
) -> DataFrame:
    """Rows of ``right`` whose time lies in ``[lo, hi]`` of a left row with the same keys.

    Time is cut into buckets of ``width``; left rows are repeated for each bucket they touch (two
    at most when ``hi - lo <= width``) and the join runs on key and bucket. Right key columns are
    dropped; other right columns must not clash with left ones.
    """
    touched = F.sequence(F.expr(f"`{lo}` div {int(width)}L"), F.expr(f"`{hi}` div {int(width)}L"))
    l = left.withColumn(SLICE, F.explode(touched))
    r = right.withColumnRenamed(right_ts, "__rt").select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.expr(f"__rt div {int(width)}L").alias("__s"),
        F.col("__rt").alias(right_ts),
        *[c for c in right.columns if c not in keys and c != right_ts],
    )
    on = (F.col(SLICE) == F.col("__s")) & F.col(right_ts).between(F.col(lo), F.col(hi))
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"__k{i}"))
    if how != "inner":
        raise ValueError("repeated left rows only fit an inner join")
    return l.join(r, on).drop(SLICE, "__s", *[f"__k{i}" for i in range(len(keys))])


def values(column: pa.Array) -> list:
    """Python values of an Arrow column, by way of numpy where nothing is missing."""
    if column.null_count == 0 and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def scan_in_order(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: T.StructType | str,
    spread: bool = False,
) -> DataFrame:
    """Hand each task its groups one after the other, rows sorted, as a stream of Arrow batches.

    The input of ``step`` has the extra boolean column ``__new``, true on the first row of a group.
    Nothing is collected per group, so the state kept by ``step`` is all the memory a group needs.
    ``spread`` keeps all shuffle partitions, for steps whose cost is in the work and not in the bytes.
    """
    columns = [F.col(g) for g in group]
    if spread:
        placed = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
    else:
        placed = df.repartition(*columns)
    placed = placed.sortWithinPartitions(*group, *order)
    first = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) == 1
    return placed.withColumn("__new", first).mapInArrow(step, schema)


def last_n_all(
    df: DataFrame, keys: Sequence[str], order: str, flag: Column, n: int, out: str, width: int | None = None,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Add ``out``: the key's last ``n`` rows, this one included, exist and all have ``flag``.

    ``tie`` orders rows of equal ``order``.

    Each slice is given the last ``n - 1`` flags before it; they come from at most that many slices.
    """
    cut = df.withColumn(AT, _at(keys, order, width)).withColumn("__f", F.coalesce(flag, F.lit(False)))
    back = Window.partitionBy(AT).orderBy(*[F.col(c).desc() for c in (order, *tie)])
    tails = (
        cut.withColumn("__i", F.row_number().over(back)).where(F.col("__i") < n)
        .groupBy(AT)
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("__i")).alias("i"), F.col("__f").alias("f")))).alias("__t"))
        .withColumn("__t", F.transform("__t", lambda t: t["f"]))
    )
    along = _along(keys).rowsBetween(-(n - 1), -1)
    tails = tails.select(AT, F.flatten(F.collect_list("__t").over(along)).alias("__carry"))
    within = Window.partitionBy(AT).orderBy(order, *tie).rowsBetween(-(n - 1), 0)
    local = cut.withColumn("__all", F.min("__f").over(within)).withColumn("__c", F.count("__f").over(within))
    joined = local.join(tails, AT, "left")
    missing = (F.lit(n) - F.col("__c")).cast("int")
    had = F.coalesce(F.size("__carry"), F.lit(0))
    from_carry = (had >= missing) & F.forall(
        F.slice(F.coalesce("__carry", F.array().cast("array<boolean>")), F.greatest(had - missing + 1, F.lit(1)), missing),
        lambda f: f,
    )
    return joined.withColumn(out, F.col("__all") & ((missing == 0) | from_carry)).drop(
        AT, "__f", "__all", "__c", "__carry"
    )
