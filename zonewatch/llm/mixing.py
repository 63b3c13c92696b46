"""Mixing sources to target weights: fixed blocks of words, multinomial counts a shard, permuted block indices.

The words of a source, its documents in a hashed order, are one long run cut into blocks of ``block`` words. An output
shard has so many slots; how many of them go to each source is drawn: the whole part of what is expected is
certain, the seats left over are drawn from a multinomial distribution with the fractions as weights. A source's slots are
numbered through all shards; slot j is in epoch j div n and takes the block to which a keyed pseudorandom permutation
of that epoch sends j mod n, n being the source's blocks. So an epoch takes each block once, and no block is
taken more often than ``most`` times. Slots and the pieces of documents meet in a join on the block's index.

Targets: sources in code-point order, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes; a
target stops at ``most`` times its source's size and the excess is shared anew by weight.

Skew: positions in a source are running sums in two steps, within hashed buckets of about ``bucket_rows`` rows and over
bucket totals, so a source that holds a third of all rows is spread like the others. Only the table of sources (one
row for each) comes to the driver, as the mixture's configuration.

Edge cases: a null or empty text has size 0, gets 0 and takes part in no block. A draw beyond ``most`` whole epochs of a
source, possible by the rounding of a shard's draw, leaves its slot empty. Repeated rows have positions of their own. An empty table gives an
empty mix. Other columns may have any name, those used here included. The same rows give the same mix, whatever the partitions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewatch.llm.text import mixed, utf8
from zonewatch.session import stage


@dataclass(frozen=True)
class Mix:
    block: int = 32
    shard_slots: int = 1 << 16
    most: int = 3
    weights: tuple[int, ...] = (1, 2, 3)
    bucket_rows: int = 1 << 13
    task_slots: int = 1 << 19
    seed: int = 11


@F.arrow_udf(T.LongType())
def _word_count(texts: pa.Array) -> pa.Array:
    return pa.array([len((t or b"").split()) for t in utf8(texts)], pa.int64())


def sized(documents: DataFrame, text: str = "text") -> DataFrame:
    """Each row of ``documents`` packed as ``own``, so that none of its names can clash, with ``row__`` (a number of its own), ``doc_id``,
    ``source``, ``hash__`` and ``size__`` (words)."""
    return documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("own"), F.monotonically_increasing_id().alias("row__"),
        F.col("`doc_id`").alias("doc_id"), F.col("`source`").alias("source"),
        F.xxhash64(F.col("`doc_id`"), F.xxhash64(F.col(f"`{text}`")), F.lit(3)).alias("hash__"), _word_count(F.col(f"`{text}`")).alias("size__"))


def targets(rows: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row for each source: ``sid`` (its rank), ``source``, ``source_size``, ``target``, ``n_blocks``.

    Sources by the ratio of their cap to their weight: those capped come first, and the level at which the rest
    share what remains follows from running sums.
    """
    sizes = rows.groupBy("source").agg(F.sum("size__").alias("source_size"))
    ranked = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (F.col("sid") % len(mix.weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(mix.most))
    whole = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    shared = ranked.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0)))
                               / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0))))
    # The first source whose cap isn't reached at its level sets the level of all that follow.
    level = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "sid", "level"))).over(whole)["level"]
    target = F.least("cap", F.coalesce(level * F.col("weight"), "cap"))
    return shared.select("sid", "source", "source_size", target.alias("target"), F.ceil(F.col("source_size") / mix.block).cast("long").alias("n_blocks"))


def permuted(j: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a keyed pseudorandom permutation of 0..n-1 sends each of ``j``: four Feistel rounds, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    turn = [np.uint64(int(mixed(np.array([key * 8 + r], dtype=np.uint64))[0])) for r in range(4)]
    out = j.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> np.uint64(half), out[todo] & low
        for t in turn:
            a, b = b, a ^ (mixed(b + t) & low)
        out[todo] = (a << np.uint64(half)) | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def slots(spark, sources: list, mix: Mix = Mix()) -> DataFrame:
    """The mix as a plan: ``(shard, sid, draw, block)`` for each filled slot; ``sources`` are the rows of ``targets``."""
    used = [s for s in sources if s["source_size"] > 0]
    wanted = np.array([s["target"] * s["n_blocks"] / s["source_size"] for s in used])
    total = int(round(wanted.sum()))
    shards = max(1, -(-total // mix.shard_slots))
    share = wanted / max(wanted.sum(), 1e-300)
    sids, blocks = [s["sid"] for s in used], {s["sid"]: s["n_blocks"] for s in used}

    def draw(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                expected = (total // shards + (k < total % shards)) * share
                count = np.floor(expected).astype(np.int64)
                seats = total // shards + (k < total % shards) - int(count.sum())
                if seats > 0:
                    left = np.maximum(expected - count, 0) + 1e-12
                    count += np.random.default_rng([mix.seed, k]).multinomial(seats, left / left.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(sids), pa.int64()), pa.array(sids, pa.int32()), pa.array(count)], names=["shard", "sid", "count"])

    drawn = spark.range(shards if used else 0).mapInArrow(draw, "shard long, sid int, count long")
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = drawn.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0)))
    # A range is one row and many slots, so the number of tasks follows the slots.
    ranges = ranges.repartition(max(1, -(-total // mix.task_slots)), "shard", "sid")

    def fill(batches):
        for batch in batches:
            for shard, sid, count, first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                n = blocks[sid]
                for at in range(first, min(first + count, mix.most * n), 1 << 15):
                    j = np.arange(at, min(at + (1 << 15), first + count, mix.most * n))
                    index = np.empty(len(j), dtype=np.int64)
                    for epoch in np.unique(j // n):
                        own = j // n == epoch
                        index[own] = permuted(j[own] % n, n, (mix.seed * 1_000_003 + sid) * mix.most + int(epoch))
                    same = lambda v, m=len(j): pa.array(np.full(m, v))
                    yield pa.RecordBatch.from_arrays([same(shard), same(sid).cast(pa.int32()), pa.array(j), pa.array(index)], names=["shard", "sid", "draw", "block"])

    return ranges.mapInArrow(fill, "shard long, sid int, draw long, block long")


def placed(rows: DataFrame, sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``row__``, ``sid``, ``size__`` and ``start``: the words before the row in its source."""
    same = F.col("source").isNull() == F.col("source__").isNull()
    of = sources.select("sid", F.col("source").alias("source__"))
    keyed = rows.select("row__", "hash__", "size__", "doc_id", "source").join(
        of, (F.coalesce("source", F.lit("")) == F.coalesce("source__", F.lit(""))) & same)
    buckets = max(1, -(-rows.count() // mix.bucket_rows))
    keyed = keyed.withColumn("bucket", F.pmod(F.shiftrightunsigned("hash__", 24), F.lit(buckets)))
    of_bucket = keyed.groupBy("sid", "bucket").agg(F.sum("size__").alias("words"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = of_bucket.select("sid", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy("hash__", "doc_id", "size__", "row__").rowsBetween(Window.unboundedPreceding, -1)
    ordered = keyed.withColumn("inner", F.coalesce(F.sum("size__").over(inside), F.lit(0)))
    return ordered.join(base, ["sid", "bucket"]).select("row__", "sid", "size__", (F.col("base") + F.col("inner")).alias("start"))


def taken_pieces(rows: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """Of rows from ``sized`` with a ``source``: pieces ``(row__, low, high, times)`` in words of the row, and the sources.

    The rows should be a written table: they are read for sizes, for positions and by the caller.
    """
    sources = stage(targets(rows, mix), "mix-sources")
    use = slots(rows.sparkSession, sources.collect(), mix).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    at = placed(rows, sources, mix).where("size__ > 0")
    block = F.lit(mix.block).cast("long")
    cut = at.withColumn("block", F.explode(F.sequence(F.expr(f"start div {mix.block}"), F.expr(f"(start + size__ - 1) div {mix.block}"))))
    pieces = cut.select(
        "sid", "block", "row__", (F.greatest(F.col("block") * block, F.col("start")) - F.col("start")).alias("low"),
        (F.least((F.col("block") + 1) * block, F.col("start") + F.col("size__")) - F.col("start")).alias("high"))
    # The planner takes the slots for few, as it can't see what the draw makes of a shard; both sides are large.
    return pieces.hint("merge").join(use, ["sid", "block"]).select("row__", "low", "high", "times"), sources


def mixed_sizes(documents: DataFrame, mix: Mix = Mix(), text: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` for each row of ``documents``."""
    rows = stage(sized(documents, text).select("doc_id", "source", "row__", "hash__", "size__"), "mix-rows")
    pieces, sources = taken_pieces(rows, mix)
    got = pieces.groupBy("row__").agg(F.sum((F.col("high") - F.col("low")) * F.col("times")).alias("taken"))
    of = sources.select(F.col("source").alias("source__"), "source_size", "target")
    same = (F.coalesce("source", F.lit("")) == F.coalesce("source__", F.lit(""))) & (F.col("source").isNull() == F.col("source__").isNull())
    return rows.join(got, "row__", "left").join(of, same).select(
        "doc_id", F.col("size__").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


_WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]+")


def cut_words(text: bytes, pieces: list[tuple[int, int]]) -> bytes:
    """The parts of ``text`` between the given words, those that follow each other as one, parted by line ends."""
    at = [m.span() for m in _WORD.finditer(text)]
    merged: list[list[int]] = []
    for low, high in sorted(pieces):
        if merged and merged[-1][1] == low:
            merged[-1][1] = high
        else:
            merged.append([low, high])
    return b"\n".join(text[at[low][0] : at[high - 1][1]] for low, high in merged)


@F.arrow_udf(T.StringType())
def _cut(texts: pa.Array, pieces: pa.Array, copy: pa.Array) -> pa.Array:
    out = []
    for t, ps, k in zip(utf8(texts), pieces.to_pylist(), copy.to_pylist(), strict=True):
        out.append(cut_words(t, [(p["low"], p["high"]) for p in ps if p["times"] >= k]).decode())
    return pa.array(out, pa.string())


def mixed_documents(documents: DataFrame, mix: Mix = Mix(), text: str = "text") -> DataFrame:
    """The mix as documents: for each row and copy k, the parts of the text that are taken k times or more.

    Other columns are those of the row, but ``n_chars``, where there is one, is that of the new text.
    """
    rows = stage(sized(documents, text), "mix-rows")
    pieces, _ = taken_pieces(rows, mix)
    lists = pieces.groupBy("row__").agg(F.collect_list(F.struct("low", "high", "times")).alias("pieces__"), F.max("times").alias("times__"))
    copies = rows.join(lists, "row__").withColumn("copy__", F.explode(F.sequence(F.lit(1).cast("long"), "times__")))
    cut = copies.withColumn("cut__", _cut(F.col("own")[text], "pieces__", "copy__"))
    new = {text: F.col("cut__")}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.length("cut__").cast(documents.schema["n_chars"].dataType)
    return cut.select(*[new.get(c, F.col("own")[c]).alias(c) for c in documents.columns])
