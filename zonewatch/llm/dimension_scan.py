"""Approximate nearest neighbours: lists of near vectors, scanned by blocks of rotated dimensions.

Vectors are scaled to length one, so that nearness by cosine is nearness by distance. Centroids are fitted by k-means
on a bounded sample (``sample`` vectors, by hash of their id); every vector belongs to the list of its nearest centroid. A
query looks at its nearest lists: at least the share ``probes`` of them, and on until they hold ``least_seen`` vectors.

Within a list, vectors and query are turned by one random rotation, after which any first d dimensions are a random
projection. The scan takes ``step`` dimensions at a time for all candidates still alive; after d of D, the
hypothesis that a candidate is nearer than the k-th nearest so far is given up if its partial distance, scaled by
D / d, is beyond that distance by the factor ``1 + epsilon / sqrt(d)``, squared. Those that last are compared by their exact cosine, on the original vectors in double precision.

Skew: a list is cut into blocks of about ``block`` vectors by hash, so a list with a third of all vectors is scanned by many
tasks; a query goes to each block and the k best of all blocks are taken by a rank that Spark limits before it shuffles. Only centroids, one vector a
list, and the lists' sizes are broadcast.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose length isn't the most
common one (the larger, if two are). Repeated ids count as different rows; a query's own row is every row of its id. A
query with fewer than k candidates in the whole table gets them all. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonewatch.llm.text import runs, starts
from zonewatch.session import stage


@dataclass(frozen=True)
class Scan:
    k: int = 5
    sample: int = 20_000
    #: Vectors of the sample for each list, at least.
    per_list: int = 64
    probes: float = 0.6
    least_seen: int = 1000
    block: int = 2048
    step: int = 16
    epsilon: float = 2.1
    seed: int = 5


def valid(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id`` and ``v`` (array of doubles) of the vectors that take part."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where("id is not null and v is not null").where(fine)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).first()
    return rows.where(F.size("v") == (length["n"] if length else 0))


def matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def kmeans(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids of length one, from unit vectors."""
    rng = np.random.default_rng(seed)
    points = np.unique(points, axis=0)
    k = min(k, len(points))
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        own = np.argmax(points @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def survivors(turned: np.ndarray, query: np.ndarray, scan: Scan) -> np.ndarray:
    """Rows of ``turned`` (rotated unit vectors) that aren't given up as the ``k`` nearest of ``query``."""
    n, d = turned.shape
    first = min(n, max(64, scan.k))
    exact = ((turned[:first] - query) ** 2).sum(axis=1)
    bound = np.partition(exact, scan.k - 1)[scan.k - 1] if first >= scan.k else np.inf
    alive, partial = np.arange(n), np.zeros(n)
    for at in range(0, d, scan.step):
        partial = partial + ((turned[alive, at : at + scan.step] - query[at : at + scan.step]) ** 2).sum(axis=1)
        seen = min(at + scan.step, d)
        factor = 1.0 if seen == d else (1 + scan.epsilon / math.sqrt(seen)) ** 2 * seen / d
        keep = partial <= bound * factor + 1e-9
        alive, partial = alive[keep], partial[keep]
        if seen == d or len(alive) <= 2 * scan.k:
            break
    return alive


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``a`` with the vector ``b``, in double precision; scaled first, so that no square overflows or vanishes."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max()
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum()))


def nearest(spark: SparkSession, vectors: DataFrame, queries, scan: Scan = Scan(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for the rows whose key meets the condition ``queries`` (a column of ``id``)."""
    rows = valid(vectors, key, vector)
    total = rows.count()
    kind = rows.schema["id"].dataType.simpleString()
    if total == 0:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    sample = rows.orderBy(F.xxhash64("id", F.lit(scan.seed)), "id").limit(scan.sample).select("v").toArrow().column(0).combine_chunks()
    points = unit(matrix(sample))
    lists = max(1, min(int(math.sqrt(total)), len(points) // scan.per_list))
    share = spark.sparkContext.broadcast((kmeans(points, lists, scan.seed), rotation(points.shape[1], scan.seed)))

    def assign(batches):
        centres, _ = share.value
        for batch in batches:
            if batch.num_rows:
                own = np.argmax(unit(matrix(batch.column(1))) @ centres.T, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column(0), batch.column(1)], names=["list", "id", "v"])

    listed = stage(rows.mapInArrow(assign, f"list int, id {kind}, v array<double>"), "vector-lists")
    sizes = {r["list"]: r["n"] for r in listed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a list
    blocks = {k: -(-n // scan.block) for k, n in sizes.items()}
    of_list = F.element_at(F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair]), F.col("list"))

    def probe(batches):
        centres, _ = share.value
        held = np.array([sizes.get(k, 0) for k in range(len(centres))])
        least = max(1, math.ceil(scan.probes * len(centres)))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            order = np.argsort(-(unit(matrix(batch.column(2))) @ centres.T), axis=1)
            seen = np.cumsum(held[order], axis=1)
            many = np.maximum(least, (seen < scan.least_seen + 1).sum(axis=1) + 1)
            row = np.repeat(np.arange(batch.num_rows), np.minimum(many, len(centres)))
            lists = np.concatenate([o[:m] for o, m in zip(order, many, strict=True)])
            per = np.array([blocks.get(k, 0) for k in lists])
            row, lists = np.repeat(row, per), np.repeat(lists, per)
            block = np.concatenate([np.arange(p) for p in per]) if len(per) else np.zeros(0)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([
                pa.array(lists.astype(np.int32)), pa.array(block.astype(np.int64)), batch.column(1).take(take), batch.column(2).take(take)], names=["list", "block", "id", "v"])

    asked = listed.where(queries).mapInArrow(probe, f"list int, block long, id {kind}, v array<double>").withColumn("kind", F.lit(1))
    held = listed.withColumn("block", F.pmod(F.xxhash64("id"), of_list)).select("list", "block", "id", "v", F.lit(0).alias("kind"))
    grouped = held.unionByName(asked).withColumn("g", F.xxhash64("list", "block")).repartition("g").sortWithinPartitions("g", "kind", "id")

    def search(batches):
        _, turn = share.value
        for table in runs(batches, "g"):
            cuts = starts(table["g"].to_numpy())
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = table.slice(lo, hi - lo).combine_chunks()
                kinds = part["kind"].to_numpy()
                split = int(np.searchsorted(kinds, 1))
                if split == 0 or split == len(kinds):
                    continue
                ids = part["id"].to_numpy()
                v = matrix(part["v"].combine_chunks() if isinstance(part["v"], pa.ChunkedArray) else part["v"])
                turned = unit(v) @ turn
                out = []
                for q in range(split, len(ids)):
                    mine = np.flatnonzero(ids[:split] != ids[q]) if (ids[:split] == ids[q]).any() else slice(None)
                    at = survivors(turned[:split][mine], turned[q], scan)
                    if not isinstance(mine, slice):
                        at = mine[at]
                    score = cosine(v[at], v[q])
                    best = np.lexsort((ids[at], -score))[: scan.k]
                    out.append((np.full(len(best), ids[q]), ids[at][best], score[best]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    found = grouped.select("g", "kind", "id", "v").mapInArrow(search, f"query_id {kind}, vec_id {kind}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= scan.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
