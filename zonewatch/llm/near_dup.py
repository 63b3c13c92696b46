"""Near duplicates: MinHash samples in bands for candidates, odd sketches to check them, whole sets to confirm.

A text is the set of its distinct word shingles, as 64-bit hashes. Texts with equal sets are one node from the
start. The MinHash samples of a node are cut into bands; nodes that agree on a band are candidates. Each sample is
also folded into a bitmap by flipping the bit it hashes to: two nodes' bitmaps differ in about as many bits as
samples disagree, so the population count of their XOR estimates high similarities closely with 64 bytes a node.
Candidate pairs whose count is far above what the threshold allows are left out; what remains falls into small
clusters, and inside these the full sets decide.

Skew: a band value held by very many nodes is cut into blocks, and each pair of blocks is looked at on its own.
Tasks hand on only edges that join what was not joined before, at most one for each node and task, never all pairs.
Nothing is capped: every pair that shares a band is compared. A pair at exactly the threshold shares no band with
a probability of at most ``MISS``, and passes the bitmap test but for ``SIGMAS`` standard deviations.

Edge cases: a text without words (null, empty, white space) has an empty set, and a row without an id can't be
named: both are linked with nothing. Repeated rows are equal texts. An id that stands with several texts is judged for each of
them; ``keep_first`` leaves one row of a group, also where its rows share an id. A very long text is one set; a pair of such sets is what
a task holds. Other columns are not looked at and may have any name.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewatch.llm.connected import components
from zonewatch.llm.text import WordHash, chained, mixed, runs, starts, utf8
from zonewatch.session import stage

MISS, SIGMAS = 1e-6, 5.0


@dataclass(frozen=True)
class Similarity:
    """What counts as near: ``words`` to a shingle, and ``percent`` of the union in common at least."""

    words: int = 5
    percent: int = 80
    bands: int = 36
    bits: int = 512
    #: Nodes in a block of one band value or cluster, and shingles in a block of one cluster: what a task holds is twice that,
    #: or two sets where sets are larger.
    block_nodes: int = 1024
    block_shingles: int = 1 << 18

    @property
    def rows(self) -> int:
        """Samples in a band: as many as leave a pair at the threshold unseen with probability ``MISS`` at most."""
        p = self.percent / 100
        fits = [r for r in range(1, 17) if (1 - p**r) ** self.bands <= MISS]
        return max(fits, default=1)

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_bits(self) -> int:
        """Differing bits that a pair at the threshold stays below, but for ``SIGMAS`` standard deviations."""
        k, p = self.samples, self.percent / 100
        apart = k * (1 - p) + SIGMAS * math.sqrt(k * p * (1 - p))
        mean = self.bits / 2 * (1 - (1 - 2 / self.bits) ** (2 * apart))
        return min(self.bits, math.ceil(mean + SIGMAS * math.sqrt(mean) / 2))


def shingles(text: bytes | None, hashes: WordHash, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; one hash for a text of fewer words, none without words."""
    h = hashes.of((text or b"").lower().split())
    if len(h) == 0:
        return h
    if len(h) < width:
        return chained([np.array([len(h)], dtype=np.uint64), *[h[k : k + 1] for k in range(len(h))]])
    return np.unique(chained([h[k : len(h) - width + 1 + k] for k in range(width)]))


def set_name(hashes: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


class Family:
    """The sampling functions of a ``Similarity``; the same ones in every process."""

    def __init__(self, near: Similarity):
        rng = np.random.default_rng(20240229)
        self.near = near
        self.scale = rng.integers(0, 2**63, near.samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 2**63, near.samples, dtype=np.uint64)
        self.salt = mixed(np.arange(near.samples, dtype=np.uint64) + np.uint64(77))

    def sample(self, hashes: np.ndarray) -> np.ndarray:
        least = None
        for at in range(0, len(hashes), 1024):
            part = (hashes[at : at + 1024, None] * self.scale + self.shift).min(axis=0)
            least = part if least is None else np.minimum(least, part)
        return least

    def bands(self, samples: np.ndarray) -> np.ndarray:
        """A hash for each row and band; the band's number goes into it."""
        cut = samples.reshape(len(samples), self.near.bands, self.near.rows)
        number = np.broadcast_to(np.arange(self.near.bands, dtype=np.uint64), cut.shape[:2])
        return chained([number, *[cut[:, :, k] for k in range(self.near.rows)]])

    def odd(self, samples: np.ndarray) -> np.ndarray:
        """Each row's samples folded into a parity bitmap, packed into bytes."""
        n, bits = len(samples), self.near.bits
        place = (mixed(samples ^ self.salt) % np.uint64(bits)).astype(np.int64) + np.arange(n)[:, None] * bits
        return np.packbits(np.bincount(place.ravel(), minlength=n * bits).reshape(n, bits).astype(np.uint8) & 1, axis=1)


def _mark(text: str):
    """Tells the texts of one id apart."""
    return F.xxhash64(F.col(f"`{text}`"))


def sketched(documents: DataFrame, near: Similarity, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``documents``: a row number, the key, the set's size and name, band hashes and bitmap."""
    kind = documents.schema[key].dataType
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("doc_id", kind), T.StructField("n", T.LongType()), T.StructField("name", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("odd", T.BinaryType()), T.StructField("mark", T.LongType()),
    ])

    def run(batches):
        hashes, family = WordHash(), Family(near)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(t, hashes, near.words) for t in utf8(part.column(2))]
                full = [k for k, s in enumerate(sets) if len(s)]
                bands, odd = [None] * len(sets), [None] * len(sets)
                if full:
                    samples = np.stack([family.sample(sets[k]) for k in full])
                    for k, b, o in zip(full, family.bands(samples).view(np.int64), family.odd(samples), strict=True):
                        bands[k], odd[k] = b, o.tobytes()
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_name(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.binary()), part.column(3),
                ], names=schema.names)

    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), _mark(text).alias("mark"))
    return rows.mapInArrow(run, schema)


def _joins(label: np.ndarray, u: int, others: np.ndarray) -> list[int]:
    """Merge ``u``'s class with those of ``others``; one of ``others`` for each class that was apart."""
    found = []
    for v in others:
        if label[v] != label[u]:
            found.append(int(v))
            label[label == label[v]] = label[u]
    return found


def _bitmaps(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)


def _alike(odd, n, u: int, near: Similarity) -> np.ndarray:
    """Rows after ``u`` that size and bitmap allow to be near it."""
    apart = np.bitwise_count(odd[u + 1 :] ^ odd[u]).sum(axis=1)
    small, large = np.minimum(n[u + 1 :], n[u]), np.maximum(n[u + 1 :], n[u])
    return u + 1 + np.flatnonzero((apart <= near.most_bits) & (100 * small >= near.percent * large))


_EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _edges(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _by_bitmap(near: Similarity):
    def run(batches):
        for table in runs(batches, "g", 4096):
            a, b = [], []
            node, n, odd = table["node"].to_numpy(), table["n"].to_numpy(), _bitmaps(table["odd"])
            cuts = starts(table["g"].to_numpy())
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo == 2:
                    pairs = [(lo, lo + 1)] if len(_alike(odd[lo:hi], n[lo:hi], 0, near)) else []
                else:
                    label, pairs = np.arange(hi - lo), []
                    for u in range(hi - lo - 1):
                        pairs += [(lo + u, lo + v) for v in _joins(label, u, _alike(odd[lo:hi], n[lo:hi], u, near))]
                a += [int(node[x]) for x, _ in pairs]
                b += [int(node[y]) for _, y in pairs]
            yield _edges(a, b)

    return run


def _by_sets(near: Similarity):
    def run(batches):
        for table in runs(batches, "g"):
            a, b = [], []
            cuts = starts(table["g"].to_numpy())
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = table.slice(lo, hi - lo)
                node, n, odd = part["node"].to_numpy(), part["n"].to_numpy(), _bitmaps(part["odd"])
                if len(node) < 2:
                    continue
                ends = np.r_[0, np.cumsum(n)]
                _, ids = np.unique(np.frombuffer(b"".join(part["hashes"].to_pylist()), dtype=np.uint64), return_inverse=True)
                inside, label = np.zeros(ids.max() + 1, dtype=bool), np.arange(len(node))
                for u in range(len(node) - 1):
                    others = _alike(odd, n, u, near)
                    others = others[label[others] != label[u]]
                    if len(others) == 0:
                        continue
                    inside[ids[ends[u] : ends[u + 1]]] = True
                    common = np.array([np.count_nonzero(inside[ids[ends[v] : ends[v + 1]]]) for v in others])
                    inside[ids[ends[u] : ends[u + 1]]] = False
                    linked = others[100 * common >= near.percent * (n[others] + n[u] - common)]
                    joined = _joins(label, u, linked)
                    a += [int(node[u])] * len(joined)
                    b += [int(node[v]) for v in joined]
            yield _edges(a, b)

    return run


def _in_blocks(members: DataFrame, group: str, blocks: str) -> DataFrame:
    """Each row once for every pair of blocks that its own block is part of, with the pair's hash ``g``."""
    own = F.pmod(F.xxhash64("node"), F.col(blocks))
    return members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))).withColumn(
        "g", F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other"))
    )


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("g").sortWithinPartitions("g", "node")


def near_duplicates(documents: DataFrame, near: Similarity = Similarity(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest key linked to it, in any number of steps), ``kept``."""
    found = _grouped_rows(documents, near, key, text).select("doc_id", "n_shingles", "component_id")
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _grouped_rows(documents: DataFrame, near: Similarity, key: str, text: str) -> DataFrame:
    """Each row's id, mark, set size, the number of its group (null for an empty set) and the group's smallest id."""
    rows = stage(sketched(documents, near, key, text), "near-sketched")
    nodes = stage(
        rows.where("n > 0 and doc_id is not null").groupBy("name").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id")), "near-nodes"
    )
    first = rows.join(nodes.select("node"), rows["row"] == F.col("node"))
    banded = first.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = banded.join(shared, "bucket").withColumn("blocks", F.ceil(F.col("m") / near.block_nodes))
    paired = _in_blocks(members.select("node", "bucket", "blocks"), "bucket", "blocks").select("node", "g")
    paired = paired.join(first.select("node", "n", "odd"), "node")
    alike = components(_grouped(paired).mapInArrow(_by_bitmap(near), _EDGES), "near-alike")

    inside = stage(
        alike.join(rows.select(F.col("row").alias("node"), "doc_id", "n", "odd", "name"), "node"), "near-inside"
    )
    # Never more blocks than nodes: with one node a block, each pair of sets is looked at on its own.
    wanted = F.greatest(F.ceil(F.sum("n") / near.block_shingles), F.ceil(F.count(F.lit(1)) / near.block_nodes))
    sizes = inside.groupBy("component").agg(F.least(wanted, F.count(F.lit(1))).alias("blocks"))
    inside = inside.join(sizes, "component")
    sets = _with_sets(inside, documents.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), near)
    linked = components(_grouped(_in_blocks(sets, "component", "blocks")).select("g", "node", "n", "odd", "hashes").mapInArrow(_by_sets(near), _EDGES), "near-linked")

    named = nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_name = named.join(least, "component").select("name", "component", "component_id")
    found = rows.select("doc_id", "mark", F.col("n").alias("n_shingles"), "name").join(of_name, "name", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return found.select("doc_id", "mark", "n_shingles", "component", component.alias("component_id"))


def _with_sets(inside: DataFrame, texts: DataFrame, near: Similarity) -> DataFrame:
    """The shingle hashes of the nodes in ``inside``, made again from their texts."""
    joined = texts.join(inside, "doc_id").select("node", "component", "blocks", "n", "odd", "name", "text")
    schema = T.StructType([*joined.schema.fields[:5], T.StructField("hashes", T.BinaryType())])

    def run(batches):
        hashes = WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(t, hashes, near.words) for t in utf8(part.column(6))]
                same = [set_name(s) == name for s, name in zip(sets, part.column(5).to_pylist(), strict=True)]
                out = pa.RecordBatch.from_arrays(
                    [part.column(k) for k in range(5)] + [pa.array([s.tobytes() for s in sets], pa.binary())], names=schema.names
                )
                yield out.filter(pa.array(same))

    return joined.mapInArrow(run, schema)


def keep_first(documents: DataFrame, near: Similarity = Similarity(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with one document of each group of near duplicates, and one row of rows that are the same."""
    judged = _grouped_rows(documents, near, key, text).where("doc_id is not null and doc_id <=> component_id")
    # Of texts of one group that share its smallest id, one; decided on ids and marks alone.
    winners = judged.groupBy(F.col("doc_id").alias("id"), F.coalesce("component", "mark").alias("group"), F.isnull("component").alias("alone")).agg(
        F.min("mark").alias("mark")).select("id", "mark", F.lit(True).alias("wins"))
    # The row stays packed, so that none of its names can clash.
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("own"), F.col(f"`{key}`").alias("id"), _mark(text).alias("mark"))
    joined = rows.join(winners, ["id", "mark"], "left").where("id is null or wins")
    # Rows that are the same; they lie together since the join.
    turn = F.row_number().over(Window.partitionBy("id", "mark").orderBy(F.lit(0)))
    return joined.withColumn("turn", turn).where("id is null or turn = 1").select("own.*")
