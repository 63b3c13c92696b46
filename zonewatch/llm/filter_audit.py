"""Filter interaction audit: what each filter removes in every order, with exact duplicates found by radix tries.

Five filters give each document a mask of failure bits; an audit needs only the number of documents for each part and mask.
Four bits come from the text alone. The fifth, an identical text with a smaller id, is decided by compressed
tries over whole texts:

1. every task folds identical texts of its own rows into one with the smallest id, so a text that holds a third of all rows
   leaves each task a few times;
2. the texts are range-partitioned by adaptive prefixes: a prefix that holds more than ``node_bytes`` becomes a node, whose
   texts are told apart by the ``step`` characters behind what all of them share, and so on, with twice the characters each time, until
   a prefix is light or holds one text alone; so a large group of near copies takes as many rounds as its texts' length has bits;
3. each partition inserts its texts into a radix trie with the smallest id at every terminal, and walks it: the rows with that
   id are the text's first, all others are duplicates;
4. masks are summed by part, and every order and step is a sum over at most 32 masks a part.

Nodes are at most ``2 * most_nodes`` at any size (a node weighs more than the total over ``most_nodes``), which bounds what is broadcast.

Edge cases: a null text is an empty one, equal to all empty texts. Rows with equal id and text are each other's copies but none has a smaller
id, so both stay. A null id is smaller than none and has no smaller one. Several labels of an id: good if any is good, toxic if any is toxic.
A null or empty part is the part ''. Very long texts are inserted whole. Only the named columns are read, so others may have any name. An empty
table has no parts and no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import permutations
from math import ceil

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewatch.llm.text import utf8
from zonewatch.session import stage

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
DUPLICATE = 1 << FILTERS.index("E")
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

_CAPITALS = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#$%&*|"


@dataclass(frozen=True)
class Audit:
    """``part`` is the column whose values are reported apart; the sizes are in bytes of text."""

    key: str = "doc_id"
    text: str = "text"
    part: str = "lang"
    fold_bytes: int = 32 << 20
    node_bytes: int = 16 << 20
    most_nodes: int = 4096
    step: int = 8


def text_bits(text: bytes) -> int:
    """Failure bits of the four filters that look at one text."""
    words = text.split()
    points = len(text.translate(None, _CONTINUED))
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * (len(text) - len(text.translate(None, _CAPITALS))) > 3 * points) << 2
        | (len(text.translate(None, _SYMBOLS)) < len(text)) << 3
    )


def mark(text: bytes) -> bytes:
    """Names a text among the rows of one id; whether texts are equal is decided by the tries."""
    return xxhash.xxh3_128_digest(text)


_JUDGED = T.StructType([T.StructField("bits", T.IntegerType()), T.StructField("mark", T.BinaryType())])


@F.arrow_udf(_JUDGED)
def _judged(texts: pa.Array) -> pa.Array:
    found = [t or b"" for t in utf8(texts)]
    return pa.StructArray.from_arrays(
        [pa.array([text_bits(t) for t in found], pa.int32()), pa.array([mark(t) for t in found], pa.binary())], ["bits", "mark"]
    )


class Trie:
    """A compressed trie of byte strings; every string that was put in has a terminal with its smallest id and its mark."""

    __slots__ = ("below", "label", "least", "mark")

    def __init__(self, label: bytes = b"", least=None, mark: bytes | None = None):
        self.label, self.least, self.mark = label, least, mark
        self.below: dict[int, Trie] = {}

    def put(self, text: bytes, ident, mark: bytes) -> None:
        node, at = self, 0
        while at < len(text):
            child = node.below.get(text[at])
            if child is None:
                node.below[text[at]] = Trie(text[at:], ident, mark)
                return
            if not text.startswith(child.label, at):
                child = node._split(child, shared(child.label, text, at))
            node, at = child, at + len(child.label)
        if node.mark is None:
            node.least, node.mark = ident, mark
        elif ident < node.least:
            node.least = ident

    def _split(self, child: Trie, length: int) -> Trie:
        upper = Trie(child.label[:length])
        child.label = child.label[length:]
        upper.below[child.label[0]] = child
        self.below[upper.label[0]] = upper
        return upper

    def terminals(self):
        """Smallest id and mark of every text, in the order of the texts."""
        left = [self]
        while left:
            node = left.pop()
            if node.mark is not None:
                yield node.least, node.mark
            left += [node.below[b] for b in sorted(node.below, reverse=True)]


def shared(label: bytes, text: bytes, at: int) -> int:
    """How many bytes ``label`` shares with ``text`` from ``at`` on."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


def _folded(documents: DataFrame, audit: Audit) -> DataFrame:
    """Texts with the smallest id of a task's rows; texts of rows without an id take no part."""
    kind = documents.schema[audit.key].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("text", T.StringType())])
    limit = audit.fold_bytes

    def run(batches):
        seen: dict[bytes, object] = {}
        size, arrow = 0, None

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen.values()), arrow), pa.array(list(seen), pa.binary()).cast(pa.string())], names=["id", "text"]
            )

        for batch in batches:
            arrow = batch.column(0).type
            for ident, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                t = t or b""
                least = seen.get(t)
                if least is None:
                    seen[t] = ident
                    size += len(t) + 64
                    if size >= limit:
                        yield out()
                        seen, size = {}, 0
                elif ident < least:
                    seen[t] = ident
        if seen:
            yield out()

    rows = documents.where(F.col(f"`{audit.key}`").isNotNull())
    return rows.select(F.col(f"`{audit.key}`").alias("id"), F.col(f"`{audit.text}`").alias("text")).mapInArrow(run, schema)


def _beyond(cut: Column, step: int, turn: int) -> Column:
    """The characters that tell texts apart behind ``cut``: ``step`` of them, and from the second turn on a hash of twice as many each turn."""
    first = F.col("text").substr(cut + 1, F.lit(step))
    return first if turn == 0 else F.concat(first, F.lit("#"), F.hex(F.xxhash64(F.col("text").substr(cut + 1, F.lit(step << turn)))))


def parted(texts: DataFrame, audit: Audit) -> DataFrame:
    """``texts`` range-partitioned by node and by the characters that follow what the node's texts share."""
    spark = texts.sparkSession
    size = F.octet_length("text") + 64
    total = texts.agg(F.sum(size)).first()[0] or 0
    limit = max(audit.node_bytes, ceil(total / audit.most_nodes))
    rows = texts.withColumn("node", F.lit(0)).withColumn("at", _beyond(F.lit(0), audit.step, 0))
    open_rows, nodes, turn = rows, 1, 0
    while total > limit:
        heavy = open_rows.groupBy("node", "at").agg(F.sum(size).alias("bytes")).where(F.col("bytes") > limit)
        found = [tuple(r) for r in heavy.select("node", "at").collect()]  # fewer than most_nodes
        if not found:
            break
        names = spark.createDataFrame([(*f, nodes + k) for k, f in enumerate(found)], "node int, at string, deeper int")
        # What all texts of a node share is what its first and its last text share.
        ends = open_rows.join(F.broadcast(names), ["node", "at"]).groupBy("deeper").agg(F.min("text").alias("a"), F.max("text").alias("z"))
        cuts = [(r.deeper, r.cut) for r in ends.select("deeper", _shared_points("a", "z").alias("cut")).where("a <> z").collect()]
        if not cuts:
            break
        cut_of = dict(cuts)
        split = [(*f, nodes + k, cut_of[nodes + k]) for k, f in enumerate(found) if nodes + k in cut_of]
        nodes, turn = nodes + len(found), turn + 1
        deeper = F.broadcast(spark.createDataFrame(split, "node int, at string, deeper int, cut int"))
        step = lambda df, how: df.join(deeper, ["node", "at"], how).select(
            "id", "text", F.coalesce("deeper", "node").alias("node"),
            F.when(F.col("deeper").isNull(), F.col("at")).otherwise(_beyond(F.col("cut"), audit.step, turn)).alias("at"))
        rows, open_rows = step(rows, "left"), step(open_rows, "inner")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(total / (2 * audit.node_bytes)))
    return rows.repartitionByRange(parts, "node", "at")


@F.arrow_udf(T.IntegerType())
def _shared_of(a: pa.Array, z: pa.Array) -> pa.Array:
    def one(x: str, y: str) -> int:
        low, high = 0, min(len(x), len(y))
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if x[low:middle] == y[low:middle] else (low, middle - 1)
        return low

    return pa.array([one(x, y) for x, y in zip(a.to_pylist(), z.to_pylist(), strict=True)], pa.int32())


def _shared_points(a: str, z: str) -> Column:
    """How many characters two texts share from their start on."""
    return _shared_of(F.col(a), F.col(z))


def firsts(documents: DataFrame, audit: Audit = Audit()) -> DataFrame:
    """For every different text the smallest id that has it, and the text's mark."""
    kind = documents.schema[audit.key].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("mark", T.BinaryType())])

    def run(batches):
        root, arrow = Trie(), None
        for batch in batches:
            arrow = batch.column(0).type
            for ident, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                root.put(t, ident, mark(t))
        if arrow is None:
            return
        ids, marks = [], []
        for ident, m in root.terminals():
            ids.append(ident), marks.append(m)
            if len(ids) == 65536:
                yield pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array(marks, pa.binary())], names=["id", "mark"])
                ids, marks = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array(marks, pa.binary())], names=["id", "mark"])

    folded = stage(_folded(documents, audit), "audit-texts", compression="zstd")
    return parted(folded, audit).select("id", "text").mapInArrow(run, schema)


def masks(documents: DataFrame, audit: Audit = Audit()) -> DataFrame:
    """Every row's id, part and mask of failure bits (bit k is that of filter k of ``FILTERS``)."""
    judged = _judged.asNondeterministic()(F.col(f"`{audit.text}`"))
    rows = documents.select(
        F.col(f"`{audit.key}`").alias("id"), F.coalesce(F.col(f"`{audit.part}`"), F.lit("")).alias("part"), judged.alias("j"),
    ).select("id", "part", "j.bits", "j.mark")
    first = firsts(documents, audit).withColumn("first", F.lit(True))
    copy = F.when(F.col("first").isNull() & F.col("id").isNotNull(), F.lit(DUPLICATE)).otherwise(F.lit(0))
    return rows.join(first, ["id", "mark"], "left").select("id", "part", F.col("bits").bitwiseOR(copy).alias("mask"))


def mask_counts(masked: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents, good ones and toxic ones for each part and mask: at most 32 rows a part."""
    marks = labels.groupBy(F.col(f"`{key}`").alias("id")).agg(
        F.max(F.expr("coalesce(quality = 1, false)")).alias("good"), F.max(F.expr("coalesce(toxic = 1, false)")).alias("toxic"))
    return masked.join(marks, "id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def report(counts: DataFrame) -> DataFrame:
    """For each part, order and step what the step's filter does, as sums over the part's masks."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    steps = [(o, s + 1, bit[f], reduce(lambda a, b: a | b, (bit[x] for x in o[:s]), 0)) for o in ORDERS for s, f in enumerate(o)]
    entries = F.array(*[
        F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(own).alias("own"), F.lit(before).alias("before"))
        for o, s, own, before in steps
    ])
    rows = counts.withColumn("e", F.explode(entries)).select("*", "e.*")
    mask, own, before = F.col("mask"), F.col("own"), F.col("before")
    fails, earlier = mask.bitwiseAND(own) != 0, mask.bitwiseAND(before) != 0
    total = lambda test, value: F.sum(F.when(test, value).otherwise(F.lit(0))).cast("long")
    n = F.col("n")
    # Of the orders, the filter comes first among the mask's own filters in one of each bit_count(mask).
    share = n * (F.lit(len(ORDERS)) / F.greatest(F.bit_count(mask), F.lit(1))).cast("long")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier, n).alias("kept"), total(fails & ~earlier, n).alias("removed"), total(fails & earlier, n).alias("redundant"),
        total(mask == own, n).alias("unique_fails"), total(fails & ~earlier, F.col("good")).alias("good_lost"),
        total(fails & ~earlier, F.col("toxic")).alias("toxic_lost"), total(fails, share).alias("shapley"),
    )


def audited(documents: DataFrame, labels: DataFrame, audit: Audit = Audit()) -> DataFrame:
    """The whole audit: ``part``, ``filter_order``, ``step`` and the counts."""
    return report(mask_counts(masks(documents, audit), labels, audit.key))
