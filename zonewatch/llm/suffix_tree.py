"""Language-model scoring: a probabilistic suffix tree over words.

Counting. Texts are dictionary-encoded once, in chunks of whole documents, as a written table. The exact count of
every word comes from all chunks' words in one shuffle, which also carries it back to the chunks. Word sequences of two
to ``depth + 1`` words are kept if training rows hold them ``least_count`` times, whatever the size of the corpus. They are counted
exactly, length by length: a chunk hands on its sequences whose first and whose last words are both kept sequences, dealt by hash to
buckets whose number grows with the tokens, and a bucket gives each chunk the kept ones of what it handed on.

The tree. A context (up to ``depth`` words) is a node if the words that follow it diverge from what follows its suffix:
a G-test of its kept next words, and all others together, beyond ``sigmas`` standard deviations of the chance value.
Suffixes of nodes are nodes too. Sequences and nodes are written tables keyed by hash, which grow with the corpus. None of
them comes to the driver or is broadcast: a chunk is joined to the sequences and nodes it contains.

Smoothing. The root gives unknown words, as one type, the share of words seen once (Good and Turing), taken evenly from all
known words. A node takes ``DISCOUNT`` from each count and hands the rest, and all it knows nothing about, to its suffix.

Scoring. The state at a word is the longest chain of nodes that ends there, each resting on the one before; a text's score is
the sum of log10 probabilities of its words and its end.

Edge cases: a null or empty text is its end alone. A row without an id trains and isn't held out. Without training rows, or
in an empty table, all counts are 0 and scores are those of no knowledge, 0 for the root's single type.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewatch.llm.text import mixed, narrow, starts, utf8, wide
from zonewatch.session import discard, stage

DISCOUNT = 0.5
#: No word is empty, so this one stands for the end of a text.
END = b""


@dataclass(frozen=True)
class Tree:
    """A sequence of words enters the model if training rows hold it ``least_count`` times, at every size."""

    depth: int = 3
    least_count: int = 3
    sigmas: float = 4.0
    #: At least ``2 ** (counter_bits - 14)`` buckets count sequences; no result depends on it.
    counter_bits: int = 20
    chunk_bytes: int = 4 << 20
    #: Tokens of the training rows for each bucket.
    bucket_tokens: int = 2_000_000

    def buckets(self, tokens: int) -> int:
        return max(1 << max(self.counter_bits - 14, 0), -(-tokens // self.bucket_tokens))


def held_out(key):
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def encoded(documents: DataFrame, tree: Tree, key: str, text: str) -> DataFrame:
    """Chunks of documents: ids of words (the most frequent of a chunk first), the words, and their counts in training rows."""
    kind = documents.schema[key].dataType
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("docs", T.ArrayType(kind)), T.StructField("held", T.ArrayType(T.BooleanType())),
        T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("ids", T.BinaryType()),
        T.StructField("words", T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("train", T.LongType())]))),
    ])

    def pack(chunk, docs, held, texts, kind):
        seen: dict[bytes, int] = {}
        found: list[int] = []
        lengths = np.zeros(len(texts), dtype=np.int64)
        for k, t in enumerate(texts):
            words = (t or b"").lower().split()
            words.append(END)
            lengths[k] = len(words)
            found += [seen.setdefault(w, len(seen)) for w in words]
        flat = np.array(found, dtype=np.int64)
        learnt = flat[np.repeat(~np.array(held, dtype=bool), lengths)]
        order = np.argsort(-np.bincount(flat, minlength=len(seen)), kind="stable")
        rank = np.empty(len(seen), dtype="<u4")
        rank[order] = np.arange(len(seen))
        words, train = list(seen), np.bincount(learnt, minlength=len(seen))[order]
        entries = pa.StructArray.from_arrays([pa.array([words[k] for k in order], pa.binary()), pa.array(train)], ["word", "train"])
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays([
            pa.array([chunk], pa.int64()), one(pa.array(docs, kind)), one(pa.array(held, pa.bool_())), one(pa.array(lengths)),
            pa.array([zstandard.ZstdCompressor(level=1).compress(narrow(rank[flat]))], pa.binary()), one(entries),
        ], names=schema.names)

    def run(batches):
        chunk = (TaskContext.get().partitionId() << 32) - 1
        docs, held, texts, size, kind = [], [], [], 0, None
        for batch in batches:
            kind = batch.column(0).type
            for d, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                docs.append(d), held.append(h), texts.append(t)
                size += len(t or b"") + 16
                if size >= tree.chunk_bytes:
                    yield pack(chunk := chunk + 1, docs, held, texts, kind)
                    docs, held, texts, size = [], [], [], 0
        if docs:
            yield pack(chunk + 1, docs, held, texts, kind)

    rows = documents.select(F.col(f"`{key}`").alias("doc"), held_out(F.col(f"`{key}`")).alias("held"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, schema)


class Chunk:
    """One row of ``counted``, with the hashes of its word sequences."""

    def __init__(self, row):
        self.docs, self.held = row["docs"].values, row["held"].values.to_numpy(zero_copy_only=False)
        self.lengths = row["lengths"].values.to_numpy()
        self.ids = wide(zstandard.ZstdDecompressor().decompress(row["ids"].as_py()))
        self.words, self.counts = unpacked(row["hash"].as_py(), np.uint64), unpacked(row["counts"].as_py(), np.int64)
        self.hash = self.words[self.ids]
        self._grams = [self.hash]
        starts = np.cumsum(self.lengths) - self.lengths
        self.place = np.arange(len(self.ids)) - np.repeat(starts, self.lengths)
        self.train = np.repeat(~self.held.astype(bool), self.lengths)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the ``n`` words that end at each place, and whether the text has so many there."""
        while len(self._grams) < n:
            longer = np.zeros(len(self.ids), dtype=np.uint64)
            longer[1:] = gram([self._grams[-1][:-1], self.hash[1:]])
            self._grams.append(longer)
        return self._grams[n - 1], self.place >= n - 1


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def gram(parts: list[np.ndarray]) -> np.ndarray:
    """The hash of a sequence of word hashes; that of all but the last may stand for them."""
    h = parts[0]
    for p in parts[1:]:
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + p)
    return h


def packed(values: np.ndarray) -> bytes:
    """64-bit values as bytes that compress well: all first bytes, then all second ones, and so on."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view(kind).reshape(-1)


def _chunks(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(name)[k] for name in batch.schema.names}


def word_counts(chunks: DataFrame) -> DataFrame:
    """``chunk``, ``at`` (the word's id there), ``c`` (its count in all training rows), ``first`` (once a word)."""
    entries = chunks.select("chunk", F.posexplode("words").alias("at", "w")).select("chunk", "at", "w.word", "w.train")
    every = Window.partitionBy("word")
    counted = entries.withColumn("c", F.sum("train").over(every)).withColumn("first", F.row_number().over(every.orderBy("chunk")) == 1)
    return counted.select("chunk", F.col("at").cast("int").alias("at"), "c", "first")


def counted(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """The chunks with the hashes of their words and the words' counts; a chunk meets at most one count for each word it holds."""
    schema = T.StructType([*chunks.drop("words").schema, T.StructField("hash", T.BinaryType()), T.StructField("counts", T.BinaryType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words = [w for part in left["words"].chunks for w in part.values.to_pylist()]
        c = np.zeros(len(words), dtype=np.int64)
        c[right["at"].to_numpy()] = right["c"].to_numpy()
        out = left.drop_columns(["words"])
        h = np.array([word_hash(w) for w in words], dtype=np.uint64)
        return out.append_column("hash", pa.array([packed(h)], pa.binary())).append_column("counts", pa.array([packed(c)], pa.binary()))

    narrow_chunks = chunks.select("chunk", "docs", "held", "lengths", "ids", F.col("words.word").alias("words"))
    return narrow_chunks.groupBy("chunk").cogroup(counts.select("chunk", "at", "c").groupBy("chunk")).applyInArrow(run, schema)


# Sequences of ``n`` words that a chunk holds: sorted ``keys``, with their counts (``c``) and which of them this chunk stands for (``first``).
_HELD = "bucket int, chunk long, n int, keys binary, c binary, first binary"
# What a chunk is joined to: counts of its kept sequences of ``n`` words (kind c), shares that its nodes hand on (kind left).
_MEETS = "chunk long, kind string, n int, keys binary, vals binary, first binary"


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _dealt(chunk: int, n: int, keys: np.ndarray, train: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Sorted keys of a chunk as one row for each bucket."""
    of = _bucket(keys, buckets)
    order = np.argsort(of, kind="stable")
    of, keys, train = of[order], keys[order], train[order]
    cuts = starts(of)
    parts = list(zip(cuts[:-1], cuts[1:], strict=True))
    return pa.RecordBatch.from_arrays([
        pa.array(of[cuts[:-1]], pa.int32()), pa.array(np.full(len(parts), chunk), pa.int64()), pa.array(np.full(len(parts), n), pa.int32()),
        pa.array([packed(keys[lo:hi]) for lo, hi in parts], pa.binary()), pa.array([packed(train[lo:hi]) for lo, hi in parts], pa.binary()),
        pa.nulls(len(parts), pa.binary()),
    ], names=["bucket", "chunk", "n", "keys", "c", "first"])


class Met:
    """What a chunk was joined to: for each kind and length, sorted keys and their values."""

    def __init__(self, table: pa.Table):
        gathered: dict[tuple[str, int], list] = {}
        for r in table.to_pylist():
            kind = np.float64 if r["kind"] == "left" else np.int64
            first = np.unpackbits(np.frombuffer(r["first"], dtype=np.uint8)) if r["first"] is not None else np.zeros(0, np.uint8)
            keys = unpacked(r["keys"], np.uint64)
            gathered.setdefault((r["kind"], r["n"]), []).append((keys, unpacked(r["vals"], kind), first[: len(keys)].astype(bool)))
        self.of = {}
        for at, parts in gathered.items():
            keys, values, first = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(keys)
            self.of[at] = keys[order], values[order], first[order] if len(first) else first

    def get(self, kind: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.of.get((kind, n), (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, bool)))

    def counts(self, chunk: Chunk, n: int) -> np.ndarray:
        """At each place, the count of the ``n`` words that end there, 0 if they aren't kept."""
        if n == 1:
            return chunk.counts[chunk.ids]
        keys, c, _ = self.get("c", n)
        h, whole = chunk.grams(n)
        at, known = find(keys, h)
        out = np.zeros(len(h), dtype=np.int64)
        known &= whole
        out[known] = c[at[known]]
        return out


def _meeting(held: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, [h.select("chunk", F.lit("c").alias("kind"), "n", "keys", F.col("c").alias("vals"), "first") for h in held])


def _joined(chunks: DataFrame, meets: DataFrame, fn, schema) -> DataFrame:
    """``fn(chunk id, Chunk, Met)`` of each chunk and the rows of ``meets`` that are for it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = _chunks(left.to_batches())
        return pa.Table.from_batches([fn(row["chunk"].as_py(), Chunk(row), Met(right))])

    return chunks.groupBy("chunk").cogroup(meets.groupBy("chunk")).applyInArrow(run, schema)


def _kept(chunks: DataFrame, n: int, shorter: DataFrame | None, least: int, buckets: int) -> DataFrame:
    """The sequences of ``n`` words that training rows hold ``least`` times, as ``_HELD``; ``shorter`` are those of one word less."""

    def gathered(name: int, c: Chunk, met: Met) -> pa.RecordBatch:
        h, ok = c.grams(n)
        often = met.counts(c, n - 1) >= least
        ok = ok & often
        ok[1:] &= often[:-1]
        keys, which = np.unique(h[ok], return_inverse=True)
        train = np.bincount(which, weights=c.train[ok], minlength=len(keys)).astype(np.int64)
        return _dealt(name, n, keys, train, buckets)

    def alone(batches):
        for row in _chunks(batches):
            yield gathered(row["chunk"].as_py(), Chunk(row), Met(pa.table({"kind": []})))

    def summed(rows: pa.Table) -> pa.Table:
        parts = [unpacked(k, np.uint64) for k in rows["keys"].to_pylist()]
        flat = np.concatenate(parts)
        keys, first, which = np.unique(flat, return_index=True, return_inverse=True)
        c = np.bincount(which, weights=np.concatenate([unpacked(t, np.int64) for t in rows["c"].to_pylist()])).astype(np.int64)[which]
        stands = np.zeros(len(flat), dtype=bool)
        stands[first] = True
        ends = np.cumsum([len(p) for p in parts])
        own = [slice(e - len(p), e) for p, e in zip(parts, ends, strict=True)]
        good = c >= least
        return pa.Table.from_arrays([
            rows["bucket"], rows["chunk"], rows["n"], pa.array([packed(flat[o][good[o]]) for o in own], pa.binary()),
            pa.array([packed(c[o][good[o]]) for o in own], pa.binary()), pa.array([np.packbits(stands[o][good[o]]).tobytes() for o in own], pa.binary()),
        ], names=["bucket", "chunk", "n", "keys", "c", "first"])

    found = chunks.mapInArrow(alone, _HELD) if shorter is None else _joined(chunks, _meeting([shorter]), gathered, _HELD)
    return stage(found.groupBy("bucket").applyInArrow(summed, _HELD), f"tree-sequences-{n}")


def _words(chunks: DataFrame, least: int, buckets: int) -> DataFrame:
    """Each chunk's words that may be contexts, as ``_HELD``."""

    def run(batches):
        for row in _chunks(batches):
            c = Chunk(row)
            often = c.counts >= least
            order = np.argsort(c.words[often])
            yield _dealt(row["chunk"].as_py(), 1, c.words[often][order], c.counts[often][order], buckets)

    return chunks.mapInArrow(run, _HELD)


def _sequences(chunks: DataFrame, held: list[DataFrame], root: Root, depth: int) -> DataFrame:
    """Each kept sequence once: ``n`` words, ``key``, ``context``, ``suffix`` (of the context), ``shorter`` (the suffix's sequence),
    ``c``, ``total`` (of the context) and, where that is the root's, the probability of ``shorter`` (``below``)."""

    def run(_, chunk: Chunk, met: Met) -> pa.RecordBatch:
        out = []
        for n in range(2, depth + 2):
            keys, c, first = met.get("c", n)
            keys, c = keys[first], c[first]
            h, whole = chunk.grams(n)
            own, known = find(keys, h)
            at = np.flatnonzero(known & whole)
            _, one = np.unique(own[at], return_index=True)
            at = at[one]
            before = [chunk.grams(k)[0][at - 1] for k in (n - 1, n - 2) if k]
            suffix = before[1] if n > 2 else np.zeros(len(at), dtype=np.uint64)
            total = met.counts(chunk, n - 1)[at - 1]
            below = root.p(chunk.counts[chunk.ids[at]]) if n == 2 else np.full(len(at), np.nan)
            cols = [x.view(np.int64) for x in (h[at], before[0], suffix, chunk.grams(n - 1)[0][at])]
            out.append([np.full(len(at), n, dtype=np.int32), *cols, c[own[at]].astype(np.int64), total, below])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)],
                                          names=["n", "key", "context", "suffix", "shorter", "c", "total", "below"])

    kind = "n int, key long, context long, suffix long, shorter long, c long, total long, below double"
    return stage(_joined(chunks, _meeting(held), run, kind), "tree-sequences")


def _nodes(sequences: DataFrame, tree: Tree) -> list[DataFrame]:
    """For contexts of one word, two and so on: the retained ones (``context``) and what they hand on to their suffix (``left``)."""
    tried: list[DataFrame] = []
    given: list[DataFrame] = []
    below = None
    for n in range(2, tree.depth + 2):
        rows = sequences.where(F.col("n") == n)
        if below is not None:
            rows = rows.drop("below").join(below, "shorter")
        # A context with its kept next words, tested against what its suffix says of them (``below``).
        sums = rows.groupBy("context").agg(
            F.max("suffix").alias("suffix"), F.max("total").alias("total"), F.count(F.lit(1)).alias("m"), F.sum("c").alias("seen"),
            F.sum(F.expr("c * ln(c / (total * below))")).alias("own"), F.sum("below").alias("said"))
        rest = sums.withColumn("rest", F.expr("total - seen")).withColumn("other", F.expr("greatest(1 - said, 1e-12D)"))
        tested = rest.select(
            "context", "suffix", F.expr(f"(rest + {DISCOUNT}D * m) / total").alias("left"),
            F.expr(f"2 * (own + if(rest > 0, rest * ln(rest / (total * other)), 0D)) > m + {tree.sigmas}D * sqrt(2 * m)").alias("diverges"))
        level = stage(tested, f"tree-tested-{n}")
        tried.append(level)
        if n <= tree.depth:
            p = rows.join(level.select("context", "left"), "context").select(
                F.col("key").alias("shorter"), F.expr(f"(c - {DISCOUNT}D) / total + `left` * below").alias("below"))
            below = stage(p, f"tree-below-{n}")
            given.append(below)
    discard(*given)
    kept: list[DataFrame] = []
    for level in reversed(tried):
        if kept:
            need = kept[0].select(F.col("suffix").alias("context")).distinct().withColumn("need", F.lit(True))
            rows = level.join(need, "context", "left").where("diverges or need")
        else:
            rows = level.where("diverges")
        kept.insert(0, stage(rows.select("context", "suffix", "left"), "tree-nodes"))
        discard(level)
    return [k.select("context", "left") for k in kept]


def _handed(held: DataFrame, nodes: DataFrame, n: int, buckets: int) -> DataFrame:
    """For each chunk, the nodes of ``n - 1`` words among the sequences it holds, as ``_MEETS``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        contexts = right["context"].to_numpy().view(np.uint64)
        order = np.argsort(contexts)
        contexts, share = contexts[order], right["left"].to_numpy()[order]
        chunk, keys, vals = [], [], []
        for name, data in zip(left["chunk"].to_pylist(), left["keys"].to_pylist(), strict=True):
            own = unpacked(data, np.uint64)
            at, known = find(contexts, own)
            if known.any():
                chunk.append(name), keys.append(packed(own[known])), vals.append(packed(share[at[known]]))
        return pa.Table.from_arrays([
            pa.array(chunk, pa.int64()), pa.array(["left"] * len(chunk), pa.string()), pa.array([n] * len(chunk), pa.int32()),
            pa.array(keys, pa.binary()), pa.array(vals, pa.binary()), pa.nulls(len(chunk), pa.binary()),
        ], names=["chunk", "kind", "n", "keys", "vals", "first"])

    placed = nodes.withColumn("bucket", F.expr(f"cast(shiftrightunsigned(context, 32) % {buckets} as int)"))
    return held.select("bucket", "chunk", "keys").groupBy("bucket").cogroup(placed.groupBy("bucket")).applyInArrow(run, _MEETS)


class Root:
    """What all contexts rest on: totals of the training rows."""

    def __init__(self, tokens: int, types: int, once: int):
        self.tokens, self.types = tokens, types
        self.discount = min(0.9, max(once, 0.5) / types) if types else 0.0

    def p(self, c: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(c))
        return np.where(c > 0, c - self.discount, self.discount * self.types) / self.tokens


class Nodes:
    """Retained contexts with their next words, by number of words in the context; sorted arrays, for looking into a small tree."""

    def __init__(self, sequences: DataFrame, nodes: list[DataFrame]):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for n, level in enumerate(nodes, start=2):
            own = level.toArrow()
            rows = sequences.where(F.col("n") == n).join(level, "context", "left_semi").select("key", F.expr(f"(c - {DISCOUNT}D) / total").alias("share")).toArrow()
            contexts, keys = (t.to_numpy().view(np.uint64) for t in (own["context"], rows["key"]))
            a, b = np.argsort(contexts), np.argsort(keys)
            self.levels.append((contexts[a], own["left"].to_numpy()[a], keys[b], rows["share"].to_numpy()[b]))


def find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, where it stands in sorted ``known``, and whether it does."""
    if len(known) == 0:
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


def probabilities(chunk: Chunk, root: Root, met: Met, depth: int) -> np.ndarray:
    """Each token's probability under its longest state."""
    total = met.counts(chunk, 1)
    p = root.p(total)
    inside = np.ones(len(p), dtype=bool)
    for n in range(2, depth + 2):
        contexts, left, _ = met.get("left", n)
        at = np.flatnonzero(inside & (chunk.place >= n - 1))
        k, hit = find(contexts, chunk.grams(n - 1)[0][at - 1])
        inside[:] = False
        at, k = at[hit], k[hit]
        inside[at] = True
        count = met.counts(chunk, n)
        p[at] *= left[k]
        known = at[count[at] > 0]
        p[known] += (count[known] - DISCOUNT) / total[known - 1]
        total = count
    return p


def next_words(context: list[int], words: np.ndarray, counts: np.ndarray, root: Root, nodes: Nodes) -> np.ndarray:
    """The distribution over ``words`` (hashes, with their ``counts`` in training) after ``context`` (hashes)."""
    p = root.p(counts)
    for n, (contexts, left, keys, shares) in enumerate(nodes.levels, start=2):
        if len(context) < n - 1:
            break
        before = [np.array([h], dtype=np.uint64) for h in context[len(context) - n + 1 :]]
        at, hit = find(contexts, gram(before))
        if not hit[0]:
            break
        own, known = find(keys, gram([*[np.repeat(h, len(words)) for h in before], words]))
        p = p * left[at[0]]
        p[known] += shares[own[known]]
    return p


@dataclass
class Learnt:
    """The model as written tables: chunks with their words' counts, kept sequences by chunk and once each, and nodes."""

    root: Root
    chunks: DataFrame
    held: list[DataFrame]
    sequences: DataFrame
    nodes: list[DataFrame]
    buckets: int
    least: int

    def meets(self) -> DataFrame:
        """What each chunk needs to be scored."""
        words = _words(self.chunks, self.least, self.buckets)
        handed = [_handed(h, k, n, self.buckets) for n, (h, k) in enumerate(zip([words, *self.held], self.nodes, strict=False), start=2)]
        return reduce(DataFrame.unionAll, handed, _meeting(self.held))


def learnt(chunks: DataFrame, tree: Tree) -> Learnt:
    """The tree of all training rows in ``chunks``, a written table."""
    counts = stage(word_counts(chunks), "tree-words", compression="zstd")
    root = Root(*counts.where("first and c > 0").agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count(F.when(F.col("c") == 1, 1))).first())
    least, buckets = tree.least_count, tree.buckets(root.tokens)
    own = stage(counted(chunks, counts), "tree-counted")
    discard(counts)
    held: list[DataFrame] = []
    for n in range(2, tree.depth + 2):
        held.append(_kept(own, n, held[-1] if held else None, least, buckets))
    sequences = _sequences(own, held, root, tree.depth)
    return Learnt(root, own, held, sequences, _nodes(sequences, tree), buckets, least)


@dataclass
class Fitted:
    root: Root
    nodes: Nodes


def fitted(chunks: DataFrame, tree: Tree) -> Fitted:
    """The tree of ``chunks`` in memory, for looking into a small one; scoring doesn't use it."""
    model = learnt(chunks, tree)
    return Fitted(model.root, Nodes(model.sequences, model.nodes))


def scored(documents: DataFrame, tree: Tree = Tree(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    chunks = stage(encoded(documents, tree, key, text), "tree-chunks", compression="zstd")
    model = learnt(chunks, tree)
    discard(chunks, model.sequences)
    root, depth = model.root, tree.depth
    kind = documents.schema[key].dataType
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])

    def score(_, chunk: Chunk, met: Met) -> pa.RecordBatch:
        firsts = np.cumsum(chunk.lengths) - chunk.lengths
        base = np.log10((chunk.counts + 1) / (root.tokens + root.types + 1))[chunk.ids]
        known = (chunk.counts > 0).astype(np.int64)[chunk.ids]
        own = np.log10(probabilities(chunk, root, met, depth))
        return pa.RecordBatch.from_arrays([
            chunk.docs, pa.array(chunk.held.astype(bool)), pa.array(chunk.lengths), pa.array(np.add.reduceat(known, firsts)),
            pa.array(np.full(len(firsts), root.tokens)), pa.array(np.add.reduceat(base, firsts)), pa.array(np.add.reduceat(own, firsts)),
        ], names=schema.names)

    # A chunk meets the sequences and nodes it contains.
    return _joined(model.chunks, model.meets(), score, schema)
