"""Packing: documents in the order of a space-filling curve, cut into sequences of fixed length.

Each document is tokenised once. Its token counts are hashed into a vector of ``features`` signed places, scaled to
length one and projected onto ``dimensions`` random directions; the coordinates, on a grid of ``2 ** grid_bits`` steps, give the
place of its cell along a Hilbert curve, so documents with like words have near keys. The documents are
range-partitioned and sorted by that key, and each partition lays its documents end to end and cuts every ``length`` tokens.

What is left at the end of a partition is cut into lengths that are powers of two, which need no padding; so
there is no padding at all. Documents are never dropped or shortened.

Skew: ties of the key, as copies have, are parted by document and row, so copies spread over partitions. The token
ids are written once (compressed) before sorting; range bounds are sampled from the key columns of that table alone.

Edge cases: a null or empty text is its end token alone. Repeated rows are packed each. A null id is kept as it is. An empty
table gives no pieces.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewatch.llm.text import narrow, wide
from zonewatch.session import stage


@dataclass(frozen=True)
class Packing:
    """``json`` is a tokenizers file; ``ranks``, if given, the same vocabulary for the faster library.

    With ``added_tokens`` a text that holds an added token of the file literally gets that token's id, as the library's plain call does.
    """

    json: str
    ranks: str | None = None
    pattern: str | None = None
    length: int = 1024
    end: int = 0
    features: int = 256
    dimensions: int = 3
    grid_bits: int = 10
    added_tokens: bool = False


def public_packing() -> Packing:
    import public_tokenizers as P

    return Packing(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def contract_packing() -> Packing:
    """The public vocabulary as the contract calls it."""
    return replace(public_packing(), added_tokens=True)


class Encoder:
    """Token ids of texts. Both libraries give the same ids; the fast one takes the texts whose characters
    can't be classed differently by the Unicode tables the two were built with, and that hold no added token that counts."""

    _PLAIN = re.compile("[^\x00-ɏ‐-‧€]")

    def __init__(self, packing: Packing):
        self.packing = packing

    @cached_property
    def exact(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.packing.json)
        t.encode_special_tokens = not self.packing.added_tokens
        return t

    @cached_property
    def added(self):
        with open(self.packing.json, encoding="utf-8") as f:
            contents = [t["content"] for t in json.load(f).get("added_tokens") or []]
        return re.compile("|".join(map(re.escape, contents)) if contents and self.packing.added_tokens else r"(?!)")

    @cached_property
    def fast(self):
        import tiktoken

        with open(self.packing.ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("packing", pat_str=self.packing.pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.packing.ranks and not self._PLAIN.search(text) and not self.added.search(text):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of whole-number ``points`` (rows) with ``bits`` bits a coordinate.

    Axes to transposed index by undoing excess work from the top bit down, then Gray decoding, then interleaving.
    """
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Projection:
    """Keys of documents from their token ids; the same in every process."""

    def __init__(self, packing: Packing):
        self.packing = packing
        rng = np.random.default_rng(8)
        self.directions = rng.standard_normal((packing.features, packing.dimensions))
        self.place = rng.integers(0, packing.features, 1 << 18)
        self.sign = rng.choice([-1.0, 1.0], 1 << 18)

    def keys(self, docs: list[np.ndarray]) -> np.ndarray:
        n, width = len(docs), self.packing.features
        flat = np.concatenate(docs).astype(np.int64) % len(self.place) if docs else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(n), [len(d) for d in docs])
        vectors = np.bincount(owner * width + self.place[flat], weights=self.sign[flat], minlength=n * width).reshape(n, width)
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        at = (vectors / np.where(norm == 0, 1, norm)) @ self.directions
        steps = 1 << self.packing.grid_bits
        # The logistic curve spreads a normal coordinate evenly over the grid.
        grid = np.minimum((steps / (1 + np.exp(-1.702 * at))).astype(np.int64), steps - 1)
        return hilbert(grid, self.packing.grid_bits)


def tokenised(documents: DataFrame, packing: Packing, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row__``, ``doc_id``, ``curve`` (the key), ``n`` (tokens with the end) and ``ids`` (compressed 32-bit ids)."""
    schema = T.StructType([
        T.StructField("row__", T.LongType()), T.StructField("doc_id", documents.schema[key].dataType), T.StructField("curve", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])

    def run(batches):
        encode, projection, pack = Encoder(packing), Projection(packing), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                docs = [np.array(encode(t), dtype="<u4") for t in part.column(2).to_pylist()]
                keys = projection.keys(docs)
                docs = [np.append(d, np.array([packing.end], dtype="<u4")) for d in docs]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(keys), pa.array([len(d) for d in docs], pa.int64()),
                    pa.array([pack.compress(narrow(d)) for d in docs], pa.binary()),
                ], names=schema.names)

    rows = documents.select(F.monotonically_increasing_id().alias("row__"), F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, schema)


_PIECES = [
    ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_length", pa.int64()),
]


class Packer:
    """Lays documents end to end; ``out`` gathers finished pieces."""

    def __init__(self, length: int, first: int):
        self.length, self.sequence = length, first
        self.open: list[tuple] = []
        self.filled = 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            take = min(len(ids) - at, self.length - self.filled)
            self.open.append((doc_id, at, ids[at : at + take], len(ids)))
            self.filled += take
            at += take
            if self.filled == self.length:
                self._close([self.length])

    def finish(self) -> None:
        """Cut what is open into lengths that are powers of two."""
        self._close([1 << b for b in range(self.filled.bit_length() - 1, -1, -1) if self.filled >> b & 1])

    def _close(self, lengths: list[int]) -> None:
        pieces, self.open, self.filled = self.open[::-1], [], 0
        for length in lengths:
            offset = 0
            while offset < length:
                doc_id, at, ids, total = pieces.pop()
                if len(ids) > length - offset:
                    pieces.append((doc_id, at + length - offset, ids[length - offset :], total))
                    ids = ids[: length - offset]
                self.out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, offset, length))
                offset += len(ids)
            self.sequence += 1


def packed(documents: DataFrame, packing: Packing, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``sequence_length``."""
    rows = stage(tokenised(documents, packing, key, text), "packing-tokens")
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(name, T.LongType()) for name, _ in _PIECES]])

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        packer = Packer(packing.length, TaskContext.get().partitionId() << 40)
        kind = None

        def done():
            out, packer.out = packer.out, []
            columns = list(zip(*out, strict=True)) if out else [[]] * (1 + len(_PIECES))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kind), *[pa.array(c, t) for c, (_, t) in zip(columns[1:], _PIECES, strict=True)]], names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, wide(unpack.decompress(ids.as_py())))
                if len(packer.out) > 10_000:
                    yield done()
        packer.finish()
        if packer.out:
            yield done()

    ordered = rows.repartitionByRange("curve", "doc_id", "row__").sortWithinPartitions("curve", "doc_id", "row__")
    return ordered.select("doc_id", "ids").mapInArrow(run, schema)
