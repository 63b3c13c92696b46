"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which ids overlap.

Each text is encoded by both tokenizers; cumulative byte ends map to token indexes in two dictionaries. The intersection of
their keys, sorted, cuts both id lists into groups that cover the same bytes. Inside a group a link is a pair of tokens whose
byte ranges overlap: one for each stretch between neighbouring ends of either list.

A link's id pair is counted by the documents that hold it:

1. documents are encoded once, in chunks of ``chunk_bytes`` of text; groups are written as a digest, links as sorted pair codes with their
   number of occurrences;
2. each chunk gives one row for each different pair (so a frequent pair leaves a chunk once), summed over chunks by pair;
3. sums come back to the chunks that hold the pair and meet the chunk's documents there.

What is broadcast is the highest count for each id of the first tokenizer: a row for each id of its vocabulary at most.

Edge cases: texts that are null, empty, or that a tokenizer does not give back byte for byte have no tokens: zeros and an empty digest, and
their pairs count nowhere. Repeated rows and repeated ids are documents of their own. A null id is kept. Ties for the highest count are all
the best. A very long text makes a chunk of its own; its pairs are at most the vocabularies' product. Only the named columns are read, so
others may have any name. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewatch.llm.packing import Encoder, Packing
from zonewatch.llm.text import narrow, starts, wide
from zonewatch.session import stage


@dataclass(frozen=True)
class Tokenizers:
    """A byte-level vocabulary (and, if given, its ranks for the faster library), and a piece model."""

    first: Packing
    second: str
    chunk_bytes: int = 16 << 20


def public_tokenizers() -> Tokenizers:
    import public_tokenizers as P

    return Tokenizers(Packing(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN), P.path("piece_bpe_32k.model"))


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints in Latin-1, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenizers, and the bytes of every id."""

    def __init__(self, of: Tokenizers):
        self.of = of
        self.encode_first = Encoder(of.first)

    @cached_property
    def pieces(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.of.second)

    @cached_property
    def first_bytes(self) -> list[bytes]:
        with open(self.of.first.json, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        letters = _byte_letters()
        out = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            # Added tokens stand in the vocabulary too; they are never given out here.
            out[k] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else b""
        return out

    @cached_property
    def second_bytes(self) -> list[bytes]:
        m = self.pieces
        one = lambda k: bytes([int(m.id_to_piece(k)[3:-1], 16)]) if m.is_byte(k) else m.id_to_piece(k).replace("▁", " ").encode()
        return [one(k) for k in range(m.get_piece_size())]

    @cached_property
    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.fromiter(map(len, b), dtype=np.int64, count=len(b)) for b in (self.first_bytes, self.second_bytes))

    @cached_property
    def written(self) -> np.ndarray:
        """Each id as it stands inside a group and at the end of a list: four runs of one table, padded with zero bytes."""
        return np.array([str(k).encode() + s for b, s in (
            (self.first_bytes, b","), (self.first_bytes, b"|"), (self.second_bytes, b","), (self.second_bytes, b";")) for k in range(len(b))])

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids by both, or None where one of them does not give the text back."""
        if not text:
            return None
        whole = (" " + text).encode()
        b = self.pieces.encode(text)
        if b"".join(map(self.second_bytes.__getitem__, b)) != whole:
            return None
        a = self.encode_first(" " + text)
        a = np.fromiter(a, dtype=np.int64, count=len(a))
        # Byte-level tokens are stretches of the text in order, so they give it back if none of it is missing.
        if int(self.lengths[0][a].sum()) != len(whole):
            return None
        return a, np.fromiter(b, dtype=np.int64, count=len(b))


def cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end: indexes into both lists, one past each group's last token."""
    list_a, list_b = ends_a.tolist(), ends_b.tolist()
    index_a, index_b = dict(zip(list_a, count(1))), dict(zip(list_b, count(1)))
    common = sorted(index_a.keys() & list_b)
    to = lambda index: np.fromiter(map(index.__getitem__, common), dtype=np.int64, count=len(common))
    return to(index_a), to(index_b)


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the tokens of every link, in order: each stretch between neighbouring ends lies in one token of each list."""
    ends = np.concatenate((ends_a, ends_b))
    ends.sort(kind="stable")
    ends = ends[np.r_[True, ends[1:] != ends[:-1]]] if len(ends) else ends
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def digest(pair: Pair, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> str:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3``: the groups' ids, written in one pass."""
    n_a, n_b = (len(x) for x in pair.lengths)
    size_a, size_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    code_a, code_b = a.copy(), b + 2 * n_a
    code_a[cut_a - 1] += n_a
    code_b[cut_b - 1] += n_b
    codes = np.empty(len(a) + len(b), dtype=np.int64)
    codes[np.arange(len(a)) + np.repeat(cut_b - size_b, size_a)] = code_a
    codes[np.arange(len(b)) + np.repeat(cut_a, size_b)] = code_b
    return hashlib.sha256(pair.written[codes].tobytes().translate(None, b"\0")[:-1]).hexdigest()


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _aligned(pair: Pair, text: str | None) -> tuple:
    """Counts, digest, and the different pair codes with their occurrences, of one text."""
    found = pair.tokens(text)
    if found is None:
        return 0, 0, 0, 0, "", b"", b""
    a, b = found
    ends_a, ends_b = (np.cumsum(n[x]) for n, x in zip(pair.lengths, found, strict=True))
    cut_a, cut_b = cuts(ends_a, ends_b)
    at_a, at_b = links(ends_a, ends_b)
    codes = a[at_a] * len(pair.lengths[1]) + b[at_b]
    codes.sort()
    edge = starts(codes)
    codes = codes[edge[:-1]]
    return (
        len(a), len(b), len(cut_a), len(at_a), digest(pair, a, b, cut_a, cut_b),
        narrow(np.diff(codes, prepend=0)), narrow(np.diff(edge)),
    )


def encoded(documents: DataFrame, of: Tokenizers, key: str, text: str) -> DataFrame:
    """One row for each document with its chunk, counts, digest and links."""
    kind = documents.schema[key].dataType
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("doc", kind), *[T.StructField(c, T.LongType()) for c in COUNTS],
        T.StructField("groups", T.StringType()), T.StructField("pairs", T.BinaryType()), T.StructField("times", T.BinaryType()),
    ])

    def run(batches):
        pair = Pair(of)
        if len(pair.first_bytes) * len(pair.second_bytes) >= 2**32:
            raise ValueError("pair codes take 32 bits; these vocabularies need more")
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            # A few texts at a time, so that what a batch of long texts gives isn't held at once.
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows, chunks = [], []
                for t in part.column(1).to_pylist():
                    if size >= of.chunk_bytes:
                        chunk, size = chunk + 1, 0
                    size += 3 * len(t or "") // 2 + 64
                    rows.append(_aligned(pair, t))
                    chunks.append(chunk)
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([
                    pa.array(chunks, pa.int64()), part.column(0), *[pa.array(c, pa.int64()) for c in columns[:4]],
                    pa.array(columns[4], pa.string()), pa.array(columns[5], pa.binary()), pa.array(columns[6], pa.binary()),
                ], names=schema.names)

    return documents.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def unpacked(data: bytes) -> np.ndarray:
    """Pair codes of ``pairs``."""
    return np.cumsum(wide(data).astype(np.int64))


def chunk_pairs(rows: DataFrame) -> DataFrame:
    """The different pairs of each chunk and how many of its documents hold them."""

    def run(batches):
        chunk, held = None, []

        def out():
            if held:
                pairs, n = np.unique(np.concatenate(held), return_counts=True)
                for at in range(0, len(pairs), 65536):
                    p = pairs[at : at + 65536]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(p), chunk)), pa.array(p), pa.array(n[at : at + 65536])], names=["chunk", "pair", "n"])

        for batch in batches:
            for c, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if c != chunk:
                    yield from out()
                    chunk, held = c, []
                if data:
                    held.append(unpacked(data))
        yield from out()

    return rows.select("chunk", "pairs").mapInArrow(run, "chunk long, pair long, n long")


def aligned(documents: DataFrame, of: Tokenizers | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: tokens, groups, links, links with their id's best partner, summed counts, and the groups' digest."""
    of = of or public_tokenizers()
    kind = documents.schema[key].dataType
    rows = stage(encoded(documents, of, key, text), "align-documents", compression="zstd")
    second = len(Pair(of).second_bytes)
    pairs = chunk_pairs(rows).withColumn("docs", F.sum("n").over(Window.partitionBy("pair"))).select("chunk", "pair", "docs")
    pairs = stage(pairs, "align-pairs", compression="zstd").withColumn("a", F.expr(f"pair div {second}"))
    # A row for each id of the first vocabulary, whatever the input.
    best = pairs.groupBy("a").agg(F.max("docs").alias("top"))
    counted = pairs.join(F.broadcast(best), "a").select("chunk", "pair", "docs", (F.col("docs") == F.col("top")).alias("best"))
    schema = T.StructType([
        T.StructField(key, kind), *[T.StructField(c, T.LongType()) for c in [*COUNTS, "n_best", "count_sum"]],
        T.StructField("groups_sha256", T.StringType()),
    ])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs = right.column("pair").to_numpy()
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
        docs, top = right.column("docs").to_numpy()[order], right.column("best").to_numpy(zero_copy_only=False)[order]
        n_best, count_sum = [], []
        for codes, times in zip(left.column("pairs").to_pylist(), left.column("times").to_pylist(), strict=True):
            at, n = np.searchsorted(pairs, unpacked(codes)), wide(times).astype(np.int64)
            n_best.append(int(n[top[at]].sum()))
            count_sum.append(int((n * docs[at]).sum()))
        return pa.Table.from_arrays(
            [left.column("doc"), *[left.column(c) for c in COUNTS], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()),
             left.column("groups")], names=schema.names)

    return rows.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(meet, schema)
