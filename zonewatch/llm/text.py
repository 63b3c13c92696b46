"""Words, hashes and grouped streams that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

# What splits words: the six white-space characters of ASCII, as ``bytes.split`` takes them.
SPACE = b" \t\n\x0b\x0c\r"

_U = np.uint64
_MIX1, _MIX2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The texts of a string column as UTF-8, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


class WordHash(dict):
    """64-bit hashes of words, remembered; forgets all when it holds ``most`` words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value mapped to a well-spread one (a bijection)."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


def chained(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each tuple of values, order counting."""
    h = mixed(parts[0] + _GOLD)
    for p in parts[1:]:
        h = mixed((h ^ p) * _GOLD + p)
    return h


def dense(words: list[bytes]) -> tuple[np.ndarray, int]:
    """Words as small integers in order of first sight, and how many there are."""
    seen: dict[bytes, int] = {}
    ids = [seen.setdefault(w, len(seen)) for w in words]
    return np.asarray(ids, dtype=np.int64), len(seen)


def runs(batches: Iterable[pa.RecordBatch], key: str, least: int = 1) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``; a group is never cut.

    Several groups come together until they make up ``least`` rows.
    """
    done: list[pa.RecordBatch] = []
    tail: list[pa.RecordBatch] = []  # the last group so far
    rows, of = 0, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.argmax(keys == keys[-1]))
        if cut or (tail and of != keys[-1]):
            done += tail
            tail = []
        if cut:
            done.append(batch.slice(0, cut))
        tail.append(batch.slice(cut))
        of = keys[-1]
        rows = sum(b.num_rows for b in done)
        if rows >= least:
            yield pa.Table.from_batches(done)
            done = []
    if done or tail:
        yield pa.Table.from_batches([*done, *tail])


def starts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts, and the end."""
    if len(keys) == 0:
        return np.zeros(1, dtype=np.int64)
    return np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]


def narrow(ids: np.ndarray) -> bytes:
    """32-bit ids as bytes that compress well: all low halves, then all high halves, which are mostly zero."""
    ids = ids.astype("<u4", copy=False)
    return (ids & 0xFFFF).astype("<u2").tobytes() + (ids >> 16).astype("<u2").tobytes()


def wide(data: bytes) -> np.ndarray:
    halves = np.frombuffer(data, dtype="<u2").astype("<u4")
    return halves[: len(halves) // 2] | (halves[len(halves) // 2 :] << 16)
