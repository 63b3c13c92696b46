import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from zonewatch.llm import mixing as M
from zonewatch.llm import packing as P
from tests.llm.cases import AWKWARD, documents, prose


def plain_targets(sizes, most=3):
    """Share by weight; cap; share the excess anew, until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    left, target, free = sum(sizes.values()), {}, list(names)
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            free.remove(s)


def test_mix(spark):
    texts = AWKWARD + prose(300, 4, 20, 200) + ["tiny source"]
    df = documents(spark, texts)
    df = df.selectExpr("doc_id", "text", "case when doc_id % 7 = 0 then 'big' when doc_id = 4 then 'one' else source end as source", "n", "lang as kept")
    rows = M.mixed_sizes(df).collect()
    assert len(rows) == len(texts)
    source = {r.doc_id: r.source for r in df.select("doc_id", "source").collect()}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))
        assert 0 <= r.taken <= 3 * r.size
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(r.source_size == sizes[source[r.doc_id]] for r in rows)
    want = plain_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= max(0.05 * want[s], 3 * M.Mix().block)
    again = M.mixed_sizes(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in rows)
    mixed = M.mixed_documents(df)
    assert mixed.columns == df.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.encode().split())
    assert {k: v for k, v in words.items() if v} == {r.doc_id: r.taken for r in rows if r.taken}


def test_mix_of_nothing(spark):
    assert M.mixed_sizes(documents(spark, [None]).where("false")).count() == 0
    rows = M.mixed_sizes(documents(spark, [None, "", " "])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 3


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    assert sorted(M.permuted(np.arange(n), n, 99)) == list(range(n))


def test_cut_words():
    assert M.cut_words(b" a  b\nc d ", [(0, 2), (3, 4)]) == b"a  b\nd"
    assert M.cut_words(b" a  b\nc d ", [(2, 3), (1, 2)]) == b"b\nc"


def test_hilbert_walks_to_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    key = P.hilbert(grid, 3)
    assert sorted(key) == list(range(512))
    steps = np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


@pytest.mark.parametrize("length", [16, 1024])
def test_round_trip(spark, length):
    from tokenizers import Tokenizer

    packing = P.Packing(**(P.public_packing().__dict__ | {"length": length}))
    exact = Tokenizer.from_file(packing.json)
    exact.encode_special_tokens = True
    texts = AWKWARD + prose(40) + ["über façade naïve ñandú", "«» … – — “quoted” 1 2", "Привет 世界 🎉", "<|endoftext|> plain"]
    df = documents(spark, texts)
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in P.packed(df, packing).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length, r.sequence_length))
    for k, text in enumerate(texts):
        ids = exact.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            part = np.array(ids[at : at + r.length], dtype="<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part))
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, n, whole in sorted(parts):
            assert offset == at
            at += n
        assert at == whole and (at == length or at & (at - 1) == 0)
    assert P.packed(df.where("false"), packing).count() == 0


def test_added_tokens_in_texts(spark):
    """A literal added token gets its own id, as the contract's call gives it, in the fast library's texts and the others."""
    from tokenizers import Tokenizer

    packing = P.contract_packing()
    plain = Tokenizer.from_file(packing.json)
    texts = ["see <|endoftext|> here", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "Привет <|endoftext|> 世界", "<|endoftext| >", *prose(5), None]
    encode = P.Encoder(packing)
    for t in texts:
        assert encode(t) == plain.encode(t or "", add_special_tokens=False).ids
    assert encode(texts[0]) == [3826, 220, 50256, 994]
    got = {r.doc_id: r.doc_tokens for r in P.packed(documents(spark, texts), packing).collect()}
    assert got == {k: len(encode(t)) + 1 for k, t in enumerate(texts)}


def test_mix_keeps_columns_of_any_name(spark):
    names = ["row__", "hash__", "size__", "own", "copy__", "pieces__", "times__", "cut__", "sid"]
    rows = [(k, t, "s", *[f"{n}{k}" for n in names]) for k, t in enumerate(prose(5))]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)
