import hashlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from zonewatch.llm import alignment as A
from tests.llm.cases import AWKWARD, documents, prose

public_tokenizers = pytest.importorskip("public_tokenizers")


def plain(texts):
    """By the libraries' plain calls and loops over all pairs of tokens."""
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = A._byte_letters()
    rows = []
    for text in texts:
        a, b, a_bytes, b_bytes = [], [], [], []
        if text:
            e = first.encode(" " + text, add_special_tokens=False)
            a, a_bytes = e.ids, [bytes(letters[c] for c in t) for t in e.tokens]
            b = second.encode(text)
            b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(b, map(second.id_to_piece, b))]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            rows.append(None)
            continue
        spans = lambda parts: [(sum(map(len, parts[:k])), sum(map(len, parts[: k + 1]))) for k in range(len(parts))]
        sa, sb = spans(a_bytes), spans(b_bytes)
        pairs = [(a[i], b[j]) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[0] < y[1] and y[0] < x[1]]
        common = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, low = [], 0
        for high in common:
            of = lambda ids, s: ",".join(str(k) for k, (p, q) in zip(ids, s) if low <= p and q <= high)  # noqa: B023, E731
            groups.append(of(a, sa) + "|" + of(b, sb))
            low = high
        rows.append((len(a), len(b), groups, pairs))
    docs = {}
    for r in rows:
        for p in set(r[3]) if r else ():
            docs[p] = docs.get(p, 0) + 1
    top = {}
    for (a, _), n in docs.items():
        top[a] = max(n, top.get(a, 0))
    return [
        (r[0], r[1], len(r[2]), len(r[3]), sum(docs[p] == top[p[0]] for p in r[3]), sum(docs[p] for p in r[3]),
         hashlib.sha256(";".join(r[2]).encode()).hexdigest()) if r else (0, 0, 0, 0, 0, 0, "") for r in rows]


TEXTS = [
    *[t[:300] if t else t for t in AWKWARD], "see <|endoftext|> here", "<s> a </s> <unk>", "▁low", "two  spaces   and　wide", "tab\tand\nline\r\n",
    "emoji 👩‍👩‍👧 and ﬁ ligature", "Größe naïve œuvre", "1234567890 3.14 -7", *prose(12, 3, 20, 60), "copy of one", "copy of one",
]


@pytest.mark.parametrize("chunk", [16 << 20, 400])
def test_against_plain(spark, chunk):
    of = A.public_tokenizers()
    of = A.Tokenizers(of.first, of.second, chunk)
    df = documents(spark, TEXTS).withColumnRenamed("n", "chunk").withColumnRenamed("row", "pairs").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in A.aligned(df, of).collect()}
    assert got == dict(enumerate(plain(TEXTS)))


def test_repeated_and_null_ids(spark):
    rows = [(None, "one text"), (1, "one text"), (1, "one text"), (1, None)]
    got = A.aligned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain([t for _, t in rows])
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *w)) for (i, _), w in zip(rows, want, strict=True))


def test_empty_table(spark):
    got = A.aligned(documents(spark, ["x"]).where("false"))
    assert got.count() == 0 and got.columns == ["doc_id", *A.COUNTS, "n_best", "count_sum", "groups_sha256"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=20), st.lists(st.integers(1, 4), min_size=1, max_size=20))
def test_links_are_overlaps(a, b):
    a, b = (a + [sum(b) - sum(a)], b) if sum(a) < sum(b) else (a, b + [sum(a) - sum(b)]) if sum(b) < sum(a) else (a, b)
    ea, eb = np.cumsum(a), np.cumsum(b)
    got = list(zip(*(x.tolist() for x in A.links(ea, eb))))
    assert got == [(i, j) for i in range(len(a)) for j in range(len(b)) if ea[i] - a[i] < eb[j] and eb[j] - b[j] < ea[i]]
    cut_a, cut_b = A.cuts(ea, eb)
    assert ea[cut_a - 1].tolist() == eb[cut_b - 1].tolist() == sorted(set(ea.tolist()) & set(eb.tolist()))
    assert len(got) == len(a) + len(b) - len(cut_a)


def test_very_long_text():
    pair, text = A.Pair(A.public_tokenizers()), " ".join(prose(1, 9, 200_000, 200_000))
    n_a, n_b, groups, n_links, _, codes, times = A._aligned(pair, text)
    assert n_links == n_a + n_b - groups == A.wide(times).sum() and len(A.unpacked(codes)) == len(A.wide(times)) < n_links
