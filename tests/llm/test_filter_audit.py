from collections import Counter
from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from zonewatch.llm import filter_audit as A
from tests.llm.cases import AWKWARD, documents, prose


def fails(rows):
    """Failing filters of each (doc_id, part, text), said plainly."""
    out = []
    for ident, _, text in rows:
        text = text or ""
        words = [w for line in text.split("\n") for w in line.replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        f = set()
        if len(words) < 200:
            f.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            f.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
            f.add("C")
        if any(c in "#$%&*|" for c in text):
            f.add("D")
        if ident is not None and any(i is not None and i < ident and (t or "") == text for i, _, t in rows):
            f.add("E")
        out.append(f)
    return out


def plain(rows, good, toxic):
    out = {}
    failing = fails(rows)
    for part in {p or "" for _, p, _ in rows}:
        own = [(r, f) for r, f in zip(rows, failing, strict=True) if (r[1] or "") == part]
        removed = Counter()
        for order in permutations("ABCDE"):
            for r, f in own:
                first = next((x for x in order if x in f), None)
                removed[first] += 1
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(r, f) for r, f in left if x in f]
                redundant = sum(x in f for r, f in own) - len(gone)
                left = [(r, f) for r, f in left if x not in f]
                out[part, "".join(order), step] = (
                    len(left), len(gone), redundant, sum(f == {x} for _, f in own), sum(r[0] in good for r, _ in gone),
                    sum(r[0] in toxic for r, _ in gone), removed[x])
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "m") for r in rows], "doc_id long, lang string, text string, part string, mask int, id string")


def texts():
    long = [p * 40 for p in prose(6, 5, 60, 90)]
    shared = "A passage that all of these share, word for word. " * 30
    many = [shared + f"tail {k % 7} " + "z" * (k % 3) for k in range(40)]
    return AWKWARD + long + long[:3] + many + prose(20, 8) + ["Same text"] * 30 + ["a " * 250 + "#"] * 3


def test_against_plain(spark):
    rows = [(k if k % 11 else None, ["en", "fr", None, ""][k % 4], t) for k, t in enumerate(texts())]
    rows += [(3, "en", "repeated row")] * 2 + [(3, "en", "another text of the same id"), (1, "de", "repeated row")]
    good, toxic = {k for k in range(0, 150, 3)}, {k for k in range(0, 150, 5)}
    labels = spark.createDataFrame(
        [(k, int(k in good), int(k in toxic)) for k in range(120)] + [(6, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    want = plain(rows, good & set(range(120)), toxic & set(range(120)))
    for audit in (A.Audit(), A.Audit(fold_bytes=2000, node_bytes=500, step=2)):
        got = A.audited(table(spark, rows).repartition(5), labels, audit).collect()
        assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in A.COUNTS) for r in got} == want


def test_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audited(documents(spark, ["x"]).where("false"), labels).count() == 0


def test_partitions_stay_light(spark):
    """Texts of one long common start are told apart behind it; equal texts stay together."""
    rows = [(k, "en", "common " * 400 + str(k % 50)) for k in range(400)]
    audit = A.Audit(node_bytes=40_000, fold_bytes=1 << 14)
    split = A.parted(A._folded(table(spark, rows), audit), audit)
    at = split.select("text", F.spark_partition_id().alias("p")).distinct().collect()
    assert len({r.text for r in at}) == len(at) == 50
    assert len({r.p for r in at}) > 10


def test_near_copies_take_few_rounds(spark, monkeypatch):
    """Texts that differ in one character each, anywhere: rounds follow the bits of their length."""
    base = "near copies differ somewhere " * 60
    rows = [(k, "en", base[: 4 * k] + "#" + base[4 * k :]) for k in range(400)]
    audit = A.Audit(node_bytes=20_000)
    texts = A._folded(table(spark, rows), audit)
    rounds, beyond = [], A._beyond
    monkeypatch.setattr(A, "_beyond", lambda cut, step, turn: rounds.append(turn) or beyond(cut, step, turn))
    split = A.parted(texts, audit).groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("text")).alias("b")).collect()
    assert max(rounds) <= 12 and len(split) > 10


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 20)), max_size=40))
def test_trie_holds_least_ids(rows):
    trie, want = A.Trie(), {}
    for text, ident in rows:
        trie.put(text, ident, A.mark(text))
        want[text] = min(ident, want.get(text, ident))
    assert list(trie.terminals()) == [(want[t], A.mark(t)) for t in sorted(want)]


def test_very_long_text():
    trie, long = A.Trie(), b"long " * 1_000_000
    for k, t in enumerate((long + b"a", long + b"b", long, long + b"a")):
        trie.put(t, 9 - k, A.mark(t))
    assert [k for k, _ in trie.terminals()] == [7, 6, 8]
