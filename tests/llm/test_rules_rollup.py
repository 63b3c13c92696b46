import re

import pytest
from pyspark.sql import functions as F

from zonewatch.llm import quality_rules as Q
from zonewatch.llm import token_rollup as R
from tests.llm.cases import AWKWARD, documents, prose

JUNK = ["LOUD!! WORDS!! " * 40, "a*** b%%% c### " * 30, "same line here\n" * 30, "x | y | z | " * 30]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)),
        len(covered), len(lines), len(re.findall("[A-Za-z]", text)), len(re.findall("[A-Z]", text)), text.count("!"))


def test_measures_against_plain(spark):
    texts = AWKWARD + prose(20) + JUNK
    got = Q.ledger(documents(spark, texts)).orderBy("doc_id").select("ledger.*").collect()
    for row, text in zip(got, texts, strict=True):
        want = dict(zip(Q.MEASURES, plain(text), strict=True))
        assert {m: row[m] for m in Q.MEASURES} == want
        bits = sum(bool(eval(rule, {}, want)) << k for k, rule in enumerate(Q.RULES.values()))  # noqa: S307
        assert row.fail_bits == bits


def test_policies_and_ablations(spark):
    texts = AWKWARD + prose(20, 3, 60, 90) + JUNK
    df = documents(spark, texts)
    kept = Q.keep_passing(df)
    assert kept.columns == df.columns
    bits = [r.b for r in Q.ledger(df).select(F.col("ledger.fail_bits").alias("b")).collect()]
    assert kept.count() == sum(not b & Q.mask(Q.POLICIES[Q.CURRENT]) for b in bits) >= 20
    for row in Q.ablations(Q.bit_counts(Q.ledger(df))).collect():
        whole, one = Q.mask(Q.POLICIES[row.policy]), Q.mask((row.rule,))
        assert (row.rejected_docs, row.only_docs) == (sum(bool(b & whole) for b in bits), sum((b & whole) == one for b in bits))
    empty = df.where("false")
    assert Q.keep_passing(empty).count() == 0
    assert {r.rejected_docs for r in Q.ablations(Q.bit_counts(Q.ledger(empty))).collect()} == {0}


def test_rollup(spark, tmp_path):
    df = documents(spark, AWKWARD + prose(10))
    counts = R.counted(df, ["space/1", "alnum/1"])
    roll = R.Rollup(spark, f"file://{tmp_path}/rollup")
    assert roll.totals().count() == 0
    assert roll.commit("a", R.inserts(counts)) and not roll.commit("a", R.inserts(counts))
    assert roll.commit("b", R.deletes(counts.where("doc_id % 2 = 0")))
    after = R.counted(df.where("doc_id % 2 = 1"), ["space/2"])
    roll.compact()
    assert roll.commit("c", R.revisions(counts.where("doc_id % 2 = 1 and tokenizer = 'space/1'"), after))
    assert not roll.commit("b", R.deletes(counts)) and roll.batches() == {"a", "b", "c"}
    odd = df.where("doc_id % 2 = 1")
    want = R.summed(R.inserts(R.counted(odd, ["space/2", "alnum/1"])))
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert rows(roll.totals()) == rows(want)
    roll.compact()
    assert rows(roll.totals()) == rows(want)
    # What a broken write leaves has no marker and isn't counted; the batch can be committed again.
    broken = tmp_path / "rollup/batch/d"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")
    assert rows(roll.totals()) == rows(want)
    assert roll.commit("d", R.inserts(counts.where("false"))) and rows(roll.totals()) == rows(want)


@pytest.mark.parametrize("text,want", [("a b a b a b", 6), ("a a a", 0), ("a a a a", 4), ("x y z q x y z", 6)])
def test_repeated_words(text, want):
    assert Q.repeated_words(text.encode().split()) == want
