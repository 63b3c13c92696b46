"""Quality rules: a ledger of failure bits, policies over the bits, ablations by bitwise counts.

Every rule is evaluated once for each document. The ledger keeps the measurements and one bit for
each rule that the document fails; a policy is a mask of the bits that reject. Changing a policy, or
asking what a rule alone costs, reads the ledger and never the texts.

Edge cases: a null or empty text has no words and fails ``few_words``; repeated rows are judged one by
one; other columns, whatever their names, are passed on untouched unless the ledger's own name is taken.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewatch.llm.text import SPACE, dense, utf8

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_bangs"]
STRUCT = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])

# Rules as comparisons of whole numbers, written so that Spark and any SQL engine agree. Order gives the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "capitals": "2 * n_capitals > n_letters",
    "bangs": "5 * n_bangs > n_words",
    "repeated_lines": "10 * n_dup_lines > 6 * n_lines",
    "long_words": "word_chars > 100 * n_words",
}
BASE = ("few_words", "repeated_windows")

# Versions of what rejects. A version, once used, stays as it is.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "capitals"),
    "v2": (*BASE, "symbols", "capitals", "bangs", "repeated_lines"),
}
CURRENT = "v2"

_CONTINUED = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123))


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that the text holds twice or more, the first included."""
    n = len(words)
    if n <= width:
        return 0
    ids, kinds = dense(words)
    key = ids[: n - width + 1]
    for k in range(1, width):
        if kinds and key.max() >= 2**62 // kinds:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * kinds + ids[k : n - width + 1 + k]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    again = count[back] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(width):
        covered[k : n - width + 1 + k] |= again
    return int(covered.sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The measurements of one UTF-8 text, in the order of ``MEASURES``."""
    if not text:
        return (0,) * len(MEASURES)
    without = lambda chars: len(text) - len(text.translate(None, chars))
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words), len(text.translate(None, SPACE + _CONTINUED)), without(_SYMBOLS), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), without(_LETTERS), without(_CAPITALS), text.count(b"!"),
    )


@F.arrow_udf(STRUCT)
def _measured(texts: pa.Array) -> pa.Array:
    rows = np.array([measure(t) for t in utf8(texts)], dtype=np.int64).reshape(-1, len(MEASURES))
    return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(MEASURES))], MEASURES)


measured = _measured.asNondeterministic()


def mask(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def ledger(documents: DataFrame, text: str = "text", into: str = "ledger") -> DataFrame:
    """``documents`` with a struct column ``into``: all measurements, and ``fail_bits`` with a bit for each failed rule."""
    df = documents.withColumn(into, measured(F.col(f"`{text}`")))
    named = F.struct(*[F.col(f"`{into}`.{m}").alias(m) for m in MEASURES])
    bits = reduce(lambda a, b: a.bitwiseOR(b), [
        F.when(_test(rule, into), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(RULES.values())
    ])
    return df.withColumn(into, F.struct(named.alias("measured"), bits.alias("fail_bits"))).withColumn(
        into, F.struct(*[F.col(f"`{into}`.measured.{m}").alias(m) for m in MEASURES], F.col(f"`{into}`.fail_bits").alias("fail_bits"))
    )


def _test(rule: str, into: str) -> Column:
    return F.expr(" ".join(f"`{into}`.{w}" if w in MEASURES else w for w in rule.split()))


def passes(bits: Column, policy: str = CURRENT) -> Column:
    return bits.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def bit_counts(ledgered: DataFrame, into: str = "ledger") -> DataFrame:
    """Documents and words for each combination of failure bits: at most 2 to the number of rules rows."""
    return ledgered.groupBy(F.col(f"`{into}`.fail_bits").alias("fail_bits")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(f"`{into}`.n_words").alias("words")
    )


def ablations(counts: DataFrame) -> DataFrame:
    """For each policy and rule of it: documents rejected, and those that only this rule rejects."""
    rows = [(p, r, mask(rules), 1 << list(RULES).index(r)) for p, rules in POLICIES.items() for r in rules]
    fail = lambda m: f"(fail_bits & {m})"
    aggs = []
    for k, (_, _, whole, one) in enumerate(rows):
        aggs += [
            F.expr(f"coalesce(sum(if({fail(whole)} != 0, docs, 0)), 0)").alias(f"r{k}"),
            F.expr(f"coalesce(sum(if({fail(whole)} = {one}, docs, 0)), 0)").alias(f"o{k}"),
            F.expr(f"coalesce(sum(if({fail(whole)} = {one}, words, 0)), 0)").alias(f"w{k}"),
        ]
    entries = F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.col(f"r{k}").alias("rejected_docs"),
                 F.col(f"o{k}").alias("only_docs"), F.col(f"w{k}").alias("only_words"))
        for k, (p, r, _, _) in enumerate(rows)
    ])
    return counts.agg(*aggs).select(F.explode(entries).alias("e")).select("e.*")


def keep_passing(documents: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that the policy passes, with their own columns."""
    name = "__ledger"
    while name in documents.columns:
        name += "_"
    return ledger(documents, into=name).where(passes(F.col(f"{name}.fail_bits"), policy)).select(*[f"`{c}`" for c in documents.columns])
