"""The registered queries of this package: each applies one operator to a whole given table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewatch.llm import (
    alignment, dimension_scan, filter_audit, html_text, kneser_ney, licences, mixing, near_dup, packing, pii, quality_rules, suffix_tree, token_rollup,
)
from zonewatch.session import checkpoint_dir, ship, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under a name, with its SQL where SQL can say it."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(ship(spark), folder)
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Characters of a word in DuckDB's pattern syntax: all but the six white-space characters of ASCII.
_WORD = r"[^\x20\x09-\x0D]+"

_RULES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{_WORD}') AS words,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM w, unnest(range(1, len(words) - 1)) AS u(i) WHERE len(words) > 2),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, unnest([0, 1, 2]) AS s(k) GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
        length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters,
        length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
        length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_bangs
      FROM w LEFT JOIN covered USING (r)),
f AS (SELECT *, ({" + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(quality_rules.RULES.values()))})::BIGINT AS fail_bits FROM m)
"""
_OF = lambda policy: quality_rules.mask(quality_rules.POLICIES[policy])


@query("op1_quality_rules", _RULES_SQL + f"""
SELECT *, fail_bits & {_OF("base")} != 0 AS base_failed, fail_bits & {_OF(quality_rules.CURRENT)} = 0 AS kept FROM f""")
def op1(spark, folder):
    return quality_rules.ledger(table(spark, folder, "documents")).select("doc_id", "ledger.*").select(
        "*", (~quality_rules.passes(F.col("fail_bits"), "base")).alias("base_failed"),
        quality_rules.passes(F.col("fail_bits")).alias("kept"),
    )


@query("rule_ablations", _RULES_SQL + " UNION ALL ".join(
    f"""SELECT '{p}' AS policy, '{r}' AS rule, count(*) FILTER (fail_bits & {_OF(p)} != 0)::BIGINT AS rejected_docs,
    count(*) FILTER (fail_bits & {_OF(p)} = {quality_rules.mask((r,))})::BIGINT AS only_docs,
    coalesce(sum(n_words) FILTER (fail_bits & {_OF(p)} = {quality_rules.mask((r,))}), 0)::BIGINT AS only_words FROM f
    """ for p, rules in quality_rules.POLICIES.items() for r in rules))
def rule_ablations(spark, folder):
    return quality_rules.ablations(quality_rules.bit_counts(quality_rules.ledger(table(spark, folder, "documents"))))


_NEAR_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS words FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 2], ' ') AS gram FROM w, unnest(range(1, greatest(len(words) - 1, 2))) AS u(i) WHERE len(words) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, m.y) AS component_id, d.doc_id = least(d.doc_id, m.y) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS y FROM r GROUP BY x) m USING (doc_id)"""


@query("op10_minhash_near_dedup", _NEAR_SQL)
def op10(spark, folder):
    return near_dup.near_duplicates(table(spark, folder, "documents"), near_dup.Similarity(words=3, percent=85))


@query("op2_mixing")
def op2(spark, folder):
    return mixing.mixed_sizes(table(spark, folder, "documents"))


@query("op9_quality_classifier")
def op9(spark, folder):
    documents = table(spark, folder, "documents")
    judged = kneser_ney.Classifier(spark, documents, table(spark, folder, "labels")).judged(documents)
    return judged.select("doc_id", "lang", "lm.*")


@query("op8_packing")
def op8(spark, folder):
    return packing.packed(table(spark, folder, "documents"), packing.contract_packing())


@query("op6_suffix_tree")
def op6(spark, folder):
    return suffix_tree.scored(table(spark, folder, "documents"))


_TOXIC_SQL = "SELECT doc_id FROM labels GROUP BY doc_id HAVING max(toxic) = 1"
_POOR_SQL = "SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 0"


@query("op3_token_counts", f"""
WITH d AS (SELECT *, doc_id IN ({_POOR_SQL}) AS poor FROM documents WHERE doc_id NOT IN ({_TOXIC_SQL})),
c AS (
  SELECT source, lang, CASE WHEN poor THEN 'space/2' ELSE 'space/1' END AS tokenizer,
    len(regexp_extract_all(coalesce(text, ''), CASE WHEN poor THEN '[^\\x20\\x09-\\x0D#*$%&|<>]+' ELSE '{_WORD}' END)) AS n FROM d
  UNION ALL SELECT source, lang, 'alnum/1', len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z]+')) FROM d)
SELECT source, lang, tokenizer, count(*)::BIGINT AS docs, sum(n)::BIGINT AS tokens FROM c GROUP BY ALL""")
def op3(spark, folder):
    """All documents come in; those with a toxic label are taken out; those of poor quality are counted anew by a later tokenizer.

    Batches arrive twice, and the totals are compacted between them.
    """
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    marks = labels.groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"), (F.min("quality") == 0).alias("poor"))
    counts = stage(token_rollup.measured(documents, list(token_rollup.TOKENIZERS)).join(marks, "doc_id", "left"), "rollup-counts")
    counts = token_rollup.each(counts)
    old, new = counts.where("tokenizer <> 'space/2'"), counts.where("tokenizer = 'space/2'")
    kept = "poor and not coalesce(toxic, false)"
    batches = {
        "1-all": token_rollup.inserts(old), "2-taken-down": token_rollup.deletes(old.where("toxic")),
        "3-recounted": token_rollup.revisions(old.where("tokenizer = 'space/1'").where(kept), new.where(kept)),
    }
    rollup = token_rollup.Rollup(spark, f"{checkpoint_dir(spark)}/stages/rollup-{uuid.uuid4().hex}")
    for name, changes in batches.items():
        rollup.commit(name, changes)
        rollup.commit(name, changes)
        if name == "2-taken-down":
            rollup.compact()
    return rollup.totals()


# All given pages hold one article element, which is what this takes.
_ARTICLE_SQL = r"""
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    coalesce(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), ''), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'),
    '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM pages)"""


@query("op4_html_extraction", _ARTICLE_SQL)
def op4(spark, folder):
    return html_text.extracted(table(spark, folder, "pages")).drop("main_path")


@query("op5_license_scan")
def op5(spark, folder):
    return licences.scanned(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "licence.*")


@query("op7_dimension_scan")
def op7(spark, folder):
    return dimension_scan.nearest(spark, table(spark, folder, "embeddings"), F.col("id") % 50 == 0)


_AUDIT_STEPS = ", ".join(
    f"('{o}', {s + 1}, {1 << filter_audit.FILTERS.index(f)}, {sum(1 << filter_audit.FILTERS.index(x) for x in o[:s])})"
    for o in filter_audit.ORDERS for s, f in enumerate(o))


@query("op13_filter_audit", f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS words FROM d),
f AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
m AS (SELECT part, (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS mask,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
  FROM w JOIN f USING (text)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
s(filter_order, step, own, earlier) AS (VALUES {_AUDIT_STEPS})
SELECT part, filter_order, step::INTEGER AS step,
  coalesce(sum(n) FILTER (mask & (own | earlier) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & own != 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & own != 0 AND mask & earlier != 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & own != 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & own != 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & own != 0), 0)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step""")
def op13(spark, folder):
    return filter_audit.audited(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op11_pii")
def op11(spark, folder):
    return pii.found(table(spark, folder, "documents"))


@query("op12_alignment")
def op12(spark, folder):
    return alignment.aligned(table(spark, folder, "documents"))
