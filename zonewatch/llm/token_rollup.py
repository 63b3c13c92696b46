"""Token counts: rollups kept up by signed changes, committed in batches that can be repeated.

A rollup is a folder. A batch is a table of changes: inserts add a document and its tokens, deletes take
them off, revisions take off what was counted and add what is counted now (also under another source, language or tokenizer). Each batch is summed by
``(source, lang, tokenizer)`` and written to a folder of its own, named by the batch; Spark's own marker of a finished write commits it.
A batch that is committed already is left alone, one that broke off is written again, so repeating never counts twice.
Totals are the sums over all committed batches; compaction writes them as a base that names the batches it covers.

Sums are partial in each task, so a source with a third of all rows is no burden. Batches hold sums only: their size follows
the number of groups, not of documents.

Edge cases: null text has 0 tokens but is a document; null source or language is a group; a group whose
documents and tokens are all taken off disappears; repeated rows count each; an empty batch commits and changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ["source", "lang", "tokenizer"]
#: Sums are small; so many files at most hold those of a batch, however many partitions a shuffle has.
WRITERS = 16

# Tokenizer versions as patterns of a token.
TOKENIZERS = {"space/1": r"[^\x20\x09-\x0D]+", "space/2": r"[^\x20\x09-\x0D#*$%&|<>]+", "alnum/1": r"[0-9A-Za-z]+"}


def counted(documents: DataFrame, tokenizers: list[str], text: str = "text") -> DataFrame:
    """``doc_id``, ``source``, ``lang``, ``tokenizer``, ``tokens`` for each document and tokenizer version."""
    return each(measured(documents, tokenizers, text))


def measured(documents: DataFrame, tokenizers: list[str], text: str = "text") -> DataFrame:
    """``doc_id``, ``source``, ``lang`` and ``counts``, an entry for each tokenizer version: one row a document."""
    count = lambda name: F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(TOKENIZERS[name])), F.lit(0)).cast("long")
    entries = F.array(*[F.struct(F.lit(t).alias("tokenizer"), count(t).alias("tokens")) for t in tokenizers])
    return documents.select("doc_id", "source", "lang", entries.alias("counts"))


def each(counts: DataFrame) -> DataFrame:
    """``counts`` from ``measured``, with any further columns, as one row for each tokenizer version."""
    rest = [c for c in counts.columns if c != "counts"]
    return counts.select(*rest, F.explode("counts").alias("e")).select(*rest, "e.*")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(1).cast("long").alias("docs"), "tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    return deletes(before).unionByName(inserts(after))


def summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Totals by source, language and tokenizer version in ``folder``, any that Spark can write to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _names(self, kind: str) -> list[str]:
        """Finished folders of a kind, by Spark's marker."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(path):
            return []
        found = [s.getPath() for s in store.listStatus(path) if s.isDirectory()]
        return sorted(p.getName() for p in found if store.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _base(self) -> tuple[str | None, set[str]]:
        names = self._names("base")
        if not names:
            return None, set()
        row = self.spark.read.parquet(f"{self.folder}/covers/{names[-1]}").first()
        return names[-1], set(json.loads(row.batches))

    def batches(self) -> set[str]:
        return self._base()[1] | set(self._names("batch"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Count ``changes`` in under the name ``batch``; False if that batch is counted already."""
        if batch in self.batches():
            return False
        summed(changes).coalesce(WRITERS).write.mode("overwrite").parquet(f"{self.folder}/batch/{batch}")
        return True

    def totals(self) -> DataFrame:
        base, covered = self._base()
        paths = [f"{self.folder}/batch/{b}" for b in self._names("batch") if b not in covered]
        paths += [f"{self.folder}/base/{base}"] if base else []
        if not paths:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, docs long, tokens long")
        return summed(self.spark.read.parquet(*paths)).where("docs != 0 or tokens != 0")

    def compact(self) -> None:
        """Write the totals as a new base. What it covers is written first, so a base that is finished is whole."""
        names = self._names("base")
        name = f"{int(names[-1]) + 1 if names else 0:08d}"
        batches = json.dumps(sorted(self.batches()))
        self.spark.createDataFrame([(batches,)], "batches string").write.mode("overwrite").parquet(f"{self.folder}/covers/{name}")
        self.totals().coalesce(WRITERS).write.mode("overwrite").parquet(f"{self.folder}/base/{name}")
