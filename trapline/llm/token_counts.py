"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums, so they follow changes without a
new pass over the corpus: an insert adds a document's count, a delete takes it away, a
revision takes the old count away and adds the new one, under whichever key each belongs. A
batch of signed changes is reduced to one row per key and written as one table named after
the batch; Spark publishes it whole (its _SUCCESS file) or not at all. A batch that is
there is not applied again, so a retry after a lost driver or executor changes nothing.
`compact` folds batches into a snapshot and writes their names to a table beside it, first the
names, then the totals. One writer at a time: two that commit the same batch together overwrite
each other's table with the same rows, two that compact together need a lock of their own.

Native: DataFrame expressions only. Sums combine before the shuffle, so a hot source costs
one row per task.

Defined cases: a null or empty text has no tokens and is one document; null source or
language is a key of its own; repeated rows count each; a change without a count counts as
zero tokens; an empty batch is committed and changes nothing; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime as R

KEY = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"

#: Patterns of the versions that are plain expressions (RE2 and Java agree on them).
WORDS = r"[^\x20\x09-\x0D]+"
PIECES = r"[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]"


def counted(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)).cast("long"), F.lit(0).cast("long"))


def inserts(rows: DataFrame, tokenizer: str, tokens: str | Column, sign: int = 1) -> DataFrame:
    """Signed changes from rows (source, lang, and a count)."""
    n = F.col(tokens) if isinstance(tokens, str) else tokens
    return rows.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("docs"), (F.coalesce(n.cast("long"), F.lit(0)) * sign).alias("tokens"))


def deletes(rows: DataFrame, tokenizer: str, tokens: str | Column) -> DataFrame:
    return inserts(rows, tokenizer, tokens, -1)


def revisions(rows: DataFrame, old: str, old_tokens: str | Column, new: str, new_tokens: str | Column) -> DataFrame:
    return deletes(rows, old, old_tokens).unionByName(inserts(rows, new, new_tokens))


class Rollup:
    """Totals under a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _published(self) -> dict[str, set[str]]:
        """Tables that are whole, and the batches each holds."""
        out = {}
        root = self._Path(self.path)
        for s in self._fs.listStatus(root) if self._fs.exists(root) else []:
            kind, _, name = s.getPath().getName().partition("=")
            if kind != "names" and self._fs.exists(self._Path(f"{self.path}/{kind}={name}/_SUCCESS")):
                out[f"{kind}={name}"] = {name} if kind == "batch" else {x.batch for x in self.spark.read.parquet(f"{self.path}/names={name}").collect()}
        return out

    def _live(self) -> tuple[list[str], set[str]]:
        """Tables to sum (a snapshot hides the tables it holds) and the batches committed."""
        tables = self._published()
        names = [n for n, held in tables.items() if not any(held < other for other in tables.values())]
        return sorted(names), set().union(*tables.values(), set())

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch once; False if it was applied before."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"a batch can't be named {batch!r}")
        if batch in self._live()[1]:
            return False
        changes.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0").select(*KEY, "docs", "tokens").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        names, _ = self._live()
        every = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], SCHEMA)
        return every.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        names, held = self._live()
        if len(names) > 1:
            n = 1 + max([-1, *(int(x.partition("=")[2]) for x in self._published() if x.startswith("snapshot="))])
            self.spark.createDataFrame([(x,) for x in sorted(held)], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/names={n}")
            self.totals().coalesce(1).write.mode("overwrite").parquet(f"{self.path}/snapshot={n}")
            for x in names:
                R.drop(self.spark, f"{self.path}/{x}")
                if x.startswith("snapshot="):
                    R.drop(self.spark, f"{self.path}/{x.replace('snapshot', 'names')}")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """All documents are inserted under tokenizer words-1 and pieces-1, later copies of a text are
    deleted, and what remains under words-1 is revised to words-2 (words of two characters or more). Every
    batch is delivered twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = F.col("text")
    counts = R.cut(docs.select("doc_id", "source", "lang", F.md5(t.cast("binary")).alias("key"), counted(t, WORDS).alias("w1"), counted(t, r"[^\x20\x09-\x0D]{2,}").alias("w2"), counted(t, PIECES).alias("p1")))
    first = counts.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    copies = counts.join(first, "key").where(F.col("doc_id") > F.col("first"))
    kept = counts.join(first, "key", "left").where("first is null or doc_id <= first or doc_id is null")
    rollup = Rollup(spark, R.scratch(spark, "token-counts"))
    batches = {
        "load": inserts(counts, "words-1", "w1").unionByName(inserts(counts, "pieces-1", "p1")),
        "copies": deletes(copies, "words-1", "w1").unionByName(deletes(copies, "pieces-1", "p1")),
        "words-2": revisions(kept, "words-1", "w1", "words-2", "w2"),
    }
    for _ in range(2):
        for name, changes in batches.items():
            rollup.commit(name, changes)
    rollup.compact()
    return rollup.totals()


OP5_SQL = r"""
WITH d AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents),
k AS (SELECT source, lang, coalesce(text, '') AS text FROM d WHERE text IS NULL OR doc_id IS NULL OR doc_id <= first_id),
n AS (SELECT source, lang, len(regexp_extract_all(text, '[^\x20\x09-\x0D]{2,}')) AS w2, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]')) AS p1 FROM k)
SELECT source, lang, 'words-2' AS tokenizer, count(*)::BIGINT AS docs, sum(w2)::BIGINT AS tokens FROM n GROUP BY source, lang
UNION ALL
SELECT source, lang, 'pieces-1' AS tokenizer, count(*)::BIGINT AS docs, sum(p1)::BIGINT AS tokens FROM n GROUP BY source, lang
"""
