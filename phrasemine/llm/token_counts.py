"""Token counts as rollups that are kept up to date by signed changes.

A batch brings inserts (+), deletes (-) and revised counts (the old one -, the
new one +). Only its sums by source, language and tokenizer version are added to the store,
so totals never need the documents again. A batch counts once however often it is committed.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemine.plans.stage import checkpoint_root, stage

KEYS = ("source", "lang", "version")
SUMS = "source string, lang string, version string, documents long, tokens long, batch string, attempt string"
LOG = "batch string, attempt string"


def counted(docs: DataFrame, tokenizers: Mapping[str, Column]) -> DataFrame:
    """``(doc_id, source, lang, version, tokens)``: each row's count under each tokenizer version.

    ``tokenizers`` gives, by version, a column that counts the tokens of ``text``; null counts as 0.
    """
    versions = F.array(
        *[
            F.struct(F.lit(v).alias("version"), F.coalesce(c, F.lit(0)).cast("long").alias("tokens"))
            for v, c in tokenizers.items()
        ]
    )
    return docs.select("doc_id", "source", "lang", F.explode(versions).alias("c")).select(
        "doc_id", "source", "lang", "c.version", "c.tokens"
    )


def inserted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).alias("sign"), "tokens")


def deleted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).alias("sign"), "tokens")


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes that turn the counts ``before`` into ``after``, whichever rows either has."""
    return deleted(before).unionAll(inserted(after))


class Rollup:
    """Totals in a folder that all executors share.

    The sums of a commit are written under a new name, and one log row makes them count.
    A commit that was broken off has no log row and is not seen; of two
    attempts at a batch one is named by the log. Batches may come in any order.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def log(self) -> DataFrame:
        """``(batch, attempt)`` of the batches that count."""
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.folder}/log/*")
        except AnalysisException:  # nothing is committed yet
            return self.spark.createDataFrame([], LOG)

    def committed(self, batch: str) -> bool:
        return bool(self.log().filter(F.col("batch") == batch).head(1))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds ``changes`` ``(source, lang, version, sign, tokens)``; false if the batch was in already.

        Sums are made in the tasks before the shuffle, so a source that has most
        rows is no hot key. Null keys are a group, null counts are 0.
        """
        if "/" in batch or not batch:
            raise ValueError("a batch is named without slashes")
        if self.committed(batch):
            return False
        attempt = uuid.uuid4().hex
        tokens = F.coalesce(F.col("tokens"), F.lit(0))
        sums = changes.groupBy(*KEYS).agg(
            F.sum("sign").cast("long").alias("documents"), F.sum(F.col("sign") * tokens).cast("long").alias("tokens")
        )
        tagged = sums.withColumns({"batch": F.lit(batch), "attempt": F.lit(attempt)})
        tagged.write.parquet(f"{self.folder}/sums/{attempt}")
        row = self.spark.createDataFrame([(batch, attempt)], LOG)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/log/{batch}")
        return True

    def totals(self) -> DataFrame:
        """``(source, lang, version, documents, tokens)`` over all batches; groups that came to nothing are left out."""
        log = self.log()
        try:
            sums = self.spark.read.schema(SUMS).parquet(f"{self.folder}/sums/*")
        except AnalysisException:
            sums = self.spark.createDataFrame([], SUMS)
        return (
            sums.join(log, ["batch", "attempt"])
            .groupBy(*KEYS)
            .agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
            .filter("documents <> 0 or tokens <> 0")
        )


PATTERNS = {"words": r"[^\x20\x09-\x0D]+", "runs": r"[0-9A-Za-z]+"}


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents, one of them sent twice.

    All documents come in with their words; those that are labelled as bad go; a
    second tokenizer version is added beside the first; and the counts of words are
    revised down where the second version finds fewer tokens. Texts are read once.
    Each row counts, also if its id comes again; a row without an id has no label and stays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    store = Rollup(spark, f"{checkpoint_root(spark)}/phrasemine/{uuid.uuid4().hex}/rollup")
    return rolled_up(store, docs, labels).totals()


def rolled_up(store: Rollup, docs: DataFrame, labels: DataFrame) -> Rollup:
    """The batches of ``op5_token_counts``, committed to ``store``."""
    bad = labels.filter("quality = 0").select("doc_id").distinct()
    # Both counts of a row stay in it, so that no join on ids has to find them again.
    both = docs.select(
        "doc_id", "source", "lang",
        *[F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).cast("long").alias(v) for v, p in PATTERNS.items()],
    )
    both = stage(both, "counts")

    def version(rows: DataFrame, name: str, tokens: str) -> DataFrame:
        return rows.select("source", "lang", F.lit(name).alias("version"), F.col(tokens).alias("tokens"))

    words, left = version(both, "words", "words"), both.join(bad, "doc_id", "left_anti")
    fewer = left.filter("runs < words")
    store.commit("inserts", inserted(words))
    store.commit("deletes", deleted(version(both.join(bad, "doc_id", "left_semi"), "words", "words")))
    store.commit("inserts", inserted(words))
    store.commit("second version", inserted(version(left, "runs", "runs")))
    store.commit("revised", revised(version(fewer, "words", "words"), version(fewer, "words", "runs")))
    return store


OP5_SQL = r"""
WITH counts AS (
  SELECT doc_id, source, lang,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS words,
    coalesce(len(regexp_extract_all(text, '[0-9A-Za-z]+')), 0) AS runs
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))
SELECT source, lang, 'words' AS version, count(*) AS documents, CAST(sum(least(words, runs)) AS BIGINT) AS tokens
FROM counts GROUP BY source, lang
UNION ALL
SELECT source, lang, 'runs', count(*), CAST(sum(runs) AS BIGINT) FROM counts GROUP BY source, lang
"""
