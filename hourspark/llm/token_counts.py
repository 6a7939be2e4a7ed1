"""Token counts as delta-maintained rollups with idempotent batch commits.

A document is a (doc_id, text_key): rows without an id, or of one id, are told apart by a key of their text, and rows
that are equal in both are copies of one document.

A store is a folder of tables, written by Spark's committers:

* ``ledger/batch=<id>``: the state (source, lang, tokens, copies, or deleted) that a batch gave each (document, version)
* ``totals/batch=<id>``: the batch's signed sums of documents and tokens by source, language and version
* ``commits/batch=<id>``: one row, written last; what has none does not count
* ``state/upto=<n>``: the state after commit n, if ``compact`` wrote it; older ledgers are not read from then on

A batch is turned into signed deltas: minus the last committed state, plus the new one.  Totals are additive, so
reading them adds a few rows a batch and never goes back to documents.  A batch that is committed already is
left alone; one that broke off is written again.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

_COMMITS = "batch string, ordinal long"
_STATE = "doc_id long, text_key string, version string, source string, lang string, tokens long, copies long, live boolean"
_TOTALS = "batch string, source string, lang string, version string, documents long, tokens long"
_KEY = ["doc_id", "text_key", "version"]


def _table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(os.path.join(folder, name))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _states(spark: SparkSession, folder: str) -> DataFrame:
    """All committed states with their ordinals, from the last compacted one on."""
    commits = F.broadcast(_table(spark, folder, "commits", _COMMITS))  # a row a batch
    whole = _table(spark, folder, "state", f"{_STATE}, upto long")
    upto = whole.agg(F.coalesce(F.max("upto"), F.lit(0))).first()[0]
    later = _table(spark, folder, "ledger", f"{_STATE}, batch string").join(commits.where(F.col("ordinal") > upto), "batch").drop("batch")
    return later.unionByName(whole.where(F.col("upto") == upto).withColumnRenamed("upto", "ordinal"))


def _latest(states: DataFrame) -> DataFrame:
    last = Window.partitionBy(*_KEY).orderBy(F.col("ordinal").desc())
    return states.withColumn("n", F.row_number().over(last)).where("n = 1 AND live").drop("n", "ordinal")


def _claimed(spark: SparkSession, folder: str, least: int) -> int:
    """An ordinal from ``least`` on that no other writer has: a file that only one of them can create."""
    jvm = spark._jvm
    while True:
        path = jvm.org.apache.hadoop.fs.Path(os.path.join(folder, "ordinals", str(least)))
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(path):
            return least
        least += 1


def commit(spark: SparkSession, folder: str, batch: str, changes: DataFrame) -> bool:
    """Commit ``changes`` (doc_id, version, source, lang, tokens, op 'put' or 'delete') as ``batch``.

    False if the batch was committed before.  ``changes`` may have text_key (else all rows of an id are one
    document) and copies (else 1; the number a put leaves).  Of changes of one (document, version) in a batch a
    put wins over a delete and the largest (tokens, source, lang, copies) over others; null counts are 0; null ids
    are an id.  Deletes of unknown documents and empty batches change nothing.  A commit reads the ledger's keys
    and ranks the states of its own documents alone.
    """
    commits = _table(spark, folder, "commits", _COMMITS)
    if not commits.where(F.col("batch") == batch).isEmpty():
        return False
    key = F.coalesce("text_key", F.lit("")) if "text_key" in changes.columns else F.lit("")
    copies = F.coalesce("copies", F.lit(1)) if "copies" in changes.columns else F.lit(1)
    state = F.struct((F.col("op") == "put").alias("live"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), "source", "lang", copies.cast("long").alias("copies"))
    news = changes.groupBy("doc_id", key.alias("text_key"), "version").agg(F.max(state).alias("s")).select(*_KEY, "s.*")
    where = os.path.join(folder, "ledger", f"batch={batch}")
    news.write.mode("overwrite").parquet(where)
    news = spark.read.schema(_STATE).parquet(where)
    keys = news.select(*[F.col(c).alias(f"_{c}") for c in _KEY])
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key")) & (F.col("version") == F.col("_version"))
    gone = _latest(_states(spark, folder).join(keys, same, "left_semi"))
    signed = gone.withColumn("sign", F.lit(-1)).unionByName(news.where("live").withColumn("sign", F.lit(1)))
    counted = F.col("sign") * F.col("copies")
    sums = signed.groupBy("source", "lang", "version").agg(F.sum(counted).alias("documents"), F.sum(counted * F.col("tokens")).alias("tokens"))
    sums.write.mode("overwrite").parquet(os.path.join(folder, "totals", f"batch={batch}"))
    ordinal = _claimed(spark, folder, commits.agg(F.coalesce(F.max("ordinal"), F.lit(0)) + 1).first()[0])
    spark.createDataFrame([(ordinal,)], "ordinal long").coalesce(1).write.mode("overwrite").parquet(os.path.join(folder, "commits", f"batch={batch}"))
    return True


def compact(spark: SparkSession, folder: str) -> None:
    """Write the state after all commits so far, so that later commits read it and the ledgers after it."""
    last = _table(spark, folder, "commits", _COMMITS).agg(F.max("ordinal")).first()[0]
    if last is not None:
        _latest(_states(spark, folder)).write.mode("overwrite").parquet(os.path.join(folder, "state", f"upto={last}"))


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """(source, lang, version, documents, tokens) over all committed batches; groups without documents are gone."""
    commits = F.broadcast(_table(spark, folder, "commits", _COMMITS))
    rows = _table(spark, folder, "totals", _TOTALS).join(commits, "batch")
    return rows.groupBy("source", "lang", "version").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0")


def puts(counted: DataFrame, version: str, tokens: Column, op: str = "put") -> DataFrame:
    """Changes of ``counted`` (doc_id, source, lang, and text_key and copies if it has them)."""
    own = [c for c in ("text_key", "copies") if c in counted.columns]
    return counted.select("doc_id", *own, F.lit(version).alias("version"), "source", "lang", tokens.cast("long").alias("tokens"), F.lit(op).alias("op"))
