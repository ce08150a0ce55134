"""Queries p7_ to p9_ and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.leakage import leaks
from gridspark.llm.mixing import Mix
from gridspark.llm.subjects import subject_areas


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    """The longest leaked passage of each item in each document, with its place in the original text."""
    return leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items"), where=True)


def _mix(spark: SparkSession, d: str) -> Mix:
    return Mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).short


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).chosen


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report


def p8_reach(spark: SparkSession, d: str) -> DataFrame:
    """What each source has and whether it can reach its target."""
    return _mix(spark, d).reach


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subject_areas(_table(spark, d, "documents"), _table(spark, d, "topic_labels"), _table(spark, d, "subject_areas"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d)


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source by subject (NULL: none)."""
    s = _subjects(spark, d).withColumnRenamed("doc_id", "id")
    docs = _table(spark, d, "documents").select("doc_id", "source")
    return docs.join(s, F.col("doc_id") == F.col("id"), "left").groupBy("source", "subject").agg(F.count_distinct("doc_id").alias("documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p7_found, p7_passages, p8_found, p8_mix, p8_shares, p8_reach, p9_found, p9_composition)}


#: sizes in characters: every source is far enough from its limit that the unit does not matter
_REACH = """
WITH o AS (SELECT source, count(*) AS own_docs, coalesce(sum(length(text)), 0) AS own FROM documents GROUP BY source),
t AS (SELECT m.source, m.target_share, m.max_repeats, coalesce(o.own_docs, 0) AS own_docs,
             m.target_share * (SELECT sum(length(text)) FROM documents) <= m.max_repeats * coalesce(o.own, 0) AS reached
      FROM mix_targets m LEFT JOIN o ON o.source = m.source)
"""


def oracle_sql() -> dict[str, str]:
    return {"p8_found": _REACH + "SELECT source FROM t WHERE NOT reached", "p8_reach": _REACH + "SELECT source, target_share, max_repeats, own_docs, reached FROM t"}
