"""Queries of the text problems, with the SQL each is held against where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.common import read
from quarryline.llm import leakage, lookalike, mixing, residue, topn


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_look_pairs(read(spark, d, "files"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """The same as classes: a row for each entry that has look-alikes, with their number."""
    return lookalike.same_look_classes(read(spark, d, "files"))


def p1_spellings(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.respelled(read(spark, d, "files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.largest_files(read(spark, d, "files")).select("volume_id", "parent_id", "id")


def p3_ranked(spark: SparkSession, d: str) -> DataFrame:
    return topn.largest_files(read(spark, d, "files"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(read(spark, d, "documents"), read(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The largest mixture in which every source with documents has its share."""
    return mixing.mixture(read(spark, d, "documents"), read(spark, d, "source_targets"), mixing.SHARES)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Actual shares of the mixture that meets all shares, and of that as large as its sources, whose small ones reach
    their caps."""
    targets, counted = read(spark, d, "source_targets"), mixing.token_counts(read(spark, d, "documents"))
    both = [mixing.shares(mixing.mix_counted(counted, targets, size), targets).withColumn("size_rule", F.lit(name)) for name, size in (("shares", mixing.SHARES), ("sources", None))]
    return both[0].unionByName(both[1])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(read(spark, d, "documents")).select("doc_id").distinct()


def p9_coverage(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(read(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p1_spellings, p3_found, p3_ranked, p7_found, p8_mixture, p8_shares, p9_found, p9_coverage)}

_RANKED = """SELECT volume_id, parent_id, rn AS rank, size, path, id FROM (
  SELECT *, row_number() OVER (PARTITION BY volume_id, parent_id ORDER BY size DESC, path, id) AS rn FROM (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY changed_ns DESC) AS newest FROM files) WHERE newest = 1)
  WHERE NOT coalesce(is_dir, false) AND size IS NOT NULL) WHERE rn <= 3"""

SQL = {"p3_found": f"SELECT volume_id, parent_id, id FROM ({_RANKED})", "p3_ranked": _RANKED}
