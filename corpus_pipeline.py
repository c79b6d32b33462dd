"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; ``run`` writes every stage's documents and reads them again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weightlake.llm import decontam, jaccard, lines, packing, quality
from weightlake.llm.queries import tokenizer_path
from weightlake.llm.session import cut, shared_folder, table

#: The stages' models and neighbours are not expressible in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the forest keep."""
    counts = cut(quality.count_texts(docs))
    return quality.keep_quality(docs, quality.fit_quality(counts, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document or line has; documents that lose all their lines go."""
    found = lines.dedup_lines(docs, longest=None)
    text = F.col("row.text")
    left = found.where((F.col("n_dropped") == 0) | (F.length(F.btrim(text, F.lit(" \t\n\x0b\f\r"))) > 0))
    fields = [F.char_length(text).cast("long").alias(c) if c == "n_chars" else F.col(f"row.{c}").alias(c) for c in docs.columns]
    return left.select(*fields)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the least id (null first), then the least hash of its text.

    Of rows that repeat id and text the least row stays, by the columns in
    their order; documents without words are in no group and all stay.
    """
    found = cut(jaccard.jaccard_components(docs)).where("n_shingles > 0")
    least = found.groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("least"), F.count("*").alias("n")).where("n > 1")
    # what goes: members of a group other than its first
    gone = found.join(least, "component").where(F.struct("doc_id", "th") != F.col("least")).select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).distinct()
    same = lambda id_col, th_col: (F.col("th") == F.col(th_col)) & F.col("id").eqNullSafe(F.col(id_col))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))
    rows = rows.join(gone, same("gone_id", "gone_th"), "left_anti")
    again = found.groupBy(F.col("doc_id").alias("again_id"), F.col("th").alias("again_th")).count().where("count > 1").drop("count")
    if not again.isEmpty():
        one = rows.join(again, same("again_id", "again_th"), "left_semi").groupBy("id", "th").agg(F.min("row").alias("row"))
        rows = rows.join(again, same("again_id", "again_th"), "left_anti").select("row").unionByName(one.select("row"))
    return rows.select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), short=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack(docs, packing.WordTokenizer(tokenizer_path(), 2))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]


def _drop(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``; the other stages' tables are dropped when the next is written."""
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
        if k:
            _drop(spark, f"{top}/{k - 1}")
    return docs
