"""From raw documents to token files: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
documents; the last returns what the token files hold.  Between stages the rows are
written to the shared folder and read again, so that lineage ends there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.llm.common import documents, only_kept, release, small, staged
from terrapane.llm.decontaminate import clean
from terrapane.llm.mixing import mixed
from terrapane.llm.near_duplicates import near_duplicates, text_node
from terrapane.llm.quality_rules import passing
from terrapane.llm.registry import tokens_written

#: No SQL: alignments and the tokenizer are beyond it.  tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule.  Null and empty texts fail; repeated rows stay or go together; an empty table stays empty."""
    return passing(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the smallest id, and of rows repeated with that id and text one.

    Null texts are classes of their own and stay.  An empty table stays empty.
    """
    marks = near_duplicates(docs).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_found"), "kept").groupBy("_id", "_found")
    marks = staged(marks.agg(F.count(F.lit(1)).alias("_rows"), F.sum(F.col("kept").cast("long")).alias("_stay")), "marks")
    named = docs.withColumn("_key", text_node("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_key").eqNullSafe(F.col("_found"))
    left = named.join(small(marks.filter("_stay = 0")), same, "left_anti")
    again = marks.filter("_stay > 0 AND _rows > _stay")
    if again.take(1):  # repeated rows
        again = small(again)
        one = left.join(again, same, "left_semi").dropDuplicates(["doc_id", "_key"])
        left = left.join(again, same, "left_anti").unionByName(one)
    return left.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null texts hold none.  Rows with one id have verdicts of their own texts.  An empty benchmark or table changes nothing.
    """
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once, or up to three times.

    A null source is a source of its own.  Null and empty texts have no words; they are taken by their hash alike.
    An empty table stays empty.
    """
    return mixed(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from its token files.

    Null ids come first, a null text has its end token only, repeated rows stand one after another.  An empty table
    makes files without blocks and a result without rows.
    """
    return tokens_written(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What a stage staged for itself goes once its result is written."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before = docs
        with only_kept() as keep:
            docs = keep(staged(stage(spark, docs, sf_dir), name))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
