"""The corpus pipeline: language ID, near-duplicates, substring deduplication, decontamination, BPE encoding.

Every stage takes the documents its predecessor kept and returns the columns of ``documents``, the last one the
encoded documents.  Texts that a stage changes have their ``n_chars`` brought up to date; no stage caps or samples.

* language ID keeps a document unless no language is found in it (no text, or no letter) or the best score is under
  ``LEAST_SCORE``; it replaces ``lang`` by the language found;
* near-duplicates keeps one document of every class, whatever its id: the one with the least id, nulls last, once;
* substring deduplication takes out passages of 35 words or more that occur again, and leaves other texts as they are;
* decontamination drops documents that hold a benchmark item;
* encoding returns ``doc_id``, ``source``, ``lang``, ``n_tokens`` and the digests of the ids and of the decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.decontaminate import decontaminate
from marlstone.llm.langid import identify_languages
from marlstone.llm.neardup import near_duplicates
from marlstone.llm.shared import written
from marlstone.llm.substrings import substring_dedup
from marlstone.llm.transducer import bpe_round_trip

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.2
#: Rows that go to a Python worker at a time, unless the session says otherwise: operators cut what comes into pieces of a few MB anyway.
ROWS = 2000


def modest(spark: SparkSession) -> None:
    """Small batches to Python workers, whose rows are whole texts here."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > ROWS:
        spark.conf.set(name, ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; ``lang`` is the one found."""
    modest(spark)
    found = identify_languages(docs, keep=("text", "source", "n_chars"))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class: the one with the least id, nulls last; of rows with that id, one text, chosen by its digest, once."""
    modest(spark)
    docs = docs.withColumn("row", F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5("text"))))
    kept = near_duplicates(docs, row_col="row").where(F.col("row") == F.col("first_row")).select("row").distinct()
    return docs.join(kept, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages."""
    modest(spark)
    left = substring_dedup(docs, outputs=("n_removed", "kept"), keep=("text", "lang", "source", "n_chars"))
    cut = F.col("n_removed") > 0
    return left.select("doc_id", F.when(cut, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(cut, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    modest(spark)
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS[1:])
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, as digests."""
    modest(spark)
    return bpe_round_trip(docs, keep=("source", "lang"))


STAGES = [("language_id", language_id), ("near_duplicates", one_of_each), ("substrings", without_repeats), ("decontamination", decontaminated), ("encoding", encoded)]
#: No SQL: language ID and decontamination can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
