"""Queries of this subpackage: one per operator, each over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.crosspolytope import nearest
from marlstone.llm.decontaminate import decontaminate
from marlstone.llm.langid import identify_languages
from marlstone.llm.lmscore import score_documents
from marlstone.llm.neardup import near_duplicates
from marlstone.llm.substrings import substring_dedup
from marlstone.llm.token_counts import token_counts
from marlstone.llm.token_files import token_files
from marlstone.llm.toxicity import toxicity
from marlstone.llm.transducer import bpe_round_trip


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_docs(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_docs(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_docs(spark, sf_dir))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_docs(spark, sf_dir))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_docs(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_docs(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_docs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_nearest, op2_language_id, op3_toxicity, op4_near_duplicates, op5_decontamination, op6_token_counts, op7_lm_scores, op8_bpe_round_trip, op9_substring_dedup, op10_token_files)}


#: Windows of 35 words that start more than once, and the words they cover.  The other operators need a tokenizer, a trained model,
#: an edit distance over all places, or a transitive closure over whole tables, and are tested against brute force instead.
OP9_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, list_slice(w, i, i + 34) as k from d, unnest(generate_series(1, len(w) - 34)) as t(i)),
again as (select k from win group by k having count(*) > 1),
gone as (select distinct doc_id, i + j as p from win join again using (k), unnest(generate_series(0, 34)) as u(j)),
word as (select doc_id, p, w[p] as word from d, unnest(generate_series(1, len(w))) as t(p)),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as text from word anti join gone using (doc_id, p) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256
from d left join kept using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_substring_dedup": OP9_SQL}
