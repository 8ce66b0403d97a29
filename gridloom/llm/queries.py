"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on any machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.toxicity import detect_toxicity

    return detect_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY), limit=512)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.substring_dedup import removed_spans

    return removed_spans(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.common import scratch_path
    from gridloom.llm.token_files import read_token_files, write_token_files

    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY), path, end_id=0)
    return read_token_files(spark, path)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY), capacity=4096, end_id=2)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.html_text import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op7_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.media_jpeg import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.mixing import mix, training_order

    mixed = mix(table(spark, sf_dir, "documents"))
    return training_order(mixed, int(spark.conf.get("spark.sql.shuffle.partitions")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=3)


def op10_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.bm25 import search

    documents = table(spark, sf_dir, "documents")
    # The stated query set: every row whose id is divisible by 20, against all rows.
    return search(documents, documents.filter("doc_id % 20 = 0"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_files": op4_token_files,
    "op5_packing": op5_packing,
    "op6_html_text": op6_html_text,
    "op7_media_jpeg": op7_media_jpeg,
    "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash,
    "op10_bm25": op10_bm25,
}

#: DuckDB SQL for the operators that SQL can express.
ORACLES: dict[str, str] = {
    "op10_bm25": r"""
with words as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) term from documents where doc_id is not null),
tf as (select doc_id, term, count(*) n from words group by all), lengths as (select doc_id, cast(sum(n) as double) length from tf group by 1),
totals as (select (select count(*) from documents where doc_id is not null) docs, (select sum(length) from lengths) / (select count(*) from documents where doc_id is not null) mean),
df as (select term, count(*) df from tf group by 1),
asked as (select doc_id query_id, term, n * ln(1 + (docs - df + 0.5) / (df + 0.5)) weight from tf join df using (term), totals where doc_id % 20 = 0),
scored as (select query_id, tf.doc_id, round(sum(weight * (tf.n * 2.2 / (tf.n + 1.2 * (0.25 + 0.75 * length / mean)))), 9) score
  from asked join tf using (term) join lengths on lengths.doc_id = tf.doc_id, totals group by 1, 2),
ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) as place from scored)
select query_id, cast(place as int) as rank, doc_id, score from ranked where place <= 10""",
}
