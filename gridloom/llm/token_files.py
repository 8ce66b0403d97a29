"""Token ids as Parquet list columns, in ascending doc_id order, for selective reads of tokens and metadata.

Files hold doc_id, n_tokens and ids. Writer version 2 gives delta or dictionary encodings for the integer columns, row
groups and pages are small enough to skip, and column and offset indexes let a reader fetch the pages of some doc_ids
only. Place in the global id stream is derived on reading, from n_tokens alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import doc_and_text, map_batches
from gridloom.llm.encoding import encoder

#: Ids that a selective read takes; Parquet filters a list of up to ten ids by its values, a longer one by its least and largest.
ASKED = 10_000
#: Writer settings: version 2 pages (delta, dictionary), row groups of 32 MB, pages of 64 KB or 2,000 rows.
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "2000",
    "compression": "zstd",
}


def _encode(documents: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ends, ids = encoder(vocabulary).ended(batch.column(1), end_id)
        edges = np.concatenate([[0], ends])
        lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.view(np.int32)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(edges)), lists], names=["doc_id", "n_tokens", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(documents, run, f"doc_id {kind}, n_tokens long, ids array<int>")


def partitions_for(spark: SparkSession, documents: DataFrame) -> int:
    """Range partitions: as many as the scan has splits, so that a partition's size stays as the input grows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), documents.rdd.getNumPartitions())


def write_token_files(documents: DataFrame, vocabulary: str, path: str, end_id: int = 0) -> None:
    """Encodes every whole text (null: empty), appends end_id, and writes the ids in ascending doc_id order.

    Null doc_ids come first; repeated doc_ids stay, each with its own ids. An empty table gives a folder with no rows.
    The texts are range-partitioned by doc_id, which is near unique, so no partition depends on a hot source.
    """
    spark = documents.sparkSession
    docs = doc_and_text(documents)
    ordered = docs.repartitionByRange(partitions_for(spark, docs), "doc_id").sortWithinPartitions("doc_id")
    _encode(ordered, vocabulary, end_id).write.options(**LAYOUT).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files.

    start counts the ids in the files before it: a prefix sum in two levels, over files in order (one row a file), then over the
    rows of a file as they lie there, so that rows without a doc_id and rows that share one each have their own place.
    """
    stored = spark.read.parquet(path).withColumns({"file": F.col("_metadata.file_name"), "row": F.col("_metadata.row_index")})

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(4)
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy()).astype(np.dtype("<i4"), copy=False)).cast("B")
        edges = (4 * lists.offsets.to_numpy().astype(np.int64)).tolist()
        crcs = [zlib.crc32(raw[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crcs, pa.int64())], names=["doc_id", "n_tokens", "file", "row", "ids_crc32"])

    kind = stored.schema["doc_id"].dataType.simpleString()
    rows = map_batches(stored.select("doc_id", "n_tokens", "file", "row", "ids"), check, f"doc_id {kind}, n_tokens long, file string, row long, ids_crc32 long")
    files = stored.groupBy("file").agg(F.sum("n_tokens").alias("file_tokens"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    before = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("file_tokens").over(before), F.lit(0)).alias("file_start"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(files, "file").select("doc_id", (F.col("file_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and n_tokens of every document; the pages of ids are not read."""
    return spark.read.parquet(path).select("doc_id", "n_tokens")


def read_tokens(spark: SparkSession, path: str, doc_ids: Sequence[int]) -> DataFrame:
    """doc_id, n_tokens, ids of the documents named (at most ASKED of them): a filter that the reader pushes to row groups and pages.

    Files are in order of doc_id, so that statistics rule out most files and row groups, and page indexes most pages of the rest. Ids
    that no document has give no rows, nor does an empty list; documents that share an id each give one.
    """
    if len(doc_ids) > ASKED:
        raise ValueError("join the files with a table of so many ids")
    return spark.read.parquet(path).filter(F.col("doc_id").isin([int(d) for d in doc_ids])).select("doc_id", "n_tokens", "ids")
