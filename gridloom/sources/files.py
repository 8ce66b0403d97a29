"""Reading and writing evidence: tables with fixed fields, typed snapshots, plans, logs and samples."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Options of a remote connection that may be set, by the reader's name for them.
CONNECTOR_OPTIONS = {
    "fetch_size": "fetchsize", "push_filters": "pushDownPredicate", "push_aggregates": "pushDownAggregate", "push_limit": "pushDownLimit", "partition_column": "partitionColumn",
    "lower_bound": "lowerBound", "upper_bound": "upperBound", "partitions": "numPartitions", "query_timeout": "queryTimeout",
}
SAMPLE_SCHEMA = "ts_unix double, cpu map<string,double>, meminfo_kb map<string,double>, net map<string,struct<rx_bytes:double,tx_bytes:double>>, tcp map<string,double>, qdisc array<struct<dev:string,dropped:double>>, disk map<string,struct<read_bytes:double,write_bytes:double>>"
DECISION_SCHEMA = "decision_id string, record_type string, recorded_at_unix double, action string, outcome_label string"


def connector_options(**given: str | int | bool) -> dict[str, str]:
    """Options for a JDBC reader; an unknown name is an error, not ignored."""
    unknown = sorted(set(given) - set(CONNECTOR_OPTIONS))
    if unknown:
        raise ValueError(f"unknown connector options: {', '.join(unknown)}")
    return {CONNECTOR_OPTIONS[k]: str(v).lower() if isinstance(v, bool) else str(v) for k, v in given.items()}


def read_remote(spark: SparkSession, url: str, table: str, **options: str | int | bool) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **connector_options(**options)).load()


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header row, blank text is NULL."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def write_csv(df: DataFrame, path: str, fields: list[str], mode: str = "errorifexists") -> None:
    """The fields in that order; other columns are left out, and missing ones are NULL."""
    have = set(df.columns)
    df.select(*[F.col(f) if f in have else F.lit(None).cast("string").alias(f) for f in fields]).write.mode(mode).option("header", True).csv(path)


def write_snapshot(df: DataFrame, path: str, null: str = "\\N") -> list[tuple[str, str]]:
    """Rows as CSV with a NULL token; the columns' names and types are returned."""
    df.write.mode("overwrite").option("header", True).option("nullValue", null).csv(path)
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def read_snapshot(spark: SparkSession, path: str, columns: list[tuple[str, str]], null: str = "\\N") -> DataFrame:
    return spark.read.schema(", ".join(f"`{n}` {t}" for n, t in columns)).option("header", True).option("nullValue", null).csv(path)


def load_table(df: DataFrame, path: str, replace: bool = False) -> None:
    """Writes Parquet; a target with data is refused unless it is to be replaced."""
    df.write.mode("overwrite" if replace else "errorifexists").parquet(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLE_SCHEMA).json(path)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DECISION_SCHEMA).json(path)


def embedded_documents(text: str) -> list[str]:
    """The JSON documents inside a log, in order: every balanced {...} or [...] that parses."""
    found, at, decoder = [], 0, json.JSONDecoder()
    while at < len(text):
        nearest = min((i for i in (text.find("{", at), text.find("[", at)) if i >= 0), default=-1)
        if nearest < 0:
            break
        try:
            value, end = decoder.raw_decode(text, nearest)
        except ValueError:
            at = nearest + 1
            continue
        if isinstance(value, (dict, list)) and "Plan" in json.dumps(value):
            found.append(text[nearest:end])
        at = end
    return found


def read_plan_logs(spark: SparkSession, path: str) -> DataFrame:
    """path, position, document: plans in JSON from server logs, one whole log a row of input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, i, d) for p, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, d in enumerate(embedded_documents(text or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["path", "position", "document"])

    logs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return logs.mapInArrow(run, "path string, position long, document string")
