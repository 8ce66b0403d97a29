"""What this engine did for a query: its executed plan and metrics as plan nodes, catalog facts, and layout of tables."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans.control import Intervention

METRICS = {"actual_rows": "numOutputRows", "spill_bytes": "spillSize", "peak_memory": "peakMemory", "data_bytes": "dataSize", "shuffle_rows": "shuffleRecordsWritten", "shuffle_bytes": "shuffleBytesWritten"}
SCHEMA = "node_id int, parent_node_id int, depth int, node_path string, node_type string, " + ", ".join(f"{m} long" for m in METRICS)


def _children(node) -> list:
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if name.endswith("QueryStageExec"):
        return [node.plan()]
    seq = node.children()
    return [seq.apply(i) for i in range(seq.size())]


def _walk(root) -> Iterator[tuple]:
    todo, number = [(root, None, 0, "0")], 0
    while todo:
        node, parent, depth, path = todo.pop()
        if node.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "WholeStageCodegenExec", "InputAdapter") or node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo += [(c, parent, depth, path) for c in _children(node)]
            continue
        metrics = node.metrics()
        values = [metrics.apply(m).value() if metrics.contains(m) else None for m in METRICS.values()]
        yield (number, parent, depth, path, node.nodeName(), *values)
        children = _children(node)
        todo += [(c, number, depth + 1, f"{path}.{i}") for i, c in reversed(list(enumerate(children)))]
        number += 1


def profile(df: DataFrame) -> tuple[DataFrame, float]:
    """Runs the query to its end, without keeping rows; its plan nodes with metrics, and seconds."""
    execution = df._jdf.queryExecution()
    began = time.perf_counter()
    execution.toRdd().count()
    seconds = time.perf_counter() - began
    return df.sparkSession.createDataFrame(list(_walk(execution.executedPlan())), SCHEMA), seconds


def pushed_filters(df: DataFrame) -> list[str]:
    """What the scans say about filters that reached them."""
    # Long descriptions are cut short otherwise.
    with Intervention(df.sparkSession, {"spark.sql.maxMetadataStringLength": "100000"}):
        text = df._jdf.queryExecution().executedPlan().toString()
    return [part.split("]")[0] for part in text.split("PushedFilters: [")[1:]]


def exchanges(df: DataFrame) -> int:
    """Shuffles that the plan asks for, before adaptive changes."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") + df._jdf.queryExecution().executedPlan().toString().count("Exchange SinglePartition")


def catalog_tables(spark: SparkSession) -> DataFrame:
    """name, kind, temporary, columns of the tables and views in sight."""
    rows = [(t.name, t.tableType, t.isTemporary, len(spark.table(t.name).columns)) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, kind string, temporary boolean, columns int")


def partition_rows(df: DataFrame) -> DataFrame:
    """Rows of each partition: the placement of shards."""
    from pyspark.sql import functions as F

    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("rows"))


def write_bucketed(df: DataFrame, table: str, buckets: int, *keys: str) -> None:
    """A table whose joins and aggregates on the keys need no shuffle; files are sorted by them."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    df.sparkSession.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
