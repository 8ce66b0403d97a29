"""Execution plans as tables: trees flattened to nodes, edges, fingerprints, and what a plan's shape says."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Plan fields by node column.
FIELDS = {
    "node_type": "Node Type", "strategy": "Strategy", "join_type": "Join Type", "group_key": "Group Key", "sort_key": "Sort Key", "relation_name": "Relation Name",
    "remote_sql_text": "Remote SQL", "plan_rows": "Plan Rows", "plan_width": "Plan Width", "actual_total_time": "Actual Total Time", "actual_rows": "Actual Rows", "actual_loops": "Actual Loops",
    "shared_hit_blocks": "Shared Hit Blocks", "shared_read_blocks": "Shared Read Blocks", "temp_read_blocks": "Temp Read Blocks", "temp_written_blocks": "Temp Written Blocks",
    "sort_method": "Sort Method", "sort_space_used": "Sort Space Used", "sort_space_type": "Sort Space Type", "hash_batches": "Hash Batches", "disk_usage": "Disk Usage", "peak_memory_usage": "Peak Memory Usage",
}
NUMBERS = {"plan_rows", "plan_width", "actual_total_time", "actual_rows", "actual_loops", "shared_hit_blocks", "shared_read_blocks", "temp_read_blocks", "temp_written_blocks", "sort_space_used", "hash_batches", "disk_usage", "peak_memory_usage"}
#: Fields that make a plan's structure, the text of conditions without its literals; times, rows and costs don't.
STRUCTURAL = (
    "Node Type", "Strategy", "Partial Mode", "Parallel Aware", "Join Type", "Parent Relationship", "Relation Name", "Index Name", "Function Name", "Schema", "Alias", "Group Key", "Sort Key",
    "Hash Cond", "Merge Cond", "Join Filter", "Filter", "Index Cond", "Recheck Cond", "Remote SQL",
)
LITERAL = re.compile(r"(?P<word>[^\W\d]\w*)|'(?:[^']|'')*'|\d+(?:\.\d+)?")
NODE_SCHEMA = "plan_id string, node_id int, parent_node_id int, child_index int, depth int, node_path string, " + ", ".join(f"{k} {'double' if k in NUMBERS else 'string'}" for k in FIELDS)
BLOCKING = ("Sort", "Aggregate", "HashAggregate", "Hash", "Materialize", "WindowAgg", "Incremental Sort", "GroupAggregate")


def _root(document: Any) -> dict:
    while isinstance(document, list):
        document = document[0]
    return document.get("Plan", document)


def flatten(plan_id: str, document: Any) -> list[tuple]:
    """Rows of a plan tree in pre-order, the root's path '0', its children's '0.0', '0.1' and so on."""
    rows: list[tuple] = []
    todo: list[tuple] = [(_root(document), None, 0, 0, "0")]
    while todo:
        node, parent, child, depth, path = todo.pop()
        number = len(rows)
        values = []
        for column, name in FIELDS.items():
            value = node.get(name)
            if value is not None:
                value = float(value) if column in NUMBERS else (", ".join(map(str, value)) if isinstance(value, list) else str(value))
            values.append(value)
        rows.append((plan_id, number, parent, child, depth, path, *values))
        todo += [(c, number, i, depth + 1, f"{path}.{i}") for i, c in reversed(list(enumerate(node.get("Plans", []))))]
    return rows


def fingerprint(document: Any) -> str:
    """SHA-256 of the plan's structure: equal for plans that differ in literals, costs and counts only."""

    def blanked(value: Any) -> Any:
        if isinstance(value, list):
            return [blanked(v) for v in value]
        return " ".join(LITERAL.sub(lambda m: m[0] if m["word"] else "?", value).lower().split()) if isinstance(value, str) else value

    def structure(node: dict) -> dict:
        return {k: blanked(node[k]) for k in STRUCTURAL if k in node} | {"Plans": [structure(c) for c in node.get("Plans", [])]}

    return hashlib.sha256(json.dumps(structure(_root(document)), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def plan_nodes(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Nodes of plan documents (plan_id, document as JSON), flattened where the documents are."""
    import pandas as pd

    names = [c.split(" ")[0] for c in NODE_SCHEMA.split(", ")]

    def run(frames):
        for frame in frames:
            rows = [r for p, d in zip(frame["plan_id"], frame["document"], strict=True) for r in flatten(p, json.loads(d))]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"node_id": "int32", "parent_node_id": "Int32", "child_index": "int32", "depth": "int32"})

    return documents.select("plan_id", "document").mapInPandas(run, NODE_SCHEMA)


def plan_edges(nodes: DataFrame) -> DataFrame:
    parent = nodes.select("plan_id", F.col("node_id").alias("parent_node_id"), F.col("node_type").alias("parent_node_type"), F.col("depth").alias("parent_depth"), F.col("node_path").alias("parent_path"))
    child = nodes.filter("parent_node_id is not null").select("plan_id", F.col("node_id").alias("child_node_id"), "parent_node_id", "child_index", F.col("node_type").alias("child_node_type"), F.col("depth").alias("child_depth"), F.col("node_path").alias("child_path"))
    return child.join(parent, ["plan_id", "parent_node_id"])


def tree_shape(nodes: DataFrame) -> DataFrame:
    """Nodes, leaves, branches, depth and branching factor (children a node that has any) of each plan."""
    children = nodes.filter("parent_node_id is not null").groupBy("plan_id", F.col("parent_node_id").alias("node_id")).agg(F.count(F.lit(1)).alias("children"))
    joined = nodes.join(children, ["plan_id", "node_id"], "left").withColumn("children", F.coalesce("children", F.lit(0)))
    inner = F.count_if(F.col("children") > 0)
    return joined.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("node_count"), F.count_if(F.col("children") == 0).alias("leaf_count"), F.count_if(F.col("children") > 1).alias("branch_count"), F.max("depth").alias("max_depth"),
        F.round(F.sum("children") / F.nullif(inner, F.lit(0)), 6).alias("branching_factor"), F.max("children").alias("max_children"),
    )


def operator_class(node_type: Column) -> Column:
    return F.when(node_type.contains("Join") | (node_type == "Nested Loop"), "join").when(node_type.contains("Agg"), "aggregate").when(node_type.contains("Sort"), "sort").when(node_type.contains("Scan"), "scan").when(node_type == "Limit", "limit").otherwise("other")


def operator_depths(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("operator_class", operator_class(F.col("node_type"))).groupBy("plan_id", "operator_class").agg(F.count(F.lit(1)).alias("operators"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"))


def above_scans(nodes: DataFrame) -> DataFrame:
    """For each remote scan whether an aggregate, sort, limit or join lies above it."""
    scans = nodes.filter(F.col("node_type") == "Foreign Scan").select("plan_id", "node_id", F.col("node_path").alias("scan_path"))
    # Ancestors of a path are its prefixes: an equality join on each, not a comparison of all pairs.
    parts = F.split("scan_path", r"\.")
    prefixes = scans.withColumn("node_path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))))
    above = prefixes.filter("node_path != scan_path").join(nodes.select("plan_id", "node_path", operator_class(F.col("node_type")).alias("c")), ["plan_id", "node_path"])
    flags = above.groupBy("plan_id", "node_id").agg(*[F.max((F.col("c") == c).cast("int")).alias(f"has_{c}_above") for c in ("aggregate", "sort", "limit", "join")])
    return scans.join(flags, ["plan_id", "node_id"], "left").select("plan_id", "node_id", *[F.coalesce(f"has_{c}_above", F.lit(0)).alias(f"has_{c}_above") for c in ("aggregate", "sort", "limit", "join")])


def transitions(nodes: DataFrame, types: list[str]) -> DataFrame:
    """Counts of parent-to-child type pairs a plan, one column a pair of the given types, zero where there are none."""
    pairs = [f"{a} > {b}" for a in types for b in types]
    edges = plan_edges(nodes).withColumn("pair", F.concat_ws(" > ", "parent_node_type", "child_node_type"))
    return edges.groupBy("plan_id").pivot("pair", pairs).count().na.fill(0)


def blocking(nodes: DataFrame) -> DataFrame:
    """Blocking operators of each plan and the first of them from the root."""
    at = F.when(F.col("node_type").isin(*BLOCKING), F.struct("depth", "node_path", "node_type"))
    return nodes.groupBy("plan_id").agg(F.count(at).alias("blocking_count"), F.min(at)["node_type"].alias("first_blocking"), F.min(at)["depth"].alias("first_blocking_depth"))


def dominant(nodes: DataFrame, measure: str) -> DataFrame:
    """The node with most of a measure and its share of the plan's sum; ties go to the first node."""
    best = F.min(F.when(F.col(measure).isNotNull(), F.struct((-F.col(measure)).alias("m"), "node_id", "node_type")))
    return nodes.groupBy("plan_id").agg(best["node_id"].alias("node_id"), best["node_type"].alias("node_type"), F.round(-best["m"] / F.nullif(F.sum(measure), F.lit(0.0)), 6).alias("share"))


def text_plan_nodes(lines: DataFrame) -> DataFrame:
    """plan_id, line, depth, node_type, rows, loops of text plans given as plan_id, text."""
    split = lines.select("plan_id", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    parsed = split.filter(F.col("value").rlike(r"(^\S|->)\s*.*\(cost="))
    indent = F.length(F.regexp_extract("value", r"^(\s*)", 1))
    name = F.trim(F.regexp_replace(F.regexp_extract("value", r"^\s*(?:->\s*)?(.*?)\s*\(cost=", 1), r"\s+(on|using)\s.*$", ""))
    number = lambda p: F.regexp_extract("value", p, 1).try_cast("double")
    return parsed.select("plan_id", "line", F.floor((indent + 4) / 6).cast("int").alias("depth"), name.alias("node_type"), number(r"actual time=[\d.]+\.\.[\d.]+ rows=([\d.]+)").alias("actual_rows"), number(r"loops=(\d+)").alias("loops"))


#: Tokens of SQL from left to right: a comment, a string, a dollar-quoted string, a word, a number, white space, or one other character.
TOKEN = r"(?s)--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\$(?:\w*)\$.*?\$\w*\$|[A-Za-z_][A-Za-z0-9_$]*|[0-9]+(?:\.[0-9]+)?|\s+|."


def normalized_sql(sql: Column) -> Column:
    """The query's tokens in lower case, a blank for comments and white space, ? for strings and numbers."""

    def written(token: Column) -> Column:
        blank = token.startswith("--") | token.startswith("/*") | (F.trim(F.translate(token, "\t\n\r\f\x0b", "     ")) == "")
        literal = (token.startswith("'") & (F.length(token) > 1)) | (token.startswith("$") & (F.length(token) > 1)) | token.rlike("^[0-9]")
        return F.when(blank, " ").when(literal, "?").otherwise(F.lower(token))

    tokens = F.regexp_extract_all(sql, F.lit(TOKEN), F.lit(0))
    return F.trim(F.regexp_replace(F.array_join(F.transform(tokens, written), ""), " +", " "))


def sql_features(sql: Column) -> dict[str, Column]:
    """Counts of structural words in a query."""
    n = lambda pattern: F.regexp_count(F.lower(sql), F.lit(pattern))
    words = {"join": r"\bjoin\b", "left_join": r"\bleft\s+join\b", "group_by": r"\bgroup\s+by\b", "order_by": r"\border\s+by\b", "limit": r"\blimit\b", "distinct": r"\bdistinct\b", "union_all": r"\bunion\s+all\b", "with": r"\bwith\b", "materialized": r"\bmaterialized\b", "count": r"\bcount\s*\(", "sum": r"\bsum\s*\(", "avg": r"\bavg\s*\(", "min_max": r"\b(?:min|max)\s*\(", "window": r"\bover\s*\(", "subquery": r"\(\s*select\b", "between": r"\bbetween\b", "comparison": r"(?:<=|>=|<>|!=|=|<|>)", "cast": r"::"}
    return {f"n_{k}": n(p) for k, p in words.items()}


#: Functions that read the clock.
WALL_CLOCK = r"\b(?:now\s*\(|current_timestamp|current_date|clock_timestamp\s*\(|statement_timestamp\s*\(|transaction_timestamp\s*\()"


def temporal_class(sql: Column) -> Column:
    lowered = F.lower(sql)
    return F.when(lowered.rlike(WALL_CLOCK), "wall_clock").when(lowered.rlike(r"timestamp(?:tz)?\s*'|to_timestamp\s*\("), "fixed_cutoff").otherwise("timeless")


def key_usage(sql: Column, key: str = "tenant_id") -> dict[str, Column]:
    """Whether a distribution key is used in the filter, join, grouping and order of a query."""
    lowered = F.regexp_replace(F.lower(sql), r"\s+", " ")
    part = lambda pattern: F.regexp_extract(lowered, pattern, 1).contains(key)
    return {"in_where": part(r"where (.*?)(?: group by| order by| limit|$)"), "in_join": part(r" on (.*?)(?: where| group by| order by| limit|$)"), "in_group": part(r"group by (.*?)(?: order by| limit|$)"), "in_order": part(r"order by (.*?)(?: limit|$)")}


