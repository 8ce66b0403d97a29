"""Joins that need more than an equality: counts over join trees, nearest rows, brackets, validated merges, tolerant matching."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- Counting joins -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class CountQuery:
    """select count(*) over relations (alias to table), equalities of (alias, column) pairs, and filters an alias."""

    relations: dict[str, str]
    equalities: tuple[tuple[tuple[str, str], tuple[str, str]], ...]
    filters: dict[str, tuple[str, ...]]


def parse_count_query(sql: str) -> CountQuery:
    """Reads 'select count(*) from a as x, b as y where x.k = y.k and x.v >= 1 and ...'; anything else is an error."""
    text = re.sub(r"\s+", " ", re.sub(r"--[^\n]*", " ", sql)).strip().rstrip(";")
    found = re.fullmatch(r"select count\(\*\)(?: as \w+)? from (.+?)(?: where (.+))?", text, re.IGNORECASE)
    if not found:
        raise ValueError("not a counting join")
    relations = {}
    for item in found[1].split(","):
        words = item.split()
        relations[words[-1]] = words[0]
    equalities, filters = [], {alias: [] for alias in relations}
    for term in re.split(r" and ", found[2] or "", flags=re.IGNORECASE):
        if not term.strip():
            continue
        both = re.fullmatch(r"\s*(\w+)\.(\w+) = (\w+)\.(\w+)\s*", term)
        one = re.match(r"\s*(\w+)\.(\w+)\s*(=|<=|>=|<|>|!=|<>)\s*(.+)", term)
        if both and both[1] != both[3]:
            equalities.append(((both[1], both[2]), (both[3], both[4])))
        elif one and one[1] in filters:
            value = re.sub(r"::\w+", "", one[4]).strip()
            filters[one[1]].append(f"{one[2]} {one[3]} {value}")
        else:
            raise ValueError(f"not understood: {term}")
    return CountQuery(relations, tuple(equalities), {a: tuple(f) for a, f in filters.items()})


def count_join(query: CountQuery, tables: dict[str, DataFrame]) -> DataFrame:
    """One row, result_count. Pairs are never made: each relation is counted by its keys, and counts are multiplied and summed up
    along the join tree, leaves first, so a skewed many-to-many key costs one row.
    """
    # Columns that must be equal share a class; an alias may hold two columns of one class, which is then a filter.
    parent: dict[tuple[str, str], tuple[str, str]] = {}

    def root(x: tuple[str, str]) -> tuple[str, str]:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in query.equalities:
        parent[root(a)] = root(b)
    classes = {c: f"k{i}" for i, c in enumerate(sorted({root(x) for x in list(parent)}))}
    left: dict[str, tuple[DataFrame, set[str]]] = {}
    for alias, name in query.relations.items():
        df = tables[name]
        for condition in query.filters[alias]:
            df = df.filter(condition)
        columns: dict[str, list[str]] = {}
        for a, column in list(parent):
            if a == alias:
                columns.setdefault(classes[root((a, column))], []).append(column)
        for same in columns.values():
            for other in same[1:]:
                df = df.filter(F.col(same[0]) == F.col(other))
        for same in columns.values():
            df = df.filter(F.col(same[0]).isNotNull())
        keys = {k: v[0] for k, v in columns.items()}
        df = df.groupBy(*[F.col(c).alias(k) for k, c in keys.items()]).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n")) if keys else df.agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n"))
        left[alias] = (df, set(keys))
    times = lambda a, b: a.withColumnRenamed("n", "n_left").join(b.withColumnRenamed("n", "n_right"), sorted(set(a.columns) & set(b.columns) - {"n"})).withColumn("n", (F.col("n_left") * F.col("n_right")).cast("decimal(38,0)")).drop("n_left", "n_right")

    def narrowed(df: DataFrame, keep: set[str]) -> DataFrame:
        return df.groupBy(*sorted(keep)).agg(F.sum("n").cast("decimal(38,0)").alias("n"))

    while len(left) > 1:
        # The relation that shares the fewest key classes with the others goes into one that holds all it shares.
        def shared(alias: str) -> set[str]:
            others = set().union(*[keys for a, (_, keys) in left.items() if a != alias])
            return left[alias][1] & others

        alias = min(left, key=lambda a: (len(shared(a)), a))
        common = shared(alias)
        df, _ = left.pop(alias)
        df = narrowed(df, common) if common else df.agg(F.sum("n").cast("decimal(38,0)").alias("n"))
        target = max(left, key=lambda a: (len(left[a][1] & common), a))
        other, keys = left[target]
        if common:
            left[target] = (times(other, df), keys | common)
        else:
            # A relation joined to none: its count, one row, multiplies.
            left[target] = (other.withColumnRenamed("n", "n_left").join(F.broadcast(df.withColumnRenamed("n", "n_right"))).withColumn("n", (F.col("n_left") * F.col("n_right")).cast("decimal(38,0)")).drop("n_left", "n_right"), keys)
    (df, _), = left.values()
    return df.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("result_count"))


# --- Validated merges ---------------------------------------------------------------------------------------------------


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def merge_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join whose right side has each key once; duplicates are an error, found before the join."""
    found = duplicate_keys(right, *keys).limit(1).collect()
    if found:
        raise ValueError(f"the right side repeats {found[0].asDict()}")
    return left.join(right, keys, how)


def with_indicator(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with `side`: both, left_only or right_only."""
    joined = left.withColumn("in_left", F.lit(True)).join(right.withColumn("in_right", F.lit(True)), keys, "full_outer")
    side = F.when(F.col("in_left") & F.col("in_right"), "both").when(F.col("in_left"), "left_only").otherwise("right_only")
    return joined.withColumn("side", side).drop("in_left", "in_right")


def latest(df: DataFrame, keys: list[str], *priority: Column) -> DataFrame:
    """The first row a key by priority."""
    return df.withColumn("latest_", F.row_number().over(Window.partitionBy(*keys).orderBy(*priority))).filter("latest_ = 1").drop("latest_")


def bracket(samples: DataFrame, windows: DataFrame, at: str, start: str, end: str, keys: list[str]) -> DataFrame:
    """For each window the last sample time up to its start and the first from its end on, by equality of keys."""
    joined = windows.join(samples.select(*keys, F.col(at).alias("at_")), keys, "left")
    return joined.groupBy(*windows.columns).agg(F.max(F.when(F.col("at_") <= F.col(start), F.col("at_"))).alias("before"), F.min(F.when(F.col("at_") >= F.col(end), F.col("at_"))).alias("after"))


# --- Nearest rows -------------------------------------------------------------------------------------------------------


def nearest(queries: DataFrame, rows: DataFrame, k: int, kind: str = "euclidean", block: int = 2000, exclude_same: bool = True) -> DataFrame:
    """query_id, rank, id, distance: the k nearest rows of each query (id long, vector array<double>), ties by lesser id.

    Queries go to all rows in blocks of bounded size; each task keeps k a query, and the tasks' bests are merged.
    """
    schema, parts = "query_id long, id long, distance double", []
    spark = rows.sparkSession
    batch: list = []

    def answer(asked: list) -> DataFrame:
        sent = spark.sparkContext.broadcast((np.array([r.id for r in asked]), np.array([r.vector for r in asked], float)))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            best_d = np.full((len(ids), 0), np.inf)
            best_i = np.full((len(ids), 0), -1)
            for frame in frames:
                for at in range(0, len(frame), 4096):
                    part = frame.iloc[at : at + 4096]
                    v, name = np.array(part["vector"].tolist(), float), part["id"].to_numpy()
                    if kind == "euclidean":
                        d = np.sqrt(np.maximum((q**2).sum(1)[:, None] + (v**2).sum(1)[None, :] - 2 * q @ v.T, 0))
                    elif kind == "cosine":
                        norms = np.sqrt((q**2).sum(1))[:, None] * np.sqrt((v**2).sum(1))[None, :]
                        d = 1 - (q @ v.T) / np.where(norms == 0, np.nan, norms)
                    elif kind == "manhattan":
                        d = np.stack([np.abs(v - row).sum(1) for row in q])
                    else:
                        raise ValueError(f"no such distance: {kind}")
                    if exclude_same:
                        d[ids[:, None] == name[None, :]] = np.inf
                    d, i = np.concatenate([best_d, np.round(d, 9)], 1), np.concatenate([best_i, np.broadcast_to(name, d.shape)], 1)
                    order = np.lexsort((i, d), axis=1)[:, :k]
                    best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
            out = pd.DataFrame({"query_id": np.repeat(ids, best_d.shape[1]), "id": best_i.ravel(), "distance": best_d.ravel()})
            yield out[np.isfinite(out["distance"])]

        return rows.select("id", "vector").mapInPandas(run, schema)

    for row in queries.select("id", "vector").toLocalIterator():
        batch.append(row)
        if len(batch) == block:
            parts.append(answer(batch))
            batch = []
    if batch:
        parts.append(answer(batch))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, id long, distance double")
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


# --- Tolerant comparison of results -------------------------------------------------------------------------------------


def matching(left: list[tuple], right: list[tuple], close) -> dict[int, int]:
    """A largest set of pairs (left index, right index) that are close, by augmenting paths."""
    taken: dict[int, int] = {}
    choices = [[j for j, b in enumerate(right) if close(a, b)] for a in left]

    def place(i: int, seen: set[int]) -> bool:
        for j in choices[i]:
            if j not in seen:
                seen.add(j)
                if j not in taken or place(taken[j], seen):
                    taken[j] = i
                    return True
        return False

    for i in range(len(left)):
        place(i, set())
    return {i: j for j, i in taken.items()}


def tolerant_match(left: DataFrame, right: DataFrame, exact: list[str], floats: list[str], rtol: float = 1e-9, atol: float = 1e-12) -> DataFrame:
    """exact columns, left_rows, right_rows, matched: rows of equal exact columns are matched one to one where floats are close."""
    both = left.select(*exact, *floats, F.lit(0).alias("side_")).unionByName(right.select(*exact, *floats, F.lit(1).alias("side_")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = (list(frame.loc[frame["side_"] == s, floats].itertuples(index=False, name=None)) for s in (0, 1))
        close = lambda x, y: all((p is None or p != p) == (q is None or q != q) and (p != p or abs(p - q) <= max(atol, rtol * max(abs(p), abs(q)))) for p, q in zip(x, y, strict=True))
        return frame[exact].head(1).assign(left_rows=len(a), right_rows=len(b), matched=len(matching(sorted(a), sorted(b), close)))

    schema = ", ".join(f"{c} {left.schema[c].dataType.simpleString()}" for c in exact)
    return both.groupBy(*exact).applyInPandas(run, f"{schema}, left_rows long, right_rows long, matched long")
