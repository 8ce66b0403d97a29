"""Flow, topology, spill, fidelity and severity features of executions, and their standardisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import exprs as X

MB, BLOCK = 1 << 20, 8192


def flow(df: DataFrame) -> DataFrame:
    """From wan_rows, wan_bytes, regional_rows, regional_bytes, final_rows, fanin_rows: reduction, fan-in and merge ratios."""
    c = F.col
    reduction = X.safe_divide(c("regional_rows"), c("wan_rows"))
    bytes_reduction = X.safe_divide(c("regional_bytes"), c("wan_bytes"))
    log = lambda x: F.when(x > 0, F.log(x))
    return df.withColumns({
        "drf_rows": F.round(reduction, 6), "drf_bytes": F.round(bytes_reduction, 6), "log_drf_rows": F.round(log(reduction), 6), "log_drf_bytes": F.round(log(bytes_reduction), 6),
        "fanin_ratio": F.round(X.floor_divide(c("fanin_rows"), c("final_rows")), 6), "merge_ratio": F.round(X.floor_divide(c("wan_rows"), c("final_rows")), 6), "group_density": F.round(X.safe_divide(c("final_rows"), c("wan_rows")), 6),
    })


def topology(df: DataFrame, workers_a_region: int = 2) -> DataFrame:
    """From tasks, regions, workers, shards (NULL: derived): slots, active share and tasks a worker."""
    c = F.col
    workers = F.coalesce(c("workers"), c("regions") * workers_a_region)
    shards = F.coalesce(c("shards"), (c("tasks") / F.nullif(c("regions"), F.lit(0))))
    slots = shards * c("regions")
    return df.withColumns({"worker_count": workers, "shard_count": shards, "slots": slots, "active_task_share": F.round(X.safe_divide(c("tasks"), slots), 6), "task_shard_ratio": F.round(X.safe_divide(c("tasks"), shards), 6), "tasks_per_worker": F.round(X.safe_divide(c("tasks"), workers), 6)})


def spill(df: DataFrame) -> DataFrame:
    """From temp_blocks, wan_rows, wan_bytes, final_rows, regional_rows, ext_sorts, hash_batches."""
    c = F.col
    batches = F.coalesce(c("hash_batches"), F.lit(1))
    return df.withColumns({
        "spill_bytes_ratio": F.round(X.safe_divide(c("temp_blocks") * BLOCK, c("wan_bytes")), 6), "temp_per_wan_row": F.round(X.safe_divide(c("temp_blocks"), c("wan_rows")), 6), "temp_per_final_row": F.round(X.floor_divide(c("temp_blocks"), c("final_rows")), 6),
        "temp_per_regional_row": F.round(X.safe_divide(c("temp_blocks"), c("regional_rows")), 6), "spill_per_wan_mb": F.round(X.safe_divide(c("temp_blocks"), c("wan_bytes") / MB), 6), "hash_batch_excess": F.greatest(batches - 1, F.lit(0)),
        "memory_pressure": F.round(F.log1p(c("temp_blocks")) + c("ext_sorts") + F.log1p(F.greatest(batches - 1, F.lit(0))), 6), "spill_flag": ((c("temp_blocks") > 0) | (c("ext_sorts") > 0) | (batches > 1)).cast("int"),
    })


#: Severity groups: feature, kind of excess, base, critical excess.
SEVERITY = {
    "wan": (("drf_rows", "log", 1.0, 1e5), ("merge_ratio", "log", 1.0, 1e5), ("fanin_ratio", "log", 1.0, 1e5)),
    "spill": (("spill_bytes_ratio", "log", 0.0, 4.0), ("temp_per_wan_row", "log", 0.0, 0.1), ("temp_per_regional_row", "log", 0.0, 0.1), ("spill_per_wan_mb", "log", 0.0, 8192.0), ("memory_pressure", "log", 0.0, 32.0)),
    "imbalance": (("region_isf", "linear", 1.0, 1.0), ("task_isf", "linear", 1.0, 3.0)),
    "capacity": (("active_task_share", "linear", 1.0, 3.0), ("task_shard_ratio", "linear", 1.0, 3.0), ("tasks_per_worker", "log", 8.0, 56.0)),
}


def largest(columns: list[Column]) -> Column:
    return reduce(lambda a, b: F.greatest(a, b), columns[1:], columns[0]) if len(columns) > 1 else columns[0]


def severity(df: DataFrame, timeout: str | None = None) -> DataFrame:
    """severity_<group>, severity_total and its band; groups are the largest excess of the features that are there."""
    have = set(df.columns)
    groups = {}
    for group, rules in SEVERITY.items():
        made = [(X.log_excess if kind == "log" else X.linear_excess)(F.col(f), base, critical) for f, kind, base, critical in rules if f in have]
        if made:
            groups[f"severity_{group}"] = F.round(largest(made), 6)
    df = df.withColumns(groups)
    parts = [F.col(g) for g in groups]
    if timeout:
        parts.append(F.least(F.col("elapsed_seconds") / F.col(timeout), F.lit(1.0)))
    total = F.coalesce(largest(parts), F.lit(0.0))
    return df.withColumn("severity_total", total).withColumn("severity_band", F.when(total >= 0.95, "critical").when(total >= 0.8, "high").when(total >= 0.5, "medium").otherwise("low"))


def fidelity(df: DataFrame) -> DataFrame:
    """From extra work at the merge node (ratios, 1 when pushed down): components min(1, 1/x), their mean, and codes of misses."""
    parts = {p: F.least(F.lit(1.0), 1.0 / F.nullif(F.col(f"{p}_expansion"), F.lit(0.0))) for p in ("filter", "aggregate", "sort", "limit", "width")}
    known = F.filter(F.array(*parts.values()), lambda x: x.isNotNull())
    score = F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(known), F.lit(0))
    codes = F.array_join(F.filter(F.array(*[F.when(c < 1.0, F.lit(p)) for p, c in parts.items()]), lambda x: x.isNotNull()), ",")
    return df.withColumns({"fidelity": F.round(score, 6), "fidelity_miss": F.round(1.0 - score, 6), "missed": codes})


def quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: share of nulls, zeros and distinct values, from one pass over the data."""
    n = F.count(F.lit(1))
    made = [F.struct(F.lit(c).alias("feature"), F.round((n - F.count(c)) / F.nullif(n, F.lit(0)), 6).alias("null_share"), F.count_if(F.col(c) == 0).alias("zeros"), F.countDistinct(c).alias("distinct_values")) for c in columns]
    return df.agg(F.array(*made).alias("x")).select(F.inline("x"))


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Median in place of NULL, then (x - mean) / population deviation; a deviation under 1e-12 counts as 1."""
    medians = df.agg(*[F.median(c).alias(c) for c in columns])
    filled = df.join(F.broadcast(medians.select(*[F.col(c).alias(f"{c}__m") for c in columns]))).withColumns({c: F.coalesce(c, f"{c}__m") for c in columns})
    stats = filled.agg(*[F.avg(c).alias(f"{c}__a") for c in columns], *[F.stddev_pop(c).alias(f"{c}__s") for c in columns])
    out = filled.join(F.broadcast(stats))
    scaled = {c: F.round((F.col(c) - F.col(f"{c}__a")) / F.when(F.col(f"{c}__s") < 1e-12, 1.0).otherwise(F.col(f"{c}__s")), 6) for c in columns}
    return out.withColumns(scaled).select(*df.columns)


def frozen(df: DataFrame, contract: list[tuple[str, str, float, float]]) -> DataFrame:
    """A frozen preprocessing: feature, transform (identity, log1p), center, scale. NULL is the center."""
    made = {}
    for feature, transform, center, scale in contract:
        x = F.log1p(F.col(feature)) if transform == "log1p" else F.col(feature)
        made[feature] = (F.coalesce(x, F.lit(center)) - center) / (scale if abs(scale) >= 1e-12 else 1.0)
    return df.withColumns(made)


def drop_reasons(rules: dict[str, Column]) -> Column:
    """Codes of the rules that hold, joined; empty for a row to keep."""
    return F.array_join(F.filter(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]), lambda x: x.isNotNull()), ",")


def pressure_score(x: Column, p50: Column, p75: Column, p90: Column) -> Column:
    """0 up to the median, half at the upper quartile, 1 from the ninth decile on; without spread 1 above it."""
    flat = F.when(x > p90, 1.0).otherwise(0.0)
    rising = F.when(x <= p50, 0.0).when(x <= p75, F.lit(0.5) * X.safe_divide(x - p50, p75 - p50)).when(x <= p90, 0.5 + 0.5 * X.safe_divide(x - p75, p90 - p75)).otherwise(1.0)
    return F.when(x.isNull(), None).when(p90 <= p50, flat).otherwise(F.coalesce(rising, F.lit(0.5)))


def pressure_status(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score >= 0.75, "strong").when(score >= 0.40, "moderate").when(score >= 0.15, "weak").otherwise("none")


def tags(df: DataFrame) -> Column:
    """Mechanism tags of a row, from the features that are there."""
    have, c = set(df.columns), F.col
    rules = {
        "remote_fanin_extreme": ("merge_ratio", lambda: c("merge_ratio") >= 1e4), "remote_fanin": ("merge_ratio", lambda: c("merge_ratio") >= 100), "spill": ("temp_per_final_row", lambda: c("temp_per_final_row") >= 100),
        "spill_bytes": ("spill_bytes_ratio", lambda: c("spill_bytes_ratio") >= 1), "skew": ("task_isf", lambda: c("task_isf") >= 1.5), "estimate_error": ("estimate_error", lambda: F.abs(c("estimate_error")) >= 3),
    }
    return drop_reasons({name: rule() for name, (needs, rule) in rules.items() if needs in have})


#: The 19 features of the semantic space: family, transform, neutral value.
SEMANTIC = {
    "remote_path_share": ("flow", "bounded_share", 0.0), "drf_rows": ("flow", "positive_excess_log_atan", 0.0), "merge_ratio": ("flow", "positive_baseline_log2_atan", 0.0), "fanin_ratio": ("flow", "positive_baseline_log2_atan", 0.0),
    "group_density": ("flow", "bounded_share", 0.0), "finalize_share": ("flow", "bounded_share", 0.0), "region_isf": ("skew", "isf_excess_share", 0.0), "region_max_share": ("skew", "max_share_excess", 0.0),
    "task_isf": ("skew", "isf_excess_share", 0.0), "task_cv": ("skew", "nonnegative_log_atan", 0.0), "spill_bytes_ratio": ("spill", "nonnegative_log_atan", 0.0), "temp_per_final_row": ("spill", "nonnegative_log_atan", 0.0),
    "hash_batch_excess": ("spill", "nonnegative_log_atan", 0.0), "spill_flag": ("spill", "binary", 0.0), "active_task_share": ("topology", "bounded_share", 0.0), "tasks_per_worker": ("topology", "nonnegative_log_atan", 0.0),
    "repartition": ("topology", "binary", 0.0), "estimate_error": ("estimate", "signed_atan", 0.5), "fidelity_miss": ("estimate", "bounded_share", 0.0),
}


def family_weights(features: list[str]) -> dict[str, float]:
    """1 / sqrt(members of the feature's family): families have equal energy."""
    families = [SEMANTIC[f][0] for f in features]
    return {f: families.count(SEMANTIC[f][0]) ** -0.5 for f in features}


def semantic_space(df: DataFrame, n: Column) -> DataFrame:
    """The semantic features that df has, transformed and weighted; n is the number of members for shares."""
    here = [f for f in SEMANTIC if f in set(df.columns)]
    weights = family_weights(here)
    return df.withColumns({f: F.round(X.semantic(SEMANTIC[f][1], F.col(f).cast("double"), n, SEMANTIC[f][2]) * weights[f], 6) for f in here})
