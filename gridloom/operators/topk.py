"""Thirty top-k shapes over regional events with one output contract, raw (union, then rank) and regional (rank, then merge).

(source_region, key_1, key_2, bucket_at, metric, event_id, created_at). Raw and regional results are equal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import exprs as X
from gridloom.sources.catalog import CATALOG_SQL, Catalog, regional_sql

COLUMNS = ("source_region", "key_1", "key_2", "bucket_at", "metric", "event_id", "created_at")
CUTOFF = "created_at >= '2024-01-05 00:00:00'"
HIGH, LOW, MIDDLE = "value >= 150", "value <= 12", "value between 20 and 90"
DEC = "cast(value as decimal(20,6))"
SUM, AVG = f"cast(sum({DEC}) as double)", f"round(cast(sum({DEC}) as double) / count(value), 6)"
EPOCH = "epoch"
#: shape: (direction, keys, bucket, metric, filter). Event shapes have a metric a row, the others an aggregate a key.
EVENT: dict[str, tuple] = {
    "event_value_desc": ("desc", "value", ""), "event_value_asc": ("asc", "value", ""), "event_recent": ("desc", EPOCH, ""), "event_oldest": ("asc", EPOCH, ""),
    "event_deviation": ("desc", "abs(value - 75)", ""), "event_value_squared": ("desc", "round(value * value, 6)", ""), "event_log_value": ("desc", "round(ln(1 + abs(value)), 6)", ""),
    "event_recent_high_value": ("desc", EPOCH, HIGH), "event_old_low_value": ("asc", EPOCH, LOW), "event_tenant_weighted": ("desc", "round(value / (1 + tenant_id % 17), 6)", ""),
}
GROUPED: dict[str, tuple] = {
    "tenant_sum": ("desc", ("tenant_id",), None, SUM, ""), "tenant_count": ("desc", ("tenant_id",), None, "count(*)", ""), "tenant_avg": ("desc", ("tenant_id",), None, AVG, ""),
    "tenant_max": ("desc", ("tenant_id",), None, "max(value)", ""), "tenant_min": ("asc", ("tenant_id",), None, "min(value)", ""), "tenant_high_count": ("desc", ("tenant_id",), None, "count(*)", HIGH),
    "tenant_user_sum": ("desc", ("tenant_id", "user_id"), None, SUM, ""), "tenant_user_count": ("desc", ("tenant_id", "user_id"), None, "count(*)", ""),
    "tenant_day_sum": ("desc", ("tenant_id",), "day", SUM, ""), "tenant_day_count": ("desc", ("tenant_id",), "day", "count(*)", ""),
    "tenant_value_range": ("desc", ("tenant_id",), None, "round(max(value) - min(value), 6)", ""), "tenant_distinct_users": ("desc", ("tenant_id",), None, "count(distinct user_id)", ""),
    "tenant_even_user_count": ("desc", ("tenant_id",), None, "count(*)", "user_id % 2 = 0"), "tenant_midband_sum": ("desc", ("tenant_id",), None, SUM, MIDDLE),
    "tenant_day_avg": ("desc", ("tenant_id",), "day", AVG, ""), "tenant_hour_count": ("desc", ("tenant_id",), "hour", "count(*)", ""),
    "user_sum": ("desc", ("user_id",), None, SUM, ""), "user_count": ("desc", ("user_id",), None, "count(*)", ""), "user_value_range": ("desc", ("user_id",), None, "round(max(value) - min(value), 6)", ""),
    "user_day_sum": ("desc", ("user_id",), "day", SUM, ""),
}
SHAPES = tuple([*EVENT, *GROUPED])


def _order(direction: str) -> list:
    metric = F.desc_nulls_first("metric") if direction == "desc" else F.asc_nulls_last("metric")
    return [metric, *[F.asc_nulls_last(c) for c in ("source_region", "key_1", "key_2", "bucket_at", "event_id")]]


def _shaped(events: DataFrame, shape: str) -> DataFrame:
    null = lambda kind: F.lit(None).cast(kind)
    if shape in EVENT:
        _, metric, where = EVENT[shape]
        rows = events.filter(where) if where else events
        value = X.epoch(F.col("created_at")) if metric == EPOCH else F.expr(metric).cast("double")
        return rows.select("source_region", F.col("tenant_id").alias("key_1"), F.col("user_id").alias("key_2"), null("timestamp_ntz").alias("bucket_at"), value.alias("metric"), "event_id", "created_at")
    _, keys, bucket, metric, where = GROUPED[shape]
    rows = events.filter(where) if where else events
    made = {"day": X.day, "hour": X.hour, None: lambda _: null("timestamp_ntz")}[bucket](F.col("created_at"))
    grouped = rows.withColumn("bucket_at", made).groupBy("source_region", *keys, "bucket_at").agg(F.expr(metric).cast("double").alias("metric"))
    return grouped.select(
        "source_region", F.col(keys[0]).alias("key_1"), (F.col(keys[1]) if len(keys) > 1 else null("long")).alias("key_2"), "bucket_at", "metric", null("long").alias("event_id"), null("timestamp_ntz").alias("created_at")
    )


def _direction(shape: str) -> str:
    if shape not in SHAPES:
        raise ValueError(f"no such top-k shape: {shape}")
    return (EVENT.get(shape) or GROUPED[shape])[0]


def topk(catalog: Catalog, shape: str, k: int, regions: tuple[str, ...] = ("eu", "us"), pushed: bool = False, where: str = CUTOFF) -> DataFrame:
    """The k best rows of a shape. pushed: each region ranks its own rows first and only k of each are merged."""
    order = _order(_direction(shape))
    if not pushed:
        return _shaped(catalog.tagged(regions, "events").filter(where), shape).orderBy(*order).limit(k)
    parts = [catalog.regional(r, "events").filter(where).withColumn("source_region", F.lit(r)) for r in regions]
    return reduce(DataFrame.unionByName, [_shaped(p, shape).orderBy(*order).limit(k) for p in parts]).orderBy(*order).limit(k)


def topk_sql(shape: str, k: int, regions: tuple[str, ...] = ("eu", "us"), where: str = CUTOFF) -> str:
    direction = _direction(shape)
    rows = " union all ".join(f"select '{r}' source_region, * from {regional_sql(r, 'events')} e where {where}" for r in regions)
    if shape in EVENT:
        _, metric, extra = EVENT[shape]
        metric = "epoch(created_at)" if metric == EPOCH else f"cast({metric} as double)"
        body = f"select source_region, tenant_id key_1, user_id key_2, cast(null as timestamp) bucket_at, {metric} metric, event_id, created_at from ({rows}) u" + (f" where {extra}" if extra else "")
    else:
        _, keys, bucket, metric, extra = GROUPED[shape]
        at = f"date_trunc('{bucket}', created_at)" if bucket else "cast(null as timestamp)"
        second = keys[1] if len(keys) > 1 else "cast(null as bigint)"
        body = f"select source_region, {keys[0]} key_1, {second} key_2, {at} bucket_at, cast({metric} as double) metric, cast(null as bigint) event_id, cast(null as timestamp) created_at from ({rows}) u"
        body += (f" where {extra}" if extra else "") + " group by 1, 2, 3, 4"
    nulls = "desc nulls first" if direction == "desc" else "asc nulls last"
    tail = ", ".join(f"{c} asc nulls last" for c in ("source_region", "key_1", "key_2", "bucket_at", "event_id"))
    return f"with {CATALOG_SQL} select * from ({body}) b order by metric {nulls}, {tail} limit {k}"
