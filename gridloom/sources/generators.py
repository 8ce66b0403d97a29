"""Deterministic multi-tenant data with skew control, made where it is needed: no row passes through the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import exprs as X

#: The time anchor (2026-07-01T00:00:00Z), tenants' events in an id stride, and the linear congruences by
#: column (multiplier of tenant, of offset).
BASE_TIME, STRIDE = 1_782_864_000, 1_000_000
USER, VALUE, DAY, SECOND = (1103515245, 12345), (214013, 2531011), (48271, 69621), (16807, 950706376)
#: Increments and multipliers of the splitmix64 mixer.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SEGMENTS = ("consumer", "professional", "power", "trial")


@dataclass(frozen=True)
class Profile:
    """Size and shape of a data set."""

    first_tenant: int = 1
    last_tenant: int = 20
    users: int = 10
    events: int = 100
    seed: int = 42
    lookback_days: int = 30
    base_time: int = BASE_TIME
    #: Percent of tenants that are hot and of events that they hold; none: all tenants alike.
    hot_tenants: float = 0.0
    hot_events: float = 0.0
    #: 'local_sequential' or 'tenant_global'.
    event_ids: str = "local_sequential"

    @property
    def tenants(self) -> int:
        return self.last_tenant - self.first_tenant + 1

    def hot_split(self) -> tuple[int, int, int]:
        """Hot tenants, their events, and the other tenants' events."""
        total = self.tenants * self.events
        hot = max(1, min(int(self.tenants * self.hot_tenants / 100.0 + 0.5), self.tenants))
        hot_events = int(total * self.hot_events / 100.0 + 0.5)
        return hot, hot_events, total - hot_events


def series(spark: SparkSession, first: int, last: int, name: str = "value") -> DataFrame:
    """first..last, both included."""
    return spark.range(first, last + 1).withColumnRenamed("id", name)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows written in the query."""
    return spark.createDataFrame(rows, schema)


def tenants(spark: SparkSession, profile: Profile, region: str = "eu") -> DataFrame:
    t = F.col("tenant_id")
    updated = F.timestamp_seconds(F.lit(profile.base_time)).cast("timestamp_ntz")
    return series(spark, profile.first_tenant, profile.last_tenant, "tenant_id").select(
        t, F.lit(region).alias("region"), X.tenant_tier(t).alias("tenant_tier"), X.tenant_status(t).alias("tenant_status"), updated.alias("updated_at"), F.lit(1).cast("long").alias("dimension_version")
    )


def _cross(spark: SparkSession, profile: Profile, n: int, name: str) -> DataFrame:
    """Every tenant with 1..n, as one range: partitions are of equal size whatever the shape is."""
    ids = spark.range(profile.tenants * n)
    return ids.select((F.floor(F.col("id") / n) + profile.first_tenant).cast("long").alias("tenant_id"), (F.col("id") % n + 1).alias(name))


def users(spark: SparkSession, profile: Profile, home_region: str | None = None) -> DataFrame:
    """Users of each tenant; with home_region, as the table distributed by user."""
    t, u = F.col("tenant_id"), F.col("user_id")
    segment = F.element_at(F.array(*map(F.lit, SEGMENTS)), ((u - 1) % len(SEGMENTS) + 1).cast("int"))
    age = (t * 17 + u * 31 + profile.seed) % (12 * profile.lookback_days + 1)
    made = [segment.alias("user_segment"), X.user_status(u).alias("user_status"), age.alias("signup_age_days")]
    made += [F.lit(home_region).alias("home_region")] if home_region else []
    return _cross(spark, profile, profile.users, "user_id").select("tenant_id", "user_id", *made)


def events_for_tenant(profile: Profile, index: Column) -> Column:
    """Events of the index-th tenant: hot ones share theirs evenly, the first ones taking the remainder, and so do the others."""
    if not profile.hot_tenants:
        return F.lit(profile.events).cast("long")
    hot, hot_events, cold_events = profile.hot_split()
    cold = profile.tenants - hot
    share = lambda total, n, i: F.lit(total // n) + F.when(i < total % n, 1).otherwise(0)
    return F.when(index < hot, share(hot_events, hot, index)).otherwise(share(cold_events, cold, index - hot) if cold else F.lit(0)).cast("long")


def _slots(spark: SparkSession, profile: Profile) -> DataFrame:
    """tenant_id and event_offset of every event. Hot tenants are cut into runs, so that no task makes one tenant's all."""
    run = 10_000
    index = (F.col("tenant_id") - profile.first_tenant).cast("long")
    counted = series(spark, profile.first_tenant, profile.last_tenant, "tenant_id").withColumn("n", events_for_tenant(profile, index))
    runs = counted.filter("n > 0").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(run).cast("long"))))
    dealt = runs.repartition(spark.sparkContext.defaultParallelism)
    return dealt.select("tenant_id", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("start") + run, F.col("n")))).alias("event_offset"))


def _event_id(profile: Profile) -> Column:
    t, o = F.col("tenant_id"), F.col("event_offset")
    if profile.event_ids == "tenant_global":
        most = max(profile.events, profile.hot_split()[1] if profile.hot_tenants else 0)
        if most >= STRIDE:
            raise ValueError(f"tenant_global ids allow fewer than {STRIDE} events a tenant")
        return t * STRIDE + o
    if profile.event_ids != "local_sequential":
        raise ValueError(f"no such id mode: {profile.event_ids}")
    if not profile.hot_tenants:
        return (t - profile.first_tenant) * profile.events + o
    hot, hot_events, cold_events = profile.hot_split()
    i, cold = t - profile.first_tenant, profile.tenants - hot
    before = lambda total, n, j: j * (total // n) + F.least(j, F.lit(total % n))
    return F.when(i < hot, before(hot_events, hot, i)).otherwise(F.lit(hot_events) + (before(cold_events, cold, i - hot) if cold else 0)) + o


def events(spark: SparkSession, profile: Profile) -> DataFrame:
    """Events by linear congruences of tenant and offset."""
    t, o = F.col("tenant_id"), F.col("event_offset")
    draw = lambda rule, n: F.abs(t * rule[0] + o * rule[1] + profile.seed) % n
    at = F.lit(profile.base_time) - draw(DAY, profile.lookback_days + 1) * 86400 - draw(SECOND, 86400)
    return _slots(spark, profile).select(
        _event_id(profile).alias("event_id"), "tenant_id", (draw(USER, profile.users) + 1).alias("user_id"), ((draw(VALUE, 99900) + 100) / 100.0).alias("value"), F.timestamp_seconds(at).cast("timestamp_ntz").alias("created_at")
    )


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 output of each unsigned 64-bit state."""
    with np.errstate(over="ignore"):
        z = x + np.uint64(MIX[0])
        z = (z ^ z >> np.uint64(30)) * np.uint64(MIX[1])
        z = (z ^ z >> np.uint64(27)) * np.uint64(MIX[2])
        return z ^ z >> np.uint64(31)


def hashed_events(spark: SparkSession, profile: Profile) -> DataFrame:
    """Events by a 64-bit mixer of seed, tenant, offset and column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, t, o = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            with np.errstate(over="ignore"):
                state = np.uint64(profile.seed) ^ t.astype(np.uint64) * np.uint64(MIX[0]) ^ o.astype(np.uint64) * np.uint64(MIX[1])
                draw = lambda salt, n, s=state: (mixed(s ^ np.uint64(salt) * np.uint64(MIX[2])) % np.uint64(n)).astype(np.int64)
                at = profile.base_time - draw(3, profile.lookback_days + 1) * 86400 - draw(4, 86400)
                columns = [pa.array(ids), pa.array(t), pa.array(draw(1, profile.users) + 1), pa.array(1.0 + draw(2, 99901) / 100.0), pa.array(at * 1_000_000).cast(pa.timestamp("us"))]
            yield pa.RecordBatch.from_arrays(columns, names=["event_id", "tenant_id", "user_id", "value", "created_at"])

    slots = _slots(spark, profile).select(_event_id(profile).alias("event_id"), "tenant_id", "event_offset")
    return slots.mapInArrow(run, "event_id long, tenant_id long, user_id long, value double, created_at timestamp_ntz")


def random_events(spark: SparkSession, profile: Profile) -> DataFrame:
    """Events by a generator seeded for each tenant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                rng, n = np.random.default_rng([profile.seed, t]), profile.events
                at = profile.base_time - rng.integers(0, profile.lookback_days + 1, n) * 86400 - rng.integers(0, 86400, n)
                offsets = np.arange(1, n + 1)
                columns = [(t - profile.first_tenant) * n + offsets, np.full(n, t), rng.integers(1, profile.users + 1, n), np.round(rng.uniform(1, 1000, n), 2), at]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:4]), pa.array(columns[4] * 1_000_000).cast(pa.timestamp("us"))], names=["event_id", "tenant_id", "user_id", "value", "created_at"])

    one_each = series(spark, profile.first_tenant, profile.last_tenant, "tenant_id")
    return one_each.mapInArrow(run, "event_id long, tenant_id long, user_id long, value double, created_at timestamp_ntz")


def update_slice(reference: DataFrame, condition: Column, **changes: Column) -> DataFrame:
    """Rows that meet the condition get the changes and their next version; the others stay."""
    out = reference
    for name, value in (changes | {"dimension_version": F.col("dimension_version") + 1}).items():
        out = out.withColumn(name, F.when(condition, value).otherwise(F.col(name)))
    return out
