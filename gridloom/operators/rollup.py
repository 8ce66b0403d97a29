"""Declarative rollups: filter, join, group, merge over regions, rank. One spec builds a DataFrame, or SQL for another engine."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import exprs as X
from gridloom.sources.catalog import CATALOG_SQL, Catalog, regional_sql, small_side

#: Key expressions by name: Spark and SQL. Names not listed are columns.
KEYS: dict[str, tuple] = {
    "event_day": (lambda: X.day(F.col("created_at")), "date_trunc('day', created_at)"),
    "day": (lambda: X.day(F.col("created_at")), "date_trunc('day', created_at)"),
    "hour": (lambda: X.hour(F.col("created_at")), "date_trunc('hour', created_at)"),
    "tenant_tier_or_unknown": (lambda: F.coalesce("tenant_tier", F.lit("unknown")), "coalesce(tenant_tier, 'unknown')"),
    "tenant_region": (lambda: F.col("region"), "region"),
}
D = "cast(value as decimal(20,6))"
#: Measures by name: Spark aggregate and SQL aggregate.
MEASURES: dict[str, tuple] = {
    "events_count": (lambda: F.count(F.lit(1)), "count(*)"),
    "total_value": (lambda: X.exact_sum(F.col("value")), f"cast(sum({D}) as double)"),
    "avg_value": (lambda: X.exact_avg(F.col("value")), f"round(cast(sum({D}) as double) / count(value), 6)"),
    "min_value": (lambda: F.min("value"), "min(value)"),
    "max_value": (lambda: F.max("value"), "max(value)"),
    "first_event_at": (lambda: F.min("created_at"), "min(created_at)"),
    "last_event_at": (lambda: F.max("created_at"), "max(created_at)"),
    "tenant_count": (lambda: F.countDistinct("tenant_id"), "count(distinct tenant_id)"),
    "user_count": (lambda: F.countDistinct("user_id"), "count(distinct user_id)"),
    "max_dimension_version": (lambda: F.max("dimension_version"), "max(dimension_version)"),
    "newest_tenant_updated_at": (lambda: F.max("updated_at"), "max(updated_at)"),
    "region": (lambda: F.max("region"), "max(region)"),
    "tenant_tier": (lambda: F.max("tenant_tier"), "max(tenant_tier)"),
}
#: How regional partial measures become global ones. Sums of distinct counts and means of means are kept as defined.
MERGES: dict[str, tuple] = {
    "regions_touched": (lambda: F.countDistinct("source_region"), "count(distinct source_region)"),
    "events_count": (lambda: F.sum("events_count"), "cast(sum(events_count) as bigint)"),
    "tenant_count": (lambda: F.sum("tenant_count"), "cast(sum(tenant_count) as bigint)"),
    "user_count": (lambda: F.sum("user_count"), "cast(sum(user_count) as bigint)"),
    "tenant_day_rows": (lambda: F.count(F.lit(1)), "count(*)"),
    "total_value": (lambda: X.exact_sum(F.col("total_value")), "cast(sum(cast(total_value as decimal(20,6))) as double)"),
    "avg_value": (lambda: F.round(X.exact_sum(F.col("total_value")) / F.nullif(F.sum("events_count"), F.lit(0)), 6), "round(cast(sum(cast(total_value as decimal(20,6))) as double) / nullif(sum(events_count), 0), 6)"),
    "mean_tenant_avg_value": (lambda: F.round(X.exact_sum(F.col("avg_value")) / F.count("avg_value"), 6), "round(cast(sum(cast(avg_value as decimal(20,6))) as double) / count(avg_value), 6)"),
    "min_value": (lambda: F.min("min_value"), "min(min_value)"),
    "max_value": (lambda: F.max("max_value"), "max(max_value)"),
    "first_event_at": (lambda: F.min("first_event_at"), "min(first_event_at)"),
    "last_event_at": (lambda: F.max("last_event_at"), "max(last_event_at)"),
}


@dataclass(frozen=True)
class Rollup:
    """`keys` and `measures` of joined events; with `regions`, partial measures a region, merged to `merged` by `merge_keys`."""

    keys: tuple[str, ...] = ()
    measures: tuple[str, ...] = ("events_count",)
    joins: tuple[str, ...] = ()
    where: str = ""
    regions: tuple[str, ...] = ()
    merge_keys: tuple[str, ...] | None = None
    merged: tuple[str, ...] | None = None
    order: tuple[str, ...] = ()
    limit: int | None = None
    raw: bool = False
    base: str = "events"
    having: str = ""
    amplify: int = 1
    left: frozenset[str] = field(default_factory=frozenset)

    def partial_keys(self) -> tuple[str, ...]:
        return self.keys

    # --- Spark

    def _joined(self, catalog: Catalog, region: str | None) -> DataFrame:
        get = (lambda name: catalog.regional(region, name)) if region else catalog.relation
        df = get(self.base)
        if self.where:
            df = df.filter(self.where.split(" ~ ")[0])
        for name in self.joins:
            side = get(name)
            if name in self.left:
                # A dimension with gaps: tenants divisible by 4 are missing, so that the unknown bucket is used.
                side = side.filter("tenant_id % 4 != 0")
            on = ["tenant_id"] if name == "tenants" else ["tenant_id", "user_id"]
            df = df.join(small_side(side) if name == "tenants" else side, on, "left" if name in self.left else "inner")
        if " ~ " in self.where:
            df = df.filter(self.where.split(" ~ ")[1])
        if self.amplify > 1:
            df = df.withColumn("replica_id", F.explode(F.sequence(F.lit(1), F.lit(self.amplify))))
        return df

    @staticmethod
    def _key(name: str) -> Column:
        return (KEYS[name][0]() if name in KEYS else F.col(name)).alias(name.removesuffix("_or_unknown"))

    def _grouped(self, df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        made = [MEASURES[m][0]().alias(m) for m in self.measures]
        return df.groupBy(*map(self._key, keys)).agg(*made) if keys else df.agg(*made)

    def build(self, catalog: Catalog) -> DataFrame:
        if not self.regions:
            df = self._grouped(self._joined(catalog, None), self.keys)
        else:
            parts = [self._joined(catalog, r).withColumn("source_region", F.lit(r)) for r in self.regions]
            if self.raw:
                df = self._grouped(reduce(DataFrame.unionByName, parts), self.keys)
            else:
                partial = [self._grouped(p, ("source_region", *(k for k in self.keys if k != "source_region"))) for p in parts]
                df = reduce(DataFrame.unionByName, partial)
                if self.having:
                    df = df.filter(self.having)
                if self.merged is not None:
                    made = [MERGES[m][0]().alias(m) for m in self.merged]
                    keys = [k.removesuffix("_or_unknown") for k in (self.keys if self.merge_keys is None else self.merge_keys)]
                    df = df.groupBy(*keys).agg(*made) if keys else df.agg(*made)
        return ranked(df, self.order, self.limit)

    # --- SQL

    def _joined_sql(self, region: str | None) -> str:
        get = (lambda name: regional_sql(region, name)) if region else (lambda name: f"{name}_t")
        text = f"select * from {get(self.base)} b"
        for name in self.joins:
            side = get(name)
            if name in self.left:
                side = f"(select * from {side} z where tenant_id % 4 != 0)"
            text += f" {'left ' * (name in self.left)}join {side} {name}_s using ({'tenant_id' if name == 'tenants' else 'tenant_id, user_id'})"
        if self.amplify > 1:
            text += f" cross join range({self.amplify}) r"
        return text + (f" where {self.where.replace(' ~ ', ' and ')}" if self.where else "")

    def _grouped_sql(self, source: str, keys: tuple[str, ...], tag: str | None = None) -> str:
        made = [f"{KEYS[k][1] if k in KEYS else k} as {k.removesuffix('_or_unknown')}" for k in keys if not (tag and k == "source_region")]
        tagged = [f"'{tag}' as source_region"] if tag else []
        values = [f"{MEASURES[m][1]} as {m}" for m in self.measures]
        group = f" group by {', '.join(str(i + 1 + len(tagged)) for i in range(len(made)))}" if made else ""
        if tag and not made:
            group = ""
        return f"select {', '.join([*tagged, *made, *values])} from ({source}) s{group}"

    def sql(self) -> str:
        if not self.regions:
            body = self._grouped_sql(self._joined_sql(None), self.keys)
        elif self.raw:
            body = self._grouped_sql(" union all ".join(f"select *, '{r}' as source_region from ({self._joined_sql(r)}) j" for r in self.regions), self.keys)
        else:
            body = " union all ".join(self._grouped_sql(self._joined_sql(r), tuple(k for k in self.keys if k != "source_region"), r) for r in self.regions)
            if self.having or self.merged is not None:
                body = f"select * from ({body}) p" + (f" where {self.having}" if self.having else "")
            if self.merged is not None:
                keys = [k.removesuffix("_or_unknown") for k in (self.keys if self.merge_keys is None else self.merge_keys)]
                body = f"select {', '.join([*keys, *(f'{MERGES[m][1]} as {m}' for m in self.merged)])} from ({body}) q" + (f" group by {', '.join(keys)}" if keys else "")
        return f"with {CATALOG_SQL} select * from ({body}) o" + order_sql(self.order, self.limit)

    def but(self, **changes) -> Rollup:
        return replace(self, **changes)


def ranked(df: DataFrame, order: tuple[str, ...], limit: int | None) -> DataFrame:
    """Sorted by names, a leading '-' for descending: NULLs are largest, as in the SQL the corpus was written for."""
    if order:
        df = df.orderBy(*[F.desc_nulls_first(o[1:]) if o[0] == "-" else F.asc_nulls_last(o) for o in order])
    return df.limit(limit) if limit else df


def order_sql(order: tuple[str, ...], limit: int | None) -> str:
    text = ", ".join(f"{o[1:]} desc nulls first" if o[0] == "-" else f"{o} asc nulls last" for o in order)
    return (f" order by {text}" if text else "") + (f" limit {limit}" if limit else "")
