"""The relations that queries run over, as DataFrames: events, tenants, users, and their regional foreign schemas."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import exprs as X

#: Regions by the name that queries use for them.
REGIONS = {"eu": "EUROPE", "us": "AMERICA", "apac": "ASIA"}
#: Largest dimension, in bytes as the optimizer knows them, that is sent to every task.
BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame) -> DataFrame:
    """A broadcast hint if the plan's size estimate is within BROADCAST_BYTES; else df, for a shuffled join."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


class Catalog:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        """Fact rows with the tenant of their user."""
        owner = self.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("tenant_id"))
        events = self.table("events").select("event_id", "user_id", "value", F.col("ts").cast("timestamp_ntz").alias("created_at"))
        return events.join(owner, "user_id").select("event_id", "tenant_id", "user_id", "value", "created_at")

    @cached_property
    def tenants(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        tenant = F.col("n_nationkey").cast("long")
        return nation.join(small_side(region), F.col("n_regionkey") == F.col("r_regionkey")).select(
            tenant.alias("tenant_id"), F.col("r_name").alias("region"), X.tenant_tier(tenant).alias("tenant_tier"), X.tenant_status(tenant).alias("tenant_status"),
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"), (tenant % 3 + 1).alias("dimension_version"),
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_nationkey").cast("long").alias("tenant_id"), F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("user_segment"), X.user_status(F.col("c_custkey")).alias("user_status")
        )

    @cached_property
    def global_users(self) -> DataFrame:
        return self.users.join(small_side(self.tenants.select("tenant_id", F.col("region").alias("home_region"))), "tenant_id")

    def relation(self, name: str) -> DataFrame:
        return getattr(self, name)

    def regional(self, region: str, name: str) -> DataFrame:
        """A relation as the region's foreign schema has it: the rows of its tenants."""
        here = self.tenants.filter(F.col("region") == REGIONS[region]).select("tenant_id")
        return self.relation(name).join(small_side(here), "tenant_id", "left_semi")

    def tagged(self, regions: tuple[str, ...], name: str) -> DataFrame:
        """A relation's rows of several regions with source_region: one scan, whatever the number of regions."""
        codes = F.create_map(*[F.lit(x) for r in regions for x in (REGIONS[r], r)])
        here = self.tenants.filter(F.col("region").isin([REGIONS[r] for r in regions])).select("tenant_id", codes[F.col("region")].alias("source_region"))
        return self.relation(name).join(small_side(here), "tenant_id")

    def import_schema(self, region: str, names: tuple[str, ...] = ("events", "tenants", "users", "global_users")) -> list[str]:
        """Registers a region's relations as views fdw_<region>_<name>, for SQL."""
        views = []
        for name in names:
            self.regional(region, name).createOrReplaceTempView(view := f"fdw_{region}_{name}")
            views.append(view)
        return views


#: The same relations for DuckDB.
CATALOG_SQL = """
tenants_t as (select cast(n_nationkey as bigint) tenant_id, r_name region,
  case when n_nationkey % 20 = 0 then 'enterprise' when n_nationkey % 5 = 0 then 'pro' else 'standard' end tenant_tier,
  case when n_nationkey % 97 = 0 then 'suspended' when n_nationkey % 31 = 0 then 'inactive' else 'active' end tenant_status,
  timestamp '2024-01-01 00:00:00' updated_at, cast(n_nationkey % 3 + 1 as bigint) dimension_version
  from nation join region on n_regionkey = r_regionkey),
events_t as (select event_id, cast(c_nationkey as bigint) tenant_id, user_id, value, ts created_at from events join customer on user_id = c_custkey),
users_t as (select cast(c_nationkey as bigint) tenant_id, c_custkey user_id, c_mktsegment user_segment,
  case when c_custkey % 53 = 0 then 'suspended' when c_custkey % 17 = 0 then 'inactive' else 'active' end user_status from customer),
global_users_t as (select u.*, t.region home_region from users_t u join tenants_t t using (tenant_id))
"""


def regional_sql(region: str, name: str) -> str:
    return f"(select x.* from {name}_t x where x.tenant_id in (select tenant_id from tenants_t where region = '{REGIONS[region]}'))"
