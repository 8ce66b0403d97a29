"""Registered queries for the toolkit's operators over stand-in evidence, each with SQL that says the same.

The stand-ins are derived from the star tables: line items are task work (region of the supplier, worker and task by modulus), orders are
query runs (scenario by customer, action by key), embeddings are states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import exprs as X
from gridloom.operators import aggregates as A
from gridloom.operators import features, interventions, joins, models
from gridloom.operators.corpus import D14, D21
from gridloom.plans import rewrite, structure
from gridloom.sources import generators
from gridloom.sources.catalog import CATALOG_SQL, Catalog, regional_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Callable[[Catalog], DataFrame]], Callable]:
    def add(build: Callable[[Catalog], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: build(Catalog(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return build

    return add


# --- Stand-ins ----------------------------------------------------------------------------------------------------------

DX = "cast({} as decimal(20,6))".format


def tasks(c: Catalog) -> DataFrame:
    where = c.table("supplier").join(c.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("region_id"))
    items = c.table("lineitem").join(where, "l_suppkey")
    return items.groupBy((F.col("l_orderkey") % 40).alias("run_id"), "region_id", (F.col("l_suppkey") % 3).alias("worker"), (F.col("l_orderkey") % 16).alias("task")).agg(
        X.exact_sum(F.col("l_quantity")).alias("task_rows"), X.exact_sum(F.col("l_extendedprice")).alias("task_bytes"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("temp_blocks")
    )


TASKS = f"""tasks as (select l_orderkey % 40 run_id, n_regionkey region_id, l_suppkey % 3 worker, l_orderkey % 16 task,
  cast(sum({DX('l_quantity')}) as double) task_rows, cast(sum({DX('l_extendedprice')}) as double) task_bytes, count(*) n, cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as bigint) temp_blocks
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2, 3, 4)"""


def runs(c: Catalog) -> DataFrame:
    o = c.table("orders")
    k = F.col("o_orderkey")
    action = F.element_at(F.array(*map(F.lit, ("stressed", "work_mem", "pushdown", "colocate"))), (k % 4 + 1).cast("int"))
    return o.select(
        k.alias("run_id"), (F.col("o_custkey") % 50).alias("scenario_id"), action.alias("action"), F.floor(k / 4).alias("repetition"), F.round(F.col("o_totalprice") / 1000.0, 6).alias("elapsed_seconds"),
        (F.col("o_orderpriority") != "5-LOW").alias("completed"), F.concat(F.lit("sig"), ((F.col("o_custkey") % 50 + F.when(k % 97 == 0, 1).otherwise(0)) % 7).cast("string")).alias("signature"), F.col("o_orderdate").alias("started_at"), F.col("o_orderstatus").alias("state"),
    )


RUNS = """runs as (select o_orderkey run_id, o_custkey % 50 scenario_id, ['stressed','work_mem','pushdown','colocate'][o_orderkey % 4 + 1] action, o_orderkey // 4 repetition,
  round(o_totalprice / 1000.0, 6) elapsed_seconds, o_orderpriority <> '5-LOW' completed, 'sig' || cast((o_custkey % 50 + case when o_orderkey % 97 = 0 then 1 else 0 end) % 7 as varchar) signature, o_orderdate started_at, o_orderstatus state from orders)"""
CONDITIONS = """conditions as (select scenario_id, action, count(*) filter (where completed) completed_count, round(median(case when completed then elapsed_seconds end), 6) elapsed_median,
  case when count(distinct case when completed then signature end) = 1 then min(case when completed then signature end) end signature from runs group by 1, 2)"""
GAINS = """gains as (select a.scenario_id, a.action, b.elapsed_median before, a.elapsed_median after, case when b.elapsed_median > 0 and a.elapsed_median > 0 then round(log2(b.elapsed_median / a.elapsed_median), 6) end gain,
  a.signature = b.signature result_equal from conditions a join conditions b on a.scenario_id = b.scenario_id and b.action = 'stressed' where a.action <> 'stressed')"""


def gain_rows(c: Catalog) -> DataFrame:
    return interventions.gains(interventions.condition_summary(runs(c)))


def vectors(c: Catalog) -> DataFrame:
    return c.table("embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), "label")


VECTORS = "vectors as (select vec_id id, list_transform(embedding, lambda x: cast(x as double)) as vector, label from embeddings)"


def scores(c: Catalog) -> DataFrame:
    """actual and predicted gain of each action: the prediction is the gain of the neighbouring scenario."""
    g = gain_rows(c).filter("gain is not null")
    other = g.select(((F.col("scenario_id") + 1) % 50).alias("scenario_id"), "action", F.col("gain").alias("predicted"))
    return g.select("scenario_id", "action", F.col("gain").alias("actual")).join(other, ["scenario_id", "action"])


SCORES = "scores as (select g.scenario_id, g.action, g.gain actual, h.gain predicted from gains g join gains h on h.action = g.action and (h.scenario_id + 1) % 50 = g.scenario_id where g.gain is not null and h.gain is not null)"
W_ALL = f"with {RUNS}, {CONDITIONS}, {GAINS}, {SCORES} "


def nodes(c: Catalog) -> DataFrame:
    """A plan to 64 orders: a tree by integer halving, one node an order."""
    o = c.table("orders")
    k = F.col("o_orderkey")
    types = F.array(*map(F.lit, ("Foreign Scan", "Hash Join", "Sort", "Aggregate", "Limit", "Seq Scan", "Hash")))
    place = k % 64 + 1
    depth = F.floor(F.log2(place)).cast("int")
    path = F.expr("array_join(transform(sequence(0, cast(floor(log2(o_orderkey % 64 + 1)) as int)), i -> cast(floor((o_orderkey % 64 + 1) / pow(2, cast(floor(log2(o_orderkey % 64 + 1)) as int) - i)) as string)), '.')")
    return o.select(
        F.floor(k / 64).cast("string").alias("plan_id"), place.cast("int").alias("node_id"), F.when(place > 1, F.floor(place / 2)).cast("int").alias("parent_node_id"), (place % 2).cast("int").alias("child_index"), depth.alias("depth"), path.alias("node_path"),
        F.element_at(types, ((k * 7 + F.floor(k / 64)) % 7 + 1).cast("int")).alias("node_type"), F.round("o_totalprice", 2).alias("actual_total_time"), F.col("o_custkey").cast("double").alias("actual_rows"), (k % 900 + 1).cast("double").alias("plan_rows"),
    )


NODES = """nodes as (select cast(o_orderkey // 64 as varchar) plan_id, cast(o_orderkey % 64 + 1 as int) node_id, cast(case when o_orderkey % 64 + 1 > 1 then (o_orderkey % 64 + 1) // 2 end as int) parent_node_id,
  cast((o_orderkey % 64 + 1) % 2 as int) child_index, cast(floor(log2(o_orderkey % 64 + 1)) as int) depth,
  ['Foreign Scan','Hash Join','Sort','Aggregate','Limit','Seq Scan','Hash'][(o_orderkey * 7 + o_orderkey // 64) % 7 + 1] node_type, round(o_totalprice, 2) actual_total_time, cast(o_custkey as double) actual_rows, cast(o_orderkey % 900 + 1 as double) plan_rows
  from orders)"""

# --- Sources and generators ---------------------------------------------------------------------------------------------

SMALL = generators.Profile(last_tenant=12, users=6, events=40)
HOT = generators.Profile(last_tenant=30, users=6, events=40, hot_tenants=10.0, hot_events=55.0)


@register("gen_series", "select range as value from range(3, 18)")
def _(c):
    return generators.series(c.spark, 3, 17)


@register("gen_values", "select * from (values (cast(1 as bigint), 'a'), (2, 'b'), (3, null)) t(id, name)")
def _(c):
    return generators.values(c.spark, [(1, "a"), (2, "b"), (3, None)], "id long, name string")


@register("gen_tenants", "select range tenant_id, 'eu' region, case when range % 20 = 0 then 'enterprise' when range % 5 = 0 then 'pro' else 'standard' end tenant_tier, case when range % 97 = 0 then 'suspended' when range % 31 = 0 then 'inactive' else 'active' end tenant_status, timestamp '2026-07-01 00:00:00' updated_at, cast(1 as bigint) dimension_version from range(1, 201)")
def _(c):
    return generators.tenants(c.spark, generators.Profile(last_tenant=200))


USERS_SQL = "select t.range tenant_id, u.range user_id, ['consumer','professional','power','trial'][(u.range - 1) % 4 + 1] user_segment, case when u.range % 53 = 0 then 'suspended' when u.range % 17 = 0 then 'inactive' else 'active' end user_status, (t.range * 17 + u.range * 31 + 42) % 361 signup_age_days{} from range(1, 13) t, range(1, 61) u"


@register("gen_users", USERS_SQL.format(""))
def _(c):
    return generators.users(c.spark, generators.Profile(last_tenant=12, users=60))


@register("gen_global_users", USERS_SQL.format(", 'eu' as home_region"))
def _(c):
    return generators.users(c.spark, generators.Profile(last_tenant=12, users=60), "eu")


EVENTS_SQL = "select {} event_id, t tenant_id, abs(t * 1103515245 + o * 12345 + 42) % 6 + 1 user_id, (abs(t * 214013 + o * 2531011 + 42) % 99900 + 100) / 100.0 as value, make_timestamp((1782864000 - abs(t * 48271 + o * 69621 + 42) % 31 * 86400 - abs(t * 16807 + o * 950706376 + 42) % 86400) * 1000000) created_at from (select t.range t, o.range o from range(1, 13) t, range(1, 41) o)"


@register("gen_events_lcg", EVENTS_SQL.format("(t - 1) * 40 + o"))
def _(c):
    return generators.events(c.spark, SMALL)


@register("gen_events_tenant_global", EVENTS_SQL.format("t * 1000000 + o"))
def _(c):
    return generators.events(c.spark, generators.Profile(last_tenant=12, users=6, events=40, event_ids="tenant_global"))


@register("gen_hot_tenant_allocation", "select range + 1 tenant_id, case when range < 3 then 660 // 3 + case when range < 660 % 3 then 1 else 0 end else 540 // 27 + case when range - 3 < 540 % 27 then 1 else 0 end end events from range(30)")
def _(c):
    return generators.series(c.spark, 1, 30, "tenant_id").withColumn("events", generators.events_for_tenant(HOT, F.col("tenant_id") - 1))


@register("gen_hot_event_ids", "select count(*) n, count(distinct event_id) ids, min(event_id) least, max(event_id) most from (select range + 1 event_id from range(1200))")
def _(c):
    return generators.events(c.spark, HOT).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"), F.min("event_id").alias("least"), F.max("event_id").alias("most"))


@register("gen_events_hashed")
def _(c):
    return generators.hashed_events(c.spark, HOT)


@register("gen_events_random")
def _(c):
    return generators.random_events(c.spark, SMALL)


@register("update_reference_slice", f"with {CATALOG_SQL} select tenant_id, case when region = 'ASIA' then 'enterprise' else tenant_tier end tenant_tier, dimension_version + case when region = 'ASIA' then 1 else 0 end dimension_version from tenants_t")
def _(c):
    return generators.update_slice(c.tenants, F.col("region") == "ASIA", tenant_tier=F.lit("enterprise")).select("tenant_id", "tenant_tier", "dimension_version")


# --- Scans, probes, payloads --------------------------------------------------------------------------------------------


@register("stage_e1_recent_hourly_burst", f"with {CATALOG_SQL} select date_trunc('hour', created_at) as hour, count(*) as events from events_t where created_at >= '2024-01-29 00:00:00' group by 1")
def _(c):
    return c.events.filter("created_at >= '2024-01-29 00:00:00'").groupBy(X.hour(F.col("created_at")).alias("hour")).agg(F.count(F.lit(1)).alias("events"))


@register("stage_e3_bad_pushdown_sqrt", f"with {CATALOG_SQL} select tenant_id, count(*) as transformed_high_value_events from events_t where sqrt(value) > 10 group by 1")
def _(c):
    return c.events.filter(F.sqrt("value") > 10).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("transformed_high_value_events"))


@register("stage_a6_high_value_filter", f"with {CATALOG_SQL} select tenant_id, count(*) as high_value_events from events_t where value > 120 and {D14} group by 1")
def _(c):
    return c.events.filter(f"value > 120 and {D14}").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("high_value_events"))


SHAPE = {"users": "users", "global_users": "global_users", "events": "events"}


@register("stage_e6_dataset_shape_probe", f"""with {CATALOG_SQL}, t as (select count(*) tenants, count(*) filter (where tenant_tier = 'enterprise') enterprise_tenants, count(*) filter (where tenant_status = 'suspended') suspended_tenants, max(dimension_version) max_dimension_version from tenants_t),
u as (select cast(sum(n) as bigint) users, min(n) min_users_per_tenant, max(n) max_users_per_tenant, cast(round(avg(n), 2) as double) avg_users_per_tenant from (select tenant_id, count(*) n from users_t group by 1)),
g as (select cast(sum(n) as bigint) global_users, min(n) min_global_users_per_tenant, max(n) max_global_users_per_tenant, cast(round(avg(n), 2) as double) avg_global_users_per_tenant from (select tenant_id, count(*) n from global_users_t group by 1)),
e as (select cast(sum(n) as bigint) events, min(n) min_events_per_tenant, max(n) max_events_per_tenant, cast(round(avg(n), 2) as double) avg_events_per_tenant from (select tenant_id, count(*) n from events_t group by 1)) select * from t, u, g, e""")
def _(c):
    tenants = c.tenants.agg(F.count(F.lit(1)).alias("tenants"), F.count_if(F.col("tenant_tier") == "enterprise").alias("enterprise_tenants"), F.count_if(F.col("tenant_status") == "suspended").alias("suspended_tenants"), F.max("dimension_version").alias("max_dimension_version"))
    for name in SHAPE:
        counted = c.relation(name).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))
        tenants = tenants.join(F.broadcast(counted.agg(F.sum("n").alias(name), F.min("n").alias(f"min_{name}_per_tenant"), F.max("n").alias(f"max_{name}_per_tenant"), F.round(F.avg("n"), 2).alias(f"avg_{name}_per_tenant"))))
    return tenants


def payload(df: DataFrame, repeats: int, width: int) -> DataFrame:
    return df.withColumn("synthetic_payload", F.substring(F.repeat(F.md5(F.concat_ws(":", "event_id", "tenant_id", "user_id")), repeats), 1, width))


PAYLOAD = "substring(repeat(md5(event_id || ':' || tenant_id || ':' || user_id), 4), 1, 100) synthetic_payload"
RECENT = ["created_at desc", "source_region", "tenant_id", "event_id"]


@register("gac_fdw_event_raw_wide_sample", f"with {CATALOG_SQL} select event_id, tenant_id, user_id, value, created_at, {PAYLOAD} from {regional_sql('eu', 'events')} e where {D14} and value >= 15 order by created_at desc, tenant_id, event_id limit 50")
def _(c):
    rows = c.regional("eu", "events").filter(f"{D14} and value >= 15")
    best = rows.orderBy(F.desc("created_at"), "tenant_id", "event_id").limit(50)
    return payload(best, 4, 100).select("event_id", "tenant_id", "user_id", "value", "created_at", "synthetic_payload")


@register("gac_fdw_multiregion_event_raw_wide_sample", f"with {CATALOG_SQL} select source_region, event_id, tenant_id, user_id, value, created_at, {PAYLOAD} from (select 'eu' source_region, * from {regional_sql('eu', 'events')} a union all select 'us', * from {regional_sql('us', 'events')} b) where {D14} and value >= 15 order by created_at desc, source_region, tenant_id, event_id limit 50")
def _(c):
    branches = {r: c.regional(r, "events").filter(f"{D14} and value >= 15") for r in ("eu", "us")}
    best = rewrite.topk_below_union(branches, [F.desc("created_at"), F.col("source_region"), F.col("tenant_id"), F.col("event_id")], 50)
    return payload(best, 4, 100).select("source_region", "event_id", "tenant_id", "user_id", "value", "created_at", "synthetic_payload")


HOT_SUM = " + ".join(f"user_id % {97 + i}" for i in range(8))


@register("gac_fdw_multiregion_hot_worker_probe", f"with {CATALOG_SQL} select source_region, count(*) events_count, cast(sum({HOT_SUM}) as bigint) worker_checksum from (select 'eu' source_region, * from {regional_sql('eu', 'events')} a union all select 'us', * from {regional_sql('us', 'events')} b) where tenant_id between 2 and 20 group by 1")
def _(c):
    branches = {r: c.regional(r, "events").filter(F.col("tenant_id").between(2, 20)) for r in ("eu", "us")}
    work = sum((F.col("user_id") % (97 + i) for i in range(1, 8)), F.col("user_id") % 97)
    partial = lambda df: df.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("events_count"), F.sum(work).alias("worker_checksum"))
    return rewrite.reduce_then_merge(branches, partial, lambda df: df.groupBy("source_region").agg(F.sum("events_count").alias("events_count"), F.sum("worker_checksum").alias("worker_checksum")))


for kind in ("raw", "regional"):

    @register(f"gac_fdw_coordinator_{kind}_distinct_users", f"with {CATALOG_SQL} select distinct user_id from (select * from {regional_sql('eu', 'events')} a union all select * from {regional_sql('us', 'events')} b) where {D21} and user_id <= 120")
    def _(c, kind=kind):
        branches = {r: c.regional(r, "events").filter(f"{D21} and user_id <= 120").select("user_id") for r in ("eu", "us")}
        return branches["eu"].union(branches["us"]).distinct() if kind == "raw" else rewrite.distinct_below_union(branches)

    @register(f"gac_fdw_coordinator_{kind}_event_topk", f"with {CATALOG_SQL} select source_region, event_id, tenant_id, user_id, value from (select 'eu' source_region, * from {regional_sql('eu', 'events')} a union all select 'us', * from {regional_sql('us', 'events')} b) where {D21} order by value desc, source_region, tenant_id, event_id limit 40")
    def _(c, kind=kind):
        branches = {r: c.regional(r, "events").filter(D21).select("event_id", "tenant_id", "user_id", "value") for r in ("eu", "us")}
        order = [F.desc("value"), F.col("source_region"), F.col("tenant_id"), F.col("event_id")]
        if kind == "regional":
            return rewrite.topk_below_union(branches, order, 40)
        return branches["eu"].withColumn("source_region", F.lit("eu")).union(branches["us"].withColumn("source_region", F.lit("us"))).orderBy(*order).limit(40)


@register("sr_q13_amplified_user_topk", f"with {CATALOG_SQL} select tenant_id, user_id, cast(sum({DX('value')}) as double) total_value, repeat(md5(tenant_id || ':' || user_id), 3) pressure_payload from events_t, range(5) where {D14} group by 1, 2 order by total_value desc, tenant_id, user_id limit 20")
def _(c):
    amplified = c.events.filter(D14).withColumn("replica_id", F.explode(F.sequence(F.lit(1), F.lit(5))))
    grouped = amplified.groupBy("tenant_id", "user_id").agg(X.exact_sum(F.col("value")).alias("total_value"))
    return grouped.withColumn("pressure_payload", F.repeat(F.md5(F.concat_ws(":", "tenant_id", "user_id")), 3)).orderBy(F.desc("total_value"), "tenant_id", "user_id").limit(20)


def sample_rows(c: Catalog, side: str, regions: tuple, k: int) -> DataFrame:
    where = f"{D21} and tenant_id % 3 != 1 and user_id <= 120"
    branches = {r: c.regional(r, "events").filter(where).join(c.regional(r, side).select("tenant_id", "user_id", "user_segment", "user_status"), ["tenant_id", "user_id"]) for r in regions}
    best = rewrite.topk_below_union(branches, [F.col("event_id"), F.col("source_region"), F.col("tenant_id"), F.col("user_id")], k)
    return best.select("source_region", "event_id", "tenant_id", "user_id", "user_segment", "user_status", "value")


def sample_sql(side: str, regions: tuple) -> str:
    parts = " union all ".join(f"select '{r}' source_region, e.event_id, e.tenant_id, e.user_id, u.user_segment, u.user_status, e.value from {regional_sql(r, 'events')} e join {regional_sql(r, side)} u using (tenant_id, user_id) where {D21} and tenant_id % 3 != 1 and user_id <= 120" for r in regions)
    return f"with {CATALOG_SQL} select * from ({parts}) order by event_id, source_region, tenant_id, user_id limit 60"


for label, side in (("colocated", "users"), ("repartition", "global_users")):
    for prefix, regions in ((f"gac_fdw_n3_{label}_joined_event_sample", ("eu", "us", "apac")), (f"gac_fdw_single_edge_{label}_joined_event_sample_pair", ("eu",)), (f"sr_q{16 if side == 'users' else 17}_{label}_joined_event_sample_pair", ("eu", "us"))):
        register(prefix, sample_sql(side, regions))(lambda c, s=side, r=regions: sample_rows(c, s, r, 60))


# --- Counting joins -----------------------------------------------------------------------------------------------------

#: Count queries by the shapes of the external workload's key graph, on the star tables: stars on one key, chains, many-to-many, up to seven relations.
COUNTS = {
    "star_2": "select count(*) from orders as o, customer as c where o.o_custkey = c.c_custkey and c.c_acctbal >= 100",
    "many_to_many_2": "select count(*) from events as e, orders as o where e.user_id = o.o_custkey and o.o_totalprice >= 1000",
    "many_to_many_3": "select count(*) from events as e, orders as o, customer as c where e.user_id = o.o_custkey and o.o_custkey = c.c_custkey and e.value <= 200",
    "chain_3": "select count(*) from lineitem as l, orders as o, customer as c where l.l_orderkey = o.o_orderkey and o.o_custkey = c.c_custkey and l.l_quantity >= 10 and c.c_nationkey <= 12",
    "chain_4": "select count(*) from lineitem as l, supplier as s, nation as n, region as r where l.l_suppkey = s.s_suppkey and s.s_nationkey = n.n_nationkey and n.n_regionkey = r.r_regionkey and l.l_discount <= 0.05",
    "fan_4": "select count(*) from customer as c, orders as o, events as e, supplier as s where c.c_custkey = o.o_custkey and c.c_custkey = e.user_id and s.s_nationkey = c.c_nationkey and e.value >= 10",
    "fan_5": "select count(*) from customer as c, orders as o, events as e, supplier as s, nation as n where c.c_custkey = o.o_custkey and o.o_custkey = e.user_id and s.s_nationkey = c.c_nationkey and n.n_nationkey = s.s_nationkey and o.o_totalprice <= 300000",
    "tree_6": "select count(*) from lineitem as l, orders as o, customer as c, supplier as s, nation as n, events as e where l.l_orderkey = o.o_orderkey and o.o_custkey = c.c_custkey and l.l_suppkey = s.s_suppkey and s.s_nationkey = n.n_nationkey and e.user_id = c.c_custkey and l.l_quantity <= 40",
    "tree_7": "select count(*) from lineitem as l, orders as o, customer as c, supplier as s, nation as n, region as r, part as p where l.l_orderkey = o.o_orderkey and o.o_custkey = c.c_custkey and l.l_suppkey = s.s_suppkey and s.s_nationkey = n.n_nationkey and n.n_regionkey = r.r_regionkey and l.l_partkey = p.p_partkey and p.p_size >= 5 and c.c_acctbal >= 0",
    "cycle_3": "select count(*) from customer as c, supplier as s, nation as n where c.c_nationkey = s.s_nationkey and s.s_nationkey = n.n_nationkey and c.c_nationkey = n.n_nationkey and n.n_regionkey <= 3",
}
for name, text in COUNTS.items():
    query = joins.parse_count_query(text)
    register(f"count_join_{name}", text.replace("count(*)", "count(*) as result_count"))(lambda c, q=query: joins.count_join(q, {t: c.table(t) for t in set(q.relations.values())}))


@register("count_join_multiregion", f"with {CATALOG_SQL} " + " union all ".join(f"select '{r}' source_region, count(*) result_count from {regional_sql(r, 'events')} e, {regional_sql(r, 'users')} u where e.user_id = u.user_id and e.value >= 20" for r in ("eu", "us")))
def _(c):
    query = joins.parse_count_query("select count(*) from events as e, users as u where e.user_id = u.user_id and e.value >= 20")
    parts = [joins.count_join(query, {t: c.regional(r, t) for t in ("events", "users")}).select(F.lit(r).alias("source_region"), "result_count") for r in ("eu", "us")]
    return parts[0].union(parts[1])


# --- Joins and ordering -------------------------------------------------------------------------------------------------


@register("join_indicator", f"with {RUNS}, a as (select distinct scenario_id from runs where action = 'stressed' and scenario_id % 3 <> 0), b as (select distinct scenario_id from runs where action = 'work_mem' and scenario_id % 2 = 0) select coalesce(a.scenario_id, b.scenario_id) scenario_id, case when a.scenario_id is not null and b.scenario_id is not null then 'both' when a.scenario_id is not null then 'left_only' else 'right_only' end side from a full join b on a.scenario_id = b.scenario_id")
def _(c):
    r = runs(c)
    a = r.filter("action = 'stressed' and scenario_id % 3 <> 0").select("scenario_id").distinct()
    b = r.filter("action = 'work_mem' and scenario_id % 2 = 0").select("scenario_id").distinct()
    return joins.with_indicator(a, b, ["scenario_id"])


@register("join_semi_anti", f"with {CATALOG_SQL} select u.tenant_id, u.user_id, case when exists (select 1 from events_t e where e.user_id = u.user_id and e.value > 150) then 'semi' else 'anti' end side from users_t u")
def _(c):
    some, users = c.events.filter("value > 150"), c.users.select("tenant_id", "user_id")
    return users.join(some, "user_id", "left_semi").withColumn("side", F.lit("semi")).unionByName(users.join(some, "user_id", "left_anti").withColumn("side", F.lit("anti")))


@register("join_merge_one", f"with {CATALOG_SQL} select u.user_id, t.region from users_t u left join tenants_t t using (tenant_id)")
def _(c):
    return joins.merge_one(c.users, c.tenants.select("tenant_id", "region"), ["tenant_id"]).select("user_id", "region")


@register("join_latest_attempt", f"with {RUNS} select scenario_id, action, run_id, elapsed_seconds from (select *, row_number() over (partition by scenario_id, action order by completed desc, repetition desc, run_id) rn from runs) where rn = 1")
def _(c):
    return joins.latest(runs(c), ["scenario_id", "action"], F.desc("completed"), F.desc("repetition"), F.col("run_id")).select("scenario_id", "action", "run_id", "elapsed_seconds")


@register("join_bracket", f"with {CATALOG_SQL}, w as (select user_id, timestamp '2024-01-10 00:00:00' lo, timestamp '2024-01-12 00:00:00' hi from users_t) select w.user_id, max(case when created_at <= lo then created_at end) as before, min(case when created_at >= hi then created_at end) as after from w left join events_t e on e.user_id = w.user_id group by 1")
def _(c):
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    windows = c.users.select("user_id", stamp("2024-01-10 00:00:00").alias("lo"), stamp("2024-01-12 00:00:00").alias("hi"))
    return joins.bracket(c.events, windows, "created_at", "lo", "hi", ["user_id"]).select("user_id", "before", "after")


NEAREST = "with {v}, q as (select * from vectors where id % 20 = 0) select query_id, rank, id, round(distance, 6) distance from (select q.id query_id, v.id, {d} distance, row_number() over (partition by q.id order by round({d}, 9), v.id) as rank from q, vectors v where v.id <> q.id) where rank <= 5"
DIST = {"euclidean": "sqrt(list_sum([(x[1] - x[2]) ** 2 for x in list_zip(q.vector, v.vector)]))", "manhattan": "list_sum([abs(x[1] - x[2]) for x in list_zip(q.vector, v.vector)])", "cosine": "1 - list_inner_product(q.vector, v.vector) / (sqrt(list_inner_product(q.vector, q.vector)) * sqrt(list_inner_product(v.vector, v.vector)))"}
for kind, expression in DIST.items():

    @register(f"nearest_{kind}", NEAREST.format(v=VECTORS, d=expression))
    def _(c, kind=kind):
        return joins.nearest(vectors(c).filter("id % 20 = 0"), vectors(c), 5, kind).withColumn("distance", F.round("distance", 6)).withColumn("rank", F.col("rank").cast("long"))


@register("tolerant_result_match")
def _(c):
    left = c.events.groupBy("tenant_id", "user_id").agg(F.avg("value").alias("mean"))
    right = left.withColumn("mean", F.col("mean") * (1 + 1e-12))
    return joins.tolerant_match(left, right, ["tenant_id"], ["mean"])


@register("window_transitions", f"with {RUNS} select scenario_id, before, state, count(*) n from (select scenario_id, state, lag(state) over (partition by scenario_id order by started_at, run_id) as before from runs) where before is not null group by 1, 2, 3")
def _(c):
    before = F.lag("state").over(Window.partitionBy("scenario_id").orderBy("started_at", "run_id"))
    return runs(c).withColumn("before", before).filter("before is not null").groupBy("scenario_id", "before", "state").agg(F.count(F.lit(1)).alias("n"))


@register("window_hash_shuffle", f"with {RUNS} select run_id, row_number() over (order by sha256(run_id || '::' || scenario_id), run_id) as place from runs")
def _(c):
    keyed = runs(c).select("run_id", F.sha2(F.concat_ws("::", "run_id", "scenario_id"), 256).alias("h"))
    return rewrite.ranked_by_hash(keyed, "h", "run_id").select("run_id", "place")


@register("window_stratified_quota", f"with {RUNS} select scenario_id, run_id from (select *, row_number() over (partition by scenario_id order by sha256(cast(run_id as varchar)), run_id) rn from runs) where rn <= 3")
def _(c):
    place = F.row_number().over(Window.partitionBy("scenario_id").orderBy(F.sha2(F.col("run_id").cast("string"), 256), "run_id"))
    return runs(c).withColumn("rn", place).filter("rn <= 3").select("scenario_id", "run_id")


@register("window_round_robin", f"with {RUNS} select run_id from (select *, row_number() over (partition by scenario_id order by sha256(cast(run_id as varchar)), run_id) rn from runs) order by rn, scenario_id limit 80")
def _(c):
    place = F.row_number().over(Window.partitionBy("scenario_id").orderBy(F.sha2(F.col("run_id").cast("string"), 256), "run_id"))
    return runs(c).withColumn("rn", place).orderBy("rn", "scenario_id").limit(80).select("run_id")


@register("window_average_rank", f"with {RUNS} select run_id, cast(rank() over (partition by action order by repetition % 10) + (count(*) over (partition by action, repetition % 10) - 1) / 2.0 as double) as r from runs")
def _(c):
    return runs(c).withColumn("x", F.col("repetition") % 10).withColumn("r", A.average_rank("x", ["action"])).select("run_id", "r")


@register("window_quantile_bin", f"with {RUNS}, e as (select quantile_cont(elapsed_seconds, [0.2, 0.4, 0.6, 0.8]) edges from runs) select bin, count(*) n from (select (elapsed_seconds > edges[1])::int + (elapsed_seconds > edges[2])::int + (elapsed_seconds > edges[3])::int + (elapsed_seconds > edges[4])::int as bin from runs, e) group by 1")
def _(c):
    return A.quantile_bin(runs(c), "elapsed_seconds", 5).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


# --- Aggregates ---------------------------------------------------------------------------------------------------------

SPREAD = f"""with {TASKS}, s as (select run_id, count(task_rows) n, cast(sum({DX('task_rows')}) as double) total, min(task_rows) lo, max(task_rows) hi, avg(task_rows) mean, stddev_pop(task_rows) sd, count(*) filter (where task_rows > 0) active from tasks group by 1)
select run_id, total rows_sum, lo rows_min, hi rows_max, round(total / nullif(n, 0), 6) rows_mean, round(case when mean <> 0 then sd / mean when sd = 0 then 0 end, 6) rows_cv, round(hi / total, 6) rows_max_share, round(hi / total * n, 6) rows_isf,
round(case when n = 1 then 0 else greatest(0, least(1, (hi / total * n - 1) / (n - 1))) end, 6) rows_isf_norm, round(case when n = 1 then 0 else greatest(0, least(1, sd / mean / sqrt(n - 1))) end, 6) rows_cv_norm, round(lo / hi, 6) rows_min_max_ratio, round(active / n, 6) rows_active_share from s"""


@register("agg_task_spread", SPREAD)
def _(c):
    return tasks(c).groupBy("run_id").agg(*A.spread(F.col("task_rows"), "rows"))


@register("agg_nested_skew", f"with {TASKS}, w as (select run_id, region_id, worker, sum(n) n from tasks group by all), r as (select run_id, region_id, cast(max(n) as double) / cast(sum(n) as double) * count(*) isf from w group by 1, 2) select run_id, round(max(isf), 6) worst_isf, count(*) regions from r group by 1")
def _(c):
    worker = tasks(c).groupBy("run_id", "region_id", "worker").agg(F.sum("n").alias("n"))
    region = worker.groupBy("run_id", "region_id").agg((F.max("n") / F.sum("n") * F.count(F.lit(1))).alias("isf"))
    return region.groupBy("run_id").agg(F.round(F.max("isf"), 6).alias("worst_isf"), F.count(F.lit(1)).alias("regions"))


@register("agg_complete_evidence", f"with {TASKS} select run_id, case when count(case when n > 1 then task_rows end) = count(*) then cast(sum({DX('task_rows')}) as double) end total from tasks group by 1")
def _(c):
    seen = F.when(F.col("n") > 1, F.col("task_rows"))
    return tasks(c).groupBy("run_id").agg(A.complete(seen, X.exact_sum(F.col("task_rows"))).alias("total"))


@register("agg_active_only", f"with {TASKS} select run_id, case when count(*) >= 2 then round(cast(max(temp_blocks) as double) / cast(sum(temp_blocks) as double) * count(*), 6) end isf from tasks where temp_blocks > 0 group by 1")
def _(c):
    t = F.col("temp_blocks")
    return tasks(c).filter(t > 0).groupBy("run_id").agg(F.when(F.count(F.lit(1)) >= 2, F.round(F.max(t) / F.sum(t) * F.count(F.lit(1)), 6)).alias("isf"))


@register("agg_largest_signed", f"with {RUNS}, x as (select scenario_id, round(elapsed_seconds - 150, 6) d from runs) select scenario_id, d from (select *, row_number() over (partition by scenario_id order by abs(d) desc, d desc) rn from x) where rn = 1")
def _(c):
    return runs(c).withColumn("d", F.round(F.col("elapsed_seconds") - 150, 6)).groupBy("scenario_id").agg(A.largest_signed(F.col("d")).alias("d"))


@register("agg_mode", f"with {RUNS} select scenario_id, state as mode, n as times from (select scenario_id, state, count(*) n, row_number() over (partition by scenario_id order by count(*) desc, state) rn from runs group by 1, 2) where rn = 1")
def _(c):
    return A.mode(runs(c), ["scenario_id"], "state")


@register("agg_nearest_rank_p95", f"with {RUNS} select scenario_id, list_sort(list(elapsed_seconds))[cast(ceil(count(*) * 0.95) as int)] p95 from runs group by 1")
def _(c):
    return A.nearest_rank_of(runs(c), ["scenario_id"], "elapsed_seconds", 0.95).withColumnRenamed("value", "p95")


@register("agg_percentiles", f"with {RUNS} select action, round(quantile_cont(elapsed_seconds, 0.1), 6) q10, round(median(elapsed_seconds), 6) q50, round(quantile_cont(elapsed_seconds, 0.9), 6) q90 from runs group by 1")
def _(c):
    p = lambda q: F.round(F.percentile("elapsed_seconds", F.lit(q)), 6)
    return runs(c).groupBy("action").agg(p(0.1).alias("q10"), p(0.5).alias("q50"), p(0.9).alias("q90"))


@register("agg_robust_dispersion", f"with {RUNS}, m as (select scenario_id, median(elapsed_seconds) md from runs group by 1) select scenario_id, md as median, round(median(abs(elapsed_seconds - md)), 6) mad, round(1.4826 * median(abs(elapsed_seconds - md)) / nullif(abs(md), 0), 6) dispersion from runs join m using (scenario_id) group by 1, 2")
def _(c):
    return A.robust_dispersion(runs(c), ["scenario_id"], "elapsed_seconds").withColumn("mad", F.round("mad", 6))


@register("agg_weighted_median", f"with {RUNS}, x as (select scenario_id, elapsed_seconds v, sum(repetition % 5 + 1) over (partition by scenario_id order by elapsed_seconds range between unbounded preceding and current row) cum, sum(repetition % 5 + 1) over (partition by scenario_id) total from runs) select scenario_id, min(v) weighted_median from x where cum >= total / 2 group by 1")
def _(c):
    return A.weighted_median(runs(c).withColumn("w", F.col("repetition") % 5 + 1), ["scenario_id"], "elapsed_seconds", "w")


@register("agg_weighted_moments", f"with {RUNS}, x as (select action, elapsed_seconds v, repetition % 5 + 1 w from runs) select action, round(sum(w * v) / sum(w), 5) mean, round(sqrt(greatest(sum(w * v * v) / sum(w) - power(sum(w * v) / sum(w), 2), 0)), 4) deviation, round(cast(sum(w) as double) * sum(w) / sum(w * w), 5) ess from x group by 1")
def _(c):
    w, v = (F.col("repetition") % 5 + 1).cast("double"), F.col("elapsed_seconds")
    mean, deviation = A.weighted_moments(v, w)
    return runs(c).groupBy("action").agg(F.round(mean, 5).alias("mean"), F.round(deviation, 4).alias("deviation"), F.round(A.effective_sample_size(w), 5).alias("ess"))


@register("agg_harmonic_mean", f"with {RUNS} select action, round(count(*) / sum(1 / elapsed_seconds), 6) hmean, round(stddev_samp(elapsed_seconds), 4) sd from runs where elapsed_seconds > 0 group by 1")
def _(c):
    return runs(c).groupBy("action").agg(F.round(A.harmonic_mean(F.col("elapsed_seconds")), 6).alias("hmean"), F.round(A.sample_deviation(F.col("elapsed_seconds")), 4).alias("sd"))


@register("agg_joined_set", f"with {RUNS} select scenario_id, string_agg(distinct signature, ',' order by signature) signatures from runs group by 1")
def _(c):
    return runs(c).groupBy("scenario_id").agg(A.joined_set(F.col("signature")).alias("signatures"))


@register("agg_merged_counters", f"with {RUNS}, x as (select action, state as name, count(*) n from runs group by 1, 2) select action, name, cast(n as double) total from x")
def _(c):
    maps = runs(c).groupBy("action", "scenario_id", "state").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("action", "scenario_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("state", "n")))).alias("counters"))
    return A.merged_counters(maps, ["action"], "counters")


@register("agg_pivot_actions", f"with {RUNS}, {CONDITIONS}, {GAINS} select scenario_id, max(case when action = 'work_mem' then gain end) work_mem, max(case when action = 'pushdown' then gain end) pushdown, max(case when action = 'colocate' then gain end) colocate from gains group by 1")
def _(c):
    return gain_rows(c).groupBy("scenario_id").pivot("action", ["work_mem", "pushdown", "colocate"]).agg(F.max("gain"))


@register("agg_one_hot", f"with {RUNS} select run_id, cast(state = 'F' as int) state__F, cast(state = 'O' as int) state__O, cast(state = 'P' as int) state__P from runs")
def _(c):
    return A.one_hot(runs(c).select("run_id", "state"), "state", ["F", "O", "P"]).drop("state")


@register("agg_instance_summary", f"with {RUNS} select scenario_id, count(*) runs, round(count(*) filter (where not completed) / count(*), 6) failure_rate, round(avg({DX('elapsed_seconds')}), 5) mean, round(median(elapsed_seconds), 6) median, round(stddev_pop(elapsed_seconds) / avg(elapsed_seconds), 5) cv, count(distinct signature) fingerprints from runs group by 1")
def _(c):
    e = F.col("elapsed_seconds")
    return runs(c).groupBy("scenario_id").agg(F.count(F.lit(1)).alias("runs"), F.round(F.count_if(~F.col("completed")) / F.count(F.lit(1)), 6).alias("failure_rate"), F.round(X.exact_sum(e) / F.count(e), 5).alias("mean"), F.round(F.median(e), 6).alias("median"), F.round(X.population_cv(e), 5).alias("cv"), F.countDistinct("signature").alias("fingerprints"))


# --- Plan structure -----------------------------------------------------------------------------------------------------


@register("plan_edges", f"with {NODES} select c.plan_id, c.parent_node_id, c.node_id child_node_id, c.child_index, c.node_type child_node_type, c.depth child_depth, p.node_type parent_node_type, p.depth parent_depth from nodes c join nodes p on p.plan_id = c.plan_id and p.node_id = c.parent_node_id")
def _(c):
    return structure.plan_edges(nodes(c)).drop("child_path", "parent_path")


@register("plan_tree_shape", f"with {NODES}, k as (select plan_id, parent_node_id node_id, count(*) children from nodes where parent_node_id is not null group by 1, 2), j as (select n.plan_id, n.depth, coalesce(children, 0) children from nodes n left join k using (plan_id, node_id)) select plan_id, count(*) node_count, count(*) filter (where children = 0) leaf_count, count(*) filter (where children > 1) branch_count, max(depth) max_depth, round(sum(children) / nullif(count(*) filter (where children > 0), 0), 6) branching_factor, max(children) max_children from j group by 1")
def _(c):
    return structure.tree_shape(nodes(c))


OP_CLASS = "case when node_type like '%Join%' then 'join' when node_type like '%Agg%' then 'aggregate' when node_type like '%Sort%' then 'sort' when node_type like '%Scan%' then 'scan' when node_type = 'Limit' then 'limit' else 'other' end"


@register("plan_operator_depths", f"with {NODES} select plan_id, {OP_CLASS} operator_class, count(*) operators, min(depth) min_depth, max(depth) max_depth from nodes group by 1, 2")
def _(c):
    return structure.operator_depths(nodes(c))


@register("plan_above_scans", f"with recursive {NODES}, up as (select plan_id, node_id, parent_node_id above from nodes where node_type = 'Foreign Scan' union all select u.plan_id, u.node_id, n.parent_node_id from up u join nodes n on n.plan_id = u.plan_id and n.node_id = u.above where n.parent_node_id is not null), a as (select u.plan_id, u.node_id, {OP_CLASS} c from up u left join nodes n on n.plan_id = u.plan_id and n.node_id = u.above) select plan_id, node_id, max(coalesce(cast(c = 'aggregate' as int), 0)) has_aggregate_above, max(coalesce(cast(c = 'sort' as int), 0)) has_sort_above, max(coalesce(cast(c = 'limit' as int), 0)) has_limit_above, max(coalesce(cast(c = 'join' as int), 0)) has_join_above from a group by 1, 2")
def _(c):
    return structure.above_scans(nodes(c))


PAIRS = ["Sort", "Aggregate", "Hash Join"]


@register("plan_transitions", f"with {NODES}, e as (select c.plan_id, p.node_type a, c.node_type b from nodes c join nodes p on p.plan_id = c.plan_id and p.node_id = c.parent_node_id) select plan_id, " + ", ".join(f"count(*) filter (where a = '{a}' and b = '{b}') as \"{a} > {b}\"" for a in PAIRS for b in PAIRS) + " from e group by 1")
def _(c):
    return structure.transitions(nodes(c), PAIRS)


@register("plan_blocking", f"with {NODES} select plan_id, count(*) blocking_count, arg_min(node_type, depth * 1000 + node_id) first_blocking, min(depth) first_blocking_depth from nodes where node_type in ('Sort', 'Aggregate', 'Hash') group by 1")
def _(c):
    named = nodes(c).withColumn("node_path", F.lpad(F.col("node_id").cast("string"), 6, "0"))
    return structure.blocking(named).filter("blocking_count > 0")


@register("plan_dominant", f"with {NODES} select plan_id, node_id, node_type, round(actual_total_time / sum(actual_total_time) over (partition by plan_id), 6) as share from nodes qualify row_number() over (partition by plan_id order by actual_total_time desc, node_id) = 1")
def _(c):
    return structure.dominant(nodes(c), "actual_total_time")


@register("plan_row_estimates", f"with {NODES} select plan_id, {OP_CLASS} operator_class, round(arg_max(ln((actual_rows + 1) / (plan_rows + 1)), abs(ln((actual_rows + 1) / (plan_rows + 1)))), 6) worst from nodes group by 1, 2")
def _(c):
    error = F.log((F.col("actual_rows") + 1) / (F.col("plan_rows") + 1))
    return nodes(c).withColumn("operator_class", structure.operator_class(F.col("node_type"))).groupBy("plan_id", "operator_class").agg(F.round(A.largest_signed(error), 6).alias("worst"))


@register("plan_coordinator_pressure", f"with {NODES}, k as (select plan_id, parent_node_id node_id, cast(sum(cast(actual_rows as bigint)) as bigint) input_rows from nodes where parent_node_id is not null group by 1, 2) select n.plan_id, cast(sum(case when node_type = 'Foreign Scan' then cast(actual_rows as bigint) end) as bigint) fanin_rows, max(case when parent_node_id is null then actual_rows end) final_rows, cast(sum(case when node_type = 'Sort' then input_rows end) as bigint) sort_input_rows, cast(sum(case when node_type = 'Hash Join' then input_rows end) as bigint) join_input_rows from nodes n left join k using (plan_id, node_id) group by 1")
def _(c):
    n = nodes(c)
    inputs = n.filter("parent_node_id is not null").groupBy("plan_id", F.col("parent_node_id").alias("node_id")).agg(F.sum(F.col("actual_rows").cast("long")).alias("input_rows"))
    kind = lambda t, x: F.sum(F.when(F.col("node_type") == t, x))
    return n.join(inputs, ["plan_id", "node_id"], "left").groupBy("plan_id").agg(kind("Foreign Scan", F.col("actual_rows").cast("long")).alias("fanin_rows"), F.max(F.when(F.col("parent_node_id").isNull(), F.col("actual_rows"))).alias("final_rows"), kind("Sort", F.col("input_rows")).alias("sort_input_rows"), kind("Hash Join", F.col("input_rows")).alias("join_input_rows"))
