"""Registered queries for features, models and interventions, each with SQL that says the same where SQL can."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import exprs as X
from gridloom.operators import features, interventions, joins, models
from gridloom.plans import structure
from gridloom.plans.toolkit import CONDITIONS, DX, GAINS, RUNS, SCORES, TASKS, VECTORS, gain_rows, register, runs, scores, tasks, vectors
from gridloom.sources.catalog import Catalog

# --- Features -----------------------------------------------------------------------------------------------------------


def executions(c: Catalog) -> DataFrame:
    """A row a run with the inputs of all features; some are NULL."""
    t = tasks(c)
    n = F.count(F.lit(1))
    return t.groupBy("run_id").agg(
        X.exact_sum(F.col("task_rows")).alias("regional_rows"), X.exact_sum(F.col("task_bytes")).alias("regional_bytes"), F.floor(X.exact_sum(F.col("task_rows")) / 7).cast("double").alias("wan_rows"), F.floor(X.exact_sum(F.col("task_bytes")) / 9).cast("double").alias("wan_bytes"),
        (F.col("run_id") % 5).cast("double").alias("final_rows"), n.cast("double").alias("fanin_rows"), n.alias("tasks"), F.countDistinct("region_id").alias("regions"), F.when(F.col("run_id") % 3 == 0, F.countDistinct("worker")).alias("workers"),
        F.lit(None).cast("double").alias("shards"), F.when(F.col("run_id") % 4 != 1, F.sum("temp_blocks")).cast("double").alias("temp_blocks"), (F.col("run_id") % 3).cast("double").alias("ext_sorts"), F.when(F.col("run_id") % 2 == 0, F.col("run_id") % 6 + 1).cast("double").alias("hash_batches"),
        F.round(X.safe_divide(F.max("task_rows"), X.exact_sum(F.col("task_rows"))) * n, 6).alias("task_isf"),
    )


EXECUTIONS = f"""executions as (select run_id, cast(sum({DX('task_rows')}) as double) regional_rows, cast(sum({DX('task_bytes')}) as double) regional_bytes, cast(floor(cast(sum({DX('task_rows')}) as double) / 7) as double) wan_rows, cast(floor(cast(sum({DX('task_bytes')}) as double) / 9) as double) wan_bytes,
 cast(run_id % 5 as double) final_rows, cast(count(*) as double) fanin_rows, count(*) tasks, count(distinct region_id) regions, case when run_id % 3 = 0 then count(distinct worker) end workers, cast(null as double) shards, cast(case when run_id % 4 <> 1 then sum(temp_blocks) end as double) temp_blocks,
 cast(run_id % 3 as double) ext_sorts, cast(case when run_id % 2 = 0 then run_id % 6 + 1 end as double) hash_batches, round(max(task_rows) / cast(sum({DX('task_rows')}) as double) * count(*), 6) task_isf from tasks group by run_id)"""
FLOW = """flow as (select *, case when wan_rows > 0 then round(regional_rows / wan_rows, 6) end drf_rows, case when wan_bytes > 0 then round(regional_bytes / wan_bytes, 6) end drf_bytes, case when wan_rows > 0 and regional_rows > 0 then round(ln(regional_rows / wan_rows), 6) end log_drf_rows,
 case when wan_bytes > 0 and regional_bytes > 0 then round(ln(regional_bytes / wan_bytes), 6) end log_drf_bytes, round(fanin_rows / greatest(final_rows, 1), 6) fanin_ratio, round(wan_rows / greatest(final_rows, 1), 6) merge_ratio, case when wan_rows > 0 then round(final_rows / wan_rows, 6) end group_density from executions)"""
SPILL = """spill as (select *, case when wan_bytes > 0 then round(temp_blocks * 8192 / wan_bytes, 6) end spill_bytes_ratio, case when wan_rows > 0 then round(temp_blocks / wan_rows, 6) end temp_per_wan_row, round(temp_blocks / greatest(final_rows, 1), 6) temp_per_final_row, case when regional_rows > 0 then round(temp_blocks / regional_rows, 6) end temp_per_regional_row,
 case when wan_bytes > 0 then round(temp_blocks / (wan_bytes / 1048576), 6) end spill_per_wan_mb, greatest(coalesce(hash_batches, 1) - 1, 0) hash_batch_excess, round(ln(1 + temp_blocks) + ext_sorts + ln(1 + greatest(coalesce(hash_batches, 1) - 1, 0)), 6) memory_pressure, cast(coalesce(temp_blocks > 0, false) or ext_sorts > 0 or coalesce(hash_batches, 1) > 1 as int) spill_flag from flow)"""
TOPOLOGY = """topo as (select *, coalesce(workers, regions * 2) worker_count, coalesce(shards, tasks / nullif(regions, 0)) shard_count, coalesce(shards, tasks / nullif(regions, 0)) * regions slots from spill), topology as (select *, case when slots > 0 then round(tasks / slots, 6) end active_task_share,
 case when shard_count > 0 then round(tasks / shard_count, 6) end task_shard_ratio, case when worker_count > 0 then round(tasks / worker_count, 6) end tasks_per_worker from topo)"""
W = f"with {TASKS}, {EXECUTIONS}, {FLOW}, {SPILL}, {TOPOLOGY} "


def featured(c: Catalog) -> DataFrame:
    return features.topology(features.spill(features.flow(executions(c))))


@register("feature_flow", W + "select run_id, drf_rows, drf_bytes, log_drf_rows, log_drf_bytes, fanin_ratio, merge_ratio, group_density from flow")
def _(c):
    return featured(c).select("run_id", "drf_rows", "drf_bytes", "log_drf_rows", "log_drf_bytes", "fanin_ratio", "merge_ratio", "group_density")


@register("feature_spill", W + "select run_id, spill_bytes_ratio, temp_per_wan_row, temp_per_final_row, temp_per_regional_row, spill_per_wan_mb, hash_batch_excess, memory_pressure, spill_flag from (select * replace (case when temp_blocks is null and ext_sorts = 0 and coalesce(hash_batches, 1) <= 1 then null else spill_flag end as spill_flag) from spill)")
def _(c):
    return featured(c).select("run_id", "spill_bytes_ratio", "temp_per_wan_row", "temp_per_final_row", "temp_per_regional_row", "spill_per_wan_mb", "hash_batch_excess", "memory_pressure", "spill_flag")


@register("feature_topology", W + "select run_id, worker_count, shard_count, slots, active_task_share, task_shard_ratio, tasks_per_worker from topology")
def _(c):
    return featured(c).select("run_id", "worker_count", "shard_count", "slots", "active_task_share", "task_shard_ratio", "tasks_per_worker")


def log_excess(x: str, base: float, critical: float) -> str:
    return f"case when {x} is not null then least(ln(1 + greatest({x} - {base}, 0)) / ln(1 + {critical}), 1) end"


def linear_excess(x: str, base: float, critical: float) -> str:
    return f"case when {x} is not null then least(greatest({x} - {base}, 0) / {critical}, 1) end"


def severity_sql() -> str:
    have = {"drf_rows", "merge_ratio", "fanin_ratio", "spill_bytes_ratio", "temp_per_wan_row", "temp_per_regional_row", "spill_per_wan_mb", "memory_pressure", "task_isf", "active_task_share", "task_shard_ratio", "tasks_per_worker"}
    made = []
    for group, rules in features.SEVERITY.items():
        parts = [(log_excess if kind == "log" else linear_excess)(f, b, k) for f, kind, b, k in rules if f in have]
        made.append(f"round(greatest({', '.join(parts)}), 6) severity_{group}")
    total = "coalesce(greatest(severity_wan, severity_spill, severity_imbalance, severity_capacity), 0.0)"
    return W + f"select *, case when severity_total >= 0.95 then 'critical' when severity_total >= 0.8 then 'high' when severity_total >= 0.5 then 'medium' else 'low' end severity_band from (select *, {total} severity_total from (select run_id, {', '.join(made)} from topology))"


@register("feature_severity", severity_sql())
def _(c):
    return features.severity(featured(c)).select("run_id", "severity_wan", "severity_spill", "severity_imbalance", "severity_capacity", "severity_total", "severity_band")


@register("feature_merge_precedence", W + "select run_id, coalesce(hash_batches, ext_sorts, -1.0) merged, coalesce(cast(workers as double), tasks_per_worker) kept from topology")
def _(c):
    return featured(c).select("run_id", F.coalesce("hash_batches", "ext_sorts", F.lit(-1.0)).alias("merged"), F.coalesce(F.col("workers").cast("double"), "tasks_per_worker").alias("kept"))


QUALITY = ["temp_blocks", "hash_batches", "workers", "drf_rows"]


@register("feature_quality", W + " union all ".join(f"select '{q}' feature, round(count(*) filter (where {q} is null) / count(*), 6) null_share, count(*) filter (where {q} = 0) zeros, count(distinct {q}) distinct_values from topology" for q in QUALITY))
def _(c):
    return features.quality(featured(c), QUALITY)


STANDARD = ["temp_blocks", "hash_batches", "merge_ratio"]


@register("feature_standardize", W + ", m as (select " + ", ".join(f"median({q}) {q}_m" for q in STANDARD) + " from topology), f as (select run_id, " + ", ".join(f"coalesce({q}, {q}_m) {q}" for q in STANDARD) + " from topology, m), s as (select " + ", ".join(f"avg({q}) {q}_a, stddev_pop({q}) {q}_s" for q in STANDARD) + " from f) select run_id, " + ", ".join(f"round(({q} - {q}_a) / case when {q}_s < 1e-12 then 1 else {q}_s end, 6) {q}" for q in STANDARD) + " from f, s")
def _(c):
    return features.standardize(featured(c).select("run_id", *STANDARD), STANDARD)


@register("feature_frozen", W + "select run_id, round((coalesce(ln(1 + temp_blocks), 3.0) - 3.0) / 2.0, 6) temp_blocks, round((coalesce(merge_ratio, 100.0) - 100.0) / 1.0, 6) merge_ratio from topology")
def _(c):
    out = features.frozen(featured(c).select("run_id", "temp_blocks", "merge_ratio"), [("temp_blocks", "log1p", 3.0, 2.0), ("merge_ratio", "identity", 100.0, 1e-15)])
    return out.withColumns({n: F.round(n, 6) for n in ("temp_blocks", "merge_ratio")})


@register("feature_drop_reasons", W + "select run_id, concat_ws(',', case when temp_blocks is null then 'no_temp' end, case when final_rows = 0 then 'no_rows' end, case when task_isf >= 1.5 then 'skewed' end) reasons from topology")
def _(c):
    return featured(c).select("run_id", features.drop_reasons({"no_temp": F.col("temp_blocks").isNull(), "no_rows": F.col("final_rows") == 0, "skewed": F.col("task_isf") >= 1.5}).alias("reasons"))


@register("feature_tags", W + "select run_id, concat_ws(',', case when merge_ratio >= 10000 then 'remote_fanin_extreme' end, case when merge_ratio >= 100 then 'remote_fanin' end, case when temp_per_final_row >= 100 then 'spill' end, case when spill_bytes_ratio >= 1 then 'spill_bytes' end, case when task_isf >= 1.5 then 'skew' end) tags from topology")
def _(c):
    df = featured(c)
    return df.select("run_id", features.tags(df).alias("tags"))


@register("feature_pressure", W + ", q as (select quantile_cont(merge_ratio, [0.5, 0.75, 0.9]) e from topology), s as (select run_id, case when merge_ratio is null then null when e[3] <= e[1] then case when merge_ratio > e[3] then 1.0 else 0.0 end when merge_ratio <= e[1] then 0.0 when merge_ratio <= e[2] then 0.5 * (merge_ratio - e[1]) / (e[2] - e[1]) when merge_ratio <= e[3] then 0.5 + 0.5 * (merge_ratio - e[2]) / (e[3] - e[2]) else 1.0 end score from topology, q) select run_id, round(score, 6) score, case when score is null then 'unknown' when score >= 0.75 then 'strong' when score >= 0.4 then 'moderate' when score >= 0.15 then 'weak' else 'none' end status from s")
def _(c):
    df = featured(c)
    edges = df.agg(F.percentile("merge_ratio", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9))).alias("e"))
    score = features.pressure_score(F.col("merge_ratio"), F.col("e")[0], F.col("e")[1], F.col("e")[2])
    return df.join(F.broadcast(edges)).select("run_id", F.round(score, 6).alias("score"), features.pressure_status(score).alias("status"))


@register("feature_fidelity", W + """, x as (select run_id, case when run_id % 2 = 0 then merge_ratio end f, fanin_ratio a, 1.0 s, cast(null as double) l, drf_rows w from topology), y as (select run_id, [least(1, 1 / nullif(f, 0)), least(1, 1 / nullif(a, 0)), least(1, 1 / s), least(1, 1 / l), least(1, 1 / nullif(w, 0))] p from x)
select run_id, round(list_avg(list_filter(p, lambda v: v is not null)), 6) fidelity, round(1 - list_avg(list_filter(p, lambda v: v is not null)), 6) fidelity_miss, concat_ws(',', case when p[1] < 1 then 'filter' end, case when p[2] < 1 then 'aggregate' end, case when p[3] < 1 then 'sort' end, case when p[4] < 1 then 'limit' end, case when p[5] < 1 then 'width' end) missed from y""")
def _(c):
    c_ = F.col
    df = featured(c).withColumns({"filter_expansion": F.when(c_("run_id") % 2 == 0, c_("merge_ratio")), "aggregate_expansion": c_("fanin_ratio"), "sort_expansion": F.lit(1.0), "limit_expansion": F.lit(None).cast("double"), "width_expansion": c_("drf_rows")})
    return features.fidelity(df).select("run_id", "fidelity", "fidelity_miss", "missed")


SEMANTIC = {"drf_rows": "2 / pi() * atan(ln(1 + greatest({x} - 1, 0)))", "merge_ratio": "2 / pi() * atan(log2(greatest({x}, 1)))", "fanin_ratio": "2 / pi() * atan(log2(greatest({x}, 1)))", "group_density": "greatest(0, least(1, {x}))", "task_isf": "greatest(0, least(1, ({x} - 1) / nullif(tasks - 1, 0)))",
            "spill_bytes_ratio": "2 / pi() * atan(ln(1 + greatest({x}, 0)))", "temp_per_final_row": "2 / pi() * atan(ln(1 + greatest({x}, 0)))", "hash_batch_excess": "2 / pi() * atan(ln(1 + greatest({x}, 0)))", "spill_flag": "greatest(0, least(1, {x}))",
            "active_task_share": "greatest(0, least(1, {x}))", "tasks_per_worker": "2 / pi() * atan(ln(1 + greatest({x}, 0)))"}
WEIGHTS = {"flow": 4, "skew": 1, "spill": 4, "topology": 2}


@register("feature_semantic", W + "select run_id, " + ", ".join(f"round(case when {f} is null then 0 else coalesce({e.format(x='cast(' + f + ' as double)')}, 0) end / sqrt({WEIGHTS[features.SEMANTIC[f][0]]}), 6) {f}" for f, e in SEMANTIC.items()) + " from (select * replace (case when temp_blocks is null and ext_sorts = 0 and coalesce(hash_batches, 1) <= 1 then null else spill_flag end as spill_flag) from topology)")
def _(c):
    return features.semantic_space(featured(c), F.col("tasks")).select("run_id", *SEMANTIC)


# --- Plan evidence over runs --------------------------------------------------------------------------------------------


@register("evidence_locality", W + "select run_id, case when run_id % 11 = 0 then 'repartition_mapmerge' when tasks = 1 then 'router_single_task' when run_id % 4 = 0 then 'distributed_task_plan' when regions >= 2 and task_isf >= 1.5 then 'reference_join_candidate' when run_id % 3 = 0 then 'colocated' else 'distributed_join' end locality from topology")
def _(c):
    r = F.col("run_id")
    chain = F.when(r % 11 == 0, "repartition_mapmerge").when(F.col("tasks") == 1, "router_single_task").when(r % 4 == 0, "distributed_task_plan").when((F.col("regions") >= 2) & (F.col("task_isf") >= 1.5), "reference_join_candidate").when(r % 3 == 0, "colocated").otherwise("distributed_join")
    return featured(c).select("run_id", chain.alias("locality"))


@register("evidence_availability", W + "select run_id, case when run_id % 10 = 0 then 'not_applicable' when temp_blocks is not null then 'available' when run_id % 3 = 0 then 'structurally_unavailable' else 'missing_unexpected' end availability from topology")
def _(c):
    r = F.col("run_id")
    return featured(c).select("run_id", F.when(r % 10 == 0, "not_applicable").when(F.col("temp_blocks").isNotNull(), "available").when(r % 3 == 0, "structurally_unavailable").otherwise("missing_unexpected").alias("availability"))


@register("evidence_region_fragments", f"with {TASKS} select run_id, region_id, count(*) task_count, cast(sum({DX('task_rows')}) as double) rows, cast(sum({DX('task_bytes')}) as double) bytes, count(distinct worker) workers, cast(sum(temp_blocks) as bigint) temp_blocks from tasks group by 1, 2")
def _(c):
    return tasks(c).groupBy("run_id", "region_id").agg(F.count(F.lit(1)).alias("task_count"), X.exact_sum(F.col("task_rows")).alias("rows"), X.exact_sum(F.col("task_bytes")).alias("bytes"), F.countDistinct("worker").alias("workers"), F.sum("temp_blocks").alias("temp_blocks"))


@register("evidence_remote_edges", f"with {TASKS} select run_id, region_id edge_id, cast(sum(cast(task_rows as bigint)) as bigint) remote_rows, cast(sum(cast(ceil(task_rows / 100) as bigint)) as bigint) fetch_cycles, round(median(task_bytes), 6) rtt_median from tasks group by 1, 2")
def _(c):
    return tasks(c).groupBy("run_id", F.col("region_id").alias("edge_id")).agg(F.sum(F.col("task_rows").cast("long")).alias("remote_rows"), F.sum(F.ceil(F.col("task_rows") / 100)).alias("fetch_cycles"), F.round(F.median("task_bytes"), 6).alias("rtt_median"))


@register("evidence_buffer_audit", f"with {TASKS} select run_id, coalesce(max(case when task = 0 then n end), cast(sum(n) as bigint)) blocks, round(cast(sum(temp_blocks) as double) / nullif(sum(n), 0), 6) hit_ratio from tasks group by 1")
def _(c):
    return tasks(c).groupBy("run_id").agg(F.coalesce(F.max(F.when(F.col("task") == 0, F.col("n"))), F.sum("n")).alias("blocks"), F.round(F.sum("temp_blocks") / F.nullif(F.sum("n"), F.lit(0)), 6).alias("hit_ratio"))


@register("evidence_os_deltas", "with s as (select user_id node, ts, value, row_number() over (partition by user_id order by ts, event_id) rn from events), d as (select node, max(value) - min(value) delta, min(ts) first_at, max(ts) last_at, count(*) samples from s group by 1) select node, round(delta, 6) delta, samples, case when samples >= 70 then 'high' when samples >= 60 then 'medium' else 'low' end alignment from d")
def _(c):
    n = F.count(F.lit(1))
    return c.table("events").groupBy(F.col("user_id").alias("node")).agg(F.round(F.max("value") - F.min("value"), 6).alias("delta"), n.alias("samples")).withColumn("alignment", F.when(F.col("samples") >= 70, "high").when(F.col("samples") >= 60, "medium").otherwise("low"))


@register("evidence_collector_audit", f"with {RUNS} select scenario_id, count(*) logged, count(*) - count(distinct repetition % 20) duplicates, 20 - count(distinct repetition % 20) missing, count(*) filter (where signature is null) mismatches from runs where action = 'pushdown' group by 1")
def _(c):
    slots = F.countDistinct(F.col("repetition") % 20)
    return runs(c).filter("action = 'pushdown'").groupBy("scenario_id").agg(F.count(F.lit(1)).alias("logged"), (F.count(F.lit(1)) - slots).alias("duplicates"), (F.lit(20) - slots).alias("missing"), F.count_if(F.col("signature").isNull()).alias("mismatches"))


@register("evidence_attempts", f"with {RUNS} select scenario_id, action, count(*) attempts, max(case when completed then 2 else 1 end) best_rank, arg_min(run_id, case when completed then -1e12 else 0 end + run_id) resolved from runs group by 1, 2")
def _(c):
    ranked = runs(c).withColumn("status_rank", F.when(F.col("completed"), 2).otherwise(1))
    best = joins.latest(ranked, ["scenario_id", "action"], F.desc("status_rank"), F.col("run_id")).select("scenario_id", "action", F.col("run_id").alias("resolved"))
    return ranked.groupBy("scenario_id", "action").agg(F.count(F.lit(1)).alias("attempts"), F.max("status_rank").alias("best_rank")).join(best, ["scenario_id", "action"])


TEXTS = "texts as (select item_id, 'SELECT count(*) , ''' || replace(text, '''', '') || ''' FROM t -- note' || chr(10) || ' WHERE tenant_id = ' || item_id || ' /* x */ GROUP BY 1 ORDER BY 2' sql from benchmark)"


def query_texts(c: Catalog) -> DataFrame:
    text = F.concat(F.lit("SELECT count(*) , '"), F.replace(F.col("text"), F.lit("'"), F.lit("")), F.lit("' FROM t -- note\n WHERE tenant_id = "), F.col("item_id").cast("string"), F.lit(" /* x */ GROUP BY 1 ORDER BY 2"))
    return c.table("benchmark").select("item_id", text.alias("sql"))


SQL_TOKENS = r"--[^\n]*|/\*(?s:.*?)\*/|'(?:[^']|'')*'|[A-Za-z_][A-Za-z0-9_$]*|[0-9]+(?:\.[0-9]+)?|\s+|(?s:.)"
BLANKED = "case when t like '--%' or t like '/*%' then ' ' when t like '''%''' or regexp_matches(t, '^[0-9]') then '?' when trim(t, ' ' || chr(9) || chr(10) || chr(13)) = '' then ' ' else lower(t) end"


@register("evidence_sql_normalized", f"with {TEXTS}, k as (select item_id, list_transform(regexp_extract_all(sql, '{SQL_TOKENS.replace(chr(39), chr(39) * 2)}'), lambda t: {BLANKED}) t from texts) select item_id, sha256(trim(regexp_replace(array_to_string(t, ''), ' +', ' ', 'g'))) sql_hash from k")
def _(c):
    return query_texts(c).select("item_id", F.sha2(structure.normalized_sql(F.col("sql")), 256).alias("sql_hash"))


@register("evidence_sql_features", f"with {TEXTS} select item_id, len(regexp_extract_all(lower(sql), 'count\\s*\\(')) n_count, len(regexp_extract_all(lower(sql), '\\bgroup\\s+by\\b')) n_group_by, case when regexp_matches(lower(sql), 'now\\s*\\(') then 'wall_clock' else 'timeless' end temporal, contains(regexp_extract(regexp_replace(lower(sql), '\\s+', ' ', 'g'), 'where (.*?)(?: group by| order by| limit|$)', 1), 'tenant_id') in_where from texts")
def _(c):
    s = F.col("sql")
    f = structure.sql_features(s)
    return query_texts(c).select("item_id", f["n_count"].cast("long").alias("n_count"), f["n_group_by"].cast("long").alias("n_group_by"), structure.temporal_class(s).alias("temporal"), structure.key_usage(s)["in_where"].alias("in_where"))


# --- Models -------------------------------------------------------------------------------------------------------------


def start_centers(c: Catalog, k: int) -> np.ndarray:
    return np.array([r.vector for r in vectors(c).filter(F.col("id") < k).orderBy("id").collect()])


FCM_D = "fcm_d as (select v.id, v.vector, c.id c, greatest(list_sum([power(x[1] - x[2], 2) for x in list_zip(v.vector, c.vector)]), 1e-12) d from vectors v, centers c)"
FCM_U = "fcm_u as (select *, power(d, -1 / 0.7) / sum(power(d, -1 / 0.7)) over (partition by id) u from fcm_d)"
CENTERS = "centers as (select * from vectors where id < 4)"


@register("fcm_memberships", f"with {VECTORS}, {CENTERS}, {FCM_D}, {FCM_U} select id, c cluster, round(u, 6) u from fcm_u")
def _(c):
    return models.memberships(vectors(c), start_centers(c, 4)).select("id", F.posexplode("u").alias("cluster", "u")).select("id", F.col("cluster").cast("long").alias("cluster"), F.round("u", 6).alias("u"))


@register("fcm_quality", f"with {VECTORS}, {CENTERS}, {FCM_D}, {FCM_U}, q as (select id, sum(u * u) s, sum(-u * ln(u)) e from fcm_u group by 1) select round(avg(s), 6) partition_coefficient, round(1 - (4 / 3.0) * (1 - avg(s)), 6) modified_coefficient, round(avg(e), 6) partition_entropy from q")
def _(c):
    return models.fuzzy_quality(models.memberships(vectors(c), start_centers(c, 4)), 4)


@register("fcm_display_states", f"with {VECTORS}, {CENTERS}, {FCM_D}, {FCM_U}, s as (select id, list(u order by u desc) us, sum(-u * ln(u)) e from fcm_u group by 1) select case when us[1] >= 0.5 and us[1] - us[2] >= 0.15 and e < 1.05 then 'clear' when us[1] >= 0.35 then 'mixed' else 'weak' end state, count(*) n from s group by 1")
def _(c):
    return models.memberships(vectors(c), start_centers(c, 4)).groupBy(models.display_state(F.col("u")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@register("fcm_step", f"with {VECTORS}, {CENTERS}, {FCM_D}, {FCM_U}, x as (select c, u, unnest(vector) v, generate_subscripts(vector, 1) - 1 dim from fcm_u) select c cluster, dim, round(sum(power(u, 1.7) * v) / sum(power(u, 1.7)), 6) as center from x group by 1, 2")
def _(c):
    centers, _ = models.fcm_step(vectors(c), start_centers(c, 4))
    return c.spark.createDataFrame([(i, j, round(float(centers[i, j]), 6)) for i in range(4) for j in range(centers.shape[1])], "cluster long, dim long, center double")


@register("fcm_fit")
def _(c):
    centers, objective, steps = models.fit_fcm(vectors(c), start_centers(c, 3), iterations=12)
    return c.spark.createDataFrame([(i, [float(v) for v in row], float(objective), steps) for i, row in enumerate(centers)], "cluster int, center array<double>, objective double, steps int")


@register("label_agreement", f"with {VECTORS}, x as (select id % 10 a, label b from vectors), cells as (select a, b, count(*) n from x group by 1, 2), s as (select (select sum(n * (n - 1) / 2.0) from cells) both_, (select sum(n * (n - 1) / 2.0) from (select sum(n) n from cells group by a)) rows_, (select sum(n * (n - 1) / 2.0) from (select sum(n) n from cells group by b)) columns_, (select sum(n) from cells) total) select round(cast((both_ - rows_ * columns_ / (total * (total - 1) / 2.0)) / ((rows_ + columns_) / 2.0 - rows_ * columns_ / (total * (total - 1) / 2.0)) as double), 6) ari from s")
def _(c):
    return models.rand_index(vectors(c).withColumn("a", F.col("id") % 10), "a", "label")


@register("pca_variance")
def _(c):
    _, components, variance = models.principal_components(vectors(c), 6)
    return c.spark.createDataFrame([(i, round(float(v), 5), [round(float(x), 5) for x in row * np.sign(row[np.abs(row).argmax()])]) for i, (v, row) in enumerate(zip(variance, components, strict=True))], "component int, variance double, loadings array<double>")


@register("coverage_threshold", f"with {VECTORS}, q as (select v.id, min(round(sqrt(list_sum([power(x[1] - x[2], 2) for x in list_zip(v.vector, w.vector)])), 9)) d from vectors v, vectors w where v.id % 20 = 0 and v.id <> w.id group by 1) select round(quantile_cont(d, 0.95), 6) threshold from q")
def _(c):
    return models.coverage_threshold(joins.nearest(vectors(c).filter("id % 20 = 0"), vectors(c), 1), 0.95)


KNN = "knn as (select query_id, id, distance from (select q.id query_id, v.id, round(sqrt(list_sum([power(x[1] - x[2], 2) for x in list_zip(q.vector, v.vector)])), 9) distance, row_number() over (partition by q.id order by round(sqrt(list_sum([power(x[1] - x[2], 2) for x in list_zip(q.vector, v.vector)])), 9), v.id) rn from vectors q, vectors v where q.id % 20 = 0 and v.id <> q.id) where rn <= 5)"


@register("neighbour_estimate", f"with {VECTORS}, {KNN}, o as (select id, ['a', 'b'][id % 2 + 1] as action, cast(label as double) gain from vectors) select query_id, action, round(sum(gain / (distance + 1e-6)) / sum(1 / (distance + 1e-6)), 6) estimate, count(*) support, min(distance) nearest, case when min(distance) > 5 then 'outside_reference_coverage' else 'available' end status from knn join o using (id) group by 1, 2")
def _(c):
    v = vectors(c)
    outcomes = v.select("id", F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")).alias("action"), F.col("label").cast("double").alias("gain"))
    return models.neighbour_estimate(joins.nearest(v.filter("id % 20 = 0"), v, 5), outcomes, 5.0)


@register("ridge_fit", f"with {VECTORS}, x as (select vector[1] a, vector[2] b, cast(label as double) y from vectors), s as (select count(*) n, avg(a) ma, avg(b) mb, avg(y) my, sum(a * a) - count(*) * avg(a) * avg(a) + 1 aa, sum(b * b) - count(*) * avg(b) * avg(b) + 1 bb, sum(a * b) - count(*) * avg(a) * avg(b) ab, sum(a * y) - count(*) * avg(a) * avg(y) ay, sum(b * y) - count(*) * avg(b) * avg(y) byy from x) select round((ay * bb - byy * ab) / (aa * bb - ab * ab), 5) w_a, round((byy * aa - ay * ab) / (aa * bb - ab * ab), 5) w_b from s")
def _(c):
    rows = vectors(c).select(F.col("vector")[0].alias("a"), F.col("vector")[1].alias("b"), F.col("label").cast("double").alias("y"))
    w, _ = models.ridge(rows, ["a", "b"], "y", 1.0)
    return c.spark.createDataFrame([(round(float(w[0]), 5), round(float(w[1]), 5))], "w_a double, w_b double")


@register("leave_group_out_median", f"with {RUNS}, {CONDITIONS}, {GAINS}, o as (select a.scenario_id % 5 held, median(b.gain) m from (select distinct scenario_id from gains) a join gains b on b.scenario_id % 5 <> a.scenario_id % 5 where b.gain is not null group by 1) select g.scenario_id % 5 as held, round(avg(cast(abs(gain - m) as decimal(20,9))), 5) mae from gains g join o on o.held = g.scenario_id % 5 where gain is not null group by 1")
def _(c):
    g = gain_rows(c).filter("gain is not null").withColumn("held", F.col("scenario_id") % 5)
    folds = c.spark.range(5).withColumnRenamed("id", "fold")
    others = g.join(F.broadcast(folds), F.col("held") != F.col("fold")).groupBy("fold").agg(F.median("gain").alias("m"))
    return g.join(others, F.col("held") == F.col("fold")).groupBy("held").agg(F.round(F.avg(F.abs(F.col("gain") - F.col("m")).cast("decimal(20,9)")).cast("double"), 5).alias("mae"))


@register("robust_scale", f"with {VECTORS}, x as (select id, vector[1] a from vectors), q as (select quantile_cont(a, [0.25, 0.5, 0.75]) e from x) select id, round((a - e[2]) / case when e[3] = e[1] then 1 else e[3] - e[1] end, 6) a from x, q")
def _(c):
    return models.robust_scale(vectors(c).select("id", F.col("vector")[0].alias("a")), ["a"])


# --- Interventions ------------------------------------------------------------------------------------------------------

WG = f"with {RUNS}, {CONDITIONS}, {GAINS} "
WS = f"with {RUNS}, {CONDITIONS}, {GAINS}, {SCORES} "


@register("condition_summary", WG + "select * from conditions")
def _(c):
    return interventions.condition_summary(runs(c))


@register("gain_rows", WG + "select * from gains")
def _(c):
    return gain_rows(c)


@register("gain_summary", WG + "select action, count(gain) pairs, round(median(gain), 6) median_gain, round(quantile_cont(gain, 0.1), 6) q10, round(quantile_cont(gain, 0.9), 6) q90, round(count(*) filter (where gain > 0) / nullif(count(gain), 0), 6) positive_share, count(*) filter (where gain > 0) in (0, count(gain)) consistent_direction from gains group by 1")
def _(c):
    return interventions.gain_summary(gain_rows(c))


@register("result_equivalence", WG + ", p as (select a.scenario_id, a.action, b.signature before_signature, a.signature after_signature from conditions a join conditions b on a.scenario_id = b.scenario_id and b.action = 'stressed' where a.action <> 'stressed') select scenario_id, action, case when before_signature is null and after_signature is null then 'both_missing' when before_signature is null or after_signature is null then 'one_missing' when before_signature = after_signature then 'equal' else 'different' end equivalence from p")
def _(c):
    s = interventions.condition_summary(runs(c))
    before = s.filter("action = 'stressed'").select("scenario_id", F.col("signature").alias("before_signature"))
    pairs = s.filter("action <> 'stressed'").withColumnRenamed("signature", "after_signature").join(before, "scenario_id")
    return interventions.equivalence(pairs).select("scenario_id", "action", "equivalence")


SLICE = "cast(('0x' || substring(h, {}, 15)) as bigint)"


@register("result_multiset_hash", f"with {RUNS}, r as (select sha256(scenario_id || '|' || action || '|' || state) h from runs) select count(*) row_count, " + ", ".join(f"bit_xor({SLICE.format(1 + 15 * i)}) xor_s{i}, cast(sum(cast({SLICE.format(1 + 15 * i)} as hugeint)) as varchar) sum_s{i}" for i in range(4)) + " from r")
def _(c):
    return interventions.multiset_hash(runs(c), ["scenario_id", "action", "state"])


@register("result_sequence_hash", f"with {RUNS}, b as (select run_id // 1024 b, sha256(string_agg(scenario_id || '|' || state, chr(10) order by run_id)) h, count(*) n from runs group by 1), s as (select b // 1024 s, sha256(string_agg(h, chr(10) order by b)) h, sum(n) n from b group by 1) select sha256(string_agg(h, chr(10) order by s)) sequence_sha256, cast(sum(n) as bigint) row_count from s")
def _(c):
    return interventions.sequence_hash(runs(c), ["scenario_id", "state"], "run_id")


@register("relative_change", WG + "select scenario_id, action, round(2.0 * (after - before) / (abs(after) + abs(before) + 0.1), 6) change from gains")
def _(c):
    return gain_rows(c).select("scenario_id", "action", F.round(interventions.relative_change(F.col("before"), F.col("after"), 1, 0.1), 6).alias("change"))


@register("transition_classes", WG + "select scenario_id, action, case when before is null or after is null then 'unknown' when floor(before / 50) <> floor(after / 50) then 'state_changed' when abs(2.0 * (after - before) / (abs(after) + abs(before) + 0.1)) >= 0.1 then 'moved_within_state' else 'unchanged' end transition from gains")
def _(c):
    change = interventions.relative_change(F.col("before"), F.col("after"), 1, 0.1)
    return gain_rows(c).select("scenario_id", "action", interventions.transition_class(F.floor(F.col("before") / 50), F.floor(F.col("after") / 50), change).alias("transition"))


@register("action_readiness", WG + ", x as (select action, count(gain) pairs, count(distinct scenario_id % 7) templates, round(count(*) filter (where gain > 0) / nullif(count(gain), 0), 6) positive_share, round(median(gain), 6) median_gain from gains group by 1) select *, case when abs(median_gain) < 0.05 then 'none' when positive_share >= 0.8 or positive_share <= 0.2 then 'consistent' else 'mixed' end as signal, case when pairs >= 5 and templates >= 3 then 'holdout_feasible' when pairs >= 5 then 'too_few_templates' else 'too_few_pairs' end readiness from x")
def _(c):
    return interventions.readiness(gain_rows(c).withColumn("template_id", F.col("scenario_id") % 7))


RANKED = ", p as (select *, row_number() over (partition by scenario_id order by predicted desc, action) pr, row_number() over (partition by scenario_id order by actual desc, action) ar, actual - least(0, min(actual) over (partition by scenario_id)) rel from scores)"


@register("ranking_metrics", WS + RANKED + ", m as (select scenario_id, round(avg(abs(actual - predicted)), 6) mae, cast(min(case when pr = 1 then action end) = min(case when ar = 1 then action end) as int) top1, round(max(actual) - max(case when pr = 1 then actual end), 6) regret, round(sum(rel / log2(pr + 1.0)) / nullif(sum(rel / log2(ar + 1.0)), 0), 6) ndcg from p group by 1), w as (select l.scenario_id, round(avg(cast(sign(l.actual - r.actual) = sign(l.predicted - r.predicted) as double)), 6) pairwise from scores l join scores r using (scenario_id) where l.action < r.action and l.actual <> r.actual group by 1) select m.*, w.pairwise from m left join w using (scenario_id)")
def _(c):
    return interventions.ranking_metrics(scores(c))


@register("ranking_spearman", WS + ", r as (select scenario_id, rank() over (partition by scenario_id order by actual) + (count(*) over (partition by scenario_id, actual) - 1) / 2.0 ra, rank() over (partition by scenario_id order by predicted) + (count(*) over (partition by scenario_id, predicted) - 1) / 2.0 rb from scores) select scenario_id, round(corr(ra, rb), 6) spearman from r group by 1")
def _(c):
    return interventions.spearman(scores(c), ["scenario_id"])


@register("ranking_topk_recall", WS + RANKED + " select scenario_id, round(count(*) filter (where pr <= 2 and ar <= 2) / nullif(count(*) filter (where ar <= 2), 0), 6) recall from p group by 1")
def _(c):
    return interventions.topk_recall(scores(c), 2)


@register("ranking_strings", WS + "select scenario_id, string_agg(action, '>' order by actual desc, action) ranking from scores group by 1")
def _(c):
    return interventions.ranking_strings(scores(c))


@register("ranking_reversals", WS + "select l.action action_a, r.action action_b, count(*) filter (where l.actual > r.actual) a_wins, count(*) filter (where l.actual < r.actual) b_wins, count(*) filter (where l.actual > r.actual) > 0 and count(*) filter (where l.actual < r.actual) > 0 reversed from scores l join scores r using (scenario_id) where l.action < r.action group by 1, 2")
def _(c):
    return interventions.reversals(scores(c))


PLACED = ", placed as (select row_number() over (order by scenario_id, action) - 1 place, gain from gains where gain is not null)"
DRAWN = ", d as (select s.range sample, cast(('0x' || substring(md5(s.range || ':' || i.range), 1, 12)) as bigint) % (select count(*) from placed) place from range(200) s, range((select count(*) from placed)) i), b as (select sample, {} v from d join placed using (place) group by 1) select round(quantile_cont(v, 0.025), 6) low, round(avg(v), 4) estimate, round(quantile_cont(v, 0.975), 6) high from b"


def placed(c: Catalog) -> DataFrame:
    return gain_rows(c).filter("gain is not null").select((F.row_number().over(Window.orderBy("scenario_id", "action")) - 1).cast("long").alias("place"), "gain")


@register("bootstrap_mean", WG + PLACED + DRAWN.format(f"cast(sum({DX('gain')}) as double) / count(gain)"))
def _(c):
    return interventions.bootstrap(placed(c), "gain", 200)


@register("bootstrap_median", WG + PLACED + DRAWN.format("median(gain)"))
def _(c):
    return interventions.bootstrap(placed(c), "gain", 200, "median")


@register("permutation_test")
def _(c):
    return interventions.permutation_test(scores(c).select(F.col("actual").alias("x"), F.col("predicted").alias("y")), 99)


@register("wilson_interval", WG + ", x as (select action, cast(count(*) filter (where gain > 0) as double) s, cast(count(gain) as double) n from gains group by 1), z as (select *, s / n p, 1.959963984540054 z from x) select action, round(greatest((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 0), 6) low, round(least((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 1), 6) high from z")
def _(c):
    x = gain_rows(c).groupBy("action").agg(F.count_if(F.col("gain") > 0).cast("double").alias("s"), F.count("gain").cast("double").alias("n"))
    low, high = interventions.wilson(F.col("s"), F.col("n"))
    return x.select("action", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@register("identity_memory", WG + ", e as (select *, scenario_id as episode_order, scenario_id % 6 as identity from gains) select scenario_id, action, count(gain) over w support, round(cast(sum(cast(gain as decimal(20,6))) over w as double) / count(gain) over w, 6) memory_gain from e window w as (partition by identity, action order by episode_order rows between unbounded preceding and 1 preceding)")
def _(c):
    episodes = gain_rows(c).withColumns({"episode_order": F.col("scenario_id"), "identity": F.col("scenario_id") % 6})
    out = interventions.identity_memory(episodes, ["identity"])
    return out.select("scenario_id", "action", "support", F.when(F.col("support") > 0, F.col("memory_gain")).alias("memory_gain"))


@register("prequential_status", WG + ", e as (select scenario_id, count(*) over (order by scenario_id rows between unbounded preceding and 1 preceding) memory from (select distinct scenario_id from gains)) select scenario_id, case when memory = 0 then 'cold_start_abstention' when scenario_id % 10 / 10.0 > 0.75 then 'outside_reference_coverage' when memory < 3 then 'provisional' else 'available' end status from e")
def _(c):
    earlier = F.count(F.lit(1)).over(Window.orderBy("scenario_id").rowsBetween(Window.unboundedPreceding, -1))
    e = gain_rows(c).select("scenario_id").distinct().withColumn("memory", earlier)
    return e.select("scenario_id", interventions.decision_status(F.col("scenario_id") % 10 / 10.0, F.col("memory"), 0.75).alias("status"))


MEMBER = f"{VECTORS}, {CENTERS}, {FCM_D}, {FCM_U}"


def member_rows(c: Catalog) -> DataFrame:
    return models.memberships(vectors(c), start_centers(c, 4)).select("id", "label", F.posexplode("u").alias("cluster", "u"))


@register("memory_estimates", f"with {MEMBER}, j as (select q.id query_id, ['a','b'][e.id % 2 + 1] as action, e.id episode_id, sum(least(q.u, e.u)) w, max(x.label) gain from fcm_u q join fcm_u e on e.c = q.c join vectors x on x.id = e.id where q.id % 20 = 0 and e.id < q.id group by 1, 2, 3) select query_id, action, round(sum(w * gain) / sum(w), 6) estimate, round(sqrt(greatest(sum(w * gain * gain) / sum(w) - power(sum(w * gain) / sum(w), 2), 0)), 4) deviation, round(power(sum(w), 2) / sum(w * w), 6) support, case when round(power(sum(w), 2) / sum(w * w), 6) < 10 then 'provisional' else 'available' end status from j group by 1, 2")
def _(c):
    m = member_rows(c)
    queries = m.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("id").alias("query_order"), "cluster", "u")
    episodes = m.select(F.col("id").alias("episode_id"), F.col("id").alias("episode_order"), "cluster", "u", F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")).alias("action"), F.col("label").cast("double").alias("gain"))
    return interventions.memory_estimates(queries, episodes, 10.0)


@register("fuzzy_transitions", f"with {MEMBER}, p as (select ['a','b'][f.id % 2 + 1] as action, f.c from_cluster, t.c to_cluster, sum(cast(f.u * t.u as decimal(20,9))) w from fcm_u f join fcm_u t on t.id = f.id + 1 group by 1, 2, 3) select action, from_cluster, to_cluster, round(cast(w as double), 5) weight, round(cast(w as double) / sum(cast(w as double)) over (partition by action, from_cluster), 5) as share from p")
def _(c):
    m = member_rows(c)
    before = m.select("id", F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")).alias("action"), F.col("cluster").cast("long").alias("cluster"), "u")
    after = m.select((F.col("id") - 1).alias("id"), F.col("cluster").cast("long").alias("cluster"), "u")
    return interventions.fuzzy_transitions(before, after)


@register("coverage_regret_curve", WS + RANKED + ", r as (select scenario_id query_id, round(max(actual) - max(case when pr = 1 then actual end), 6) regret from p group by 1) select query_id, round(count(*) over w / count(*) over (), 6) coverage, round(cast(sum(cast(regret as decimal(20,6))) over w as double) / count(*) over w, 6) mean_regret from r window w as (order by query_id % 9, query_id rows between unbounded preceding and current row)")
def _(c):
    m = interventions.ranking_metrics(scores(c)).select(F.col("scenario_id").alias("query_id"), "regret").withColumn("distance", F.col("query_id") % 9)
    return interventions.coverage_curve(m)


@register("leakage_audit", WG + "select scenario_id decision_id, scenario_id * 7 % 50 episode_id from gains where scenario_id * 7 % 50 >= scenario_id and scenario_id * 7 % 50 in (select scenario_id from gains)")
def _(c):
    decisions = gain_rows(c).select(F.col("scenario_id").alias("decision_id"), F.col("scenario_id").alias("decision_order"), (F.col("scenario_id") * 7 % 50).alias("episode_id"))
    evidence = decisions.select(F.col("decision_id").alias("episode_id"), F.col("decision_order").alias("evidence_order")).distinct()
    return interventions.future_rows(decisions, evidence)


@register("repeatability", WG + ", d as (select *, lag(signature) over (partition by scenario_id, action order by repetition) b from runs where completed), m as (select scenario_id, action, median(elapsed_seconds) md from d group by 1, 2) select d.scenario_id, d.action, count(*) runs, round(md, 6) as median, round(1.4826 * median(abs(elapsed_seconds - md)) / nullif(abs(md), 0), 6) dispersion, round(case when count(*) = 1 then 0 else stddev_samp(elapsed_seconds) end, 4) deviation, count(*) filter (where b is not null and b <> signature) changes from d join m using (scenario_id, action) group by 1, 2, md")
def _(c):
    return interventions.repeatability(runs(c))


@register("distance_geometry", f"with {VECTORS}, p as (select sqrt(list_sum([power(x[1] - x[2], 2) for x in list_zip(a.vector, b.vector)])) d, abs(a.label - b.label) r from vectors a join vectors b on a.id <> b.id where a.id % 20 = 0) select count(*) pairs, round(corr(d, r), 5) correlation, round(avg(d) filter (where r = 0), 5) same_label_distance from p")
def _(c):
    return models.distance_geometry(vectors(c).filter("id % 20 = 0"), vectors(c))


def fuzzifier_sql(m: float) -> str:
    power = -1 / (m - 1)
    return f"select cast({m} as double) fuzzifier, round(avg(s), 6) partition_coefficient, round(1 - (4 / 3.0) * (1 - avg(s)), 6) modified_coefficient, round(avg(e), 6) partition_entropy from (select id, sum(u * u) s, sum(-u * ln(u)) e from (select id, power(d, {power}) / sum(power(d, {power})) over (partition by id) u from fcm_d) group by 1)"


@register("fcm_fuzzifier_sensitivity", f"with {VECTORS}, {CENTERS}, {FCM_D} " + " union all ".join(map(fuzzifier_sql, (1.5, 1.7, 2.0))))
def _(c):
    return models.fuzzifier_sensitivity(vectors(c), start_centers(c, 4), [1.5, 1.7, 2.0])


@register("kmeans_clusters")
def _(c):
    return models.kmeans(vectors(c), 4).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@register("regression_elastic_net")
def _(c):
    rows = vectors(c).select(F.col("vector")[0].alias("a"), F.col("vector")[1].alias("b"), F.col("label").cast("double").alias("y"))
    return models.regress(rows, ["a", "b"], "y", "elastic_net", regParam=0.1, elasticNetParam=0.5)


@register("regression_boosted_trees")
def _(c):
    rows = vectors(c).select(F.col("vector")[0].alias("a"), F.col("vector")[1].alias("b"), F.col("label").cast("double").alias("y"))
    return models.regress(rows, ["a", "b"], "y", "boosted_trees", maxIter=5, maxDepth=3, seed=1)


@register("plan_text_nodes")
def _(c):
    text = F.concat(F.lit("Aggregate  (cost=1..2 rows=1 width=8) (actual time=0.1..0.2 rows="), F.col("n_nationkey").cast("string"), F.lit(" loops=1)\n  ->  Seq Scan on events  (cost=0..1 rows=10 width=4) (actual time=0.0..0.1 rows=10 loops=2)"))
    return structure.text_plan_nodes(c.table("nation").select(F.col("n_nationkey").cast("string").alias("plan_id"), text.alias("text")))
