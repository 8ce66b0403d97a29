"""Registered queries for evidence about executions, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import evidence, models
from gridloom.plans import rewrite
from gridloom.plans.toolkit import CONDITIONS, DX, GAINS, RUNS, VECTORS, gain_rows, register, runs, vectors
from gridloom.plans.toolkit_models import CENTERS, FCM_D, W, WG, featured, start_centers
from gridloom.sources.catalog import Catalog

IDS = "struct_pack(dataset_snapshot_id := nullif(scenario_id % 5, 0), sql_normalized_hash := signature, topology_id := state, logical_question_id := nullif(scenario_id % 3, 0), pair_id := repetition, action_id := action, result_contract_id := signature)"


def identities(c: Catalog) -> DataFrame:
    """Runs of a repetition beside its baseline run, each with what identity contracts look at."""
    scenario = F.col("scenario_id")
    who = F.struct(F.nullif(scenario % 5, F.lit(0)).alias("dataset_snapshot_id"), F.col("signature").alias("sql_normalized_hash"), F.col("state").alias("topology_id"), F.nullif(scenario % 3, F.lit(0)).alias("logical_question_id"), F.col("repetition").alias("pair_id"), F.col("action").alias("action_id"), F.col("signature").alias("result_contract_id"))
    made = runs(c).select("run_id", "action", "repetition", who.alias("who"))
    before = made.filter("action = 'stressed'").select("repetition", F.col("who").alias("before"))
    return made.filter("action <> 'stressed'").withColumnRenamed("who", "after").join(before, "repetition")


def identity_sql(mode: str) -> str:
    equal, alike, present = evidence.IDENTITY[mode]
    parts = [f"coalesce(b.{c} = a.{c}, false)" for c in equal] + [f"b.{c} is not distinct from a.{c}" for c in alike] + [f"a.{c} is not null" for c in present]
    return f"({' and '.join(parts)}) as {mode}"


@register("identity_contracts", f"with {RUNS}, who as (select *, {IDS} w from runs), p as (select a.run_id, b.w b, a.w a from who a join who b on a.repetition = b.repetition and b.action = 'stressed' where a.action <> 'stressed') select run_id, " + ", ".join(map(identity_sql, evidence.IDENTITY)) + " from p")
def _(c):
    return identities(c).select("run_id", *[evidence.identity_matches(mode).alias(mode) for mode in evidence.IDENTITY])


DIRECTION = "case when gain > 0.05 then 'improved' when gain < -0.05 then 'worsened' else 'within_noise_or_unavailable' end"


@register("outcome_classes", WG + f"select scenario_id, action, case when not coalesce(result_equal, false) or {DIRECTION} = 'within_noise_or_unavailable' then 'indeterminate' when scenario_id % 11 = 0 then 'mixed' when {DIRECTION} = 'improved' then case when scenario_id % 3 = 0 then 'mixed' else 'positive' end else case when scenario_id % 2 = 0 then 'mixed' else 'negative' end end outcome from gains")
def _(c):
    s, g = F.col("scenario_id"), F.col("gain")
    direction = F.when(g > 0.05, "improved").when(g < -0.05, "worsened").otherwise("within_noise_or_unavailable")
    return gain_rows(c).select("scenario_id", "action", evidence.outcome_class(F.col("result_equal"), direction, s % 3 == 0, s % 2 == 0, s % 11 == 0).alias("outcome"))


@register("physical_transitions", WG + ", p as (select scenario_id, list(gain order by action) filter (where gain is not null) g from gains group by 1), q as (select scenario_id, coalesce(g, []) g, list_filter(coalesce(g, []), lambda x: abs(x) > 1e-9) m from p) select scenario_id, case when len(g) = 0 then 'unavailable' when len(m) <= 1 then 'sparse' when scenario_id % 13 = 0 or (list_max(m) > 0 and list_min(m) < 0) then 'mixed' when list_min(m) < 0 then 'predominantly_favorable' else 'predominantly_adverse' end as transition from q")
def _(c):
    per = gain_rows(c).groupBy("scenario_id").agg(F.collect_list("gain").alias("g"))
    return per.select("scenario_id", evidence.physical_transition(F.col("g"), F.col("scenario_id") % 13 == 0).alias("transition"))


CLUSTERS = ", k as (select scenario_id, row_number() over (order by scenario_id) - 1 place, sum(s) s, sum(n) n from (select scenario_id, cast(gain as decimal(20,6)) s, 1 n from gains where gain is not null) group by 1), d as (select s.range sample, cast(('0x' || substring(md5(s.range || ':' || i.range), 1, 12)) as bigint) % (select count(*) from k) place from range(200) s, range((select count(*) from k)) i), b as (select sample, cast(sum(s) as double) / sum(n) v from d join k using (place) group by 1) select round(quantile_cont(v, 0.025), 6) low, round(avg(v), 4) estimate, round(quantile_cont(v, 0.975), 6) high from b"


@register("bootstrap_clusters", WG + CLUSTERS)
def _(c):
    return evidence.cluster_bootstrap(gain_rows(c), "scenario_id", "gain", 200)


@register("agg_first_seen_mode", f"with {RUNS} select scenario_id, state as mode, n as times from (select scenario_id, state, count(*) n, row_number() over (partition by scenario_id order by count(*) desc, min(run_id), state) rn from runs group by 1, 2) where rn = 1")
def _(c):
    return evidence.first_seen_mode(runs(c), ["scenario_id"], "state", "run_id")


SPILLED = "case when run_id % 3 = 0 then temp_blocks end", "case when run_id % 2 = 0 then ext_sorts end", "case when run_id % 5 <> 0 then hash_batch_excess end"


@register("spill_location", W + f", x as (select run_id, {SPILLED[0]} m, {SPILLED[1]} r, {SPILLED[2]} f from topology) select run_id, case when m is null and r is null and f is null then 'not_recorded' when m > 0 and r > 0 then 'main+regional' when m > 0 then 'main' when r > 0 then 'regional' when f > 0 then 'observed_layer_unknown' else 'not_observed' end spill_layer from x")
def _(c):
    return featured(c).select("run_id", evidence.spill_location(*map(F.expr, SPILLED)).alias("spill_layer"))


@register("pushdown_components", W + ", x as (select run_id, case when run_id % 4 <> 0 then run_id % 3 end loc, cast(run_id % 2 as double) mat, run_id % 5 rem, run_id % 7 = 0 missed, regions above, case when run_id % 3 = 1 then workers end grp, merge_ratio w from topology) select run_id, case when w is null then 'not_recorded' when w > 1.05 then 'partial' else 'observed' end projection, case when loc > 0 then case when mat / loc >= 1 then 'pushed' when mat / loc > 0 then 'partial' else 'not_pushed' end when rem > 0 then 'pushed' else 'not_observed' end filters, case when missed then 'not_pushed' when above > 0 then case when grp > 0 then 'partial' else 'not_pushed' end when grp > 0 then 'pushed' else 'not_observed' end grouping_ from x")
def _(c):
    r = F.col("run_id")
    local = F.when(r % 4 != 0, r % 3)
    return featured(c).select("run_id", evidence.projection_status(F.col("merge_ratio")).alias("projection"), evidence.filter_status(local, (r % 2).cast("double"), r % 5).alias("filters"), evidence.component_status(r % 7 == 0, F.col("regions"), F.when(r % 3 == 1, F.col("workers"))).alias("grouping_"))


FAMILY = (("merge_ratio", "value", 1.0), ("task_isf", "abs", 0.8), ("temp_blocks", "binary", 0.5))


def member_sql(feature: str, mode: str, weight: float) -> str:
    if mode == "binary":
        return f"case when {feature} is not null then least(1, greatest(0, case when {feature} > 0 then 1.0 else 0.0 end * {weight})) end"
    x = f"abs({feature})" if mode == "abs" else feature
    e = f"{feature}_e"
    rule = f"case when {e}[3] <= {e}[1] then case when {x} > {e}[3] then 1.0 else 0.0 end when {x} <= {e}[1] then 0.0 when {x} <= {e}[2] then coalesce(0.5 * ({x} - {e}[1]) / nullif({e}[2] - {e}[1], 0), 0.5) when {x} <= {e}[3] then coalesce(0.5 + 0.5 * ({x} - {e}[2]) / nullif({e}[3] - {e}[2], 0), 0.5) else 1.0 end"
    return f"case when {feature} is not null then least(1, greatest(0, {rule} * {weight})) end"


@register("pressure_family", W + ", q as (select " + ", ".join(f"quantile_cont({f'abs({f})' if m == 'abs' else f}, [0.5, 0.75, 0.9]) {f}_e" for f, m, _ in FAMILY) + " from topology), s as (select run_id, " + ", ".join(f"{member_sql(*m)} s_{m[0]}" for m in FAMILY) + " from topology, q), b as (select *, greatest(" + ", ".join(f"s_{f}" for f, _, _ in FAMILY) + ") best from s) select run_id, round(best, 6) score, case when best is null then 'not_measured' when best >= 0.75 then 'confirmed' when best >= 0.40 then 'partially_confirmed' when best >= 0.15 then 'weak' else 'contradicted' end status, case " + " ".join(f"when s_{f} = best then '{f}'" for f, _, _ in FAMILY) + " end dominant from b")
def _(c):
    return evidence.pressure_family(featured(c).select("run_id", *[f for f, _, _ in FAMILY]), FAMILY).select("run_id", "score", "status", "dominant")


@register("interaction_matrix", f"with {RUNS}, {CONDITIONS}, {GAINS} select scenario_id, action, case when action = 'work_mem' then before else 0 end before__x__work_mem, case when action = 'pushdown' then before else 0 end before__x__pushdown from gains where before is not null")
def _(c):
    return evidence.interactions(gain_rows(c).filter("before is not null").select("scenario_id", "action", "before"), ["before"], "action", ["work_mem", "pushdown"]).drop("before")


@register("label_information", f"with {VECTORS}, x as (select id % 10 a, label b from vectors), n as (select count(*) t from x), c as (select a, b, count(*) n from x group by 1, 2), ra as (select a, count(*) n from x group by 1), rb as (select b, count(*) n from x group by 1), m as (select sum(c.n / t * ln(t * c.n / (ra.n * rb.n))) mi from c join ra using (a) join rb using (b), n), h as (select (select -sum(ra.n / t * ln(ra.n / t)) from ra, n) ha, (select -sum(rb.n / t * ln(rb.n / t)) from rb, n) hb) select round(mi / ((ha + hb) / 2), 6) nmi from m, h")
def _(c):
    return models.normalized_information(vectors(c).withColumn("a", F.col("id") % 10), "a", "label")


@register("baseline_percentile", f"with {VECTORS}, {CENTERS}, {FCM_D}, x as (select id, round(sqrt(min(d)), 9) nearest from fcm_d group by 1) select id, round(count(*) over (order by nearest range between unbounded preceding and current row) / count(*) over (), 6) percentile from x")
def _(c):
    near = vectors(c).select("id", F.round(F.sqrt(F.array_min(models.squared_distances("vector", start_centers(c, 4)))), 9).alias("nearest"))
    counted = rewrite.counted_up_to(near, "nearest")
    return counted.select("id", F.round(F.col("up_to") / F.col("total"), 6).alias("percentile"))


@register("pca_plane", f"with {VECTORS}, x as (select vector[1] a, vector[2] b from vectors), s as (select var_pop(a) aa, var_pop(b) bb, covar_pop(a, b) ab from x), l as (select (aa + bb) / 2 m, sqrt(power((aa - bb) / 2, 2) + ab * ab) h from s) select unnest([0, 1]) component, unnest([round(m + h, 6), round(m - h, 6)]) variance, unnest([round((m + h) / (2 * m), 5), round((m - h) / (2 * m), 5)]) as share from l")
def _(c):
    plane = vectors(c).select(F.slice("vector", 1, 2).alias("vector"))
    _, _, variance = models.principal_components(plane, 2)
    return c.spark.createDataFrame([(i, round(float(v), 6), round(float(v / variance.sum()), 5)) for i, v in enumerate(variance)], "component int, variance double, share double")


@register("feature_domain_coordinate", WG + f", d as (select scenario_id, action, round(2.0 * (after - before) / (abs(after) + abs(before) + 0.1), 6) x, scenario_id % 4 + 1 w from gains where before is not null and after is not null), r as (select *, sum(w) over (partition by scenario_id order by x range between unbounded preceding and current row) cum, sum(w) over (partition by scenario_id) total from d), m as (select scenario_id, min(x) coordinate from r where cum >= total / 2.0 group by 1), n as (select scenario_id, count(*) components, count(*) filter (where x > 0) > 0 and count(*) filter (where x < 0) > 0 conflicting from d group by 1) select scenario_id, case when components >= 2 then coordinate end coordinate, components, conflicting from m join n using (scenario_id)")
def _(c):
    from gridloom.operators import aggregates, interventions

    change = F.round(interventions.relative_change(F.col("before"), F.col("after"), 1, 0.1), 6)
    deltas = gain_rows(c).filter("before is not null and after is not null").select("scenario_id", change.alias("x"), (F.col("scenario_id") % 4 + 1).alias("w"))
    middle = aggregates.weighted_median(deltas, ["scenario_id"], "x", "w")
    counts = deltas.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("components"), ((F.count_if(F.col("x") > 0) > 0) & (F.count_if(F.col("x") < 0) > 0)).alias("conflicting"))
    return middle.join(counts, "scenario_id").select("scenario_id", F.when(F.col("components") >= 2, F.col("weighted_median")).alias("coordinate"), "components", "conflicting")


del DX
