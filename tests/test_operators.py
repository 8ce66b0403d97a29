from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import exprs as X
from gridloom.operators import aggregates as A
from gridloom.operators import features, interventions, joins, models
from gridloom.plans import control, profile, rewrite, structure
from gridloom.sources import files, generators


def one(spark, **columns):
    kinds = {k: "double" if isinstance(v, float) or v is None else "long" for k, v in columns.items()}
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {t}" for k, t in kinds.items()))


def test_zero_final_rows_keep_extreme_fanin(spark):
    row = features.spill(features.flow(one(spark, wan_rows=20e6, wan_bytes=1e9, regional_rows=20e6, regional_bytes=1e9, final_rows=0.0, fanin_rows=20e6, temp_blocks=146488.0, ext_sorts=0.0, hash_batches=None))).first()
    assert (row.merge_ratio, row.temp_per_final_row, row.drf_rows, row.hash_batch_excess) == (20e6, 146488.0, 1.0, 0.0)


@pytest.mark.parametrize(("tasks", "regions", "workers", "slots"), [(64, 2, 4, 64.0), (96, 3, 6, 96.0)])
def test_topology_falls_back_on_tasks(spark, tasks, regions, workers, slots):
    row = features.topology(one(spark, tasks=tasks, regions=regions, workers=None, shards=None)).first()
    assert (row.worker_count, row.slots, row.active_task_share) == (workers, slots, 1.0)


def test_byte_and_scan_skew(spark):
    df = spark.createDataFrame([(1, 100.0), (1, 300.0), (2, 90.0), (2, 10.0)], "g long, x double")
    rows = {r.g: r for r in df.groupBy("g").agg(*A.spread(F.col("x"), "x")).collect()}
    assert (rows[1].x_sum, rows[1].x_max_share, rows[1].x_isf) == (400.0, 0.75, 1.5)
    assert (rows[2].x_cv, rows[2].x_cv_norm, rows[2].x_isf, rows[2].x_isf_norm) == (0.8, 0.8, 1.8, 0.8)


def test_semantic_transforms(spark):
    df = one(spark, share=1.2, isf=2.0, top=0.5, n=4, none=None)
    row = df.select(X.semantic("bounded_share", F.col("share")), X.semantic("isf_excess_share", F.col("isf"), F.col("n")), X.semantic("max_share_excess", F.col("top"), F.col("n")), X.semantic("signed_atan", F.col("none"), neutral=0.5)).first()
    assert row[0] == 1.0 and math.isclose(row[1], 1 / 3) and math.isclose(row[2], 1 / 3) and row[3] == 0.5


def test_severity_bands(spark):
    df = spark.createDataFrame([(1e9, 1.0), (1.0, 1.0), (400.0, 1.0)], "merge_ratio double, task_isf double")
    assert [r.severity_band for r in features.severity(df).collect()] == ["critical", "low", "medium"]


def test_cv_of_nothing_and_zero(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, 1.0), (2, -1.0)], "g long, x double")
    assert {r.g: r.cv for r in df.groupBy("g").agg(X.population_cv(F.col("x")).alias("cv")).collect()} == {1: 0.0, 2: None}


def test_largest_signed_prefers_positive(spark):
    df = spark.createDataFrame([(-3.0,), (3.0,), (None,)], "x double")
    assert df.agg(A.largest_signed(F.col("x"))).first()[0] == 3.0


def test_nearest_rank_forms_agree(spark):
    df = spark.createDataFrame([(i % 3, float((i * 37) % 50)) for i in range(200)] + [(0, None)], "g long, x double")
    gathered = {r.g: r.v for r in df.groupBy("g").agg(A.nearest_rank(F.col("x"), 0.95).alias("v")).collect()}
    assert gathered == {r.g: r.value for r in A.nearest_rank_of(df, ["g"], "x", 0.95).collect()}


def test_fcm_memberships_sum_to_one_and_converge(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([0.1, 0.0],), ([5.0, 5.0],), ([5.1, 5.0],)], "vector array<double>")
    centers, objective, steps = models.fit_best_fcm(df, 2, [1, 2], iterations=50)
    assert steps < 50 and objective < 0.1
    assert np.allclose(sorted(centers[:, 0]), [0.05, 5.05], atol=0.05)
    assert all(math.isclose(sum(r.u), 1) for r in models.memberships(df, centers).collect())
    assert {r.s for r in models.memberships(df, centers).select(models.display_state(F.col("u")).alias("s")).collect()} == {"clear"}
    assert np.allclose(models.align(centers[::-1], centers), centers)


def test_ward_and_pairwise_ranker():
    points = np.array([[0, 0], [0, 1], [10, 10], [10, 11], [20, 0]])
    labels = models.ward(points, 3)
    assert labels[0] == labels[1] and labels[2] == labels[3] and len(set(labels)) == 3
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    weights = models.pairwise_ranker(x, (x[:, 0] - 0.5 * x[:, 1] > 0).astype(float))
    assert weights[0] > 0 > weights[1]


def test_count_join_equals_the_join(spark):
    a = spark.createDataFrame([(i % 4, i) for i in range(30)] + [(None, 1)], "k long, v long")
    b = spark.createDataFrame([(i % 5, i) for i in range(40)], "k long, w long")
    c = spark.createDataFrame([(i % 3,) for i in range(10)], "k long")
    query = joins.parse_count_query("select count(*) from a as x, b as y, c as z where x.k = y.k and y.k = z.k and x.v >= 3 and y.w <= 30::int;")
    expected = a.filter("v >= 3").join(b.filter("w <= 30"), "k").join(c, "k").count()
    assert joins.count_join(query, {"a": a, "b": b, "c": c}).first()[0] == expected
    chain = joins.parse_count_query("select count(*) from a as x, b as y, c as z where x.k = y.k and x.v = z.k")
    assert joins.count_join(chain, {"a": a, "b": b, "c": c}).first()[0] == a.join(b, "k").join(c.withColumnRenamed("k", "v"), "v").count()
    with pytest.raises(ValueError):
        joins.parse_count_query("select max(x) from a")


def test_merges_are_validated(spark):
    left, right = spark.range(3).toDF("k"), spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(ValueError):
        joins.merge_one(left, right, ["k"])
    sides = {r.k: r.side for r in joins.with_indicator(left, right.select("k").distinct().union(spark.createDataFrame([(9,)], "k long")), ["k"]).collect()}
    assert sides == {0: "left_only", 1: "both", 2: "left_only", 9: "right_only"}


def test_tolerant_match_finds_the_largest_matching(spark):
    left = spark.createDataFrame([("a", 1.0), ("a", 1.05), ("b", 2.0)], "k string, x double")
    right = spark.createDataFrame([("a", 1.04), ("a", 0.96), ("b", 3.0)], "k string, x double")
    rows = {r.k: r.matched for r in joins.tolerant_match(left, right, ["k"], ["x"], rtol=0.05).collect()}
    assert rows == {"a": 2, "b": 0}
    assert len(joins.matching([1, 2], [2, 1], lambda a, b: abs(a - b) <= 1)) == 2


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(50, 3))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id long, vector array<double>")
    got = {(r.query_id, r.rank): r.id for r in joins.nearest(df, df, 3, block=7).collect()}
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert all(got[i, r + 1] == j for i in range(50) for r, j in enumerate(np.argsort(d[i])[:3]))
    assert joins.nearest(df.limit(0), df, 3).count() == 0


PLAN = {"Plan": {"Node Type": "Limit", "Actual Rows": 5, "Plans": [{"Node Type": "Sort", "Sort Key": ["a", "b"], "Plans": [{"Node Type": "Foreign Scan", "Remote SQL": "select 1", "Actual Rows": 90}, {"Node Type": "Hash"}]}]}}


def test_plans_are_flattened_in_pre_order(spark):
    rows = structure.flatten("p", [PLAN])
    assert [(r[1], r[2], r[4], r[5], r[6]) for r in rows] == [(0, None, 0, "0", "Limit"), (1, 0, 1, "0.0", "Sort"), (2, 1, 2, "0.0.0", "Foreign Scan"), (3, 1, 2, "0.0.1", "Hash")]
    nodes = structure.plan_nodes(spark, spark.createDataFrame([("p", json.dumps([PLAN])), ("q", json.dumps(PLAN))], "plan_id string, document string"))
    assert nodes.count() == 8
    flags = structure.above_scans(nodes).first()
    assert (flags.has_sort_above, flags.has_limit_above, flags.has_aggregate_above) == (1, 1, 0)
    shape = structure.tree_shape(nodes).filter("plan_id = 'p'").first()
    assert (shape.node_count, shape.leaf_count, shape.branch_count, shape.max_depth) == (4, 2, 1, 2)
    assert {r.first_blocking for r in structure.blocking(nodes).collect()} == {"Sort"}
    other = json.loads(json.dumps(PLAN))
    other["Plan"]["Actual Rows"] = 7
    assert structure.fingerprint(PLAN) == structure.fingerprint(other)
    other["Plan"]["Node Type"] = "Sort"
    assert structure.fingerprint(PLAN) != structure.fingerprint(other)


def test_text_plans(spark):
    text = "Aggregate  (cost=1..2 rows=1 width=8) (actual time=0.1..0.2 rows=1 loops=1)\n  ->  Seq Scan on events  (cost=0..1 rows=10 width=4) (actual time=0.0..0.1 rows=10 loops=2)\n        Filter: (x > 1)"
    rows = structure.text_plan_nodes(spark.createDataFrame([("p", text)], "plan_id string, text string")).orderBy("line").collect()
    assert [(r.depth, r.node_type, r.actual_rows, r.loops) for r in rows] == [(0, "Aggregate", 1.0, 1.0), (1, "Seq Scan", 10.0, 2.0)]


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, 2.5)], "id long, name string, x double")
    files.write_csv(df, str(tmp_path / "csv"), ["name", "id", "absent"])
    assert sorted(files.read_csv(spark, str(tmp_path / "csv"), "name string, id long, absent string").select("id").collect()) == [(1,), (2,)]
    columns = files.write_snapshot(df, str(tmp_path / "snap"))
    assert sorted(files.read_snapshot(spark, str(tmp_path / "snap"), columns).collect(), key=lambda r: r.id) == df.collect()
    files.load_table(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="exists"):
        files.load_table(df, str(tmp_path / "t"))
    files.load_table(df, str(tmp_path / "t"), replace=True)
    log = tmp_path / "server.log"
    log.write_text(f"LOG: duration 5 ms plan:\n{json.dumps(PLAN, indent=1)}\nnoise {{ not json\n{json.dumps(PLAN)}")
    assert files.read_plan_logs(spark, str(log)).count() == 2
    (tmp_path / "s.jsonl").write_text('{"ts_unix": 1.5, "cpu": {"user": 3}, "qdisc": [{"dev": "eth0", "dropped": 2}]}\n')
    assert files.read_samples(spark, str(tmp_path / "s.jsonl")).first().cpu == {"user": 3.0}
    assert files.connector_options(fetch_size=10, push_filters=True) == {"fetchsize": "10", "pushDownPredicate": "true"}
    with pytest.raises(ValueError):
        files.connector_options(no_such=1)


def test_hashed_events_follow_the_mixer(spark):
    p = generators.Profile(last_tenant=3, users=5, events=4)

    def mix(z):
        mask = (1 << 64) - 1
        z = (z + generators.MIX[0]) & mask
        z = (z ^ z >> 30) * generators.MIX[1] & mask
        z = (z ^ z >> 27) * generators.MIX[2] & mask
        return z ^ z >> 31

    for r in generators.hashed_events(spark, p).collect():
        offset, mask = (r.event_id - 1) % 4 + 1, (1 << 64) - 1
        state = p.seed ^ r.tenant_id * generators.MIX[0] & mask ^ offset * generators.MIX[1] & mask
        assert r.user_id == mix(state ^ generators.MIX[2] & mask) % 5 + 1
        assert r.value == 1.0 + mix(state ^ 2 * generators.MIX[2] & mask) % 99901 / 100.0


def test_hot_tenants_hold_their_share(spark):
    p = generators.Profile(last_tenant=100, events=50, hot_tenants=1.0, hot_events=50.0)
    counts = {r.tenant_id: r["count"] for r in generators.events(spark, p).groupBy("tenant_id").count().collect()}
    assert counts[1] == 2500 and sum(counts.values()) == 5000
    with pytest.raises(ValueError):
        generators.events(spark, generators.Profile(events=2_000_000, event_ids="tenant_global"))


def test_control():
    template = control.Template("t", "select {k} from e limit {n}", {"k": ["a", "b"], "n": 5})
    rows = list(template.instances())
    assert [r["sql"] for r in rows] == ["select a from e limit 5", "select b from e limit 5"]
    with pytest.raises(KeyError):
        control.render("{x}", {})
    plan = control.execution_plan(rows, 3)
    assert plan == control.execution_plan(rows, 3) and len({r["slot_id"] for r in plan}) == 6 and len({r["condition_id"] for r in plan}) == 2
    assert [r["instance_id"] for r in control.execution_plan(rows, 1, "explicit", explicit=[rows[1]["instance_id"], rows[0]["instance_id"]])] == [rows[1]["instance_id"], rows[0]["instance_id"]]
    design = control.crossover(list("abcd"), 4)
    follows = [(x, y) for row in design for x, y in zip(row, row[1:])]
    assert len(set(follows)) == 12 == len(follows)
    assert control.clock_functions("select now(), CURRENT_TIMESTAMP") == ["current_timestamp", "now"]
    good = {"first_tenant": 1, "last_tenant": 10, "users": 1, "events": 1, "lookback_days": 1, "base_time": 1, "regions": {"eu": (1, 5), "us": (6, 10)}}
    assert control.profile_faults(good) == []
    assert control.profile_faults(good | {"regions": {"eu": (1, 6), "us": (6, 11)}}) == ["eu and us overlap", "regions leave the tenants"]
    assert control.manifest_faults({"cells": [{"template": "x", "dataset": "d", "runtime": "r"}]}, {"t"}, {"d"}, {"r"}) == ["cell 0: unknown template x"]


def test_interventions_are_put_back(spark):
    before = spark.conf.get("spark.sql.codegen.wholeStage")
    with control.Intervention(spark, "codegen_off"):
        assert spark.conf.get("spark.sql.codegen.wholeStage") == "false"
    assert spark.conf.get("spark.sql.codegen.wholeStage") == before
    with pytest.raises(ValueError):
        control.Intervention(spark, "network_delay")


def test_exact_tests():
    assert interventions.mcnemar(0, 0) == 1.0 and math.isclose(interventions.mcnemar(1, 9), 2 * 11 / 1024)
    low, high = interventions.wilson_bounds(8, 10)
    assert math.isclose(low, 0.4901624, abs_tol=1e-6) and math.isclose(high, 0.9433178, abs_tol=1e-6)


def test_memory_never_uses_later_episodes(spark):
    q = spark.createDataFrame([(2, 2, 0, 1.0)], "query_id long, query_order long, cluster int, u double")
    e = spark.createDataFrame([(1, 1, 0, 1.0, "a", 3.0), (3, 3, 0, 1.0, "a", 99.0)], "episode_id long, episode_order long, cluster int, u double, action string, gain double")
    assert [r.estimate for r in interventions.memory_estimates(q, e).collect()] == [3.0]


def test_memory_meets_every_earlier_episode_without_pairs(spark, monkeypatch):
    """Against brute force: clusters that one side lacks, repeated memberships, null gains and actions, equal orders, small blocks."""
    monkeypatch.setattr(interventions, "QUERIES_SENT", 9)
    rng = random.Random(2)
    q = [(i, i // 2, c, rng.random()) for i in range(0, 60, 3) for c in range(3)] + [(3, 1, 1, 0.25)]
    side = {i: (rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.5])) for i in range(60)}
    e = [(i, i // 2, c, rng.random(), *side[i]) for i in range(60) for c in range(1, 4)] + [(5, 2, 2, 0.5, *side[5])]
    weights: dict = {}
    for qi, qo, qc, qu in q:
        for ei, eo, ec, eu, action, _ in e:
            if qc == ec and eo < qo and ei != qi:
                key = (qi, action, ei)
                weights[key] = weights.get(key, 0.0) + min(qu, eu)
    want: dict = {}
    for (qi, action, ei), w in weights.items():
        want.setdefault((qi, action), []).append((w, side[ei][1] or 0.0))
    queries = spark.createDataFrame(q, "query_id long, query_order long, cluster int, u double")
    episodes = spark.createDataFrame(e, "episode_id long, episode_order long, cluster int, u double, action string, gain double")
    out = interventions.memory_estimates(queries, episodes, 3.0)
    got = {(r.query_id, r.action): r for r in out.collect()}
    assert set(got) == set(want)
    for key, parts in want.items():
        total = sum(w for w, _ in parts)
        mean = sum(w * g for w, g in parts) / total
        deviation = math.sqrt(max(0.0, sum(w * g * g for w, g in parts) / total - mean**2))
        support = total**2 / sum(w * w for w, _ in parts)
        assert math.isclose(got[key].estimate, mean, abs_tol=2e-6) and math.isclose(got[key].deviation, deviation, abs_tol=2e-4)
        assert math.isclose(got[key].support, support, abs_tol=2e-6) and got[key].status == ("provisional" if support < 3.0 else "available")
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_multiset_hash_ignores_order(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "x long, y string")
    assert interventions.multiset_hash(df, ["x", "y"]).first() == interventions.multiset_hash(df.orderBy(F.desc("x")), ["x", "y"]).first()
    assert interventions.multiset_hash(df, ["x", "y"]).first() != interventions.multiset_hash(df.distinct(), ["x", "y"]).first()


def test_profile_and_layout(spark, tmp_path):
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    nodes, seconds = profile.profile(df)
    assert seconds > 0 and {"node_type", "actual_rows"} <= set(nodes.columns) and nodes.filter("actual_rows = 1000").count() >= 1
    profile.write_bucketed(spark.range(100).withColumn("k", F.col("id") % 5), "bucketed_a", 4, "k")
    profile.write_bucketed(spark.range(50).withColumn("k", F.col("id") % 5), "bucketed_b", 4, "k")
    with control.Intervention(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        assert profile.exchanges(spark.table("bucketed_a").join(spark.table("bucketed_b"), "k")) == 0
    for name in ("bucketed_a", "bucketed_b"):
        spark.sql(f"drop table {name}")
    assert rewrite.fenced(spark.range(3).toDF("x"), str(tmp_path / "f")).count() == 3


def test_streaming_rollup(spark, tmp_path):
    from gridloom.streaming import rollups

    rows = generators.events(spark, generators.Profile(last_tenant=4, users=3, events=50))
    rows.withColumn("created_at", F.col("created_at").cast("timestamp")).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = rollups.window_rollup(rollups.read_events(spark, str(tmp_path / "in"), 10), "1 day", "0 days")
    rollups.write_rollup(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = spark.read.parquet(str(tmp_path / "in")).groupBy("tenant_id", F.date_trunc("day", "created_at").alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
    joined = got.join(batch, ["tenant_id", "window_start"])
    assert got.count() > 0 and joined.count() == got.count() and joined.filter("n <> events_count").count() == 0


def test_fits_use_whole_embeddings(spark, data, monkeypatch):
    from gridloom.operators import models
    from gridloom.plans.queries import catalogue

    queries, seen, kmeans = catalogue()[0], [], models.kmeans
    monkeypatch.setattr(models, "kmeans", lambda rows, k: seen.append(len(rows.first()["vector"])) or kmeans(rows, k))
    assert queries["kmeans_clusters"](spark, data).count() > 0 and seen == [64]
    assert {len(r.center) for r in queries["fcm_fit"](spark, data).collect()} == {64}


def test_fingerprints_tell_conditions_apart_but_not_literals():
    from gridloom.plans.structure import fingerprint

    plan = lambda condition: [{"Plan": {"Node Type": "Seq Scan", "Relation Name": "events", "Filter": condition, "Actual Rows": 3}}]
    assert fingerprint(plan("(a > 1)")) == fingerprint(plan("(a  >  25.5)")) != fingerprint(plan("(b < 1)"))
    assert fingerprint(plan("(a1 = 'x''y')")) == fingerprint(plan("(A1 = 'z')")) != fingerprint(plan("(a2 = 'z')"))


def test_sql_tokens_are_read_from_left_to_right(spark):
    from pyspark.sql import functions as F

    from gridloom.plans.structure import normalized_sql

    cases = {
        "SELECT  1,'it''s --no comment' -- note 7\n FROM t1 /* -- x */ WHERE a=2.50": "select ?,? from t1 where a=?",
        "select $tag$ 'a' $tag$ || $$b$$, \"Col\" from x2y": 'select ? || ?, "col" from x2y',
        "/* a ' b */ select '/* c */'": "select ?",
        "": "",
    }
    got = spark.createDataFrame([(k,) for k in cases], "sql string").select("sql", normalized_sql(F.col("sql")).alias("n")).collect()
    assert {r.sql: r.n for r in got} == cases


def test_feature_selection_by_schema():
    from gridloom.operators.evidence import select_features

    schema = [
        {"name": "a", "model_role": "input", "included_in_default_model": True},
        {"name": "b", "source_column": "raw_b", "model_role": "input", "included_in_default_model": True},
        {"pattern": "x_*", "model_role": "input", "structural_feature": True},
        {"name": "deep", "model_role": "input", "included_in_default_model": True, "requires_topology": ["sharded", "federated"]},
        {"name": "target", "model_role": "label", "included_in_default_model": True},
        {"name": "a", "source_column": "other", "model_role": "input", "included_in_default_model": True},
    ]
    columns, order = ["x_1", "a", "raw_b", "ax_2", "x_2", "deep", "other", "target"], ("single", "sharded", "federated")
    assert select_features(schema, columns, "m0", "single", order) == {"a": "a", "b": "raw_b"}
    assert select_features(schema, columns, "m1", "federated", order) == {"a": "a", "b": "raw_b", "x_1": "x_1", "x_2": "x_2", "deep": "deep"}


def test_components_equal_numpy(spark, data):
    import numpy as np

    from gridloom.operators import models
    from gridloom.plans.toolkit import vectors
    from gridloom.sources.catalog import Catalog

    rows = vectors(Catalog(spark, data))
    x = np.array([r.vector for r in rows.collect()])
    mean, components, variance = models.principal_components(rows, 5)
    values, found = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(variance, values[::-1][:5])
    assert np.allclose(np.abs((components * found.T[::-1][:5]).sum(axis=1)), 1, atol=1e-6)
