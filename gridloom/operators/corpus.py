"""The parameterised query corpus: single-region, multi-region, rollup and probe queries as rollup specs.

Every query takes its cut-off as a literal: as-of 2024-01-31, so many days back. None reads the clock.
"""

from __future__ import annotations

from gridloom.operators.rollup import Rollup

D14, D21, D30 = ("created_at >= '2024-01-17 00:00:00'", "created_at >= '2024-01-10 00:00:00'", "created_at >= '2024-01-01 00:00:00'")
LAST_DAY = "created_at >= '2024-01-30 00:00:00'"
HIGH, LOW = 120.0, 15.0
TWO, THREE = ("eu", "us"), ("eu", "us", "apac")
SUMMARY = ("events_count", "total_value", "avg_value", "min_value", "max_value")
POINT = ("events_count", "total_value", "avg_value", "last_event_at")
COUNTS = ("events_count", "tenant_count", "total_value", "avg_value")
SEGMENT, GLOBAL = ("user_segment", "user_status"), ("user_segment", "user_status", "home_region")
#: A rollup over the users of two tenants in three: modulus, user bound, and a tenant filter that is off.
PAIR = f"{D21} and (0 = 0 or tenant_id = 0) and tenant_id % 3 != 1 and user_id <= 120"
TOP = 20


def value_order(*keys: str) -> tuple[str, ...]:
    return ("-total_value", *keys)


SINGLE: dict[str, Rollup] = {
    "q01_tenant_rollup": Rollup(("tenant_id",), ("events_count", "total_value"), where=f"{D14} and value >= {LOW}", order=value_order("tenant_id")),
    "q02_global_user_topk": Rollup(("tenant_id", "user_id"), ("total_value",), where=D14, order=value_order("tenant_id", "user_id"), limit=TOP),
    "q03_event_filter_summary": Rollup(measures=SUMMARY, where=f"{D14} and value >= {LOW}"),
    "q04_tenant_point_rollup": Rollup(("tenant_id",), POINT, where=f"tenant_id = 7 and {D14}"),
    "q05_tenant_tier_daily_join": Rollup(("tenant_tier", "event_day"), COUNTS, ("tenants",), D14, order=("event_day", "-total_value", "tenant_tier")),
    "q06_user_segment_join": Rollup(SEGMENT, COUNTS, ("users",), D14, order=value_order(*SEGMENT), limit=TOP),
    "q07_global_user_segment_join": Rollup(GLOBAL, COUNTS, ("global_users",), D14, order=value_order(*GLOBAL), limit=TOP),
    "q08_multi_dimension_rollup": Rollup(("tenant_tier", "user_segment", "event_day"), ("events_count", "total_value", "avg_value"), ("tenants", "users"), D14, order=("event_day", "-total_value", "tenant_tier", "user_segment"), limit=100),
    "q09_event_full_scan_summary": Rollup(measures=("events_count", "avg_value", "min_value", "max_value")),
    "q10_top_tenants": Rollup(("tenant_id",), POINT, where=D14, order=value_order("tenant_id"), limit=10),
    "q11_colocated_user_join_pair": Rollup(SEGMENT, COUNTS, ("users",), PAIR, order=value_order(*SEGMENT), limit=TOP),
    "q12_repartition_user_join_pair": Rollup(SEGMENT, COUNTS, ("global_users",), PAIR, order=value_order(*SEGMENT), limit=TOP),
    "q14_colocated_user_value_topk_pair": Rollup(("tenant_id", "user_id", *SEGMENT), ("events_count", "total_value"), ("users",), PAIR, order=value_order("tenant_id", "user_id"), limit=TOP),
    "q15_repartition_user_value_topk_pair": Rollup(("tenant_id", "user_id", *SEGMENT), ("events_count", "total_value"), ("global_users",), PAIR, order=value_order("tenant_id", "user_id"), limit=TOP),
    "q18_colocated_join_summary_pair": Rollup(measures=("events_count", "tenant_count", "user_count", "total_value", "avg_value"), joins=("users",), where=PAIR),
    "q19_repartition_join_summary_pair": Rollup(measures=("events_count", "tenant_count", "user_count", "total_value", "avg_value"), joins=("global_users",), where=PAIR),
    "q20_colocated_user_join_pushdown_pair": Rollup(SEGMENT, COUNTS, ("users",), f"{D21} ~ user_status = 'active'", order=value_order(*SEGMENT), limit=TOP),
    "q21_repartition_user_join_pushdown_pair": Rollup(SEGMENT, COUNTS, ("global_users",), f"{D21} ~ user_status = 'active'", order=value_order(*SEGMENT), limit=TOP),
    "q22_regional_user_value_topk_pushdown": Rollup(("tenant_id", "user_id"), ("events_count", "total_value"), where=f"{D21} and tenant_id % 2 = 0", order=value_order("tenant_id", "user_id"), limit=TOP),
}

STAGE_A: dict[str, Rollup] = {
    "a1_rolling_aggregate": Rollup(("day",), ("total_value", "events_count"), where=D14, order=("day",)),
    "a2_tenant_locality_aggregate": Rollup(("tenant_id", "day"), ("total_value",), where=f"tenant_id = 7 and {D14}", order=("day",)),
    "a3_cross_tenant_global_aggregation": Rollup(("tenant_id",), ("total_value",), where=D14, order=value_order("tenant_id"), limit=10),
    "a4_user_top_k": Rollup(("tenant_id", "user_id"), ("total_value",), where=D21, order=value_order("tenant_id", "user_id"), limit=TOP),
    "a5_fact_reference_join": Rollup(("region", "tenant_tier", "tenant_status", "day"), ("max_dimension_version", "tenant_count", "events_count", "total_value"), ("tenants",), D14, order=("day", "region", "tenant_tier", "tenant_status")),
    "e2_full_scan_summary": Rollup(measures=("events_count", "avg_value", "min_value", "max_value")),
    "e4_colocated_user_segment_join": Rollup(SEGMENT, COUNTS, ("users",), D21, order=value_order(*SEGMENT)),
    "e5_reference_staleness_probe": Rollup(("region", "tenant_tier", "tenant_status"), ("max_dimension_version", "newest_tenant_updated_at", "tenant_count", "events_count", "total_value"), ("tenants",), f"{D14} ~ tenant_tier = 'standard' and tenant_status = 'active'", order=("region",)),
    "e7_non_colocated_global_user_join": Rollup(GLOBAL, COUNTS, ("global_users",), D21, order=value_order(*GLOBAL)),
    "baseline_region_event_count": Rollup(("region",), ("events_count",), ("tenants",), order=("region",)),
    "baseline_tenant_time_window": Rollup(("tenant_id",), ("events_count", "avg_value", "first_event_at", "last_event_at"), where=f"tenant_id = 7 and {D14}"),
    "baseline_top_tenants_by_events": Rollup(("tenant_id",), ("events_count",), order=("-events_count", "tenant_id"), limit=10),
}

EU = ("eu",)
FOREIGN: dict[str, Rollup] = {
    "a1_daily_kpi_30d": Rollup(("day",), ("total_value", "events_count"), where=D30, regions=TWO, raw=True, order=("day",)),
    "a2_tenant_local_pushdown": Rollup(("tenant_id",), ("total_value", "events_count"), where="tenant_id = 8", regions=TWO, raw=True),
    "a3_tenant_top_50": Rollup(("tenant_id",), ("total_value",), where=D21, regions=TWO, raw=True, order=value_order("tenant_id"), limit=50),
    "a4_user_top_100": Rollup(("tenant_id", "user_id"), ("total_value",), where=D21, regions=TWO, raw=True, order=value_order("tenant_id", "user_id"), limit=100),
    "a5_region_daily_join": Rollup(("region_name", "day"), ("total_value",), ("tenants",), D14, TWO, raw=True, order=("day",)).but(keys=("tenant_region", "day")),
    "a6_high_value_filter": Rollup(("tenant_id",), ("events_count",), where=f"value > {HIGH} and {D21}", regions=TWO, raw=True, order=("-events_count", "tenant_id")),
    "e2_full_scan_summary": Rollup(measures=("events_count", "avg_value", "min_value", "max_value"), regions=TWO, raw=True),
    "coordinator_local_user_join": Rollup(SEGMENT, ("events_count", "total_value"), ("users",), f"{D21} and tenant_id % 2 = 0", TWO, raw=True, order=value_order(*SEGMENT)),
    "coordinator_regional_user_join": Rollup(SEGMENT, ("events_count", "total_value"), ("users",), f"{D21} and tenant_id % 2 = 0", TWO, merged=("events_count", "total_value"), order=value_order(*SEGMENT)),
    "coordinator_partial_user_topk": Rollup(("source_region", "tenant_id", "user_id"), ("events_count", "total_value"), where=f"{D21} and tenant_id % 2 = 0", regions=TWO, order=value_order("source_region", "tenant_id", "user_id"), limit=TOP),
    "coordinator_raw_user_topk": Rollup(("source_region", "tenant_id", "user_id"), ("events_count", "total_value"), where=f"{D21} and tenant_id % 2 = 0", regions=TWO, raw=True, order=value_order("source_region", "tenant_id", "user_id"), limit=TOP),
    "daily_rollup": Rollup(("event_day",), ("events_count", "total_value", "avg_value"), where=f"{D14} and value >= {LOW}", regions=EU, raw=True, order=("event_day",)),
    "event_filter_summary": Rollup(measures=SUMMARY, where=f"{D14} and value >= {LOW}", regions=EU, raw=True),
    "event_full_scan_summary": Rollup(measures=("events_count", "avg_value", "min_value", "max_value"), regions=EU, raw=True),
    "global_user_join": Rollup(GLOBAL, COUNTS, ("global_users",), D14, EU, raw=True, order=value_order(*GLOBAL), limit=TOP),
    "multi_dimension_rollup": Rollup(("tenant_tier", "user_segment", "event_day"), ("events_count", "total_value", "avg_value"), ("tenants", "users"), D14, EU, raw=True, order=("event_day", "-total_value", "tenant_tier", "user_segment"), limit=100),
    "tenant_point_rollup": Rollup(("tenant_id",), POINT, where=f"tenant_id = 8 and {D14}", regions=EU, raw=True),
    "tenant_tier_join": Rollup(("tenant_tier", "event_day"), COUNTS, ("tenants",), D14, EU, raw=True, order=("event_day", "-total_value", "tenant_tier")),
    "tenant_tier_left_join": Rollup(("tenant_tier_or_unknown", "event_day"), COUNTS, ("tenants",), D14, EU, raw=True, order=("event_day", "-total_value", "tenant_tier"), limit=100, left=frozenset(("tenants",))),
    "top_tenants": Rollup(("tenant_id",), POINT, where=D14, regions=EU, raw=True, order=value_order("tenant_id"), limit=10),
    "user_segment_join": Rollup(SEGMENT, COUNTS, ("users",), D14, EU, raw=True, order=value_order(*SEGMENT), limit=TOP),
    "user_value_topk": Rollup(("tenant_id", "user_id"), POINT, where=D14, regions=EU, raw=True, order=value_order("tenant_id", "user_id"), limit=TOP),
    "multiregion_daily_kpi": Rollup(("event_day",), ("events_count", "total_value", "tenant_count", "user_count"), where=D14, regions=TWO, merged=("regions_touched", "events_count", "total_value", "tenant_count", "user_count"), order=("-event_day",)),
    "multiregion_daily_tenant_rollup": Rollup(("event_day", "tenant_id"), ("events_count", "total_value"), where=f"{D14} and value >= {LOW}", regions=TWO, merged=("regions_touched", "events_count", "total_value", "avg_value"), order=("-event_day", "-total_value", "tenant_id"), limit=100),
    "multiregion_event_count_rollup": Rollup(("source_region",), ("events_count",), where=D14, regions=TWO, raw=True, order=("source_region",)),
    "multiregion_event_filter_summary": Rollup((), ("events_count", "total_value", "first_event_at", "last_event_at"), where=f"{D14} and value >= {LOW}", regions=TWO, having="events_count > 0", merge_keys=(), merged=("regions_touched", "events_count", "total_value", "avg_value", "first_event_at", "last_event_at")),
    "multiregion_event_full_scan_summary": Rollup((), ("events_count", "total_value", "min_value", "max_value"), regions=TWO, merge_keys=(), merged=("events_count", "avg_value", "min_value", "max_value")),
    "multiregion_event_exact_raw_summary": Rollup((), ("events_count", "min_value", "max_value"), regions=TWO, raw=True),
    "multiregion_event_exact_regional_summary": Rollup((), ("events_count", "min_value", "max_value"), regions=TWO, merge_keys=(), merged=("events_count", "min_value", "max_value")),
    "multiregion_global_user_join": Rollup(GLOBAL, ("events_count", "tenant_count", "total_value"), ("global_users",), D14, TWO, merged=("regions_touched", "events_count", "tenant_count", "total_value"), order=value_order(*GLOBAL), limit=TOP),
    "multiregion_raw_region_rollup": Rollup(("source_region",), ("events_count", "total_value"), where=D14, regions=TWO, raw=True, order=("source_region",)),
    "multiregion_raw_user_value_topk": Rollup(("tenant_id", "user_id"), ("total_value",), where=D14, regions=TWO, raw=True, order=value_order("tenant_id", "user_id"), limit=TOP),
    "multiregion_region_daily_join": Rollup(("source_region", "tenant_region", "event_day"), ("events_count", "total_value"), ("tenants",), D14, TWO, order=("-event_day", "source_region", "tenant_region")),
    "multiregion_tenant_point_rollup": Rollup(("source_region", "tenant_id"), ("events_count", "total_value", "avg_value"), where=f"tenant_id in (6, 24) and {D14}", regions=TWO, order=("source_region", "tenant_id")),
    "multiregion_tenant_point_raw_finalize": Rollup(("source_region", "tenant_id"), ("events_count", "total_value", "avg_value"), where=f"tenant_id in (6, 24) and {D14}", regions=TWO, raw=True, order=("source_region", "tenant_id")),
    "multiregion_tenant_tier_join": Rollup(("tenant_tier", "event_day"), ("events_count", "tenant_count", "total_value"), ("tenants",), D14, TWO, merged=("regions_touched", "events_count", "tenant_count", "total_value"), order=("-event_day", "-total_value", "tenant_tier"), limit=100),
    "multiregion_tenant_tier_left_join": Rollup(("tenant_tier_or_unknown", "event_day"), ("events_count", "tenant_count", "total_value"), ("tenants",), D14, TWO, merged=("regions_touched", "events_count", "tenant_count", "total_value"), order=("-event_day", "-total_value", "tenant_tier"), limit=100, left=frozenset(("tenants",))),
    "multiregion_top_tenants": Rollup(("tenant_id",), ("events_count", "total_value", "last_event_at"), where=D21, regions=TWO, merged=("regions_touched", "events_count", "total_value", "last_event_at"), order=value_order("tenant_id"), limit=10),
    "multiregion_top_tenants_raw_finalize": Rollup(("tenant_id",), ("events_count", "total_value", "last_event_at"), where=D21, regions=TWO, raw=True, order=value_order("tenant_id"), limit=10),
    "multiregion_user_segment_join": Rollup(SEGMENT, ("events_count", "tenant_count", "total_value"), ("users",), PAIR, TWO, merged=("regions_touched", "events_count", "tenant_count", "total_value"), order=value_order(*SEGMENT), limit=TOP),
    "multiregion_repartition_user_join_pair": Rollup(SEGMENT, ("events_count", "tenant_count", "total_value"), ("global_users",), PAIR, TWO, merged=("regions_touched", "events_count", "tenant_count", "total_value"), order=value_order(*SEGMENT), limit=TOP),
    "multiregion_user_value_topk": Rollup(("tenant_id", "user_id"), ("events_count", "total_value"), where=D14, regions=TWO, merged=("regions_touched", "events_count", "total_value"), order=value_order("tenant_id", "user_id"), limit=TOP),
    "multiregion_amplified_user_value_topk": Rollup(("tenant_id", "user_id"), ("events_count", "total_value"), where=D21, regions=TWO, merged=("events_count", "total_value"), order=value_order("tenant_id", "user_id"), limit=TOP, amplify=4),
    "multiregion_multi_dimension_rollup": Rollup(("tenant_tier", "user_segment", "event_day"), ("events_count", "total_value"), ("tenants", "users"), D14, TWO, merged=("regions_touched", "events_count", "total_value", "avg_value"), order=("-event_day", "-total_value", "tenant_tier", "user_segment"), limit=100),
    "single_edge_regional_user_value_topk": Rollup(("tenant_id", "user_id"), ("events_count", "total_value"), where=D21, regions=EU, raw=True, order=value_order("tenant_id", "user_id"), limit=TOP),
}
#: Colocated (users) and repartition (global_users) pairs over one and three regions; results are equal by contract.
for kind, side in (("colocated", "users"), ("repartition", "global_users")):
    FOREIGN |= {
        f"single_edge_{kind}_user_join_pair": Rollup(SEGMENT, COUNTS, (side,), PAIR, EU, raw=True, order=value_order(*SEGMENT), limit=TOP),
        f"single_edge_{kind}_user_value_topk_pair": Rollup(("tenant_id", "user_id", *SEGMENT), ("events_count", "total_value"), (side,), PAIR, EU, raw=True, order=value_order("tenant_id", "user_id"), limit=TOP),
        f"single_edge_{kind}_join_summary_pair": Rollup((), ("events_count", "tenant_count", "user_count", "total_value", "avg_value"), (side,), PAIR, EU, raw=True),
        f"n3_{kind}_user_join": Rollup(SEGMENT, ("events_count", "total_value"), (side,), PAIR, THREE, merged=("events_count", "total_value"), order=value_order(*SEGMENT), limit=TOP),
        f"n3_{kind}_user_value_topk": Rollup(("tenant_id", "user_id", *SEGMENT), ("events_count", "total_value"), (side,), PAIR, THREE, merged=("events_count", "total_value"), order=value_order("tenant_id", "user_id"), limit=TOP),
        f"n3_{kind}_join_summary": Rollup((), ("events_count", "tenant_count", "user_count", "total_value"), (side,), PAIR, THREE, merge_keys=(), merged=("events_count", "tenant_count", "user_count", "total_value", "avg_value")),
    }

#: The five materialised rollups; their day is a timestamp at midnight.
ROLLUPS: dict[str, Rollup] = {
    "daily_tenant_rollup": Rollup(("tenant_id", "event_day"), ("region", "tenant_tier", "events_count", "total_value", "avg_value", "first_event_at", "last_event_at"), ("tenants",), D30, left=frozenset()),
    "daily_tenant_tier_rollup": Rollup(("tenant_tier", "event_day"), COUNTS, ("tenants",), D30),
    "user_segment_topk_rollup": Rollup(("event_day", *SEGMENT), COUNTS, ("users",), D30),
    "global_user_topk_rollup": Rollup(("event_day", *GLOBAL), COUNTS, ("global_users",), D30),
    "multi_dimension_rollup": Rollup(("event_day", "tenant_tier", "user_segment"), ("events_count", "total_value", "avg_value"), ("tenants", "users"), D30),
}
#: Queries over a rollup: table, days from, keys, merged measures, order, limit.
OVER_ROLLUPS: dict[str, tuple] = {
    "global_user_topk": ("global_user_topk_rollup", "2024-01-10", GLOBAL, ("events_count", "tenant_count", "total_value", "avg_value"), value_order(*GLOBAL), TOP),
    "local_rollup": ("daily_tenant_rollup", "2024-01-10", ("tenant_tier", "event_day"), ("events_count", "tenant_day_rows", "total_value", "mean_tenant_avg_value"), ("event_day", "-total_value", "tenant_tier"), None),
    "multi_dimension_rollup": ("multi_dimension_rollup", "2024-01-10", ("tenant_tier", "user_segment", "event_day"), ("events_count", "total_value", "avg_value"), ("event_day", "-total_value", "tenant_tier", "user_segment"), 100),
    "tenant_point_rollup": ("daily_tenant_rollup", "2024-01-10", ("tenant_id",), ("events_count", "total_value", "mean_tenant_avg_value", "last_event_at"), ("tenant_id",), 1),
    "tenant_tier_daily_rollup": ("daily_tenant_tier_rollup", "2024-01-10", ("tenant_tier", "event_day"), ("events_count", "tenant_count", "total_value", "avg_value"), ("event_day", "-total_value", "tenant_tier"), None),
    "top_tenants": ("daily_tenant_rollup", "2024-01-10", ("tenant_id",), ("events_count", "total_value", "mean_tenant_avg_value", "last_event_at"), value_order("tenant_id"), 10),
    "user_segment_topk": ("user_segment_topk_rollup", "2024-01-10", SEGMENT, ("events_count", "tenant_count", "total_value", "avg_value"), value_order(*SEGMENT), TOP),
}
