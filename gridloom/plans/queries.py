"""All registered queries of the engine and their SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.operators import corpus, topk
from gridloom.plans import toolkit, toolkit_evidence, toolkit_models  # noqa: F401  (they register their queries)
from gridloom.operators.rollup import MERGES, Rollup, order_sql, ranked
from gridloom.sources.catalog import Catalog

Query = Callable[[SparkSession, str], DataFrame]


def _rollup(spec: Rollup) -> Query:
    return lambda spark, sf_dir: spec.build(Catalog(spark, sf_dir))


def _over_rollup(table: str, since: str, keys: tuple, merged: tuple, order: tuple, limit: int | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = corpus.ROLLUPS[table].build(Catalog(spark, sf_dir)).filter(f"event_day >= '{since} 00:00:00'")
        return ranked(rows.groupBy(*keys).agg(*[MERGES[m][0]().alias(m) for m in merged]), order, limit)

    return run


def _over_rollup_sql(table: str, since: str, keys: tuple, merged: tuple, order: tuple, limit: int | None) -> str:
    made = ", ".join([*keys, *(f"{MERGES[m][1]} as {m}" for m in merged)])
    return f"select {made} from ({corpus.ROLLUPS[table].sql()}) t where event_day >= '{since} 00:00:00' group by {', '.join(keys)}" + order_sql(order, limit)


def catalogue() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries by name, and SQL for those that SQL can express."""
    found: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for prefix, specs in (("sr_", corpus.SINGLE), ("", {f"stage_{k}" if not k.startswith("baseline") else k: v for k, v in corpus.STAGE_A.items()}), ("gac_fdw_", corpus.FOREIGN), ("etl_", corpus.ROLLUPS)):
        for name, spec in specs.items():
            found[prefix + name], sql[prefix + name] = _rollup(spec), spec.sql()
    for name, args in corpus.OVER_ROLLUPS.items():
        found[f"gac_etl_{name}"], sql[f"gac_etl_{name}"] = _over_rollup(*args), _over_rollup_sql(*args)
    for i, shape in enumerate(topk.SHAPES):
        regions = ("eu", "us", "apac") if i % 3 == 2 else ("eu", "us")
        for kind, pushed in (("raw", False), ("regional", True)):
            found[f"topk_{kind}_{shape}"] = lambda spark, sf_dir, s=shape, r=regions, p=pushed: topk.topk(Catalog(spark, sf_dir), s, 25, r, p)
            sql[f"topk_{kind}_{shape}"] = topk.topk_sql(shape, 25, regions)
    return found | toolkit.QUERIES, sql | toolkit.SQL

