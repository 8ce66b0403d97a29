"""The query corpus as data: templates, parameter products, identities, execution order, and checks of manifests."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product
from string import Formatter
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def render(template: str, parameters: dict[str, Any]) -> str:
    """Fills {name} fields; a field without a parameter, or a parameter without a field, is an error."""
    wanted = {name for _, name, _, _ in Formatter().parse(template) if name}
    if missing := sorted(wanted - set(parameters)):
        raise KeyError(f"undefined: {', '.join(missing)}")
    if unused := sorted(set(parameters) - wanted):
        raise ValueError(f"not in the template: {', '.join(unused)}")
    return template.format_map(parameters)


def combinations(parameters: dict[str, Any]) -> Iterator[dict[str, Any]]:
    """Every combination of parameters whose values are lists; others are constant."""
    names = list(parameters)
    for values in product(*[v if isinstance(v, list) else [v] for v in parameters.values()]):
        yield dict(zip(names, values, strict=True))


def identity(*parts: Any, length: int = 16) -> str:
    """A stable hash of values, whatever the order of mapping keys."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:length]


def cells(spec: dict[str, Any], axes: tuple[str, ...] = ("dataset", "runtime")) -> Iterator[dict[str, Any]]:
    """A cell for each combination of its axes' values."""
    for chosen in combinations({a: spec[a] for a in axes if a in spec}):
        yield spec | chosen


@dataclass(frozen=True)
class Template:
    name: str
    text: str
    parameters: dict[str, Any] = field(default_factory=dict)

    def instances(self) -> Iterator[dict[str, Any]]:
        for chosen in combinations(self.parameters):
            sql = render(self.text, chosen)
            yield {"template_id": self.name, "instance_id": identity(self.name, chosen), "parameters": chosen, "sql": sql}


def execution_plan(instances: list[dict[str, Any]], repetitions: int, policy: str = "shuffle", seed: int = 0, explicit: list[str] | None = None) -> list[dict[str, Any]]:
    """Instances with repetitions, condition and slot ids, in order: shuffle (by hash), manifest, or an explicit order of instance ids."""
    rows = [r | {"repetition": n, "condition_id": identity(r["template_id"], r["parameters"]), "slot_id": identity(r["instance_id"], n, seed)} for r in instances for n in range(1, repetitions + 1)]
    if policy == "manifest":
        return rows
    if policy == "shuffle":
        return sorted(rows, key=lambda r: identity(seed, r["slot_id"], length=64))
    if policy == "explicit":
        place = {name: i for i, name in enumerate(explicit or [])}
        if missing := {r["instance_id"] for r in rows} - set(place):
            raise ValueError(f"no place for {sorted(missing)[0]}")
        return sorted(rows, key=lambda r: (r["repetition"], place[r["instance_id"]]))
    raise ValueError(f"no such order policy: {policy}")


def shuffled(df: DataFrame, columns: list[str], seed: int) -> DataFrame:
    """The same order for a table of any size: by hash of columns and seed."""
    key = F.sha2(F.concat_ws("::", F.lit(str(seed)), *columns), 256)
    return df.withColumn("execution_key", key).orderBy("execution_key", *columns)


def crossover(conditions: list[str], blocks: int) -> list[list[str]]:
    """A Williams design: over the blocks each condition follows each other one equally often (an odd number needs mirrored rows)."""
    n = len(conditions)
    first = [0]
    for i in range(1, n):
        first.append((i + 1) // 2 if i % 2 else n - i // 2)
    square = [[(x + r) % n for x in first] for r in range(n)]
    if n % 2:
        square += [row[::-1] for row in square]
    return [[conditions[x] for x in square[b % len(square)]] for b in range(blocks)]


PROFILE_KEYS = {"first_tenant": int, "last_tenant": int, "users": int, "events": int, "lookback_days": int, "base_time": int, "regions": dict}


def profile_faults(profile: dict[str, Any]) -> list[str]:
    """What is wrong with a data set profile: missing keys, wrong types, empty or overlapping tenant ranges of regions."""
    faults = [f"{k} is missing" if k not in profile else f"{k} isn't {t.__name__}" for k, t in PROFILE_KEYS.items() if not isinstance(profile.get(k), t)]
    if faults:
        return faults
    ranges = sorted((a, b, name) for name, (a, b) in profile["regions"].items())
    faults += [f"{name} has no tenants" for a, b, name in ranges if b < a]
    faults += [f"{x[2]} and {y[2]} overlap" for x, y in zip(ranges, ranges[1:], strict=False) if y[0] <= x[1]]
    if ranges and (ranges[0][0] < profile["first_tenant"] or max(r[1] for r in ranges) > profile["last_tenant"]):
        faults.append("regions leave the tenants")
    return faults


def manifest_faults(manifest: dict[str, Any], templates: set[str], datasets: set[str], runtimes: set[str]) -> list[str]:
    """What is wrong with a corpus manifest: unknown names, repeated cells, bad repetitions."""
    faults, seen = [], set()
    for i, cell in enumerate(manifest.get("cells", [])):
        for key, known in (("template", templates), ("dataset", datasets), ("runtime", runtimes)):
            values = cell.get(key, [])
            faults += [f"cell {i}: unknown {key} {v}" for v in (values if isinstance(values, list) else [values]) if v not in known]
        if (name := identity(cell)) in seen:
            faults.append(f"cell {i} is repeated")
        seen.add(name)
        if not isinstance(cell.get("repetitions", 1), int) or cell.get("repetitions", 1) < 1:
            faults.append(f"cell {i}: repetitions must be 1 or more")
    return faults or ([] if manifest.get("cells") else ["no cells"])


CLOCK = re.compile(r"\b(now\s*\(|current_timestamp|current_date|clock_timestamp\s*\(|statement_timestamp\s*\(|transaction_timestamp\s*\()", re.IGNORECASE)


def clock_functions(sql: str) -> list[str]:
    """Functions in a query that read the clock; measured queries must have none."""
    return sorted({m.group(1).rstrip("( ").lower() for m in CLOCK.finditer(sql)})


# --- Runtime settings and interventions ---------------------------------------------------------------------------------

#: Settings of runtime variants, by axis. Axes without a setting here, such as network delay, can't be set on this engine.
RUNTIMES: dict[str, dict[str, str]] = {
    "default": {},
    "codegen_off": {"spark.sql.codegen.wholeStage": "false"},
    "merge_join": {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.join.preferSortMergeJoin": "true"},
    "hash_join": {"spark.sql.join.preferSortMergeJoin": "false"},
    "explicit_join_order": {"spark.sql.cbo.enabled": "false", "spark.sql.cbo.joinReorder.enabled": "false"},
    "join_reorder": {"spark.sql.cbo.enabled": "true", "spark.sql.cbo.joinReorder.enabled": "true"},
    "object_hash_off": {"spark.sql.execution.useObjectHashAggregateExec": "false"},
    "adaptive_off": {"spark.sql.adaptive.enabled": "false"},
    "colocated": {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.sources.v2.bucketing.enabled": "true"},
    "more_parallel": {"spark.sql.shuffle.partitions": "64"},
}
UNSUPPORTED = ("network_delay", "network_bandwidth", "work_mem")


class Intervention:
    """Settings applied for the length of a with block, checked when applied and put back afterwards."""

    def __init__(self, spark: SparkSession, settings: dict[str, str] | str):
        if isinstance(settings, str):
            if settings in UNSUPPORTED:
                raise ValueError(f"{settings} can't be set on this engine")
            settings = RUNTIMES[settings]
        self.spark, self.settings, self.before = spark, settings, {}

    def __enter__(self) -> Intervention:
        try:
            for key, value in self.settings.items():
                self.before[key] = self.spark.conf.get(key, None)
                self.spark.conf.set(key, value)
                if self.spark.conf.get(key) != value:
                    raise RuntimeError(f"{key} wasn't applied")
        except Exception:
            self.__exit__()
            raise
        return self

    def __exit__(self, *_: object) -> None:
        for key, value in self.before.items():
            if value is None:
                self.spark.conf.unset(key)
            else:
                self.spark.conf.set(key, value)
