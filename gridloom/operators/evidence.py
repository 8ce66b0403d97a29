"""Evidence about executions: identity contracts, outcome classes, where spill lies, pushdown components, pressure families, selections."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import exprs as X
from gridloom.operators import features
from gridloom.operators.joins import latest

# --- Identity and outcomes ----------------------------------------------------------------------------------------------

#: Of each identity mode the columns that both sides have and that are equal, those that are equal or both NULL, and those that the later side has.
IDENTITY: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "same_normalized_sql": (("dataset_snapshot_id", "sql_normalized_hash"), ("topology_id",), ()),
    "same_sql_declared_intervention": (("dataset_snapshot_id", "sql_normalized_hash", "logical_question_id", "pair_id"), (), ("action_id",)),
    "same_question_result_contract": (("dataset_snapshot_id", "logical_question_id", "pair_id", "result_contract_id"), (), ()),
}


def identity_matches(mode: str, before: str = "before", after: str = "after") -> Column:
    """Whether two executions (structs) are the same question under a contract; never NULL."""
    if mode not in IDENTITY:
        raise ValueError(f"no such identity mode: {mode}")
    equal, alike, present = IDENTITY[mode]
    found = F.lit(True)
    for c in equal:
        found = found & F.coalesce(F.col(f"{before}.{c}") == F.col(f"{after}.{c}"), F.lit(False))
    for c in alike:
        found = found & F.col(f"{before}.{c}").eqNullSafe(F.col(f"{after}.{c}"))
    for c in present:
        found = found & F.col(f"{after}.{c}").isNotNull()
    return found


def outcome_class(valid: Column, direction: Column, adverse: Column, beneficial: Column, conflicting: Column) -> Column:
    """positive, negative, mixed or indeterminate, from a direction (improved, worsened, within_noise_or_unavailable) and what domains moved."""
    return (
        F.when(~F.coalesce(valid, F.lit(False)) | (direction == "within_noise_or_unavailable"), "indeterminate")
        .when(conflicting, "mixed")
        .when(direction == "improved", F.when(adverse, "mixed").otherwise("positive"))
        .when(direction == "worsened", F.when(beneficial, "mixed").otherwise("negative"))
    )


def physical_transition(coordinates: Column, conflicting: Column) -> Column:
    """What domain coordinates (array, NULL: unavailable) say together; changes up to 1e-9 are none."""
    known = F.filter(coordinates, lambda x: x.isNotNull())
    changed = F.filter(known, lambda x: F.abs(x) > 1e-9)
    worse, better = F.exists(changed, lambda x: x > 0), F.exists(changed, lambda x: x < 0)
    return F.when(F.size(known) == 0, "unavailable").when(F.size(changed) <= 1, "sparse").when(conflicting | (worse & better), "mixed").when(better, "predominantly_favorable").otherwise("predominantly_adverse")


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, samples: int, level: float = 0.95) -> DataFrame:
    """low, estimate, high of a mean, whole clusters being drawn: a sample is a sum over drawn clusters' sums and counts.

    Draws are hashes of sample and place, so that reruns agree; clusters are placed by value, one row each.
    """
    sums = rows.filter(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(X.exact(F.col(value))).alias("s"), F.count(F.lit(1)).alias("n"))
    placed = sums.withColumn("place", (F.row_number().over(Window.orderBy(cluster)) - 1).cast("long"))
    sized = sums.agg(F.count(F.lit(1)).alias("clusters"))
    draws = rows.sparkSession.range(samples).withColumnRenamed("id", "sample").join(F.broadcast(sized)).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("clusters") - 1)))
    place = F.conv(F.substring(F.md5(F.concat_ws(":", "sample", "draw")), 1, 12), 16, 10).cast("long") % F.col("clusters")
    made = draws.select("sample", place.alias("place")).join(placed, "place").groupBy("sample").agg((F.sum("s").cast("double") / F.sum("n")).alias("v"))
    low = (1 - level) / 2
    return made.agg(F.round(F.percentile("v", F.lit(low)), 6).alias("low"), F.round(F.avg("v"), 4).alias("estimate"), F.round(F.percentile("v", F.lit(1 - low)), 6).alias("high"))


def first_seen_mode(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys, mode, times: the most frequent value; of several the one that came first by `order`."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("times"), F.min(order).alias("first_"))
    return latest(counted, keys, F.desc("times"), F.col("first_"), F.col(value)).select(*keys, F.col(value).alias("mode"), "times")


# --- Layers and components ----------------------------------------------------------------------------------------------


def spill_location(main: Column, regional: Column, flag: Column) -> Column:
    """Where temporary blocks were seen: a layer, both, somewhere, nowhere, or nothing recorded."""
    in_main, in_regions = F.coalesce(main > 0, F.lit(False)), F.coalesce(regional > 0, F.lit(False))
    return (
        F.when(main.isNull() & regional.isNull() & flag.isNull(), "not_recorded")
        .when(in_main & in_regions, "main+regional")
        .when(in_main, "main")
        .when(in_regions, "regional")
        .when(F.coalesce(flag > 0, F.lit(False)), "observed_layer_unknown")
        .otherwise("not_observed")
    )


def component_status(missed: Column, above: Column, remote: Column) -> Column:
    """Whether grouping or ordering ran remotely: not_pushed if it was missed, partial if it also ran above the scan."""
    has_remote = F.coalesce(remote > 0, F.lit(False))
    return F.when(F.coalesce(missed, F.lit(False)), "not_pushed").when(F.coalesce(above > 0, F.lit(False)), F.when(has_remote, "partial").otherwise("not_pushed")).when(has_remote, "pushed").otherwise("not_observed")


def filter_status(local: Column, matched: Column, remote: Column) -> Column:
    share = F.coalesce(matched, F.lit(0.0)) / F.nullif(local, F.lit(0))
    return F.when(local > 0, F.when(share >= 1, "pushed").when(share > 0, "partial").otherwise("not_pushed")).when(F.coalesce(remote > 0, F.lit(False)), "pushed").otherwise("not_observed")


def projection_status(expansion: Column) -> Column:
    return F.when(expansion.isNull(), "not_recorded").when(expansion > 1.05, "partial").otherwise("observed")


def pressure_family(df: DataFrame, members: Sequence[tuple[str, str, float]]) -> DataFrame:
    """df with score, status and dominant of a family: members are (feature, mode, weight), modes value, abs and binary.

    A member's score is by the quartile rule on all rows (binary: whether it is above 0), times its weight, within 0..1; the family's is
    the largest. Ties go to the first member. Rows that measure no member have no score.
    """
    shaped = {"value": lambda x: x, "abs": F.abs, "binary": lambda x: (x > 0).cast("double")}
    edges = df.agg(*[F.percentile(shaped[mode](F.col(f).cast("double")), F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9))).alias(f"{f}__edges") for f, mode, _ in members])
    scores = []
    for f, mode, weight in members:
        x, e = shaped[mode](F.col(f).cast("double")), F.col(f"{f}__edges")
        score = x if mode == "binary" else features.pressure_score(x, e[0], e[1], e[2])
        scores.append(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(score.isNotNull(), score * weight))))
    scores = [F.when(F.col(f).isNotNull(), s) for s, (f, _, _) in zip(scores, members, strict=True)]
    best = F.greatest(*scores)
    dominant = F.coalesce(*[F.when(s == best, F.lit(f)) for s, (f, _, _) in zip(scores, members, strict=True)])
    status = F.when(best.isNull(), "not_measured").when(best >= 0.75, "confirmed").when(best >= 0.40, "partially_confirmed").when(best >= 0.15, "weak").otherwise("contradicted")
    return df.join(F.broadcast(edges)).withColumns({"score": F.round(best, 6), "status": status, "dominant": dominant}).select(*df.columns, "score", "status", "dominant")


def interactions(df: DataFrame, names: Sequence[str], action: str, actions: Sequence[str]) -> DataFrame:
    """df with <feature>__x__<action>: the feature where the action was taken, else 0."""
    return df.withColumns({f"{n}__x__{a}": F.when(F.col(action) == a, F.col(n)).otherwise(F.lit(0.0)) for n in names for a in actions})


# --- Selections ---------------------------------------------------------------------------------------------------------


def select_features(schema: Sequence[dict], columns: Sequence[str], matrix: str, topology: str, order: Sequence[str]) -> dict[str, str]:
    """Feature names and their source columns that a schema takes of the columns that are there, each once, in the schema's order.

    Entries have a name (and source_column) or a pattern with '*', model_role, included_in_default_model, structural_feature (taken by
    matrix m1 too) and requires_topology: a topology, or several of which one is enough; `order` ranks topologies from least to most.
    """

    def reached(required) -> bool:
        if required in ("", None):
            return True
        if isinstance(required, list | tuple):
            return any(map(reached, required))
        return order.index(topology) >= order.index(required) if {required, topology} <= set(order) else required == topology

    found: dict[str, str] = {}
    for entry in schema:
        taken = entry.get("included_in_default_model") is True or matrix == "m1" and entry.get("structural_feature") is True
        if entry.get("model_role") != "input" or not taken or not reached(entry.get("requires_topology")):
            continue
        if "pattern" in entry:
            fits = re.compile(".*".join(map(re.escape, entry["pattern"].split("*"))))
            made = {c: c for c in columns if fits.fullmatch(c)}
        else:
            source = entry.get("source_column") or entry["name"]
            made = {entry["name"]: source} if source in columns else {}
        found |= {name: source for name, source in made.items() if name not in found}
    return found
