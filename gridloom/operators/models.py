"""Fuzzy clustering, neighbours, components and regressions over vectors."""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 1e-12


def squared_distances(vector: str, centers: np.ndarray) -> Column:
    """array<double>: squared distance to each center, floored. Centers are constants of the plan, k of them."""

    def one(center: np.ndarray) -> Column:
        other = F.array(*[F.lit(float(v)) for v in center])
        return F.greatest(F.aggregate(F.zip_with(F.col(vector), other, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x), F.lit(FLOOR))

    return F.array(*[one(c) for c in centers])


def memberships(df: DataFrame, centers: np.ndarray, m: float = 1.7, vector: str = "vector") -> DataFrame:
    """df with `u`: fuzzy memberships, d^(-1/(m-1)) over squared distances d, normalised."""
    power = -1.0 / (m - 1.0)
    raw = F.transform(squared_distances(vector, centers), lambda d: F.pow(d, F.lit(power)))
    return df.withColumn("u_raw", raw).withColumn("u", F.transform("u_raw", lambda x: x / F.aggregate("u_raw", F.lit(0.0), lambda s, y: s + y))).drop("u_raw")


def fcm_step(df: DataFrame, centers: np.ndarray, m: float = 1.7, vector: str = "vector") -> tuple[np.ndarray, float]:
    """New centers and the objective: one aggregation with k * dimensions results, whatever the number of rows."""
    k, dims = centers.shape
    with_u = memberships(df, centers, m, vector).withColumn("d", squared_distances(vector, centers))
    row = with_u.agg(
        *[F.sum(F.pow(F.col("u")[i], F.lit(m))).alias(f"w{i}") for i in range(k)],
        *[F.sum(F.pow(F.col("u")[i], F.lit(m)) * F.col(vector)[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(dims)],
        F.sum(sum((F.pow(F.col("u")[i], F.lit(m)) * F.col("d")[i] for i in range(k)), F.lit(0.0))).alias("objective"),
    ).first()
    return np.array([[row[f"s{i}_{j}"] / row[f"w{i}"] for j in range(dims)] for i in range(k)]), float(row["objective"])


def fit_fcm(df: DataFrame, centers: np.ndarray, m: float = 1.7, iterations: int = 600, tolerance: float = 1e-4, vector: str = "vector") -> tuple[np.ndarray, float, int]:
    """Centers, objective and steps, until the objective changes by less than the tolerance."""
    before = np.inf
    for step in range(1, iterations + 1):
        centers, objective = fcm_step(df, centers, m, vector)
        if abs(before - objective) < tolerance:
            break
        before = objective
    return centers, objective, step


def fit_best_fcm(df: DataFrame, k: int, seeds: list[int], **options) -> tuple[np.ndarray, float, int]:
    """The fit with the least objective over seeds; each starts from k rows in order of a seeded hash."""
    vector = options.get("vector", "vector")
    fits = [fit_fcm(df, np.array([r[0] for r in df.select(vector).orderBy(F.xxhash64(vector, F.lit(seed))).limit(k).collect()], float), **options) for seed in seeds]
    return min(fits, key=lambda f: f[1])


def align(centers: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Centers in the order that is closest to the reference in all."""
    best = min(permutations(range(len(centers))), key=lambda p: sum(((centers[i] - reference[j]) ** 2).sum() for j, i in enumerate(p)))
    return centers[list(best)]


def display_state(u: Column) -> Column:
    """clear, mixed or weak, of a membership array."""
    ordered = F.reverse(F.array_sort(u))
    entropy = -F.aggregate(u, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return F.when((ordered[0] >= 0.5) & (ordered[0] - ordered[1] >= 0.15) & (entropy < 1.05), "clear").when(ordered[0] >= 0.35, "mixed").otherwise("weak")


def fuzzy_quality(df: DataFrame, k: int) -> DataFrame:
    """Partition coefficient, its modified form, and partition entropy, from memberships `u`."""
    squares = F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)
    entropy = F.aggregate("u", F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log(x)).otherwise(0.0))
    coefficient = F.avg(squares)
    return df.agg(F.round(coefficient, 6).alias("partition_coefficient"), F.round(1 - (k / (k - 1.0)) * (1 - coefficient), 6).alias("modified_coefficient"), F.round(F.avg(entropy), 6).alias("partition_entropy"))


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, from their contingency counts."""
    pairs = lambda n: F.sum(n * (n - 1) / 2.0)
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    both = cells.agg(pairs(n).alias("both"), F.sum("n").alias("total"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs(n).alias("rows"))
    columns = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs(n).alias("columns"))
    joined = both.join(F.broadcast(rows)).join(F.broadcast(columns))
    expected = F.col("rows") * F.col("columns") / F.nullif(F.col("total") * (F.col("total") - 1) / 2.0, F.lit(0.0))
    return joined.select(F.round((F.col("both") - expected) / F.nullif((F.col("rows") + F.col("columns")) / 2.0 - expected, F.lit(0.0)), 6).alias("ari"))


def normalized_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information of two labelings over the mean of their entropies (NULL if both are constant)."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    sides = [cells.groupBy(c).agg(F.sum("n").alias(f"n_{i}")) for i, c in enumerate((a, b))]
    total = cells.agg(F.sum("n").cast("double").alias("t"))
    entropy = [s.join(F.broadcast(total)).agg((-F.sum(F.col(f"n_{i}") / F.col("t") * F.log(F.col(f"n_{i}") / F.col("t")))).alias(f"h_{i}")) for i, s in enumerate(sides)]
    share = F.col("n") / F.col("t") * F.log(F.col("t") * F.col("n") / (F.col("n_0") * F.col("n_1")))
    both = cells.join(sides[0], a).join(sides[1], b).join(F.broadcast(total)).agg(F.sum(share).alias("mi"))
    return both.join(F.broadcast(entropy[0])).join(F.broadcast(entropy[1])).select(F.round(F.col("mi") / F.nullif((F.col("h_0") + F.col("h_1")) / 2, F.lit(0.0)), 6).alias("nmi"))


def distance_geometry(queries: DataFrame, rows: DataFrame, block: int = 2000) -> DataFrame:
    """pairs, correlation of distance and label difference, mean distance of equal labels: each query (id, vector, label) against all other rows.

    Queries go to all rows in blocks of bounded size; a task returns seven sums a block.
    """
    from collections.abc import Iterator

    import pandas as pd

    spark, schema, parts, asked = rows.sparkSession, "n double, d double, r double, dd double, rr double, dr double, same double, same_d double", [], []

    def answer(batch: list) -> DataFrame:
        sent = spark.sparkContext.broadcast((np.array([r.id for r in batch]), np.array([r.vector for r in batch], float), np.array([r.label for r in batch], float)))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q, label = sent.value
            sums = np.zeros(8)
            for frame in frames:
                for at in range(0, len(frame), 4096):
                    part = frame.iloc[at : at + 4096]
                    v = np.array(part["vector"].tolist(), float)
                    d = np.sqrt(np.maximum((q**2).sum(1)[:, None] + (v**2).sum(1)[None, :] - 2 * q @ v.T, 0))
                    r = np.abs(label[:, None] - part["label"].to_numpy(float)[None, :])
                    other = ids[:, None] != part["id"].to_numpy()[None, :]
                    d, r = d[other], r[other]
                    sums += [len(d), d.sum(), r.sum(), (d * d).sum(), (r * r).sum(), (d * r).sum(), (r == 0).sum(), d[r == 0].sum()]
            yield pd.DataFrame([sums], columns=[c.split(" ")[0] for c in schema.split(", ")])

        return rows.select("id", "vector", "label").mapInPandas(run, schema)

    for row in queries.select("id", "vector", "label").toLocalIterator():
        asked.append(row)
        if len(asked) == block:
            parts.append(answer(asked))
            asked = []
    if asked or not parts:
        parts.append(answer(asked) if asked else spark.createDataFrame([], schema))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    t = found.agg(*[F.sum(c.split(" ")[0]).alias(c.split(" ")[0]) for c in schema.split(", ")])
    c = F.col
    spread = F.sqrt((c("n") * c("dd") - c("d") * c("d")) * (c("n") * c("rr") - c("r") * c("r")))
    return t.select(F.coalesce(c("n"), F.lit(0.0)).cast("long").alias("pairs"), F.round((c("n") * c("dr") - c("d") * c("r")) / F.nullif(spread, F.lit(0.0)), 5).alias("correlation"), F.round(c("same_d") / F.nullif(c("same"), F.lit(0.0)), 5).alias("same_label_distance"))


def principal_components(df: DataFrame, n: int, vector: str = "vector") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, components (rows) and explained variance, from one pass of sums and products a dimension pair."""
    import pyarrow as pa

    dims = len(df.select(vector).first()[0])

    def run(batches):
        sums = np.zeros(1 + dims + dims * dims)
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, dims)
            sums += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["sums"])

    # A row of sums a task; their number is that of tasks, their size that of the model.
    rows = df.select(vector).mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    sums = np.zeros(1 + dims + dims * dims)
    for row in rows:
        sums[row["at"]] = row["x"]
    mean = sums[1 : 1 + dims] / sums[0]
    products = sums[1 + dims :].reshape(dims, dims) / sums[0]
    variance, vectors = np.linalg.eigh(products - np.outer(mean, mean))
    order = np.argsort(-variance)[:n]
    return mean, vectors[:, order].T, variance[order]


def ridge(df: DataFrame, features: list[str], target: str, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept by normal equations of centred features: exact, and one aggregation over the rows."""
    columns = [*features, target]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in columns], *[F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if j >= i]).first()
    n, mean = row["n"], np.array([row[f"s_{c}"] for c in columns]) / row["n"]
    size = len(columns)
    cross = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)]) - n * np.outer(mean, mean)
    weights = np.linalg.solve(cross[:-1, :-1] + alpha * np.eye(size - 1), cross[:-1, -1])
    return weights, float(mean[-1] - weights @ mean[:-1])


def pairwise_ranker(features: np.ndarray, better: np.ndarray, penalty: float = 1.0, steps: int = 500, rate: float = 0.5) -> np.ndarray:
    """Weights of a logistic model on differences of pairs (first minus second, better: 1 or 0), by gradient descent."""
    weights = np.zeros(features.shape[1])
    for _ in range(steps):
        error = 1 / (1 + np.exp(-features @ weights)) - better
        weights -= rate * (features.T @ error / len(better) + penalty / len(better) * weights)
    return weights


def ward(points: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters by Ward's merging, for a bounded number of points (cluster centers, not rows)."""
    groups = {i: ([i], points[i].astype(float)) for i in range(len(points))}
    while len(groups) > k:
        names = sorted(groups)
        cost = lambda a, b: len(groups[a][0]) * len(groups[b][0]) / (len(groups[a][0]) + len(groups[b][0])) * ((groups[a][1] - groups[b][1]) ** 2).sum()
        a, b = min(((x, y) for i, x in enumerate(names) for y in names[i + 1 :]), key=lambda p: (cost(*p), p))
        members = groups[a][0] + groups.pop(b)[0]
        groups[a] = (members, points[members].mean(axis=0))
    labels = np.zeros(len(points), int)
    for label, (members, _) in enumerate(groups.values()):
        labels[members] = label
    return labels


def neighbour_estimate(neighbours: DataFrame, outcomes: DataFrame, threshold: float | None = None) -> DataFrame:
    """query_id, action, estimate, support: means of neighbours' gains weighted by 1 / (distance + 1e-6); status by coverage."""
    joined = neighbours.join(outcomes.withColumnRenamed("id", "n_id"), F.col("id") == F.col("n_id"))
    weight = 1.0 / (F.col("distance") + 1e-6)
    out = joined.groupBy("query_id", "action").agg(F.round(F.sum(weight * F.col("gain")) / F.sum(weight), 6).alias("estimate"), F.count(F.lit(1)).alias("support"), F.min("distance").alias("nearest"))
    if threshold is not None:
        out = out.withColumn("status", F.when(F.col("nearest") > threshold, "outside_reference_coverage").otherwise("available"))
    return out


def coverage_threshold(nearest_of_each: DataFrame, q: float) -> DataFrame:
    """The q-quantile of distances to the nearest other row."""
    return nearest_of_each.agg(F.round(F.percentile("distance", F.lit(q)), 6).alias("threshold"))


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / interquartile range; a range of 0 counts as 1."""
    edges = df.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"{c}__q") for c in columns])
    out = df.join(F.broadcast(edges))
    made = {c: F.round((F.col(c) - F.col(f"{c}__q")[1]) / F.when(F.col(f"{c}__q")[2] == F.col(f"{c}__q")[0], 1.0).otherwise(F.col(f"{c}__q")[2] - F.col(f"{c}__q")[0]), 6) for c in columns}
    return out.withColumns(made).select(*df.columns)


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("rn_ = 1").drop("rn_")


def fuzzifier_sensitivity(df: DataFrame, centers: np.ndarray, fuzzifiers: list[float]) -> DataFrame:
    """Quality of the memberships from fixed centers for each fuzzifier."""
    parts = [fuzzy_quality(memberships(df, centers, m), len(centers)).withColumn("fuzzifier", F.lit(m)) for m in fuzzifiers]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def kmeans(df: DataFrame, k: int, seed: int = 1, iterations: int = 50) -> DataFrame:
    """df with `cluster`, by k-means on `vector`."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    made = df.withColumn("ml_vector", array_to_vector("vector"))
    fitted = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="ml_vector", predictionCol="cluster").fit(made)
    return fitted.transform(made).drop("ml_vector")


def regress(df: DataFrame, features: list[str], target: str, kind: str, **options) -> DataFrame:
    """df with `prediction`, by 'elastic_net' or 'boosted_trees' regression."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    made = VectorAssembler(inputCols=features, outputCol="ml_features").transform(df)
    model = {"elastic_net": LinearRegression, "boosted_trees": GBTRegressor}[kind](featuresCol="ml_features", labelCol=target, **options)
    return model.fit(made).transform(made).drop("ml_features")
