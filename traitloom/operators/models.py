"""Small models on trait tables."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows that a task trains a forest on; each is kept with its weight in every tree.
TRAINED_ROWS = 250_000
#: Rows that a task clusters.
CLUSTERED_ROWS = 1_000_000


def _polynomial(df: DataFrame, x: str, y: str) -> dict[str, float]:
    """Least-squares parabola from one row of sums, centred for stability."""
    m = df.agg(F.avg(x).alias("mx"), F.avg(y).alias("my")).first()
    if m["mx"] is None:
        raise ValueError("nothing to fit")
    u, v = F.col(x) - m["mx"], F.col(y) - m["my"]
    s = df.agg(F.count("*").alias("n"), F.sum(u * u).alias("s2"), F.sum(u**3).alias("s3"), F.sum(u**4).alias("s4"), F.sum(u * v).alias("t1"), F.sum(u * u * v).alias("t2")).first()
    a = np.array([[s["n"], 0.0, s["s2"]], [0.0, s["s2"], s["s3"]], [s["s2"], s["s3"], s["s4"]]])
    q0, q1, q2 = np.linalg.lstsq(a, np.array([0.0, s["t1"], s["t2"]]), rcond=None)[0]
    return {"p0": m["my"] + q0 - q1 * m["mx"] + q2 * m["mx"] ** 2, "p1": q1 - 2 * q2 * m["mx"], "p2": q2}


def predict_polynomial(x: Column, p: dict[str, float]) -> Column:
    return F.lit(float(p["p0"])) + F.lit(float(p["p1"])) * x + F.lit(float(p["p2"])) * x * x


def fit_polynomial(df: DataFrame, x: str, y: str, keep: float = 0.5) -> dict[str, float]:
    """Parabola refitted on the rows whose absolute residual is at most a share of its deviation."""
    first = _polynomial(df, x, y)
    rows = df.withColumn("_residual", F.abs(F.col(y) - predict_polynomial(F.col(x), first)))
    top = keep * (rows.agg(F.stddev_pop("_residual").alias("s")).first()["s"] or 0.0)
    return _polynomial(rows.where(F.col("_residual") <= top), x, y)


def in_tasks(df: DataFrame, most: int) -> DataFrame:
    """Rows dealt out so that no task holds more than about ``most``; a table of fewer stays as it is.

    Spark ML caches what it fits on, several times as large as in a file, and
    by the partitions of the file.
    """
    parts = -(-df.count() // most)
    return df.repartition(parts) if parts > 1 else df


def correctness_forest(df: DataFrame, columns: list[str], label: str, trees: int = 100, seed: int = 42):
    """Random forest for ``label``; returns the model and the scored rows."""
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(df.na.fill(0, subset=columns))
    model = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, seed=seed).fit(in_tasks(rows.select("features", label), TRAINED_ROWS))
    return model, model.transform(rows)


def forest_report(model, scored: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Accuracy and the importance of every feature (name, value), one row each."""
    right = scored.agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("value")).select(F.lit("accuracy").alias("name"), "value")
    weights = scored.sparkSession.createDataFrame([(f"importance_{c}", float(w)) for c, w in zip(columns, model.featureImportances.toArray(), strict=True)], "name string, value double")
    return right.unionByName(weights)


def with_fallback(scored: DataFrame, value: str, fallback: Column) -> DataFrame:
    """Predicted mean: the measured one where it is judged right, else the fallback."""
    return scored.withColumn("pred_mean", F.when(F.col("prediction") == 0, fallback).otherwise(F.col(value)))


def _fitted_components(df: DataFrame, columns: list[str], k: int):
    """Complete rows with standardised columns, the fitted model, and a sign per component that makes its largest loading positive."""
    rows = VectorAssembler(inputCols=columns, outputCol="_raw").transform(df.na.drop(subset=columns))
    rows = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True).fit(rows).transform(rows)
    model = PCA(k=k, inputCol="_scaled", outputCol="_pc").fit(rows)
    axes = model.pc.toArray()
    return rows, model, [1.0 if axes[np.abs(axes[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]


def principal_components(df: DataFrame, columns: list[str], k: int) -> tuple[DataFrame, list[float]]:
    """Standardised principal components as columns pc1.., and the explained shares; each component's largest loading is positive."""
    rows, model, signs = _fitted_components(df, columns, k)
    out = model.transform(rows).withColumn("_pc", vector_to_array("_pc"))
    return out.withColumns({f"pc{i + 1}": F.get("_pc", F.lit(i)) * sign for i, sign in enumerate(signs)}).drop("_raw", "_scaled", "_pc"), model.explainedVariance.toArray().tolist()


def component_loadings(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Loadings of :func:`principal_components`: a row (trait, pc1, ..) per column, and a last one, ``explained``, of the shares of the variance."""
    _, model, signs = _fitted_components(df, columns, k)
    loadings = [(name, *map(float, row * signs)) for name, row in zip(columns, model.pc.toArray(), strict=True)]
    shares = ("explained", *map(float, model.explainedVariance.toArray()))
    return df.sparkSession.createDataFrame([*loadings, shares], ", ".join(["trait string", *[f"pc{i + 1} double" for i in range(k)]]))


def discriminant_axes(df: DataFrame, columns: list[str], cls: str, k: int = 2) -> tuple[DataFrame, list[float]]:
    """Linear discriminant projections ld1.. and explained shares.

    Class sums and cross products are one aggregation per class; the d by d
    eigenproblem is all that runs on the driver.
    """
    rows = df.na.drop(subset=[*columns, cls])
    products = {f"{a}__{b}": F.sum(F.col(a) * F.col(b)) for i, a in enumerate(columns) for b in columns[i:]}
    totals = rows.groupBy(cls).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in columns], *[e.alias(n) for n, e in products.items()])
    d = len(columns)
    per_class = totals.agg(
        F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns],
        *[F.sum(n).alias(n) for n in products], *[F.sum(F.col(a) * F.col(b) / F.col("n")).alias(f"m_{a}__{b}") for i, a in enumerate(columns) for b in columns[i:]],
    ).first()
    total, within, between = per_class["n"], np.zeros((d, d)), np.zeros((d, d))
    for i, a in enumerate(columns):
        for j in range(i, d):
            b = columns[j]
            classes = per_class[f"m_{a}__{b}"]
            within[i, j] = within[j, i] = per_class[f"{a}__{b}"] - classes
            between[i, j] = between[j, i] = classes - per_class[a] * per_class[b] / total
    values, vectors = np.linalg.eig(np.linalg.pinv(within) @ between)
    order = np.argsort(-values.real)[:k]
    axes = vectors.real[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])])
    shares = (values.real[order] / values.real.sum()).tolist()
    project = lambda v: sum((F.col(c) * F.lit(float(w)) for c, w in zip(columns, v, strict=True)), F.lit(0.0))
    return rows.withColumns({f"ld{i + 1}": project(axes[:, i]) for i in range(axes.shape[1])}), shares


def anchors(boxes: DataFrame, k: int = 9, seed: int = 1) -> list[list[float]]:
    """Cluster centres of whitened box sizes, in original units, by rising area."""
    scale = boxes.agg(F.stddev_pop("w").alias("w"), F.stddev_pop("h").alias("h")).first()
    rows = VectorAssembler(inputCols=["sw", "sh"], outputCol="features").transform(in_tasks(boxes.select((F.col("w") / scale["w"]).alias("sw"), (F.col("h") / scale["h"]).alias("sh")), CLUSTERED_ROWS))
    centres = KMeans(k=k, seed=seed).fit(rows).clusterCenters()
    return sorted(([float(a * scale["w"]), float(b * scale["h"])] for a, b in centres), key=lambda c: c[0] * c[1])


def point_clusters(points: DataFrame, k: int, seed: int = 1) -> list[tuple[int, int]]:
    """Integer centroids of a Gaussian mixture over points."""
    rows = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(in_tasks(points, CLUSTERED_ROWS))
    means = GaussianMixture(k=k, seed=seed).fit(rows).gaussiansDF.select(vector_to_array("mean").alias("m")).collect()
    return sorted((int(r["m"][0]), int(r["m"][1])) for r in means)
