"""Exact Shapley values of tree ensembles and linear models, row by row.

A leaf pays its value if every condition on its path holds. Without a feature its conditions
hold by the share of training rows that took that turn (the path-dependent expectation). For
one user and one leaf the game is a product over the features of the path: a factor is 1 or 0
with the feature and the share without it. Its Shapley value has a closed form,

    value * (o_j - r_j) * integral over t in (0, 1) of the product of (r_i + t (o_i - r_i)), i != j,

since the integral of t^s (1 - t)^(k-1-s) is the weight of a coalition of s. The integrand is a
polynomial of degree k - 1, so a Gauss-Legendre rule with k / 2 nodes is exact. Features off the
path have o = r = 1 and change nothing. Contributions and bias add up to the margin.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillview.functions.paths import leaf_table, paid_by_leaves
from tillview.sources.scratch import scratch_path

#: The fitted model: inner nodes have a feature (its number) and a threshold, leaves a value; ``cover``
#: counts the training rows of a node.
NODES = (
    "tree int, node int, feature int, threshold double, left int, right int, value double, cover double, weight double"
)


@dataclass
class Leaf:
    """The value of a leaf with its conditions per feature: above ``low``, at most ``high``, and their share."""

    tree: int
    value: float
    low: dict[str, float] = field(default_factory=dict)
    high: dict[str, float] = field(default_factory=dict)
    share: dict[str, float] = field(default_factory=dict)


def ensemble_nodes(spark: SparkSession, classifier) -> DataFrame:
    """NODES of a fitted boosted or bagged ensemble of Spark ML, from its saved form.

    Values are in units of the margin: the boosted sum, or the forest's share of votes for class 1.
    """
    path = scratch_path(spark, "ensemble")
    classifier.write().overwrite().save(path)
    votes = F.col("nodeData.impurityStats")
    if "Regression" in type(classifier.trees[0]).__name__:
        value, weight = F.col("nodeData.prediction"), F.col("weights")
    else:
        total = F.aggregate(votes, F.lit(0.0), lambda a, x: a + x)
        value, weight = votes[1] / total, F.lit(1.0 / classifier.getNumTrees)
    inner = F.col("nodeData.leftChild") >= 0
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "metadata", "weights").drop("metadata")
    return spark.read.parquet(f"{path}/data").join(weights, "treeID").select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("node"),
        F.when(inner, F.col("nodeData.split.featureIndex")).alias("feature"),
        F.when(inner, F.col("nodeData.split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.when(~inner, value).alias("value"),
        F.col("nodeData.rawCount").cast("double").alias("cover"),
        weight.alias("weight"),
    )


def leaves(nodes: DataFrame, features: list[str]) -> list[Leaf]:
    """The leaves of an ensemble; as many as its parameters allow (trees x 2^depth), whatever the data."""
    rows = {(r["tree"], r["node"]): r for r in nodes.collect()}
    found, open_ = [], [(r, Leaf(t, 0.0)) for (t, n), r in sorted(rows.items()) if n == 0]
    while open_:
        row, path = open_.pop()
        if row["feature"] is None:
            path.value = row["weight"] * row["value"]
            found.append(path)
            continue
        name, cut = features[row["feature"]], row["threshold"]
        for side in ("left", "right"):
            child = rows[row["tree"], row[side]]
            step = Leaf(path.tree, 0.0, dict(path.low), dict(path.high), dict(path.share))
            bounds, pick = (step.high, min) if side == "left" else (step.low, max)
            bounds[name] = pick(bounds.get(name, cut), cut)
            step.share[name] = step.share.get(name, 1.0) * child["cover"] / row["cover"]
            open_.append((child, step))
    return found


def tree_contributions(rows: DataFrame, nodes: DataFrame, features: list[str], key: str = "user_id") -> DataFrame:
    """(key, one column per feature, bias): the exact contributions to the margin, one row per row.

    What a leaf pays a user depends only on which of its path's features hold, so its shares are
    tabulated beforehand, 2^depth rows a leaf. The tables travel to the tasks, their size is bounded
    by the model's parameters; a row is looked up where it is, nothing is shuffled. A missing value
    fails every condition, as it does in the ensemble (NaN goes right).
    """
    found = leaves(nodes, features)
    bias = sum(leaf.value * float(np.prod(list(leaf.share.values()))) for leaf in found)
    tables = [leaf_table(leaf, features) for leaf in found if leaf.share]
    keyed = rows.select(key, *[F.col(f).cast("double").alias(f"x_{i}") for i, f in enumerate(features)])
    fields = [T.StructField(f"by_{i}", T.DoubleType()) for i in range(len(features))]
    paid = keyed.mapInArrow(lambda batches: paid_by_leaves(batches, tables), T.StructType([keyed.schema[key], *fields]))
    return paid.select(key, *[F.col(f"by_{i}").alias(f) for i, f in enumerate(features)], F.lit(bias).alias("bias"))


def linear_contributions(
    rows: DataFrame, model: LogisticRegressionModel, means: list[float], spreads: list[float], features: list[str], key: str = "user_id"
) -> DataFrame:
    """The same for a linear model on standardised features: a feature's term against its mean."""
    terms = [
        ((F.col(f).cast("double") - m) * (float(c) / s if s else 0.0)).alias(f)
        for f, c, m, s in zip(features, model.coefficients, means, spreads)
    ]
    return rows.select(key, *terms, F.lit(float(model.intercept)).alias("bias"))
