"""Churn model: training, selection, scoring and explanation with Spark ML."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillview.functions.ranks import exact_percentiles
from tillview.operators import shapley
from tillview.operators.churn import FEATURES, heuristic_probability, risk_label, rule_factors
from tillview.operators.tables import upsert_by_key
from tillview.sources.scratch import materialize, scratch_path

MIN_AUC = 0.75
MIN_ROWS = 200
FOLDS = 5
SEED = 42
# a tree ensemble within this distance of the best AUC is preferred
TOLERANCE = 0.005
PREFERRED = "gradient_boosting"
# users whose Shapley values are kept with a stored model
EXPLAINED_ROWS = 500
LABEL, WEIGHT, FOLD = "churned", "weight", "fold"

# How a feature is called and written in an explanation.
FEATURE_LABELS = {
    "recency_days": "days since last purchase",
    "frequency": "total orders",
    "monetary": "total spend",
    "avg_order_value": "average order value",
    "tenure_days": "customer tenure (days)",
    "purchase_velocity": "purchase rate (orders/day)",
    "recency_ratio": "silence relative to tenure",
}
FEATURE_FORMATS = {
    "recency_days": "%.0f days",
    "tenure_days": "%.0f days",
    "frequency": "%.0f orders",
    "purchase_velocity": "%.3f/day",
    "recency_ratio": "%.2fx",
    "monetary": "$%.0f",
    "avg_order_value": "$%.0f",
}


class GateError(RuntimeError):
    """Too little data or too weak a model."""


@dataclass
class ChurnModel:
    """A fitted pipeline over the raw feature columns, with its selection report."""

    pipeline: PipelineModel
    name: str
    cv_auc: float
    report: dict[str, float]

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        meta = {"model_name": self.name, "cv_auc": self.cv_auc, "feature_names": FEATURES, "report": self.report}
        _session().createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/metadata"
        )

    @staticmethod
    def load(path: str) -> "ChurnModel":
        meta = json.loads(_session().read.text(f"{path}/metadata").first()[0])
        return ChurnModel(
            PipelineModel.load(f"{path}/pipeline"), meta["model_name"], meta["cv_auc"], meta["report"]
        )


def _session() -> SparkSession:
    return SparkSession.getActiveSession()


def _assembler(columns: list[str] = FEATURES, output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol=output)


class _StoredPipeline(Pipeline):
    """A pipeline whose fitted model is read back from the shared folder.

    Straight from ``fit`` a forest or linear model carries its training summary and with it the
    session, which cannot be sent to tasks any more once an Observation has been used.
    """

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        path = scratch_path(dataset.sparkSession, "model")
        super()._fit(dataset).write().save(path)
        return PipelineModel.load(path)


def candidates(rounds: int = 100, depth: int = 5) -> dict[str, Pipeline]:
    common = {"labelCol": LABEL, "weightCol": WEIGHT}
    boosting = GBTClassifier(
        maxIter=rounds, maxDepth=depth, stepSize=0.05, subsamplingRate=0.8, seed=SEED, **common
    )
    forest = RandomForestClassifier(numTrees=rounds, maxDepth=depth, subsamplingRate=0.8, seed=SEED, **common)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    linear = LogisticRegression(featuresCol="scaled", maxIter=50, regParam=0.01, **common)
    return {
        PREFERRED: _StoredPipeline(stages=[_assembler(), boosting]),
        "random_forest": _StoredPipeline(stages=[_assembler(), forest]),
        "logistic_regression": _StoredPipeline(stages=[_assembler(), scaler, linear]),
    }


def prepare_training(training: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Stored rows with class weight and fold.

    Positives weigh negatives / positives. Folds are stratified: within a class, users in
    the order of a hash are dealt to the folds by quintile of that order, so every fold
    has a fifth of each class, and the same one wherever a row is recomputed.
    """
    prepared = (
        training.withColumn("draw", F.pmod(F.xxhash64("user_id", F.lit(SEED)), F.lit(2**52)).cast("double"))
        .withColumn(LABEL, F.col(LABEL).cast("double"))
        .withColumns({c: F.col(c).cast("double") for c in FEATURES})
    )
    # stored before they are counted: the fact behind them is aggregated once
    rows = materialize(prepared, "training")
    counts = rows.agg(F.count("*").alias("n"), F.sum(LABEL).alias("positive")).first()
    if counts["n"] < min_rows:
        raise GateError(f"{counts['n']} training rows, need {min_rows}")
    weight = (counts["n"] - counts["positive"]) / max(counts["positive"], 1)
    stored = rows.withColumn(WEIGHT, F.when(F.col(LABEL) == 1, F.lit(float(weight))).otherwise(1.0))
    edges = {
        label: exact_percentiles(stored.filter(F.col(LABEL) == label), ["draw"], [i / FOLDS for i in range(1, FOLDS)])["draw"]
        for label in (0.0, 1.0)
    }
    fold = F.lit(0)
    for label, cuts in edges.items():
        for cut in cuts:
            if cut is not None:
                fold = fold + ((F.col(LABEL) == label) & (F.col("draw") > cut)).cast("int")
    return stored.withColumn(FOLD, fold).drop("draw")


def evaluate_candidates(prepared: DataFrame, models: dict[str, Pipeline]) -> dict[str, float]:
    """Mean AUC over the folds per candidate. The fits are independent jobs and
    run side by side, so that one fit's short stages do not leave executors idle."""
    evaluator = BinaryClassificationEvaluator(labelCol=LABEL)

    def auc(name: str, fold: int) -> float:
        fitted = models[name].fit(prepared.filter(F.col(FOLD) != fold))
        return evaluator.evaluate(fitted.transform(prepared.filter(F.col(FOLD) == fold)))

    runs = [(name, fold) for name in models for fold in range(FOLDS)]
    with ThreadPoolExecutor(max_workers=FOLDS) as pool:
        scores = list(pool.map(inheritable_thread_target(prepared.sparkSession)(lambda run: auc(*run)), runs))
    return {
        name: sum(score for (n, _), score in zip(runs, scores) if n == name) / FOLDS for name in models
    }


def choose(report: dict[str, float]) -> str:
    best = max(report, key=report.get)
    if PREFERRED in report and report[best] - report[PREFERRED] <= TOLERANCE:
        return PREFERRED
    return best


def churn_candidates(prepared: DataFrame, rounds: int = 100, min_auc: float = MIN_AUC) -> tuple[dict[str, float], str]:
    """Cross-validated AUC per candidate and the decision on the one that would be chosen."""
    report = evaluate_candidates(prepared, candidates(rounds))
    return report, "promote" if report[choose(report)] >= min_auc else "blocked"


def churn_refit(prepared: DataFrame, report: dict[str, float], rounds: int = 100) -> ChurnModel:
    """The candidate that is chosen by the report, fitted on all rows."""
    name = choose(report)
    return ChurnModel(candidates(rounds)[name].fit(prepared), name, report[name], report)


def churn_fit(training: DataFrame, rounds: int = 100, min_rows: int = 1) -> ChurnModel:
    """The preferred candidate on all rows, without a selection."""
    fitted = candidates(rounds)[PREFERRED].fit(prepare_training(training, min_rows))
    return ChurnModel(fitted, PREFERRED, float("nan"), {})


def churn_train(
    training: DataFrame, rounds: int = 100, min_auc: float = MIN_AUC, min_rows: int = MIN_ROWS
) -> ChurnModel:
    """Cross-validate the candidates, pick one and fit it on all rows."""
    prepared = prepare_training(training, min_rows)
    report, decision = churn_candidates(prepared, rounds, min_auc)
    if decision == "blocked":
        raise GateError(f"best AUC {report[choose(report)]:.4f} is below {min_auc}")
    return churn_refit(prepared, report, rounds)


def churn_score_batch(prepared_features: DataFrame, model: ChurnModel | None) -> DataFrame:
    """Probability, label and rule-based reasons for every user.

    Takes the frame of ``churn_feature_prep``; without a model the heuristic decides.
    """
    if model is None:
        scored = prepared_features.withColumn("churn_probability", heuristic_probability().cast("double"))
    else:
        scored = model.pipeline.transform(prepared_features).withColumn(
            "churn_probability", F.round(vector_to_array("probability")[1], 4)
        )
    return scored.select(
        "user_id",
        "churn_probability",
        risk_label(F.col("churn_probability")).alias("churn_risk_label"),
        rule_factors().alias("rule_factors"),
    )


def churn_contributions(prepared_features: DataFrame, model: ChurnModel, key: str = "user_id") -> DataFrame:
    """Exact Shapley values of every user's margin: the key, one column per feature, bias.

    The margin is the ensemble's raw score of class 1 (the share of votes for a forest, the
    log odds for the linear model); contributions and bias add up to it.
    """
    classifier = model.pipeline.stages[-1]
    if isinstance(classifier, LogisticRegressionModel):
        scaler = model.pipeline.stages[1]
        return shapley.linear_contributions(
            prepared_features, classifier, list(scaler.mean), list(scaler.std), FEATURES, key
        )
    nodes = shapley.ensemble_nodes(prepared_features.sparkSession, classifier)
    return shapley.tree_contributions(prepared_features, nodes, FEATURES, key)


def churn_model_factors(prepared_features: DataFrame, model: ChurnModel, top: int = 2) -> DataFrame:
    """The features with the largest Shapley values of a user's margin, in words."""
    # the features ride along as the key, so that they need not be joined again
    user = F.struct("user_id", *FEATURES).alias("user")
    found = churn_contributions(prepared_features.select(user, *FEATURES), model, "user").select(
        "user.*", *[F.col(f).alias(f"by_{f}") for f in FEATURES]
    )

    def described(feature: str) -> Column:
        contribution = F.col(f"by_{feature}")
        text = F.concat(
            F.when(contribution > 0, "High ").otherwise("Low "),
            F.lit(f"{FEATURE_LABELS[feature]} ("),
            F.format_string(FEATURE_FORMATS[feature], F.col(feature).cast("double")),
            F.lit(")"),
        )
        return F.struct((-F.abs(contribution)).alias("order"), F.lit(FEATURES.index(feature)).alias("i"), text.alias("t"))

    ranked = F.slice(F.array_sort(F.array(*[described(f) for f in FEATURES])), 1, top)
    return found.select("user_id", F.transform(ranked, lambda r: r["t"]).alias("top_risk_factors"))


def score_report(scores: DataFrame, label: str = LABEL, probability: str = "churn_probability", cut: float = 0.5) -> DataFrame:
    """Precision, recall and F1 per class at ``cut`` and the exact AUC, from a table of scores.

    Scores are taken to four digits, as they are stored. All figures come from the counts of
    both classes per score: one aggregate with map-side combine, at most 10,001 rows whatever
    the number of users; the running sums for the AUC are over those rows. Equal scores count
    half, the rank form of the AUC. An empty class gives nulls.
    """
    actual = F.col(label).cast("int")
    histogram = scores.groupBy(F.round(F.col(probability).cast("double"), 4).alias("score")).agg(
        F.count_if(actual == 1).alias("up"), F.count_if(actual == 0).alias("down")
    )
    below = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = histogram.withColumn("below", F.coalesce(F.sum("down").over(below), F.lit(0)))
    over = F.col("score") >= cut
    total = lambda column, where: F.coalesce(F.sum(F.when(where, F.col(column))), F.lit(0))
    counts = ranked.agg(
        F.sum("up").alias("ups"),
        F.sum("down").alias("downs"),
        # pairs in the right order, twice, so that ties are whole numbers
        F.sum(F.col("up") * (2 * F.col("below") + F.col("down"))).alias("pairs"),
        total("up", over).alias("up_over"),
        total("down", over).alias("down_over"),
    )
    known = counts.withColumns(
        {
            "train_auc": F.try_divide(F.col("pairs").cast("double"), 2 * F.col("ups").cast("double") * F.col("downs")),
            "kept": F.col("downs") - F.col("down_over"),
            "missed": F.col("ups") - F.col("up_over"),
        }
    )

    def line(name: str, hit: str, predicted: Column, support: str) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            F.try_divide(F.col(hit).cast("double"), predicted).alias("precision"),
            F.try_divide(F.col(hit).cast("double"), F.col(support)).alias("recall"),
            F.try_divide(2.0 * F.col(hit), predicted + F.col(support)).alias("f1"),
            F.col(support).alias("support"),
        )

    rows = F.array(
        line("Retained", "kept", F.col("kept") + F.col("missed"), "downs"),
        line("Churned", "up_over", F.col("up_over") + F.col("down_over"), "ups"),
    )
    return known.select(F.explode(rows).alias("r"), "train_auc").select("r.*", "train_auc")


def _stored_scores(rows: DataFrame, fitted: PipelineModel) -> DataFrame:
    """(churned, churn_probability) of a model, written before they are judged."""
    scored = fitted.transform(rows.withColumns({c: F.col(c).cast("double") for c in FEATURES}))
    return materialize(
        scored.select(LABEL, F.round(vector_to_array("probability")[1], 4).alias("churn_probability")), "scores"
    )


def churn_model_report(training: DataFrame, model: ChurnModel) -> DataFrame:
    """AUC and precision, recall and F1 per class at probability 0.5, from the stored scores."""
    return score_report(_stored_scores(training, model.pipeline))


def churn_store(prepared: DataFrame, model: ChurnModel, path: str) -> ChurnModel:
    """Store a model, its report on all training rows and the Shapley values of the first
    ``EXPLAINED_ROWS`` users; the model as it is read back.

    The metadata come last, so a new folder that has them is whole.
    """
    churn_model_report(prepared, model).write.mode("overwrite").parquet(f"{path}/training_report")
    some = prepared.orderBy("user_id").limit(EXPLAINED_ROWS)
    churn_contributions(some, model).write.mode("overwrite").parquet(f"{path}/contributions")
    model.save(path)
    return ChurnModel.load(path)


def churn_holdout_eval(
    training: DataFrame, rounds: int = 100, min_auc: float = MIN_AUC, min_rows: int = MIN_ROWS
) -> DataFrame:
    """AUC of the boosted trees on a fifth of the users that training never saw."""
    prepared = prepare_training(training, min_rows)
    fitted = candidates(rounds)[PREFERRED].fit(prepared.filter(F.col(FOLD) != 0))
    auc = score_report(_stored_scores(prepared.filter(F.col(FOLD) == 0), fitted)).first()["train_auc"]
    decision = "promote" if auc is not None and auc >= min_auc else "blocked"
    return training.sparkSession.createDataFrame([(auc, decision)], "churn_auc double, decision string")


def rfm_silhouette(metrics: DataFrame, bins: int = 5) -> DataFrame:
    """Silhouette of the buyers' summed quantile bins (squared Euclidean distance, linear in the rows)."""
    columns = ["recency_days", "frequency", "monetary"]
    buyers = metrics.filter(F.col("frequency") > 0)
    edges = exact_percentiles(buyers, columns, [i / bins for i in range(1, bins)])
    label = F.lit(0)
    for column in columns:
        for edge in sorted(set(edges[column])):
            label = label + (F.col(column).cast("double") >= F.lit(edge)).cast("int")
    labelled = buyers.select(label.cast("double").alias("prediction"), *[F.col(c).cast("double").alias(c) for c in columns])
    vectors = materialize(labelled, "silhouette")
    score = ClusteringEvaluator().evaluate(_assembler(columns).transform(vectors))
    return metrics.sparkSession.createDataFrame([(score,)], "silhouette double")


def register_rfm(registry: DataFrame, edges: DataFrame, version: str, trained_at) -> DataFrame:
    """The registry with the segment edges of a version as its metrics.

    ``edges`` is the short table of :func:`customers.rfm_breakpoints`: a few rows per feature.
    """
    rows = edges.orderBy("feature", "edge").collect()
    metrics = {f: [r["value"] for r in rows if r["feature"] == f] for f in dict.fromkeys(r["feature"] for r in rows)}
    return model_registry_promote(registry, "rfm_segments", version, trained_at, metrics)


def model_registry_promote(registry: DataFrame, name: str, version: str, trained_at, metrics: dict) -> DataFrame:
    """The registry with one active (model, version) upserted."""
    row = registry.sparkSession.createDataFrame(
        [(name, version, json.dumps(metrics))], "model_name string, version string, metrics string"
    ).select(
        "model_name",
        "version",
        F.lit(str(trained_at)).cast("timestamp").alias("trained_at"),
        "metrics",
        F.lit(True).alias("is_active"),
    )
    return upsert_by_key(registry, row, ["model_name", "version"])
