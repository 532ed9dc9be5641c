"""Model training on a set whose labels follow from the features."""

import itertools
import math
import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tillview.operators import churn, ml, shapley
from tillview.plans import catalog
from tillview.sources.schemas import MODEL_REGISTRY


@pytest.fixture(scope="module")
def training(spark):
    base = spark.range(600).select(
        F.col("id").alias("user_id"),
        F.pmod(F.hash("id"), F.lit(400)).cast("bigint").alias("recency_days"),
        (F.pmod(F.hash("id", F.lit(1)), F.lit(30)) + 1).cast("bigint").alias("frequency"),
        F.pmod(F.hash("id", F.lit(2)), F.lit(5000)).cast("double").alias("monetary"),
        F.lit(50.0).alias("avg_order_value"),
        F.lit(400.0).alias("tenure_days"),
        (F.pmod(F.hash("id"), F.lit(400)) > 150).cast("bigint").alias("churned"),
    )
    return churn.churn_feature_prep(base)


@pytest.fixture(scope="module")
def model(training):
    return ml.churn_train(training, rounds=3)


def test_selection_and_persistence(spark, training, model, tmp_path):
    assert set(model.report) == {"gradient_boosting", "random_forest", "logistic_regression"}
    assert model.cv_auc > 0.95
    model.save(str(tmp_path / "m"))
    loaded = ml.ChurnModel.load(str(tmp_path / "m"))
    assert (loaded.name, loaded.cv_auc) == (model.name, model.cv_auc)
    same = ml.churn_score_batch(training, loaded).exceptAll(ml.churn_score_batch(training, model))
    assert same.count() == 0


def test_preference_for_the_boosted_trees():
    assert ml.choose({"gradient_boosting": 0.900, "random_forest": 0.9049}) == "gradient_boosting"
    assert ml.choose({"gradient_boosting": 0.900, "random_forest": 0.9061}) == "random_forest"


def test_gates(training):
    with pytest.raises(ml.GateError, match="training rows"):
        ml.churn_train(training.limit(50))
    noise = training.withColumn("churned", F.pmod(F.hash("user_id", F.lit(9)), F.lit(2)))
    with pytest.raises(ml.GateError, match="below"):
        ml.churn_train(noise, rounds=2)


def test_scores_and_fallback(training, model):
    rows = ml.churn_score_batch(training, model).collect()
    assert len(rows) == 600
    assert all(0 <= r.churn_probability <= 1 and r.churn_risk_label in ("Low", "Medium", "High") for r in rows)
    plain = {r.user_id: r.churn_probability for r in ml.churn_score_batch(training, None).collect()}
    heuristic = {r.user_id: float(r.churn_probability) for r in churn.churn_heuristic(training).collect()}
    assert plain == heuristic


def test_explanation_names_the_deciding_feature(training, model):
    rows = ml.churn_model_factors(training, model).collect()
    named = [r for r in rows if any("days since last purchase" in f or "silence" in f for f in r.top_risk_factors)]
    assert all(len(r.top_risk_factors) == 2 for r in rows) and len(named) > 500


def test_contributions_add_up_to_the_margin(training, model):
    """Of each kind of model, for every user."""
    prepared = ml.prepare_training(training)
    for name, pipeline in ml.candidates(rounds=3).items():
        fitted = ml.ChurnModel(pipeline.fit(prepared), name, 0.0, {})
        total = sum((F.col(f) for f in ml.FEATURES), F.col("bias"))
        sums = {r.user_id: r.total for r in ml.churn_contributions(prepared, fitted).select("user_id", total.alias("total")).collect()}
        column = "probability" if name == "random_forest" else "rawPrediction"
        scored = fitted.pipeline.transform(prepared).select("user_id", vector_to_array(column)[1].alias("margin")).collect()
        assert len(sums) == len(scored) == 600
        assert max(abs(sums[r.user_id] - r.margin) for r in scored) < 1e-9


def test_contributions_by_all_subsets(spark):
    """Random trees, also with a feature twice on a path, against the definition."""
    draw = random.Random(5)
    names = ["a", "b", "c", "d", "e"]
    nodes = []

    def grow(tree, cover, depth):
        node = sum(n[0] == tree for n in nodes)
        nodes.append(None)
        if depth == 0 or cover < 2:
            nodes[-1] = row = (tree, node, None, None, -1, -1, draw.uniform(-1, 1), cover, 0.5 + tree)
            return row
        place = len(nodes) - 1
        nodes[place] = (tree, node)
        left = draw.randrange(1, int(cover))
        children = [grow(tree, float(c), depth - 1) for c in (left, cover - left)]
        nodes[place] = (tree, node, draw.randrange(5), draw.uniform(0, 1), children[0][1], children[1][1], None, cover, 0.5 + tree)
        return nodes[place]

    for tree in range(3):
        grow(tree, 90.0, 4)
    by = {(n[0], n[1]): n for n in nodes}

    def worth(x, subset, tree, node=0):
        _, _, feature, cut, left, right, value, cover, weight = by[tree, node]
        if feature is None:
            return weight * value
        if feature in subset:
            return worth(x, subset, tree, left if x[feature] <= cut else right)
        return sum(by[tree, c][7] / cover * worth(x, subset, tree, c) for c in (left, right))

    users = [(i, *(draw.uniform(0, 1) for _ in names)) for i in range(6)]
    frame = spark.createDataFrame(users, "user_id int, " + ", ".join(f"{n} double" for n in names))
    got = {r.user_id: r for r in shapley.tree_contributions(frame, spark.createDataFrame(nodes, shapley.NODES), names).collect()}
    for i, *x in users:
        v = {s: sum(worth(x, s, t) for t in range(3)) for k in range(6) for s in itertools.combinations(range(5), k)}
        assert got[i].bias == pytest.approx(v[()], abs=1e-12)
        for j, name in enumerate(names):
            wanted = 0.0
            for s in v:
                if j not in s:
                    share = math.factorial(len(s)) * math.factorial(4 - len(s)) / math.factorial(5)
                    wanted += share * (v[tuple(sorted((*s, j)))] - v[s])
            assert got[i][name] == pytest.approx(wanted, abs=1e-12)


def test_contributions_are_looked_up_where_the_row_is(spark):
    """No row is repeated per tree or leaf and none is shuffled; nulls and NaN go where the ensemble sends them."""
    nodes = [
        (0, 0, 0, 0.5, 1, 2, None, 10.0, 1.0),
        (0, 1, None, None, -1, -1, 1.0, 4.0, 1.0),
        (0, 2, 0, 0.8, 3, 4, None, 6.0, 1.0),
        (0, 3, None, None, -1, -1, 5.0, 2.0, 1.0),
        (0, 4, None, None, -1, -1, 9.0, 4.0, 1.0),
    ]
    users = [(1, 0.2), (2, 0.7), (3, 0.9), (4, float("nan")), (5, None)]
    rows = spark.createDataFrame(users, "user_id int, a double")
    got = shapley.tree_contributions(rows, spark.createDataFrame(nodes, shapley.NODES), ["a"])
    assert {r.user_id: round(r.a + r.bias, 12) for r in got.collect()} == {1: 1.0, 2: 5.0, 3: 9.0, 4: 9.0, 5: 0.0}
    plan = got._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Exchange", "Generate", "Join", "Aggregate"))


def test_score_report_by_pairs(spark):
    draw = random.Random(2)
    rows = [(draw.randrange(2), draw.randrange(12) / 12) for _ in range(300)]
    got = {r["class"]: r for r in ml.score_report(spark.createDataFrame(rows, "churned int, churn_probability double")).collect()}
    up, down = ([p for y, p in rows if y == k] for k in (1, 0))
    auc = sum((a > b) + (a == b) / 2 for a in up for b in down) / len(up) / len(down)
    assert got["Churned"].train_auc == pytest.approx(auc, abs=1e-12)
    assert got["Churned"].recall == sum(p >= 0.5 for p in up) / len(up)
    assert got["Retained"].precision == sum(p < 0.5 for p in down) / sum(p < 0.5 for _, p in rows)
    one = ml.score_report(spark.createDataFrame([(1, 0.7)], "churned int, churn_probability double")).collect()
    assert {r.train_auc for r in one} == {None}
    assert ml.score_report(spark.createDataFrame([], "churned int, churn_probability double")).count() == 2


def test_reports(spark, training, model):
    report = {r["class"]: r for r in ml.churn_model_report(training, model).collect()}
    assert report["Churned"].support + report["Retained"].support == 600
    assert report["Churned"].f1 > 0.9 and report["Churned"].train_auc > 0.95
    assert ml.churn_holdout_eval(training, rounds=2).first().decision == "promote"
    score = ml.rfm_silhouette(training).first().silhouette
    assert -1 <= score <= 1


def test_training_and_scoring_read_the_same_features(spark, sales):
    rows = [(i, 1 + i % 9, 1, f"2024-{1 + i % 5:02d}-{1 + i % 27:02d}", 1, 10 + i) for i in range(120)]
    fact = sales(rows)
    past = fact.filter("transaction_date < '2024-04-27'")
    trained = churn.churn_training_set(fact, "2024-05-26").drop("churned").collect()
    assert trained and sorted(trained) == sorted(churn.churn_scoring_set(past, "2024-04-26").collect())


def test_folds_are_stratified(spark, training):
    rows = ml.prepare_training(training).groupBy("churned", ml.FOLD).count().collect()
    assert len(rows) == 2 * ml.FOLDS
    for label in (0.0, 1.0):
        sizes = [r["count"] for r in rows if r.churned == label]
        assert max(sizes) - min(sizes) <= 1


def test_training_rows_are_computed_once(spark, training, monkeypatch):
    """They are stored before any job counts them, and nothing reads their source again."""
    earlier, store, context = [], ml.materialize, spark.sparkContext

    def stored(rows, label):
        if label == "training":
            earlier.extend(context.statusTracker().getJobIdsForGroup("prepare"))
        return store(rows, label)

    monkeypatch.setattr(ml, "materialize", stored)
    context.setJobGroup("prepare", "training rows")
    try:
        prepared = ml.prepare_training(training)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert earlier == []
    assert "Range" not in prepared._jdf.queryExecution().toString() and prepared.count() == 600


def test_registry_keeps_one_row_per_version(spark):
    registry = spark.createDataFrame([], MODEL_REGISTRY)
    for auc in (0.8, 0.9):
        registry = ml.model_registry_promote(registry, "churn_model", "2024-01-01", "2024-01-01 02:00:00", {"auc": auc})
    registry = ml.model_registry_promote(registry, "churn_model", "2024-01-02", "2024-01-02 02:00:00", {"auc": 0.7})
    rows = {r.version: (r.metrics, r.is_active) for r in registry.collect()}
    assert rows == {"2024-01-01": ('{"auc": 0.9}', True), "2024-01-02": ('{"auc": 0.7}', True)}


def test_candidates_are_judged_after_an_observation(spark, training):
    seen = Observation("seen")
    training.observe(seen, F.count(F.lit(1)).alias("rows")).collect()
    assert seen.get == {"rows": 600}
    models = ml.candidates(rounds=1)
    report = ml.evaluate_candidates(ml.prepare_training(training), {n: models[n] for n in ("random_forest", "logistic_regression")})
    assert min(report.values()) > 0.9


@pytest.fixture
def stored_at(spark, sales, tmp_path, monkeypatch):
    """churn_train over orders of 240 users, of whom half stop buying: its rows by candidate, and where the model goes."""
    rows = [
        (1000 * user + i, user, 1, f"2024-{1 + i // 2:02d}-{1 + 14 * (i % 2) + user % 13:02d}", 1, 10 + (user * 37 + i) % 90)
        for user in range(240)
        for i in range(12 if user % 2 else 8)
    ]
    amount = F.col("total_amount").cast("double").alias("o_totalprice")
    named = [F.lit("1").alias("o_orderpriority"), F.lit("F").alias("o_orderstatus")]
    sales(rows).selectExpr(
        "transaction_id AS o_orderkey", "user_id AS o_custkey", "transaction_date AS o_orderdate", "total_amount"
    ).select("o_orderkey", "o_custkey", "o_orderdate", amount, *named).write.parquet(str(tmp_path / "orders.parquet"))
    place, few = tmp_path / "model", ml.candidates(rounds=2)
    monkeypatch.setattr(ml, "candidates", lambda rounds: few)
    monkeypatch.setattr(catalog, "scratch_path", lambda *_: str(place))

    def run():
        return {r.candidate: r for r in catalog.all_queries()["churn_train"](spark, str(tmp_path)).collect()}, place

    return run


def test_what_the_gates_promote_is_fitted_on_all_rows_and_stored(spark, stored_at):
    told, place = stored_at()
    assert {r.decision for r in told.values()} == {"promote"} and len(told) == 3
    stored = ml.ChurnModel.load(str(place))
    assert [n for n, r in told.items() if r.chosen] == [stored.name]
    assert stored.report == {n: r.cv_auc for n, r in told.items()} and stored.cv_auc == told[stored.name].cv_auc
    report = {r["class"]: r for r in spark.read.parquet(f"{place}/training_report").collect()}
    assert report["Churned"].support == report["Retained"].support == 120 and report["Churned"].train_auc > 0.95
    assert spark.read.parquet(f"{place}/contributions").count() == 240


def test_the_stored_model_knows_every_row(spark, stored_at, monkeypatch):
    """The linear model, whose coefficients show what it was fitted on."""
    seen, prepare = [], ml.prepare_training
    monkeypatch.setattr(ml, "evaluate_candidates", lambda *_: {"random_forest": 0.8, "logistic_regression": 0.9})
    monkeypatch.setattr(ml, "prepare_training", lambda *a: seen.append(prepare(*a)) or seen[-1])
    told, place = stored_at()
    assert told["logistic_regression"].chosen and len(seen) == 1
    stored, whole = ml.ChurnModel.load(str(place)), ml.candidates(0)["logistic_regression"].fit(seen[0])
    assert stored.name == "logistic_regression"
    assert list(stored.pipeline.stages[-1].coefficients) == pytest.approx(list(whole.stages[-1].coefficients), rel=1e-6)


def test_what_the_gates_block_is_not_stored(stored_at, monkeypatch):
    monkeypatch.setattr(ml, "evaluate_candidates", lambda *_: {"gradient_boosting": 0.7, "random_forest": 0.6})
    told, place = stored_at()
    assert {n: (r.chosen, r.decision) for n, r in told.items()} == {
        "gradient_boosting": (True, "blocked"),
        "random_forest": (False, "blocked"),
    }
    assert not place.exists()
