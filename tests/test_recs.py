"""Pair counts against brute force, with groups that hold a third of all rows."""

import itertools
import random
import subprocess
import sys
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tillview.functions.sums import sums_of_arrays
from tillview.operators import recs


def brute_force(rows, min_common):
    groups = defaultdict(set)
    for item, group in rows:
        groups[group].add(item)
    counts = defaultdict(int)
    for items in groups.values():
        for a, b in itertools.combinations(sorted(items), 2):
            counts[(a, b)] += 1
    return {pair: n for pair, n in counts.items() if n >= min_common}


def random_rows(seed, hot_groups):
    rng = random.Random(seed)
    rows = {(rng.randint(1, 60), rng.randint(1, 40)) for _ in range(500)}
    for group in range(1000, 1000 + hot_groups):
        rows |= {(item, group) for item in range(1, 61)}
    return sorted(rows)


@pytest.mark.parametrize("min_common", [1, 2, 5])
@pytest.mark.parametrize("hot_groups", [0, 6])
def test_pairs_equal_brute_force(spark, min_common, hot_groups):
    rows = random_rows(min_common * 10 + hot_groups, hot_groups)
    members = spark.createDataFrame(rows, "item bigint, grp bigint")
    got = recs.overlapping_pairs(members.toDF("product_id", "user_id"), "product_id", "user_id", min_common)
    assert {(r.item_a, r.item_b): r.common for r in got.collect()} == brute_force(rows, min_common)


def test_a_group_of_several_slices_equals_brute_force(spark):
    hot = [(item, group) for group in (1, 2, 3) for item in range(2 * recs.GROUP_SLICE + 100) if item % 3 == 0 or group < 3]
    members = spark.createDataFrame(hot, "item bigint, grp bigint")
    got = recs.overlapping_pairs(members, "item", "grp", 3)
    n = len([1 for item, group in hot if group == 3])
    assert got.count() == n * (n - 1) // 2
    assert got.filter("common <> 3 OR item_a % 3 <> 0 OR item_b % 3 <> 0").count() == 0


def test_pairs_are_shuffled_as_ids_alone(spark, monkeypatch):
    rows = random_rows(3, 4)
    members = spark.createDataFrame(rows, "item bigint, grp bigint")
    pairs = recs.overlapping_pairs(members, "item", "grp", 2)
    assert "array_repeat" not in pairs._jdf.queryExecution().toString()
    monkeypatch.setattr(recs, "PAIRS_PER_TASK", 100)
    apart = recs.overlapping_pairs(members, "item", "grp", 2)
    for got in (pairs, apart):
        assert {(r.item_a, r.item_b): r.common for r in got.collect()} == brute_force(rows, 2)


@pytest.fixture
def shop(spark, sales):
    rng = random.Random(5)
    rows = [(i, rng.randint(1, 25), rng.randint(1, 30), "2024-01-01", 1, 10) for i in range(220)]
    # user 99 bought everything, product 30 was bought by everyone
    rows += [(1000 + p, 99, p, "2024-01-01", 1, 10) for p in range(1, 31)]
    rows += [(2000 + u, u, 30, "2024-01-01", 1, 10) for u in range(1, 26)]
    products = spark.range(1, 31).selectExpr(
        "id AS product_id", "concat('p', id) AS product_name", "'c' AS category", "CAST(1 AS DECIMAL(12,2)) AS current_price"
    )
    return sales(rows), products, spark.range(1, 101).withColumnRenamed("id", "user_id")


def test_single_and_batch_recommendations_agree(spark, shop):
    fact, products, users = shop
    batch = recs.rec_user_jaccard_batch(fact, products, users).collect()
    by_user = defaultdict(set)
    for r in batch:
        by_user[r.target_user].add(tuple(r))
    for user in (1, 7, 99):
        single = {tuple(r) for r in recs.rec_user_jaccard(fact, products, user).collect()}
        assert single == by_user[user]
    only = recs.rec_user_jaccard_batch(fact, products, spark.createDataFrame([(7,)], "user_id bigint"))
    assert {tuple(r) for r in only.collect()} == by_user[7]


def test_repeat_purchases_of_a_neighbour_count_again(spark, sales):
    rows = [(1, 1, 1, "2024-01-01", 1, 1), (2, 1, 2, "2024-01-01", 1, 1)]
    rows += [(3, 2, 1, "2024-01-01", 1, 1), (4, 2, 2, "2024-01-01", 1, 1)]
    rows += [(5, 2, 3, "2024-01-01", 1, 1), (6, 2, 3, "2024-01-02", 1, 1)]
    products = spark.range(1, 4).selectExpr("id AS product_id", "'p' AS product_name", "'c' AS category", "1 AS current_price")
    (row,) = recs.rec_user_jaccard(sales(rows), products, 1).collect()
    assert row.product_id == 3
    assert float(row.recommendation_score) == pytest.approx(2 * 2 / 3, abs=1e-6)
    assert row.recommended_by_n_similar_users == 1


def test_item_lift_matches_definition(shop):
    fact, products, users = shop
    owned = {(r.user_id, r.product_id) for r in fact.collect()}
    buyers = defaultdict(set)
    for user, product in owned:
        buyers[product].add(user)
    want = {}
    for a, b in itertools.combinations(sorted(buyers), 2):
        common = len(buyers[a] & buyers[b])
        lift = common * 100 / (len(buyers[a]) * len(buyers[b]))
        if common >= 5 and round(lift, 2) > 1.5:
            want[(a, b)] = (common, pytest.approx(lift, abs=0.0051))
    got = recs.rec_item_lift(fact, products, users, limit=1000).collect()
    assert {(r.product_a, r.product_b): (r.co_purchase_count, float(r.lift)) for r in got} == want
    assert want


def test_user_without_purchases_gets_nothing(shop):
    fact, products, _ = shop
    assert recs.rec_user_jaccard(fact, products, 12345).count() == 0
    assert recs.rec_user_overlap(fact, products, 12345).count() == 0


@pytest.mark.parametrize("targets", [range(1, 61), (3, 17, 60)])
def test_hot_products_form_few_pairs(spark, monkeypatch, targets):
    """One product that all users bought and one that a third did: exact counts, few pair rows."""
    monkeypatch.setattr(recs, "GROUP_SLICE", 15)
    rng = random.Random(4)
    rows = {(u, rng.randint(1, 150)) for u in range(1, 61) for _ in range(4)}
    rows |= {(u, 1000) for u in range(1, 61)} | {(u, 1001) for u in range(1, 61, 3)}
    purchases = spark.createDataFrame(sorted(rows), "user_id bigint, product_id bigint")
    wanted = spark.createDataFrame([(u,) for u in targets], "user_id bigint")
    for min_common in (2, 3):
        got = {(r.target_user, r.user_id): r.common for r in recs._common_with_targets(purchases, wanted, min_common).collect()}
        every = brute_force(rows, min_common)
        both = {(a, b): n for (x, y), n in every.items() for a, b in ((x, y), (y, x)) if a in set(targets)}
        assert got == both and both
    ranked = recs._with_degree(purchases.toDF("item", "grp"))
    kept = ranked.join(recs._busiest_groups(ranked, 1), ["item", "grp"], "left_anti")
    formed = recs._shared_with(kept, wanted.toDF("item")).agg({"common": "sum"}).first()[0]
    groups = defaultdict(int)
    for _, product in rows:
        groups[product] += 1
    assert formed < sum(n * n for n in groups.values()) * len(targets) / 60 / 4


@pytest.mark.parametrize("per_task", [5, 100_000])
def test_sums_of_arrays_return_only_what_counts(spark, monkeypatch, per_task):
    """Also for keys that are taken apart, and for ids beyond INT."""
    monkeypatch.setattr(recs, "PAIRS_PER_TASK", per_task)
    rows = random_rows(7, 2) + [(2**40 + i, group) for i in range(3) for group in (1, 2, 1000)]
    members = spark.createDataFrame(rows, "item bigint, grp bigint")
    ranked = recs._with_degree(members)
    got = recs._shared_with(ranked, least=3).collect()
    every = brute_force(rows, 3)
    assert {(min(r.item_a, r.item_b), max(r.item_a, r.item_b)): r.common for r in got} == every
    assert len(got) == len(every) < len(brute_force(rows, 1))


def test_similarity_in_whole_numbers_equals_the_decimals(spark):
    rows = [(c, a, a + c % 7) for a in range(1, 60) for c in range(1, a + 1)] + [(5000, 7001, 9001), (3999, 4001, 10_000_019)]
    frame = spark.createDataFrame(rows, "common bigint, a bigint, b bigint")
    got = frame.select("*", recs._jaccard(*map(F.col, frame.columns)).alias("units")).collect()
    places = Decimal(1).scaleb(-15), Decimal(1).scaleb(-12)
    for r in got:
        exact = Decimal(r.common) / Decimal(r.a + r.b - r.common)
        for place in places:
            exact = exact.quantize(place, ROUND_HALF_UP)
        assert r.units == exact.scaleb(12)


def test_the_kernel_needs_no_package_on_the_executors():
    code = "import sys, pickle; f = pickle.load(sys.stdin.buffer); assert list(f([], 0)) == []"
    subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(sums_of_arrays), check=True, cwd="/")
