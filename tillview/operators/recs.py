"""Recommendations from purchases shared between users or between products.

One user or one product is a look-up: its own rows come first, the candidates follow
by semi join, and only their rows are aggregated; nothing is stored.

Counting what all products (or users) have in common starts from the groups they share. To
share ``k`` groups, two items must share one that is not among the ``k - 1`` busiest of
either. So those of an item's busiest groups that are large form no pairs; they are only
looked up for the pairs that the other groups have formed, and the counts stay exact. The
members of a group that still meets in slices do so two slices a task, never a whole group.

What meets travels as arrays: an item with its partners in a group, a target with a neighbour's
basket. They are shuffled by the item or target and added up where they arrive, by a sort in
numpy, so that a pair costs the bytes of one id. Sums too small to matter are never stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillview.functions.numeric import money_ratio, ratio
from tillview.functions.sums import sums_of_arrays
from tillview.sources.scratch import materialize

# members of a slice; two slices of a group meet in a task
GROUP_SLICE = 2_000
# what a task aggregates, also what a single item may bring to one task
PAIRS_PER_TASK = 3_000_000
# similarities are whole multiples of this, so that sums do not depend on their order
SIMILARITY_UNIT = 10**12
INT = 2**31


def _bought(transactions: DataFrame) -> DataFrame:
    return transactions.filter(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())


def purchase_counts(transactions: DataFrame) -> DataFrame:
    """One row per user and product with the number of purchases."""
    return _bought(transactions).groupBy("user_id", "product_id").agg(F.count("*").alias("purchases"))


def overlapping_pairs(
    members: DataFrame, item: str, group: str, min_common: int, wanted: DataFrame | None = None
) -> DataFrame:
    """Pairs ``item_a < item_b`` that share at least ``min_common`` groups.

    ``members`` has distinct (item, group) rows; with ``wanted`` (a column ``item``) one of a
    pair is in it. Returns item_a, item_b, common. Pairs that cannot get that far with what was
    left out are dropped before they are stored.
    """
    kind = dict(members.dtypes)[item]
    rows = _narrow(materialize(members.select(F.col(item).alias("item"), F.col(group).alias("grp")), "members"), "item")
    if wanted is not None:
        wanted = rows.select("item").distinct().join(wanted, "item", "left_semi")
    ranked = _with_degree(rows)
    left_out = _busiest_groups(ranked, min_common - 1)
    as_before = [F.least("item_a", "item_b").cast(kind).alias("item_a"), F.greatest("item_a", "item_b").cast(kind).alias("item_b")]
    if left_out.isEmpty():
        return _shared_with(ranked, wanted, min_common).select(*as_before, "common")
    kept = ranked.join(left_out, ["item", "grp"], "left_anti")
    missing = left_out.groupBy("item").agg(F.count("*").alias("missing"))
    missing_of = lambda side: missing.select(F.col("item").alias(f"item_{side}"), F.col("missing").alias(f"missing_{side}"))
    zero = F.lit(0)
    # counted once and read three times below
    candidates = materialize(
        _shared_with(kept, wanted)
        .join(missing_of("a"), "item_a", "left")
        .join(missing_of("b"), "item_b", "left")
        .withColumn("more", F.coalesce("missing_a", zero) + F.coalesce("missing_b", zero))
        .filter(F.col("common") + F.col("more") >= min_common)
        .select("item_a", "item_b", "common", "more"),
        "pairs",
    )
    looked_up = _looked_up(candidates.filter(F.col("more") > 0).select("item_a", "item_b"), rows, kept, left_out)
    return (
        candidates.select("item_a", "item_b", "common")
        .unionByName(looked_up)
        .groupBy("item_a", "item_b")
        .agg(F.sum("common").alias("common"))
        .filter(F.col("common") >= min_common)
        .select(*as_before, "common")
    )


def _narrow(rows: DataFrame, column: str) -> DataFrame:
    """The rows with ids as INT if all of them are: half the bytes of a pair."""
    if dict(rows.dtypes)[column] != "bigint":
        return rows
    low, high = rows.agg(F.min(column), F.max(column)).first()
    fits = low is not None and -INT <= low and high < INT
    return rows.withColumn(column, F.col(column).cast("int")) if fits else rows


def _with_degree(rows: DataFrame) -> DataFrame:
    return rows.join(rows.groupBy("grp").agg(F.count("*").alias("degree")), "grp")


def _looked_up(pairs: DataFrame, rows: DataFrame, kept: DataFrame, left_out: DataFrame) -> DataFrame:
    """(item_a, item_b, 1): for the pairs, each shared group that one of them left out.

    A group left out for item_a counts if item_b has it at all, one left out for item_b only
    if it was kept for item_a.
    """
    first = pairs.join(left_out.withColumnRenamed("item", "item_a"), "item_a").join(
        rows.select(F.col("item").alias("item_b"), "grp"), ["item_b", "grp"], "left_semi"
    )
    second = pairs.join(left_out.withColumnRenamed("item", "item_b"), "item_b").join(
        kept.select(F.col("item").alias("item_a"), "grp"), ["item_a", "grp"], "left_semi"
    )
    return first.select("item_a", "item_b").unionByName(second.select("item_a", "item_b")).withColumn(
        "common", F.lit(1).cast("bigint")
    )


def _busiest_groups(ranked: DataFrame, most: int) -> DataFrame:
    """The large groups among the ``most`` busiest of each item; one global order of the groups."""
    # Spark limits each item's rows before the shuffle, so no item's whole list meets in one task
    busiest = Window.partitionBy("item").orderBy(F.col("degree").desc(), F.col("grp").desc())
    large = ranked.filter(F.col("degree") > GROUP_SLICE)
    top = large.withColumn("place", F.row_number().over(busiest)).filter(F.col("place") <= most)
    return materialize(top.select("item", "grp"), "busiest")


def _tasks(frame: DataFrame, size: Column) -> int:
    """AQE sizes a stage by the bytes that go in; what matters is the pairs that come out."""
    pairs = frame.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()[0]
    return max(frame.sparkSession.sparkContext.defaultParallelism, pairs // PAIRS_PER_TASK + 1)


def _summed(frame: DataFrame, load: DataFrame, tasks: int, least: int) -> DataFrame:
    """(key, member, units, n): per key and member of its arrays the sum of units x times and the rows.

    ``frame`` has key, units, members and times, the last two of one length; without units and times,
    which are then not shuffled either, a member counts once. Only sums over ``least`` are
    returned. The arrays of a key meet in one task. ``load`` has what each key
    brings; keys that bring more than a task's share are taken apart before the shuffle and
    spread over all tasks.
    """
    types = dict(frame.dtypes)
    kind, member = types["key"], types["members"].removeprefix("array<").removesuffix(">")
    heavy = materialize(load.filter(F.col("load") > PAIRS_PER_TASK).select("key"), "heavy")
    some = not heavy.isEmpty()
    light = frame.join(heavy, "key", "left_anti") if some else frame
    sums = light.repartition(tasks, "key").mapInArrow(
        lambda batches: sums_of_arrays(batches, least), f"key {kind}, member {member}, units bigint, n bigint"
    )
    if not some:
        return sums
    apart = frame.join(heavy, "key", "left_semi")
    if "times" in types:
        apart = apart.select("key", "units", F.explode(F.arrays_zip("members", "times")).alias("m"))
        apart = apart.select("key", F.col("m.members").alias("member"), (F.col("units") * F.col("m.times")).alias("worth"))
    else:
        apart = apart.select("key", F.explode("members").alias("member"), F.lit(1).cast("bigint").alias("worth"))
    spread = apart.groupBy("key", "member").agg(F.sum("worth").alias("units"), F.count("*").alias("n"))
    return sums.unionByName(spread.filter(F.col("units") > least))


def _slices() -> Column:
    return F.ceil(F.col("degree") / GROUP_SLICE).cast("bigint")


def _shared_with(ranked: DataFrame, wanted: DataFrame | None = None, least: int = 1) -> DataFrame:
    """(item_a, item_b, common) per pair of items that share ``least`` groups, each pair once; one of them is wanted.

    Of two wanted items ``item_a`` comes first by its hash. Slices are ranges of the hash, so the
    slice of the first is not after that of the second in any group; else ``item_a`` is the wanted one.
    """
    place = F.hash("item").cast("bigint") + INT
    if wanted is None:
        asked, rows = F.lit(True), ranked
    else:
        asked = F.col("asked").isNotNull()
        rows = ranked.join(wanted.select("item", F.lit(True).alias("asked")).distinct(), "item", "left")
    tasks = _tasks(rows.filter(asked), F.col("degree"))
    in_order = lambda which: F.sort_array(F.collect_list(F.when(which, F.struct(place.alias("place"), "item"))))["item"]
    slices = (
        rows.withColumn("p", F.shiftright(place * _slices(), 32).cast("int"))
        .repartition(tasks, "grp", "p")
        .groupBy("grp", "p")
        .agg(in_order(asked).alias("asked"), in_order(~asked).alias("others"), (F.max(_slices()) - 1).cast("int").alias("last"))
    )
    # within a slice: the wanted that come after, and all others
    met = slices.select("asked", "others", F.posexplode("asked").alias("i", "item_a")).select(
        "item_a", F.concat(F.slice("asked", F.col("i") + 2, F.size("asked")), F.col("others")).alias("partners")
    )
    if not ranked.filter(F.col("degree") > GROUP_SLICE).isEmpty():
        met = met.unionByName(_across(slices.filter(F.col("last") > 0), tasks))
    met = met.filter(F.size("partners") > 0)
    load = rows.filter(asked).groupBy(F.col("item").alias("key")).agg(F.sum("degree").alias("load"))
    frame = met.select(F.col("item_a").alias("key"), F.col("partners").alias("members"))
    return _summed(frame, load, tasks, least - 1).select(
        F.col("key").alias("item_a"), F.col("member").alias("item_b"), F.col("n").alias("common")
    )


def _across(slices: DataFrame, tasks: int) -> DataFrame:
    """(item_a, partners) of two slices of a group; a cell is one pair of slices."""
    left = slices.filter(F.col("p") < F.col("last")).select(
        "grp", "p", F.explode(F.sequence(F.col("p") + 1, F.col("last"))).alias("q"), F.col("asked").alias("first"), F.col("others").alias("first_others")
    )
    right = slices.filter(F.col("p") > 0).select(
        "grp", F.col("p").alias("q"), F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("p"), "asked", "others"
    )
    cells = left.repartition(tasks, "grp", "p", "q").join(right.repartition(tasks, "grp", "p", "q"), ["grp", "p", "q"])
    sides = F.array(
        F.struct(F.col("first").alias("items"), F.concat("asked", "others").alias("partners")),
        F.struct(F.col("asked").alias("items"), F.col("first_others").alias("partners")),
    )
    return cells.select(F.explode(sides).alias("side")).select(F.explode("side.items").alias("item_a"), "side.partners")


def _common_with_targets(purchases: DataFrame, targets: DataFrame, min_common: int) -> DataFrame:
    """(target_user, user_id, common): the users that share enough products with each target."""
    wanted = targets.select(F.col("user_id").alias("item")).distinct()
    pairs = materialize(overlapping_pairs(purchases, "user_id", "product_id", min_common, wanted), "pairs")
    to = wanted.withColumnRenamed("item", "target_user")
    one, other = (
        pairs.select(F.col(f"item_{a}").alias("target_user"), F.col(f"item_{b}").alias("user_id"), "common")
        for a, b in ("ab", "ba")
    )
    return one.unionByName(other).join(to, "target_user", "left_semi")


def _jaccard(common: Column, size_a: Column, size_b: Column) -> Column:
    """Jaccard similarity to 12 decimals, in whole units of the last, so that sums do not depend on their order."""
    either = size_a + size_b - common
    exact = F.try_divide(common.cast("decimal(14,0)"), either.cast("decimal(14,0)"))
    wide = (F.round(exact, 12) * F.lit(SIMILARITY_UNIT).cast("decimal(13,0)")).cast("bigint")
    # the same in whole numbers, where they hold 15 digits as the decimals do
    digits = F.call_function("div", common * F.lit(2 * 10**15) + either, either * F.lit(2))
    quick = F.call_function("div", digits + F.lit(500), F.lit(1000))
    return F.when((common < 4000) & (either > 0), quick).otherwise(wide)


def _nearly(min_score: float) -> int:
    """Units that no score has less of if it rounds to more than ``min_score``."""
    return int(min_score * SIMILARITY_UNIT) - SIMILARITY_UNIT // 10**5


def _scores(similar: DataFrame, purchases: DataFrame, baskets: DataFrame, min_score: float) -> DataFrame:
    """(target_user, product_id, recommendation_score, recommended_by_n_similar_users) over ``min_score``."""
    part = F.pmod(F.hash("product_id"), F.ceil(F.col("products") / GROUP_SLICE).cast("int"))
    carried = (
        _narrow(_narrow(purchases, "product_id"), "purchases")
        .join(baskets, "user_id")
        .groupBy("user_id", part.alias("part"))
        .agg(F.collect_list(F.struct("product_id", "purchases")).alias("basket"))
        .select("user_id", F.col("basket.product_id").alias("members"), F.col("basket.purchases").alias("times"))
    )
    unit = F.lit(SIMILARITY_UNIT).cast("decimal(13,0)")
    sized = similar.join(baskets, "user_id")
    load = sized.groupBy(F.col("target_user").alias("key")).agg(F.sum("products").alias("load"))
    # a neighbour's repeat purchases count again
    met = similar.select("user_id", F.col("target_user").alias("key"), "units")
    frame = met.join(carried, "user_id").select("key", "units", "members", "times")
    score = F.round(F.try_divide(F.col("units").cast("decimal(20,0)"), unit), 6)
    return (
        _summed(frame, load, _tasks(sized, F.col("products")), _nearly(min_score))
        .select(
            F.col("key").alias("target_user"),
            F.col("member").cast(dict(purchases.dtypes)["product_id"]).alias("product_id"),
            score.alias("recommendation_score"),
            F.col("n").alias("recommended_by_n_similar_users"),
        )
        .filter(F.col("recommendation_score") > F.lit(min_score).cast("decimal(10,6)"))
    )


def _recommendations(
    similar: DataFrame, purchases: DataFrame, owned: DataFrame, products: DataFrame, min_score: float, limit: int
) -> DataFrame:
    """Products of similar users that the target does not own, best ``limit`` per target.

    ``similar`` has target_user, user_id and units of similarity; ``owned`` target_user and product_id.
    """
    best = Window.partitionBy("target_user").orderBy(F.col("recommendation_score").desc(), "product_id")
    # no product of a target scores more than its neighbours' similarities times their most purchases of a product
    baskets = materialize(
        purchases.groupBy("user_id").agg(F.max("purchases").alias("most"), F.count("*").alias("products")), "baskets"
    )
    bound = F.sum(F.col("units").cast("double") * F.col("most"))
    within_reach = similar.join(baskets, "user_id").groupBy("target_user").agg(bound.alias("bound")).filter(F.col("bound") > _nearly(min_score))
    near = similar.join(within_reach.select("target_user"), "target_user", "left_semi")
    return (
        _scores(near, purchases, baskets, min_score)
        .join(owned, ["target_user", "product_id"], "left_anti")
        .withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= limit)
        .join(products.select("product_id", "product_name", "category", "current_price"), "product_id")
        .select(
            "target_user",
            "product_id",
            "product_name",
            "category",
            "current_price",
            "recommendation_score",
            "recommended_by_n_similar_users",
        )
    )


def rec_user_jaccard(
    transactions: DataFrame,
    products: DataFrame,
    user_id: int,
    min_common: int = 2,
    min_score: float = 0.1,
    limit: int = 20,
) -> DataFrame:
    """Recommendations for one user, from the rows of users who share products with them."""
    bought = _bought(transactions)
    target = bought.filter(F.col("user_id") == user_id).select("product_id").distinct()
    size = target.agg(F.count("*")).scalar()
    near = (
        bought.filter(F.col("user_id") != user_id)
        .join(target, "product_id", "left_semi")
        .select("user_id", "product_id")
        .distinct()
        .groupBy("user_id")
        .agg(F.count("*").alias("common"))
        .filter(F.col("common") >= min_common)
    )
    # only the baskets of similar users and the target's own
    baskets = purchase_counts(bought.join(near, "user_id", "left_semi"))
    sizes = baskets.groupBy("user_id").agg(F.count("*").alias("products"))
    similar = near.join(sizes, "user_id").select(
        F.lit(user_id).cast("bigint").alias("target_user"),
        "user_id",
        _jaccard(F.col("common"), F.col("products"), F.lit(size)).alias("units"),
    )
    owned = target.withColumn("target_user", F.lit(user_id).cast("bigint"))
    return _recommendations(similar, baskets, owned, products, min_score, limit)


def rec_user_jaccard_batch(
    transactions: DataFrame,
    products: DataFrame,
    targets: DataFrame,
    min_common: int = 2,
    min_score: float = 0.1,
    limit: int = 20,
) -> DataFrame:
    """The same for every user in ``targets``; the work grows with the targets' baskets."""
    purchases = materialize(purchase_counts(transactions), "purchases")
    common = _common_with_targets(purchases, targets, min_common)
    sizes = materialize(purchases.groupBy("user_id").agg(F.count("*").alias("products")), "baskets")
    similar = (
        common.join(sizes, "user_id")
        .join(sizes.select(F.col("user_id").alias("target_user"), F.col("products").alias("size")), "target_user")
        .select("target_user", "user_id", _jaccard(F.col("common"), F.col("products"), F.col("size")).alias("units"))
    )
    similar = materialize(similar, "similar")
    owned = purchases.join(targets.select("user_id"), "user_id", "left_semi").select(
        F.col("user_id").alias("target_user"), "product_id"
    )
    return _recommendations(similar, purchases, owned, products, min_score, limit)


def rec_user_overlap(
    transactions: DataFrame, products: DataFrame, user_id: int, limit: int = 10
) -> DataFrame:
    """Products by the number of distinct buyers who share any product with the user."""
    bought = _bought(transactions).select("user_id", "product_id")
    owned = bought.filter(F.col("user_id") == user_id).select("product_id").distinct()
    neighbours = (
        bought.filter(F.col("user_id") != user_id)
        .join(owned, "product_id", "left_semi")
        .select("user_id")
        .distinct()
    )
    return (
        bought.join(neighbours, "user_id", "left_semi")
        .join(owned, "product_id", "left_anti")
        .distinct()
        .groupBy("product_id")
        .agg(F.count("*").alias("recommendation_score"))
        .join(products.select("product_id", "product_name", "category", "current_price"), "product_id")
        .orderBy(F.col("recommendation_score").desc(), "product_id")
        .limit(limit)
        .withColumn("reason", F.lit("customers like you also bought"))
    )


def rec_item_lift(
    transactions: DataFrame,
    products: DataFrame,
    users: DataFrame,
    min_common: int = 5,
    min_lift: float = 1.5,
    limit: int = 50,
) -> DataFrame:
    """Product pairs bought by the same users more often than chance would have it.

    A product with fewer than ``min_common`` buyers cannot be part of a pair,
    and neither can one that so many users bought that no lift exceeds the
    threshold (lift is at most users / buyers). Both go before pairs are formed.
    """
    total = users.agg(F.countDistinct("user_id")).scalar()
    purchases = materialize(purchase_counts(transactions).select("user_id", "product_id"), "purchases")
    popularity = purchases.groupBy("product_id").agg(F.count("*").alias("buyers"))
    eligible = popularity.filter(
        (F.col("buyers") >= min_common) & (F.col("buyers") * F.lit(min_lift) <= total)
    )
    pairs = overlapping_pairs(
        purchases.join(eligible.select("product_id"), "product_id", "left_semi"), "product_id", "user_id", min_common
    )
    side = lambda s: popularity.select(
        F.col("product_id").alias(f"item_{s}"), F.col("buyers").alias(f"product_{s}_buyers")
    )
    name = lambda s: products.select(
        F.col("product_id").alias(f"product_{s}"), F.col("product_name").alias(f"product_{s}_name")
    )
    top = (
        pairs.join(side("a"), "item_a")
        .join(side("b"), "item_b")
        .withColumn(
            "lift",
            money_ratio(F.col("common") * total, F.col("product_a_buyers") * F.col("product_b_buyers"), 2),
        )
        .filter(F.col("lift") > F.lit(min_lift).cast("decimal(10,4)"))
        .select(
            F.col("item_a").alias("product_a"),
            F.col("item_b").alias("product_b"),
            F.col("common").alias("co_purchase_count"),
            "product_a_buyers",
            "product_b_buyers",
            "lift",
            ratio("common", "product_a_buyers", 2, times=100).alias("confidence_pct"),
        )
    )
    # a pair whose product is not in the catalogue does not count towards the limit
    listed = top.join(products.select(F.col("product_id").alias("product_a")), "product_a", "left_semi").join(
        products.select(F.col("product_id").alias("product_b")), "product_b", "left_semi"
    )
    return (
        listed.orderBy(F.col("lift").desc(), F.col("co_purchase_count").desc(), "product_a", "product_b")
        .limit(limit)
        .join(name("a"), "product_a")
        .join(name("b"), "product_b")
    )


def rec_similar_products(
    transactions: DataFrame,
    products: DataFrame,
    users: DataFrame,
    product_id: int,
    min_common: int = 2,
    limit: int = 10,
) -> DataFrame:
    """Products most associated with one product, from the rows of its buyers."""
    total = users.agg(F.countDistinct("user_id")).scalar()
    bought = _bought(transactions).select("user_id", "product_id")
    buyers = bought.filter(F.col("product_id") == product_id).select("user_id").distinct()
    base = buyers.agg(F.count("*")).scalar()
    together = (
        bought.filter(F.col("product_id") != product_id)
        .join(buyers, "user_id", "left_semi")
        .distinct()
        .groupBy("product_id")
        .agg(F.count("*").alias("co_purchase_count"))
        .filter(F.col("co_purchase_count") >= min_common)
    )
    popularity = (
        bought.join(together, "product_id", "left_semi")
        .distinct()
        .groupBy("product_id")
        .agg(F.count("*").alias("paired_buyers"))
    )
    return (
        together.join(popularity, "product_id")
        .withColumn("base_buyers", base)
        .withColumn(
            "lift", money_ratio(F.col("co_purchase_count") * total, F.col("base_buyers") * F.col("paired_buyers"), 2)
        )
        .withColumn("confidence_pct", ratio("co_purchase_count", "base_buyers", 2, times=100))
        .join(products.select("product_id", "product_name", "category", "current_price"), "product_id")
        .orderBy(F.col("lift").desc(), F.col("co_purchase_count").desc(), "product_id")
        .limit(limit)
    )
