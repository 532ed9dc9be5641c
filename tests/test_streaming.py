"""Streams: late, repeated, malformed and out-of-order events."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tillview.plans import catalog
from tillview.sources.shop import Shop
from tillview.streaming import events, sinks, transactions


def send(folder, name, messages):
    folder.mkdir(exist_ok=True)
    text = "\n".join(m if isinstance(m, str) else json.dumps(m) for m in messages)
    (folder / name).write_text(text + "\n")
    time.sleep(0.01)  # the file source orders by modification time


def source(spark, folder):
    return spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder))


def event(i, at, kind="page_view", user=1, session="s"):
    return {"event_id": f"e{i}", "event_type": kind, "user_id": user, "session_id": session, "timestamp": at}


def purchase(i, at, user=1, amount=10.0, **extra):
    return {
        **event(i, at, "purchase", user), "product_id": 5, "quantity": 2, "unit_price": amount / 2,
        "total_amount": amount, **extra,
    }


def test_counts_drop_late_events_and_updates_win(spark, tmp_path):
    inbox = tmp_path / "in"
    send(inbox, "1.json", [event(1, "2024-01-01T10:00:01"), event(2, "2024-01-01T10:00:04", user=2), "{broken"])
    send(inbox, "2.json", [event(3, "2024-01-01T10:00:02", user=3), event(4, "2024-01-01T10:01:00")])
    send(inbox, "3.json", [event(7, "2024-01-01T10:01:01")])
    # a watermark holds from the second batch after it: 10:00:50 makes the first late, not the second
    send(inbox, "4.json", [event(5, "2024-01-01T10:00:03", user=4), event(6, "2024-01-01T10:00:51")])
    counts = events.event_counts(events.parse_events(source(spark, inbox)))
    path = str(tmp_path / "updates")
    sinks.start_keyed(counts, path, str(tmp_path / "cp"), available_now=True).awaitTermination()
    rows = {
        (str(r.window_start)[11:], r.event_type): (r.event_count, r.unique_users)
        for r in sinks.read_keyed(spark, path, ["window_start", "event_type"]).filter("event_type IS NOT NULL").collect()
    }
    assert rows == {
        ("10:00:00", "page_view"): (3, 3),
        ("10:00:50", "page_view"): (1, 1),
        ("10:01:00", "page_view"): (2, 1),
    }


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "updates")
    for batch_id, value in [(0, 1), (1, 2), (1, 2)]:
        spark.createDataFrame([("k", value)], "k string, v int").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    assert [tuple(r) for r in sinks.read_keyed(spark, path, ["k"]).collect()] == [("k", 2)]
    assert sinks.compact_keyed(spark, path, ["k"]) == sinks.compact_keyed(spark, path, ["k"]) == 1
    assert [tuple(r) for r in sinks.read_keyed(spark, path, ["k"]).collect()] == [("k", 2)]
    for batch_id, rows in [(2, [("k", 3)]), (3, [("l", 4)])]:
        spark.createDataFrame(rows, "k string, v int").write.parquet(f"{path}/batch_id={batch_id}")
    assert {tuple(r) for r in sinks.read_keyed(spark, path, ["k"]).collect()} == {("k", 3), ("l", 4)}
    assert sinks.compact_keyed(spark, path, ["k"]) == 3
    # what the first base was made of is gone, what only the second holds is still there
    assert sorted(p.name for p in (tmp_path / "updates").glob("batch_id=*")) == ["batch_id=2", "batch_id=3"]
    assert {tuple(r) for r in sinks.read_keyed(spark, path, ["k"]).collect()} == {("k", 3), ("l", 4)}


def test_ids_beyond_32_bits_are_kept(spark):
    wide = purchase(1, "2024-01-01T10:00:01", user=2**40)
    assert events.parse_events(spark.createDataFrame([(json.dumps(wide),)], "value string")).first().user_id == 2**40


def test_sessions_as_a_stream_leave_the_state(spark, tmp_path):
    inbox = tmp_path / "in"
    send(inbox, "1.json", [event(1, "2024-01-01T23:59:00"), event(2, "2024-01-01T23:59:30", kind="x")])
    send(inbox, "2.json", [event(3, "2024-01-02T00:01:00"), event(4, "2024-01-03T00:00:00", session="t")])
    days = events.session_rollup(events.parse_events(source(spark, inbox)), lateness="1 hour")
    path = str(tmp_path / "updates")
    keys = ["day", "session_id"]
    sinks.start_keyed(days, path, str(tmp_path / "cp"), True, keys=keys, compact_every=2).awaitTermination()
    rows = {r.session_id: r for r in events.merge_sessions(sinks.read_keyed(spark, path, keys)).collect()}
    assert (rows["s"].pages_viewed, rows["s"].duration_seconds) == (2, 120) and rows["t"].duration_seconds == 0


def test_ingest_skips_bad_records_and_repeats(spark, tmp_path):
    inbox = tmp_path / "in"
    no_amount = purchase(3, "2024-01-01T10:00:03")
    del no_amount["total_amount"]
    send(
        inbox,
        "1.json",
        [purchase(1, "2024-01-01T10:00:01", payment_method="card"), purchase(2, "2024-01-01T10:00:02"), no_amount, "nonsense",
         event(4, "2024-01-01T10:00:04")],
    )
    send(inbox, "2.json", [purchase(1, "2024-01-01T10:00:01", payment_method="card"), purchase(5, "2024-02-01T00:00:00")])
    rows = transactions.ingest_transactions(source(spark, inbox))
    path = str(tmp_path / "table")
    sinks.start_append(rows, path, str(tmp_path / "cp"), ["txn_month"], available_now=True).awaitTermination()
    got = {r.transaction_id: (r.payment_method, r.order_status, float(r.unit_price)) for r in spark.read.parquet(path).collect()}
    assert got == {"e1": ("card", "completed", 5.0), "e2": ("unknown", "completed", 5.0), "e5": ("unknown", "completed", 5.0)}
    assert spark.read.parquet(path).count() == 3


def test_user_totals_survive_disorder(spark, tmp_path):
    inbox = tmp_path / "in"
    send(inbox, "1.json", [purchase(1, "2024-01-01T10:30:00", amount=10)])
    send(inbox, "2.json", [purchase(2, "2024-01-01T10:10:00", amount=4), purchase(3, "2024-01-01T10:20:00", user=2)])
    totals = transactions.running_user_totals(transactions.ingest_transactions(source(spark, inbox)))
    path = str(tmp_path / "updates")
    sinks.start_keyed(totals, path, str(tmp_path / "cp"), available_now=True).awaitTermination()
    rows = {r.user_id: r for r in sinks.read_keyed(spark, path, ["user_id"]).collect()}
    assert (float(rows[1].lifetime_value), rows[1].total_purchases, str(rows[1].last_purchase_date)) == (14.0, 2, "2024-01-01 10:30:00")
    assert rows[2].total_purchases == 1


def test_sessions_and_funnel(spark):
    rows = [("a", 1, "page_view", 0), ("a", 1, "product_click", 30), ("a", 1, "page_view", 90), ("b", 2, "page_view", 0), (None, 3, "page_view", 0)]
    rows += [("c", 4, "product_click", 5), ("c", 4, "page_view", 9)]  # clicked before the first view
    df = spark.createDataFrame(rows, "session_id string, user_id int, event_type string, at int").withColumn(
        "timestamp", F.timestamp_seconds("at")
    )
    sessions = {r.session_id: (r.pages_viewed, r.duration_seconds) for r in events.session_rollup(df).collect()}
    assert sessions == {"a": (2, 90), "b": (1, 0), "c": (1, 4)}
    funnel = events.event_funnel(df, ["page_view", "product_click", "purchase", "refund"]).collect()
    assert [(r.reached, None if r.conversion_pct is None else float(r.conversion_pct)) for r in funnel] == [(3, 100.0), (1, 33.33), (0, 0.0), (0, None)]


def test_funnel_follows_any_ordered_run(spark):
    """Sessions in random order over several slices, equal times and a stage named twice, by brute force."""
    draw = random.Random(12)
    kinds = ["view", "click", "purchase", "other"]
    rows = [("early", 1, "click", 5), ("early", 1, "view", 10), ("early", 1, "click", 12), ("early", 1, "purchase", 13)]
    for session in range(120):
        rows += [(str(session), 1, draw.choice(kinds), draw.randrange(0, 3000, 100)) for _ in range(draw.randrange(9))]
    rows += [("late", 1, "view", None), (None, 1, "view", 3)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "session_id string, user_id int, event_type string, at int").withColumn(
        "timestamp", F.timestamp_seconds("at")
    )
    for stages in (["view", "click", "purchase"], ["click", "view", "click", "click"], ["purchase"]):
        reached = [0] * len(stages)
        for session in {r[0] for r in rows} - {None}:
            now = -1
            for i, stage in enumerate(stages):
                # a stage named twice running needs one more event only if the first use took its time
                times = [t for s, _, k, t in rows if s == session and k == stage and t is not None and t >= now]
                if not times:
                    break
                now = min(times)
                reached[i] += 1
        assert [r.reached for r in events.event_funnel(df, stages).collect()] == reached
    assert [r.reached for r in events.event_funnel(df.where("session_id = 'early'"), kinds[:3]).collect()] == [1, 1, 1]
    assert [r.reached for r in events.event_funnel(df.limit(0), kinds[:3]).collect()] == [0, 0, 0]
    with pytest.raises(ValueError, match="stages"):
        events.event_funnel(df, [])


@pytest.mark.parametrize("value", ["{", "[]", "null", ""])
def test_malformed_json_becomes_null(spark, value):
    row = events.parse_events(spark.createDataFrame([(value,)], "value string")).first()
    assert row.event_id is None and row.timestamp is None


def test_deliveries_of_uneven_density_lose_no_event(spark, tmp_path):
    """Few files in the first delivery, many in the others: a batch that ends inside one drops the rest."""
    rows = []
    for file in range(8):
        hours = [h for h in range(0, 100, 2) if h >= 25 or (file < 3 and h % 10 == 0)]
        rows += [(file * 1000 + h, file, h * 3600 + file, file * 100 + h, "view") for h in hours]
    rows += [(9000, 0, 0, 1, "view"), (9001, 0, 100 * 3600 - 1, 1, "view"), (9002, 0, None, 1, "view")]
    table = spark.createDataFrame(rows, "event_id bigint, file int, at bigint, user_id bigint, event_type string").select(
        "event_id", F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), "user_id", "event_type",
        F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"), "file",
    )
    for file in range(8):
        table.where(F.col("file") == file).drop("file").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    shop = Shop(spark, str(tmp_path))
    counts = catalog._stream_event_counts(shop)
    assert counts.agg(F.sum("event_count")).first()[0] == len(rows) - 1  # a window needs a time
    sessions = catalog._stream_sessions(shop)
    assert sessions.agg(F.sum("pages_viewed")).first()[0] == len(rows) - 1


def test_rows_without_a_time_are_delivered(spark, tmp_path):
    rows = [(1, 0, 1), (2, 50, 1), (3, None, 1)]
    spark.createDataFrame(rows, "event_id bigint, at bigint, user_id bigint").select(
        "event_id", F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), "user_id"
    ).write.parquet(str(tmp_path / "events.parquet"))
    inbox = str(tmp_path / "inbox")
    for _ in catalog._deliver(Shop(spark, str(tmp_path)), inbox):
        pass
    assert spark.read.parquet(inbox).count() == 3


def test_sessions_end_by_inactivity_and_are_told_once(spark, tmp_path):
    """Over midnight, out of order, merged by an event between two runs; late events change nothing."""
    inbox = tmp_path / "in"
    send(inbox, "1.json", [event(1, "2024-01-01T23:50:00"), event(2, "2024-01-02T00:30:00"), event(3, "2024-01-01T12:00:00", user=2)])
    send(inbox, "2.json", [event(4, "2024-01-02T00:10:00", kind="x"), event(5, "2024-01-02T00:40:00", user=None)])
    send(inbox, "3.json", [event(6, "2024-01-02T09:00:00", user=3)])
    send(inbox, "4.json", [event(8, "2024-01-02T09:10:00", user=3)])
    send(inbox, "5.json", [event(7, "2024-01-01T23:55:00")])  # a watermark holds from the second batch after it
    told = events.inactivity_sessions(events.parse_events(source(spark, inbox)), lateness="1 hour")
    path, checkpoint = str(tmp_path / "table"), str(tmp_path / "cp")
    sinks.start_append(told, path, checkpoint, available_now=True).awaitTermination()
    closed = {r.user_id: (str(r.session_start), str(r.session_end), r.events, r.pages_viewed) for r in spark.read.parquet(path).collect()}
    assert closed == {
        1: ("2024-01-01 23:50:00", "2024-01-02 00:30:00", 3, 2),
        2: ("2024-01-01 12:00:00", "2024-01-01 12:00:00", 1, 1),
    }
    # the open session goes on and is told when the watermark has passed it
    send(inbox, "6.json", [event(9, "2024-01-02T12:00:00", user=4), event(10, "2024-01-02T09:35:00", user=3)])
    sinks.start_append(told, path, checkpoint, available_now=True).awaitTermination()
    rows = [(r.user_id, r.events, r.duration_seconds) for r in spark.read.parquet(path).where("user_id > 2").collect()]
    assert rows == [(3, 3, 2100)]


def test_account_of_an_ingestion(spark, tmp_path):
    """Every message is kept, quarantined, another event, late or a repeat."""
    inbox = tmp_path / "in"
    no_amount = purchase(3, "2024-01-01T10:00:03")
    del no_amount["total_amount"]
    no_time = purchase(8, "noon")
    send(inbox, "1.json", [purchase(1, "2024-01-01T10:00:01"), no_amount, no_time, "nonsense", "{}", '{"event_id": "e9", "event', event(4, "2024-01-01T10:00:04")])
    send(inbox, "2.json", [purchase(1, "2024-01-01T10:00:01"), purchase(5, "2024-01-05T00:00:00")])
    passes, path = [], str(tmp_path / "table")

    def take():
        rows = transactions.ingest_transactions(transactions.accounted_messages(source(spark, inbox)))
        passes.append(sinks.start_append(rows, path, str(tmp_path / "cp"), available_now=True))
        passes[-1].awaitTermination()

    take()
    send(inbox, "3.json", [purchase(6, "2024-01-02T00:00:00"), purchase(7, "2024-01-05T01:00:00"), purchase(7, "2024-01-05T01:00:00")])
    take()
    told, kept = transactions.account_of(passes), spark.read.parquet(path).count()
    assert told == {"input": 12, "quarantined": 5, "other": 1, "late": 1, "repeated": 2} and kept == 3
    bad = spark.createDataFrame([(line,) for line in (inbox / "1.json").read_text().splitlines()], "value string")
    reasons = sorted(r.reason for r in transactions.quarantined_messages(bad).collect())
    assert reasons == ["not an event"] * 3 + ["without timestamp", "without total_amount"]


def test_console_and_memory_sinks(spark, tmp_path):
    """The console sink's stream into memory: the newest totals of each batch."""
    inbox = tmp_path / "in"
    send(inbox, "1.json", [purchase(1, "2024-01-01T10:00:01"), purchase(2, "2024-01-01T10:00:02")])
    totals = transactions.running_user_totals(transactions.ingest_transactions(source(spark, inbox)))
    writer = totals.writeStream.outputMode("update").format("memory").queryName("totals")
    writer.trigger(availableNow=True).start().awaitTermination()
    assert [(r.user_id, r.total_purchases) for r in spark.table("totals").collect()] == [(1, 2)]


def test_distinct_users_of_a_busy_window_are_exact(spark, tmp_path):
    inbox = tmp_path / "in"
    at = "2024-01-01T10:00:0%d"
    for part in range(2):
        users = [(part * 300 + i) for i in range(400)]
        send(inbox, f"{part}.json", [event(u, at % (u % 5), user=u, session=f"s{u % 350}") for u in users])
    counts = events.event_counts(events.parse_events(source(spark, inbox)))
    path = str(tmp_path / "updates")
    sinks.start_keyed(counts, path, str(tmp_path / "cp"), available_now=True).awaitTermination()
    row = sinks.read_keyed(spark, path, ["window_start", "event_type"]).first()
    # the second batch repeats 100 users of the first
    assert (row.event_count, row.unique_users, row.unique_sessions) == (800, 700, 350)


def test_a_delivery_has_a_file_for_each_core(spark, tmp_path):
    shop, inbox = Shop(spark, "/root/testdata/sf0.001"), tmp_path / "in"
    seen = set()
    for _ in catalog._deliver(shop, str(inbox)):
        files = {f.name for f in inbox.glob("*.parquet")}
        assert len(files - seen) == spark.sparkContext.defaultParallelism
        seen = files
    assert spark.read.parquet(str(inbox)).exceptAll(shop.table("events")).count() == 0
    assert spark.read.parquet(str(inbox)).count() == shop.table("events").count()
