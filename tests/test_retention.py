"""A key shows again after its retention, whatever the micro-batches, and its state is forgotten."""

import datetime as dt
import random

import pytest

from plumbline.session import shared_folder
from plumbline.streaming import retention
from plumbline.streaming.runner import drain

START = dt.datetime(2024, 1, 1)


def landed(spark, rows, parts, label, schema):
    """Files of a feed in order, one for each micro-batch."""
    folder, size = shared_folder(spark, label), -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.parquet(f"{folder}/part{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part*")


def expected(times, minutes):
    shown = {}
    for key, at in sorted(t for t in times if None not in t):
        if not shown.get(key) or at >= shown[key][-1] + dt.timedelta(minutes=minutes):
            shown.setdefault(key, []).append(at)
    return sorted((k, t) for k, own in shown.items() for t in own)


@pytest.mark.parametrize("parts", [1, 5])
def test_a_key_shows_again_after_its_retention(spark, parts):
    rng = random.Random(1)
    times = sorted(((rng.choice("abc"), START + dt.timedelta(minutes=rng.randrange(0, 3000))) for _ in range(200)), key=lambda t: t[1])
    times += [("hot", START + dt.timedelta(minutes=3000 + i)) for i in range(300)] + [(None, START + dt.timedelta(minutes=3300)), ("x", None)]
    feed = landed(spark, times, parts, f"again{parts}", "k string, ts timestamp_ntz")
    found = drain(retention.shown_again(feed, ["k"], "ts", 120), f"again{parts}")
    got = sorted((r["k"], r["shown_at"]) for r in found.collect())
    assert got == expected(times, 120) and len([k for k, _ in got if k == "hot"]) == 3


def test_a_second_call_goes_on_and_late_rows_are_dropped(spark):
    schema = "operation string, status string, run_source string, run_id string, ts timestamp_ntz"
    folder, checkpoint = shared_folder(spark, "calls"), shared_folder(spark, "calls-state")

    def land(name, *rows):
        spark.createDataFrame([("insert", "pending", None, r, START + dt.timedelta(minutes=m)) for r, m in rows], schema).coalesce(1).write.parquet(f"{folder}/{name}")
        feed = spark.readStream.schema(schema).parquet(f"{folder}/*")
        found = drain(retention.pending_again(feed, "ts", 60), "calls", folder=checkpoint)
        return sorted((r["run_id"], int((r["shown_at"] - START).total_seconds() // 60)) for r in found.collect())

    assert land("a", ("r", 0), ("r", 30), ("s", 10)) == [("r", 0), ("s", 10)]
    assert land("b", ("r", 59), ("s", 200)) == [("r", 0), ("s", 10), ("s", 200)]
    # "late" comes before what has been seen and is dropped; "r" shows again.
    assert land("c", ("r", 201), ("late", 5)) == [("r", 0), ("r", 201), ("s", 10), ("s", 200)]


def test_state_is_dropped_behind_the_watermark(spark):
    rows = [(f"k{i}", START + dt.timedelta(minutes=i)) for i in range(40)] + [("end", START + dt.timedelta(days=9)), ("end", START + dt.timedelta(days=10))]
    feed = landed(spark, rows, 42, "state", "k string, ts timestamp_ntz")
    folder = shared_folder(spark, "state-run")
    drain(retention.shown_again(feed, ["k"], "ts", 5), "state", folder=folder)
    state = spark.read.format("statestore").option("stateVarName", "last").load(f"{folder}/checkpoint")
    assert state.count() <= 3


@pytest.mark.parametrize("buckets", [1, 7])
def test_keys_share_a_state_row(spark, monkeypatch, buckets):
    monkeypatch.setattr(retention, "BUCKETS", buckets)
    rng = random.Random(4)
    times = sorted((rng.randrange(60), rng.choice("ab"), START + dt.timedelta(minutes=rng.randrange(0, 2000))) for _ in range(600))
    times.sort(key=lambda t: t[2])
    feed, folder = landed(spark, times, 3, f"share{buckets}", "k int, l string, ts timestamp_ntz"), shared_folder(spark, "share-run")
    found = drain(retention.shown_again(feed, ["k", "l"], "ts", 500), f"share{buckets}", folder=folder)
    assert sorted(((r["k"], r["l"]), r["shown_at"]) for r in found.collect()) == expected([((k, l), t) for k, l, t in times], 500)
    # 120 keys, most of them silent still.
    assert spark.read.format("statestore").option("stateVarName", "last").load(f"{folder}/checkpoint").count() <= buckets
