"""Streams over several batches give what one batch gives, and continue from their checkpoint."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dossier.operators.retrieval import build_postings
from dossier.session import shared_folder
from dossier.sources.files import converted_bodies
from dossier.streaming import discovery, runs


def rounds(n=600, seed=4):
    rng = random.Random(seed)
    at = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at += dt.timedelta(minutes=rng.randint(1, 200))
        rows.append((i, rng.randint(1, 3), at, rng.random() < 0.93))
    return rows


ROUND = "event_id long, subscription_id long, seen_at timestamp, failed boolean"


def simulate(rows):
    state, out = {}, {}
    for event, sub, _, failed in rows:
        attempt, dead = state.get(sub, (0, 0))
        alert = False
        if not failed:
            attempt, dead, what = 0, 0, "run"
        elif attempt + 1 <= 3:
            attempt, what = attempt + 1, "retry"
        else:
            attempt, dead, what = 0, dead + 1, "dead_letter"
            alert = dead % 5 == 0
        state[sub] = (attempt, dead)
        out[event] = (what, attempt, dead, alert)
    return out


def shown(df):
    return {r.event_id: (r.event, r.attempt, r.consecutive_failures, r.alert) for r in df.collect()}


def test_retry_rule_in_one_pass(spark):
    rows = rounds()
    want = simulate(rows)
    assert any(w[3] for w in want.values())
    assert shown(discovery.retry_states(spark.createDataFrame(rows, ROUND))) == want


@pytest.mark.parametrize("run", [discovery.retry_stream, discovery.stateful_retry_stream])
def test_retry_rule_as_stream(spark, run):
    rows = rounds(200)
    folder, out, checkpoint = (shared_folder(spark, p) for p in ("rounds", "states", "stream"))
    stream = lambda: runs.file_stream(spark, folder, "*.parquet", spark.createDataFrame([], ROUND).schema, 1)
    spark.createDataFrame(rows[:120], ROUND).coalesce(1).write.parquet(folder)
    run(stream(), out, checkpoint)
    spark.createDataFrame(rows[120:], ROUND).coalesce(1).write.mode("append").parquet(folder)
    assert shown(run(stream(), out, checkpoint)) == simulate(rows)


def test_next_run(spark):
    df = spark.sql("SELECT * FROM VALUES ('run', 0), ('retry', 1), ('retry', 2), ('retry', 3), ('dead_letter', 0) AS t(event, attempt)")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    got = df.select(F.date_format(discovery.next_run(F.col("event"), F.col("attempt"), at, F.lit(2)), "HH:mm:ss").alias("t")).collect()
    assert [r.t for r in got] == ["02:00:00", "00:01:00", "00:05:00", "00:25:00", "02:00:00"]


def test_windows(spark):
    df = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-10 05:00:00'), (2, TIMESTAMP '2023-01-01'), (3, NULL) AS t(id, cursor)")
    since = discovery.window_start(F.col("cursor"), F.lit("2024-01-11").cast("timestamp"))
    got = [str(r[0]) for r in df.orderBy("id").select(F.date_format(since, "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == ["2024-01-10 04:00:00", "2024-01-04 00:00:00", "2024-01-08 00:00:00"]


def test_first_sightings_over_batches(spark):
    schema = "connector_id string, external_id string, arrival long"
    folder, out, checkpoint = (shared_folder(spark, p) for p in ("refs", "seen", "stream"))
    stream = lambda: runs.file_stream(spark, folder, "*.parquet", spark.createDataFrame([], schema).schema, 1)
    first = [("c", str(i % 7), i) for i in range(20)]
    later = [("c", str(i % 9), i) for i in range(20, 40)] + [("d", "1", 41)]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(folder)
    discovery.first_sightings(stream(), out, checkpoint)
    spark.createDataFrame(later, schema).coalesce(1).write.mode("append").parquet(folder)
    got = discovery.first_sightings(stream(), out, checkpoint)
    assert sorted((r.connector_id, r.external_id, r.arrival, r.first_batch) for r in got.collect()) == sorted(
        [("c", str(i), i, 0) for i in range(7)] + [("c", "7", 25, 1), ("c", "8", 26, 1), ("d", "1", 41, 1)]
    )
    assert sum(r.sightings for r in got.collect()) == len(first + later)


@pytest.mark.parametrize("every", [1, 2, 3])
def test_state_is_compacted_and_survives_restarts(spark, every):
    schema = "subscription_id long, published_at timestamp"
    folder, out, checkpoint = (shared_folder(spark, p) for p in ("refs", "cursors", "stream"))
    rng, rows = random.Random(every), []
    for run in range(3):
        # late rows: any run may bring any day
        new = [(rng.randrange(5 + run), dt.datetime(2024, 1, rng.randint(1, 28), run)) for _ in range(12)]
        rows += new
        spark.createDataFrame(new, schema).repartition(2).write.mode("append").parquet(folder)
        stream = runs.file_stream(spark, folder, "*.parquet", spark.createDataFrame([], schema).schema, 1)
        got = discovery.running_cursors(stream, out, checkpoint, every=every)
        want = {}
        for s, at in rows:
            want[s] = max(want.get(s, at), at)
        assert {r.subscription_id: r.cursor for r in got.collect()} == want
    # nothing new: the state is read as it stands, from one snapshot and the batches after it
    again = discovery.running_cursors(stream, out, checkpoint, every=every)
    assert {r.subscription_id: r.cursor for r in again.collect()} == want
    read = {f.split("cursors-")[1].split("/")[1] + f.split("batch=")[1].split("/")[0] for f in again.inputFiles()}
    assert sum(f.startswith("snapshots") for f in read) <= 1 and sum(f.startswith("recent") for f in read) <= every


def test_bounded_first_sightings(spark):
    schema = "connector_id string, external_id string, seen_at timestamp"
    folder, out = shared_folder(spark, "refs"), shared_folder(spark, "out")
    day = lambda d: dt.datetime(2024, 1, d)
    spark.createDataFrame([("c", "1", day(1)), ("c", "1", day(2)), ("c", "2", day(3))], schema).write.parquet(folder)
    stream = runs.file_stream(spark, folder, "*.parquet", spark.createDataFrame([], schema).schema)
    unique = discovery.bounded_first_sightings(stream, "seen_at")
    runs.run_available(unique, lambda batch, n: runs.keep_batch(batch, out, n))
    assert sorted(r.external_id for r in spark.read.parquet(out).collect()) == ["1", "2"]


def test_quota_over_batches(spark):
    schema = "seen_at timestamp, n long"
    folder, out, checkpoint = (shared_folder(spark, p) for p in ("log", "quota", "stream"))
    stream = lambda: runs.file_stream(spark, folder, "*.parquet", spark.createDataFrame([], schema).schema, 1)
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    spark.createDataFrame([(at(1, 3), 1), (at(1, 23), 2)], schema).coalesce(1).write.parquet(folder)
    discovery.daily_quota(stream(), "seen_at", "n", out, checkpoint)
    spark.createDataFrame([(at(1, 23), 4), (at(2, 1), 8)], schema).coalesce(1).write.mode("append").parquet(folder)
    got = discovery.daily_quota(stream(), "seen_at", "n", out, checkpoint)
    assert sorted((str(r.day), r.downloads) for r in got.collect()) == [("2024-01-01", 7), ("2024-01-02", 8)]
    # a day counts in full however late its rows come
    spark.createDataFrame([(at(1, 4), 16)], schema).coalesce(1).write.mode("append").parquet(folder)
    got = discovery.daily_quota(stream(), "seen_at", "n", out, checkpoint)
    assert sorted((str(r.day), r.downloads) for r in got.collect()) == [("2024-01-01", 23), ("2024-01-02", 8)]


def test_body_index_follows_the_latest_body(spark):
    schema = "report_id long, title string, body string, summary string"
    folder, out, checkpoint = (shared_folder(spark, p) for p in ("bodies", "index", "stream"))
    stream = lambda: runs.file_stream(spark, folder, "*.parquet", spark.createDataFrame([], schema).schema, 1)
    long = lambda word: (word + " ") * 60
    first = [(1, "one", long("alpha"), ""), (2, "two", "short", ""), (3, "three", long("beta") + "\n- 3 -\n", "s")]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(folder)
    discovery.index_bodies(stream(), out, checkpoint)
    second = [(1, "one", long("gamma"), ""), (3, "three", "now short", "")]
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(folder)
    discovery.index_bodies(stream(), out, checkpoint)
    latest = spark.createDataFrame([second[0], first[2]], schema)
    clean = converted_bodies(latest)
    want = build_postings(
        clean.select(F.col("report_id").alias("id"), "title"), clean.select("report_id", F.col("cleaned").alias("body")), clean.select("report_id", "summary")
    )
    rows = lambda df: sorted((r.report_id, r.token, r.field, r.tf) for r in df.collect())
    assert rows(discovery.current_postings(spark, out)) == rows(want)
    assert sorted((r.report_id, r.batch) for r in spark.read.parquet(f"{out}/rejects").collect()) == [(2, 0), (3, 1)]


def test_table_stream_reads_a_file_and_a_folder(spark):
    """A table of many files lies in a folder with the name a single file would have."""
    folder = shared_folder(spark, "tables")
    spark.range(0, 10).repartition(3).write.parquet(f"{folder}/many.parquet")
    spark.range(0, 4).coalesce(1).write.parquet(f"{folder}/part")
    (single,) = [f for f in spark.read.parquet(f"{folder}/part").inputFiles()]
    for table, want in [(f"{folder}/many.parquet", 10), (single, 4)]:
        out = shared_folder(spark, "out")
        stream = runs.table_stream(spark, table, spark.range(1).schema)
        runs.run_available(stream, lambda batch, n: runs.keep_batch(batch, out, n))
        assert spark.read.parquet(out).count() == want
