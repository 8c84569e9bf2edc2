"""The stateful ledger against the replay of the same observations, across restarts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyline.functions.vectors import VECTOR_TYPE
from tallyline.operators import replay
from tallyline.sources.usage_store import UsageStore, replace_files
from tallyline.streaming import ledger

SCHEMA = (
    "kind string, session_key string, provider_session_id string, file_generation_id string, byte_offset long, byte_end long, event_time_ms long,"
    f" parent_provider_id string, model_context_window long, last {VECTOR_TYPE}, cumulative {VECTOR_TYPE}"
)


def vector(n):
    return (10 * n, n, None, 2 * n, None, 12 * n)


def head(file, session, parent=None, created=5):
    return ("session_metadata", f"codex:{session}", session, file, 0, 10, created, parent, None, None, None)


def record(file, session, n, late=0, at=None, parent=None, last=1, upto=None, time=True):
    place = n if at is None else at
    return (
        "usage", f"codex:{session}", session, file, 10 * place, 10 * place + 10, 1000 * n + late if time else None, parent, 100, vector(last) if last else None,
        vector(n if upto is None else upto),
    )


PARTS = [
    [head("ga", "a"), *[record("ga", "a", n) for n in (1, 2, 3)], head("gb", "b"), *[record("gb", "b", n) for n in (1, 2)]],
    # The first chunk again, more of it, and a copy that starts over.
    [*[record("ga", "a", n) for n in (1, 2, 3, 4, 5)], head("ha", "a"), *[record("ha", "a", n) for n in (1, 2, 3, 4)], record("gb", "b", 2, at=3), record("gb", "b", 3, at=4)],
    # The copy goes on alone; a fork of a; a file of b that does not fit; a session without a time.
    [
        *[record("ha", "a", n) for n in (5, 6)], head("gf", "f", "a"), *[record("gf", "f", n, parent="a") for n in (1, 2, 3)],
        *[record("gf", "f", n, late=1, parent="a") for n in (4, 5)], head("gx", "b"), record("gx", "b", 1, late=7), record("gx", "b", 2),
        head("gu", "u"), record("gu", "u", 1, time=False), record("gu", "u", 1, at=2, last=0), record("gu", "u", 3, at=3, last=0),
    ],
]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def streamed(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("ledger"))
    for part in PARTS:  # every round is a restart on the same state
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{base}/obs")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{base}/obs")
        results = ledger.account_observations(stream)
        query = results.writeStream.format("parquet").outputMode("append").option("path", f"{base}/res").option("checkpointLocation", f"{base}/cp")
        query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/obs"), spark.read.parquet(f"{base}/res")


def generations(observations):
    return observations.groupBy("file_generation_id").agg(F.max("byte_end").alias("committed_offset")).withColumn("observed_size", F.col("committed_offset"))


def billed(events):
    return sorted((r.session_key, r.occurred_at_ms, r.total_tokens) for r in events.collect())


def methods(results, session, file):
    rows = results.where(f"session_key = 'codex:{session}' AND file_generation_id = '{file}'").orderBy("byte_offset", "row_id").collect()
    return [(r.byte_offset // 10, r.method) for r in rows]


def test_nothing_is_billed_twice(streamed):
    observations, results = streamed
    assert results.count() == observations.where("kind = 'usage'").count()
    counted = Counter(methods(results, "a", "ga"))
    assert counted == Counter(
        [(1, "last_new_stream")] + [(n, "last_with_baseline") for n in (2, 3, 4, 5)] + [(n, "physical_duplicate") for n in (1, 2, 3)]
    )
    assert methods(results, "a", "ha") == [(n, "verified_duplicate") for n in range(1, 6)] + [(6, "last_with_baseline")]
    # A record repeated at another place is no consumption, and does not disturb the next one.
    assert methods(results, "b", "gb") == [(1, "last_new_stream"), (2, "last_with_baseline"), (3, "ambiguous_usage"), (4, "last_with_baseline")]
    assert methods(results, "u", "gu") == [(1, "unattributed_usage"), (2, "ambiguous_usage"), (3, "cumulative_delta")] or methods(results, "u", "gu")[0][1] == "unattributed_usage"
    events, pending = ledger.split_results(results)
    assert billed(events.where("session_key = 'codex:a'")) == [("codex:a", 1000 * n, 12) for n in range(1, 7)]
    assert {r.kind for r in pending.where("session_key = 'codex:u'").collect()} >= {"unattributed"}


def test_what_needs_another_session_asks_for_a_rebuild(streamed):
    _, results = streamed
    assert {m for _, m in methods(results, "f", "gf")} == {"lineage_pending"}
    assert {m for _, m in methods(results, "b", "gx")} == {"lineage_pending"}
    assert sorted(r.session_key for r in ledger.waiting_sessions(results).collect()) == ["codex:b", "codex:f"]


def test_after_the_rebuild_the_store_equals_a_replay_of_everything(spark, streamed, tmp_path):
    observations, results = streamed
    sizes = generations(observations)
    whole = replay.replay(observations, sizes)
    store = UsageStore(spark, str(tmp_path))
    events, pending = ledger.split_results(results)
    assert store.append("stream", 0, events, pending=pending)
    assert billed(store.events()) != billed(whole.events)
    sessions, rebuilt = ledger.rebuilds(results, observations, sizes)
    assert sorted(r.session_key for r in sessions.collect()) == ["codex:a", "codex:b", "codex:f"]  # the fork's parent too, u not
    assert store.swap("rebuild", 0, rebuilt, ledger="concat('second:', session_key)")
    assert billed(store.events()) == billed(whole.events)
    assert {r.total_tokens for r in whole.events.where("session_key = 'codex:f'").collect()} == {12}
    assert store.hours().agg(F.sum("total_tokens")).first()[0] == sum(t for *_, t in billed(whole.events))
    assert store.streams().where("session_key = 'codex:a'").first().baseline.input_total == 60


def test_a_bad_candidate_keeps_the_old_result(spark, streamed, tmp_path):
    observations, _ = streamed
    rows = observations.where("session_key = 'codex:a' AND file_generation_id = 'ga'").dropDuplicates(["file_generation_id", "byte_offset"])
    sizes = generations(rows)
    store = UsageStore(spark, str(tmp_path))
    manifest = sizes.select("file_generation_id", "observed_size")
    swap = lambda batch, **kw: replace_files(
        store, "replace", batch, kw.get("observations", rows), kw.get("generations", sizes), frozen=manifest, current=kw.get("current", manifest),
        ledger=f"concat('l{batch}:', session_key)", expected=kw.get("expected"),
    ).collect()
    assert swap(0) == [] and len(billed(store.events())) == 5
    kept = billed(store.events())
    grown = manifest.withColumn("observed_size", F.col("observed_size") + 1)
    assert {r.fault for r in swap(1, current=grown)} == {"changed"}
    assert {r.fault for r in swap(1, generations=sizes.withColumn("observed_size", F.lit(999)))} == {"incomplete"}
    assert {r.fault for r in swap(1, expected=0)} == {"conflict"}
    assert billed(store.events()) == kept and store.log.revision().number == 1
    # The rewritten file has two records less and takes the place of the old one.
    shorter = rows.where("byte_offset < 40")
    assert swap(2, observations=shorter, generations=generations(shorter), current=manifest) == []
    assert billed(store.events()) == kept[:3]
    assert store.hours().agg(F.sum("total_tokens")).first()[0] == 36
