"""Guarded batches, stored ledgers and maintained rollups."""

import pytest
from pyspark.sql import functions as F

from tallyline.model import HOUR_MS
from tallyline.operators import measures, rollup
from tallyline.operators.filters import UsageFilter
from tallyline.sources.commits import CommitConflict, CommitLog
from tallyline.sources.usage_store import UsageStore

ROW = "k string, v long, day string"
OFFSET = "file_generation_id string, expected_offset long, committed_offset long"


def rows(spark, *values):
    return spark.createDataFrame([(k, v, d) for k, v, d in values], ROW)


def read(log, table="t"):
    return sorted(tuple(r) for r in log.read(table, ROW).collect())


def test_batches_are_whole_and_come_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    assert read(log) == [] and log.revision().number == 0
    assert log.commit("w", 0, {"t": rows(spark, ("a", 1, "x")), "u": rows(spark, ("b", 2, "x"))})
    assert not log.commit("w", 0, {"t": rows(spark, ("a", 1, "x"))})  # the same batch again
    assert not log.commit("w", 1, {"t": rows(spark)})  # an empty one
    assert log.commit("w", 1, {"t": rows(spark, ("c", 3, "y"))})
    assert log.commit("other", 0, {"u": rows(spark, ("d", 4, "y"))})
    assert read(log) == [("a", 1, "x"), ("c", 3, "y")] and len(read(log, "u")) == 2
    assert log.revision().number == 3 and log.revision().writers == {"w": 1, "other": 0}
    assert log.compact("t", ROW) and not log.compact("t", ROW)
    assert read(log) == [("a", 1, "x"), ("c", 3, "y")]


def test_a_stale_writer_changes_nothing(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    before = log.revision()
    log.commit("first", 0, {"t": rows(spark, ("a", 1, "x"))})
    with pytest.raises(CommitConflict):  # made for the state before, and loses the race
        log.commit("second", 0, {"t": rows(spark, ("b", 2, "x"))}, at=before)
    with pytest.raises(CommitConflict):
        log.commit("second", 0, {"t": rows(spark, ("b", 2, "x"))}, expected=0)
    assert read(log) == [("a", 1, "x")]
    assert log.commit("second", 0, {"t": rows(spark, ("b", 2, "x"))}, expected=1)


def test_offsets_guard_a_batch(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    step = lambda batch, *offsets: log.commit("w", batch, {"t": rows(spark, ("a", batch, "x"))}, offsets=spark.createDataFrame(list(offsets), OFFSET))
    assert step(0, ("f", 0, 10), ("g", 0, 5))
    assert step(1, ("f", 10, 30))
    for wrong in (("f", 10, 40), ("f", 30, 20), ("g", 0, 5), ("f", 31, 50), ("f", None, 50)):
        with pytest.raises(CommitConflict):
            step(2, wrong, ("h", 0, 1))
    assert sorted(tuple(r) for r in log.offsets().collect()) == [("f", 30), ("g", 5)]
    assert len(read(log)) == 2


def test_partitions_are_put_in_place_of_stored_ones(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    kw = {"partitioned": {"t": "day"}}
    log.commit("w", 0, {"t": rows(spark, ("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z"))}, **kw)
    old = log.revision()
    log.commit("w", 1, {"t": rows(spark, ("d", 4, "x"))}, replacing={"t": ["x", "y"]}, **kw)
    assert read(log) == [("c", 3, "z"), ("d", 4, "x")]
    assert len(log.read("t", ROW, old).collect()) == 3
    plan = log.read("t", ROW).where("day = 'x'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def events(spark, *items, ledger="l"):
    """(session, hour, minute, tokens) -> events."""
    return spark.createDataFrame(
        [(f"{s}-{h}-{m}", f"{ledger}-{s}", s, (400_000 + h) * HOUR_MS + m * 60_000, "p", "m", None, f"t{m}", ["src"], t, t, None, None, None, None, None) for s, h, m, t in items],
        "event_id string, ledger_id string, session_key string, occurred_at_ms long, provider string, model string, project_id string, turn_id string, source_ids array<string>,"
        " total_tokens long, input_total long, cached_input long, cache_write_input long, output_total long, reasoning_output long, reported_total long",
    )


def total(store, spark):
    """Totals over stored hours (edges from facts) and over facts; both must agree."""
    spec = UsageFilter(400_000 * HOUR_MS - 5, 400_060 * HOUR_MS + 1_800_000)
    mixed = rollup.hybrid_totals(store.events(), store.hours().drop("day"), store.turns().drop("day"), store.sessions(), store.ready_ledgers(), spec).first().asDict()
    plain = measures.totals(store.events().where(f"occurred_at_ms >= {spec.start_ms} AND occurred_at_ms < {spec.end_ms}")).first().asDict()
    assert mixed == plain
    return int(mixed["total_tokens"]), mixed["usage_event_count"]


def test_a_late_event_reaches_its_stored_hour(spark, tmp_path):
    store = UsageStore(spark, str(tmp_path))
    assert store.append("w", 0, events(spark, ("s", 1, 0, 10), ("s", 30, 0, 20), ("r", 1, 5, 7)))
    first = store.log.revision()
    assert total(store, spark) == (37, 3)
    assert store.append("w", 1, events(spark, ("s", 1, 30, 5)))  # a day late
    assert not store.append("w", 1, events(spark, ("s", 1, 30, 5)))
    assert total(store, spark) == (42, 4)
    hours = {(r.session_key, r.hour_start_ms // HOUR_MS - 400_000): int(r.total_tokens) for r in store.hours().collect()}
    assert hours == {("s", 1): 15, ("s", 30): 20, ("r", 1): 7}
    # The other day keeps its folder; the old revision still shows what it showed.
    parts = lambda revision: {k: tuple(v) for k, v in revision.parts["hours"].items()}
    assert len(set(parts(first).items()) & set(parts(store.log.revision()).items())) == 1
    assert store.hours(first).where("session_key = 's'").agg(F.sum("total_tokens")).first()[0] == 30


def test_events_of_a_ledger_that_is_not_active_are_not_counted(spark, tmp_path):
    store = UsageStore(spark, str(tmp_path))
    store.append("w", 0, events(spark, ("s", 1, 0, 10)))
    store.append("w", 1, events(spark, ("s", 1, 1, 99), ledger="another"))
    assert total(store, spark) == (10, 1)
