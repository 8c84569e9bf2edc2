import pytest

from tallyline.operators import lineage, replay
from tallyline.plans import registry

registry.load_all()


def stored_events(spark, folder, users: int = 7, each: int = 12) -> str:
    rows = spark.range(users * each).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id AS INT), 0) AS ts", f"id % {users} AS user_id",
        "'view' AS event_type", "CAST(id % 13 + 1 AS DOUBLE) AS value", """concat('{"k": ', id % 100, '}') AS props""",
    )
    rows.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_a_replay_that_loses_a_record_is_not_published(spark, tmp_path, monkeypatch):
    whole = lineage.canonical_records
    monkeypatch.setattr(lineage, "canonical_records", lambda plan, records: whole(plan, records).where("NOT (group_session_key = 'codex:u1' AND ordinal = 3)"))
    with pytest.raises(ValueError, match="classify every usage record"):
        registry.QUERIES["pipeline_published"](spark, stored_events(spark, tmp_path / "lost"))


def test_a_replay_that_sets_a_copy_aside_nowhere_is_not_published(spark, tmp_path, monkeypatch):
    whole = lineage.classify_copies

    def fewer(plan, records):
        copies, aside = whole(plan, records)
        return copies, aside.where("NOT startswith(file_generation_id, 'x')")

    monkeypatch.setattr(lineage, "classify_copies", fewer)
    with pytest.raises(ValueError, match="classify every usage record"):
        registry.QUERIES["pipeline_published"](spark, stored_events(spark, tmp_path / "aside"))


def test_a_whole_replay_is_published(spark, tmp_path):
    rows = registry.QUERIES["pipeline_published"](spark, stored_events(spark, tmp_path / "whole")).collect()
    assert {r.session_key for r in rows} >= {f"codex:u{u}" for u in range(7)} and sum(r.events for r in rows) > 84


def test_a_replay_leaves_only_what_it_publishes(spark, tmp_path):
    from pathlib import Path
    from urllib.parse import urlparse

    from tallyline.session import scratch_dir

    folder = Path(urlparse(scratch_dir(spark)).path)
    before = set(folder.iterdir()) if folder.exists() else set()
    events = registry.QUERIES["pipeline_events"](spark, stored_events(spark, tmp_path / "left"))
    written = [set(spark.read.parquet(str(f)).columns) for f in set(folder.iterdir()) - before]
    assert written and not [c for c in written if c & {"signature", "line", "header", "request_usage", "arrival"}]
    assert events.count() > 84


def test_a_scan_deals_its_rows_once_and_keeps_null_keys_apart(spark, monkeypatch):
    from tallyline.operators.scan import chunked_scan

    rows = spark.createDataFrame([(s, n, at) for s in ("a", "", None) for n in (0, None) for at in range(4)], "s string, n long, at long")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = chunked_scan(rows, ["s", "n"], "at div 2", ["at"], sums={"upto": "1L"}, previous={"before": "at"})
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 4  # rows, chunks, chunks of a group, their carry
        for r in found.collect():
            assert (r.upto, r.before) == (r.at + 1, r.at - 1 if r.at else None), r
        assert found.columns == ["s", "n", "at", "upto", "before"] and found.exceptAll(rows.selectExpr("s", "n", "at", "at + 1", "nullif(at - 1, -1)")).isEmpty()
        assert found.count() == 24
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
