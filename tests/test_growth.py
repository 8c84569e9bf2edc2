"""Plans of queries that grew too fast: how often they read, parse and shuffle."""

import glob
import os

from pyspark.sql import functions as F

from tallyline.operators import lineage, quota, rollup, sessions
from tallyline.operators.measures import exact_sum
from tallyline.plans import log_checks
from tallyline.session import empty, scratch_dir
from tallyline.sources.tables import UsageTables
from tallyline.sources.usage_store import HOURS, UsageStore

DIRECTORY = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_readings_are_parsed_once(spark):
    """The book looks at its limits several times; the verdict on a reading parses it no second time."""
    rows = [("a", 1, 1, True, '{"rateLimits":{"primary":{"usedPercent":1}}}'), ("a", 2, 2, False, '{"rateLimits":{"limitId":"b"}}')]
    readings = spark.createDataFrame(rows, "account string, seq long, at_ms long, is_read boolean, reading string")
    limits = quota.parse_readings(readings)
    assert plan_of(limits).count("LogicalRDD") == 1
    book = quota.current_book(limits)
    assert "parse_json" not in plan_of(book)
    assert {(r.limit_id, r.seq) for r in book.collect()} == {("legacy", 1), ("b", 2)}


def test_odd_readings_keep_their_verdict(spark):
    """Kinds that are recognised without spelling out their schema."""
    texts = {
        1: ('{"rateLimits":{"primary":{"usedPercent":1.5,"windowDurationMins":300},"secondary":null}}', [(1.5, 98.5, 300)]),
        2: ('{"rateLimits":{"primary":[1]}}', None), 3: ('{"rateLimits":[]}', None), 4: ('{"rateLimits":{"limitId":{}}}', None),
        5: ('{"rateLimitsByLimitId":{"a":null}}', None), 6: ('{"rateLimits":{"secondary":{"usedPercent":"1","windowDurationMins":0}}}', [(None, None, None)]),
        7: ('{"rateLimitsByLimitId":null,"rateLimits":{}}', []),
    }
    rows = [("a", n, n, True, text) for n, (text, _) in texts.items()]
    found = quota.parse_readings(spark.createDataFrame(rows, "account string, seq long, at_ms long, is_read boolean, reading string")).collect()
    shown = {r.seq: [(w.used_percent, w.remaining_percent, w.duration_mins) for w in r.windows] for r in found}
    assert shown == {n: windows for n, (_, windows) in texts.items() if windows is not None}


def test_turn_totals_read_and_shuffle_once(spark):
    """One aggregation by turn: no branch for distinct ids, and no join with the times."""
    found = sessions.turn_totals(UsageTables(spark, DIRECTORY).facts)
    plan = plan_of(found)
    assert plan.count("Aggregate") == 1 and "Join" not in plan and "Union" not in plan
    counts = found.select(F.min("session_count"), F.max("session_count"), F.min("reliable_turn_count"), F.max("reliable_turn_count")).first()
    assert tuple(counts) == (1, 1, 1, 1) and found.columns[-2:] == ["first_at_ms", "last_at_ms"]


def test_a_batch_writes_a_day_once_and_leaves_nothing_beside(spark, tmp_path):
    """Files of a batch follow its days and bytes, not days times tasks; what it wrote on the way is gone."""
    facts = UsageTables(spark, DIRECTORY).facts
    store = UsageStore(spark, str(tmp_path))
    before = set(os.listdir(scratch_dir(spark))) if os.path.isdir(scratch_dir(spark)) else set()
    store.append("load", 0, facts.where("event_number % 10 <> 3").repartition(8))
    store.append("load", 1, facts.where("event_number % 10 = 3").repartition(8))
    assert set(os.listdir(scratch_dir(spark))) == before
    for table in ("hours", "turns"):
        for folder in glob.glob(f"{tmp_path}/{table}/commit=*/day=*"):
            assert len(glob.glob(f"{folder}/*.parquet")) == 1
    whole, held = rollup.build_rollup(facts), store.hours()
    assert held.select(*whole.columns).exceptAll(whole).isEmpty() and whole.exceptAll(held.select(*whole.columns)).isEmpty()


def test_tables_without_rows_need_no_task(spark):
    """Plans drop what is known to be empty; a made-up table would start a worker per partition."""
    nothing = empty(spark, HOURS)
    assert nothing.count() == 0 and "Scan" not in plan_of(nothing) and plan_of(nothing).startswith("LocalRelation <empty>")
    assert plan_of(spark.range(3).selectExpr("CAST(id AS STRING) AS session_key").join(nothing, "session_key")).startswith("LocalRelation <empty>")


def test_sums_are_exact_below_and_above_a_long(spark):
    most = 2**63 - 1
    rows = [(1, 5), (1, None), (2, most), (2, most), (3, None), (4, most), (5, 2**62), (5, 2**62), (6, 2**42), (6, 2**21 - 1), (7, 0)]
    found = exact_sum(spark.createDataFrame(rows, "k int, n long"), ["k"], {"n": "n"})
    assert {r.k: r.n if r.n is None else int(r.n) for r in found.collect()} == {1: 5, 2: 2 * most, 3: None, 4: most, 5: 2**63, 6: 2**42 + 2**21 - 1, 7: 0}


def test_copies_are_planned_over_tables_of_known_size(spark):
    """Checkpoints hand on guessed sizes and whole rows; written steps have sizes and are read by column."""
    plan = lineage.canonical_plan(*log_checks.sequences(spark, DIRECTORY))
    assert "RDD" not in plan_of(plan)
    assert {r.role for r in plan.select("role").distinct().collect()} == {"primary", "member", "isolated"}
