import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyline.functions import text as X, vectors as V
from tallyline.operators import coverage, filters, pages, rollup
from tallyline.operators.filters import Selection, UsageFilter
from tallyline.sources import manifests, sinks, titles

def plain_judgement(v):
    """Total and error of a vector, from the rules as sentences."""
    i, c, w, o, r, t = v
    known = [x for x in v if x is not None]
    parts = [x for x in (c, w, None if None in (c, w) else c + w) if x is not None]
    low = (sum(x for x in (c, w) if x is not None) if i is None else i) + ((r or 0) if o is None else o)
    if any(x < 0 for x in known) or (i is not None and any(p > i for p in parts)) or (None not in (r, o) and r > o):
        return None, "INVALID_USAGE"
    if None not in (i, o) and i + o >= 2**63:
        return None, "NUMERIC_OVERFLOW"
    if t is not None and (low != t if None not in (i, o) else low > t):
        return None, "INVALID_USAGE"
    return (i + o if None not in (i, o) else t), None


def test_vectors(spark):
    rng = random.Random(17)
    top = 2**63 - 1
    pick = lambda: rng.choice([None, None, 0, 1, 3, 4, 7, 11, -2])
    vectors = [tuple(pick() for _ in range(6)) for _ in range(600)]
    for _ in range(200):  # sound ones
        i, o = rng.randrange(2**40), rng.randrange(2**40)
        vectors.append((i, rng.randrange(i + 1) // 2, rng.choice([None, i // 3]), o, rng.choice([None, o // 2]), rng.choice([None, i + o])))
    vectors += [(top, None, None, 1, None, None), (top, None, None, 0, None, top), (None, None, None, None, None, top)]
    rows = spark.createDataFrame(list(enumerate(vectors)), f"n int, v {V.VECTOR_TYPE}")
    got = {r.n: (r.t, r.e) for r in rows.selectExpr("n", f"{V.validated_total('v')} AS t", f"{V.total_error('v')} AS e").collect()}
    assert {n: (v, got[n]) for n, v in enumerate(vectors) if got[n] != plain_judgement(v)} == {}


def test_small_vectors_agree_with_the_fold(spark):
    from tallyline.operators.accounting import _sound

    small = list(itertools.product([None, 0, 2], [None, 0, 1, 3], [None, 1], [None, 0, 2], [None, 0, 3], [None, 2, 4]))
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(small)], f"n int, v {V.VECTOR_TYPE}")
    got = {r.n: r.e for r in rows.selectExpr("n", f"{V.total_error('v')} AS e").collect()}
    assert all((got[n] is None) == _sound(v) for n, v in enumerate(small))


def test_display(spark):
    values = [None, 0, 999, 1000, 1049, 1050, 999_949, 999_950, 999_999, 1_000_000, 10**9, 10**30]
    df = spark.createDataFrame([(n, None if v is None else str(v)) for n, v in enumerate(values)], "n int, s string")
    got = df.select("n", X.compact_tokens(F.col("s").cast("decimal(38,0)")).alias("c")).orderBy("n").collect()
    assert [r.c for r in got] == ["—", "0", "999", "1.0K", "1.0K", "1.1K", "999.9K", "1000.0K", "1000.0K", "1.0M", "1.0B", "1000000000000000000000.0B"]
    money = spark.createDataFrame([("5000000000000",), ("4999999999999",), ("1234567890123456789",)], "s string")
    assert [r.m for r in money.select(X.money_rounded(F.col("s").cast("decimal(38,0)")).alias("m")).collect()] == ["0.01", "0.00", "1234.57"]
    assert money.select(X.money_from_atoms(F.col("s").cast("decimal(38,0)")).alias("m")).collect()[2].m == "1234.567890123456789"
    pct = spark.createDataFrame([(1, 3), (2, 3), (0, 0), (4, 3), (None, 3), (199999, 200000)], "n long, d long")
    assert [r.p for r in pct.select(X.percentage(F.col("n"), F.col("d")).alias("p")).collect()] == [33.33, 66.67, None, None, None, 100.0]
    rate = spark.createDataFrame([("12.5",), ("0.000000001",), ("1000000",), ("1000000.1",), ("01",), ("1.",), ("1.0000000001",), ("-1",)], "s string")
    got = rate.select(X.rate_atoms(F.col("s")).cast("long").alias("a"), X.rate_per_million(X.rate_atoms(F.col("s"))).alias("t")).collect()
    assert [(r.a, r.t) for r in got] == [(12_500_000_000, "12.5"), (1, "0.000000001"), (10**15, "1000000")] + [(None, None)] * 5
    hours = spark.createDataFrame([(-1,), (0,), (3_600_000,), (-3_600_001,)], "t long").select(X.utc_hour(F.col("t")).alias("h")).collect()
    assert [r.h for r in hours] == [-3_600_000, 0, 3_600_000, -7_200_000]


def test_filter_validation():
    for bad in (
        dict(start_ms=5, end_ms=5), dict(start_ms=0, end_ms=1, timezone="No/Where"), dict(start_ms=0, end_ms=1, models=Selection.of(*map(str, range(101)))),
        dict(start_ms=0, end_ms=1, models=Selection.of("a\n")),
    ):
        with pytest.raises(ValueError):
            UsageFilter(**bad).validate()
    for size, search in ((0, ""), (201, ""), (5, "x" * 257)):
        with pytest.raises(ValueError):
            filters.validate_page(size, search)


def test_latest_by_breaks_ties_by_smallest_key(spark):
    rows = [("s", 5, "b", 1), ("s", 5, "a", 2), ("s", 5, "ab", 3), ("s", 4, "A", 4), ("t", 1, "é", 5), ("t", 1, "f", 6)]
    df = spark.createDataFrame(rows, "k string, at long, id string, v int")
    assert {r.k: r.v for r in pages.latest_by(df, ["k"], "at", "id", ["v"]).collect()} == {"s": 2, "t": 6}


def test_manifest_and_registry(spark):
    before = spark.createDataFrame([("s", "i1", "/a", 10, "x"), ("s", "i2", "/b", 10, "x"), ("s", "i3", "/c", 10, "x")], "source_id string, identity string, path string, size long, anchors string")
    after = spark.createDataFrame([("s", "i1", "/a", 12, "x"), ("s", "i2", "/b", 20, "changed"), ("s", "i9", "/c", 5, None)], "source_id string, identity string, path string, size long, known_anchors string")
    got = {r.identity: r.change for r in manifests.file_changes(before, after).collect()}
    assert got == {"i1": "appended", "i2": "replaced", "i3": "superseded", "i9": "replaced"}
    roots = spark.createDataFrame([("k", "/x", "default"), ("k", "/y", "explicit"), ("z", "/z", "environment")], "root_key string, root_path string, origin string")
    assert {(r.root_key, r.root_path) for r in manifests.discovered_roots(roots).collect()} == {("k", "/y"), ("z", "/z")}
    registry = spark.createDataFrame([("s1", "k1", "/1", False, True)], "source_id string, root_key string, root_path string, enabled boolean, removed boolean")
    again = manifests.register_source(registry, "s2", "k1", "/new").collect()
    assert [(r.source_id, r.root_path, r.enabled, r.removed) for r in again] == [("s1", "/new", True, False)]
    more = manifests.register_source(registry, "s2", "k2", "/2")
    assert manifests.set_source(more, "s2", enabled=False).where("source_id = 's2' AND NOT enabled").count() == 1


def test_sinks(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.createDataFrame([("a", 5, 1), ("b", 86_400_005, 2), ("c", None, 3)], "session_key string, occurred_at_ms long, v int")
    assert sinks.write_batch(rows, path, 7, "occurred_at_ms") and sinks.write_batch(rows, path, 7, "occurred_at_ms")
    assert not sinks.write_batch(rows.where("false"), path, 8)
    assert spark.read.parquet(path).count() == 3
    facts = f"{tmp_path}/f"
    sinks.write_facts(rows.where("occurred_at_ms IS NOT NULL"), facts, 2)
    kept = sinks.read_facts(spark, facts, 86_400_000, 86_400_006)
    assert [r.v for r in kept.collect()] == [2]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(occurred_at_ms" in plan


def test_scan_reaches_parquet(spark):
    from tallyline.operators import measures
    from tallyline.sources.tables import UsageTables

    facts = UsageTables(spark, "/root/testdata/sf0.001").usage(1_704_413_400_000, 1_705_624_500_000)
    plan = measures.exact_sum(facts, [], {"total_tokens": "total_tokens"})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<ts:timestamp_ntz,value:double>" in plan


def test_titles_and_coverage_states(spark):
    lines = spark.createDataFrame(
        [(1, '{"id":"a","thread_name":"old","updated_at":"2024-01-01T00:00:00Z"}'), (2, '{"id":"a","thread_name":"new","updated_at":"2024-01-01T00:00:00Z"}'),
         (3, '{"id":"a","thread_name":"past","updated_at":"2023-01-01T00:00:00Z"}'), (4, '{"id":"b","thread_name":" ","updated_at":"2024-01-01T00:00:00Z"}'), (5, "{oops")],
        "line_no int, line string",
    )
    assert [(r.session_key, r.title) for r in titles.latest_titles(lines).collect()] == [("a", "new")]
    trees = spark.createDataFrame([("a", "readable"), ("a", "missing"), ("b", "readable"), ("b", "unreadable"), ("c", "missing"), ("d", "unreadable")], "source_id string, outcome string")
    assert {r.source_id: r.readability for r in coverage.readability(trees).collect()} == {
        "a": "readable", "b": "partially_readable", "c": "awaiting_directory", "d": "unreadable",
    }


def test_full_hours():
    h = 3_600_000
    assert rollup.full_hours(0, h) == (0, h) and rollup.full_hours(1, 2 * h - 1) == (h, h)


def test_display_forms_agree_on_both_sides_of_the_long_range(spark):
    edges = [0, 1, 49, 50, 949, 950, 999, 1000, 1049, 1050, 999_949, 999_950, 10**6, 10**9 - 1, 10**9, X.SMALL - 1, X.SMALL, X.SMALL + 1, 10**15]
    money = [0, 4_999_999_999_999, 5_000_000_000_000, 10**15 - 1, 10**18 - 1, 10**18, 10**18 + 5 * 10**12]
    rows = spark.createDataFrame([(n,) for n in edges + money], "n long")
    wide = F.col("n").cast("decimal(38,0)")
    got = rows.select("n", X.compact_tokens(F.col("n")).alias("c"), X.money_rounded(wide).alias("m"), X.percentage(F.col("n"), F.lit(X.SMALL + 7)).alias("w"), X.percentage(F.col("n"), F.lit(X.SMALL - 7)).alias("s")).collect()
    for r in got:
        scale, mark = next(((s, m) for s, m in ((10**9, "B"), (10**6, "M"), (10**3, "K")) if r.n >= s), (1, ""))
        tenths = (r.n * 10 + scale // 2) // scale
        assert r.c == (f"{tenths // 10}.{tenths % 10}{mark}" if mark else str(r.n))
        cents = (r.n + 5 * 10**12) // 10**13
        assert r.m == f"{cents // 100}.{cents % 100:02d}"
        for shown, d in ((r.w, X.SMALL + 7), (r.s, X.SMALL - 7)):
            assert shown == ((r.n * 10_000 + d // 2) // d / 100 if r.n <= d else None)
