from pyspark.sql import functions as F

from tallyline.operators import accounting, normalize
from tallyline.streaming import ingest
from tests.test_logs import HEAD, USAGE, line, usage


def total(n, inputs=100, outputs=20):
    return {"input_tokens": inputs * n, "output_tokens": outputs * n, "total_tokens": (inputs + outputs) * n}


def script(session):
    """Lines of one file, cut into three chunks at awkward places."""
    proof = lambda n: {
        "thread_id": session, "turn_id": "t1", "session_id": session, "root_turn_id": "t1", "response_id": f"r{n}",
        "usage": total(1), "thread_token_usage": total(n), "turn_token_usage": total(n),
    }
    event = lambda n, **kw: line("event_msg", usage(total(1), total(n)), **kw)
    return [
        [line("session_meta", {"id": session, "cwd": "/w", "model_provider": "p\"q"}), line("turn_context", {"model": "m1", "turn_id": "t1"}), event(1, time="2024-01-01T00:00:00Z"), line("token_usage_record", proof(2))],
        [event(2, time="2024-01-01T00:10:00Z"), event(2, time="2024-01-01T00:10:00Z"), line("turn_context", {"model": None}), event(3)],
        [event(4, time="2024-01-01T02:00:00Z"), "{broken", event(6, time="2024-01-01T02:00:01Z")],
    ]


def chunks(spark, sessions):
    out = [[], [], []]
    for s in sessions:
        at = 0
        for n, texts in enumerate(script(s)):
            for text in texts:
                size = len(text.encode()) + 1
                out[n].append((f"g-{s}", at, at + size, text, False))
                at += size
    return [spark.createDataFrame(rows, ingest.LINE_SCHEMA) for rows in out]


def test_stream_equals_batch_across_restarts(spark, tmp_path):
    base = str(tmp_path)
    parts = chunks(spark, ["s1", "s2", "s3"])
    for part in parts:  # every round is a restart: new queries on the same checkpoints
        part.coalesce(1).write.mode("append").parquet(f"{base}/landed")
        ingest.ingest(ingest.landed_lines(spark, f"{base}/landed"), f"{base}/obs", f"{base}/ctx", f"{base}/cp1").awaitTermination()
        stream = spark.readStream.schema(spark.read.parquet(f"{base}/obs").schema).parquet(f"{base}/obs")
        ingest.write_stream(ingest.account_stream(stream), f"{base}/res", f"{base}/cp2").awaitTermination()
    lines = parts[0].unionByName(parts[1]).unionByName(parts[2])
    whole = normalize.normalize(lines)
    got = spark.read.parquet(f"{base}/obs")
    shown = [c for c in whole.columns if c not in ("last", "cumulative", "request_usage")] + ["last", "cumulative"]
    key = ["file_generation_id", "byte_offset"]
    same = lambda df: [r.asDict(True) for r in df.select(*shown, F.col("request_usage.response_id")).orderBy(*key).collect()]
    assert same(got) == same(whole)
    assert [r.response_id for r in whole.where("request_usage IS NOT NULL").select("request_usage.response_id").collect()] == ["r2"] * 3

    batch = accounting.account(
        whole.where("kind = 'usage'").withColumns(
            {"row_id": F.col("byte_offset"), "independent_new_stream": F.expr("byte_offset = min(byte_offset) OVER (PARTITION BY session_key)")}
        )
    )
    expected = {(r.session_key, r.byte_offset): (r.method, r.event_total) for r in batch.collect()}
    found = {(r.session_key, r.byte_offset): (r.method, r.total_tokens) for r in spark.read.parquet(f"{base}/res").collect()}
    assert found == expected
    assert {m for m, _ in found.values()} == {"last_new_stream", "last_with_baseline", "ambiguous_usage", "unattributed_usage"}

    # The same batch again changes nothing.
    before = got.count()
    ingest.write_batch(got.where("batch_id = 0").drop("batch_id"), f"{base}/obs", 0)
    assert spark.read.parquet(f"{base}/obs").count() == before


def test_hourly_stream(spark, tmp_path):
    rows = [("a", 1_704_067_200_000 + n * 60_000, 10) for n in range(180)]
    spark.createDataFrame(rows, "model string, event_time_ms long, total_tokens long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("model string, event_time_ms long, total_tokens long").parquet(f"{tmp_path}/in")
    ingest.write_stream(ingest.hourly_totals(stream, ["model"], "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {r.hour_start_ms: (int(r.total_tokens), r.events) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1_704_067_200_000: (600, 60), 1_704_070_800_000: (600, 60)}


def test_swap_keeps_what_did_not_validate(spark):
    schema = "session_key string, total long"
    published = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], schema)
    candidates = spark.createDataFrame([("a", 10), ("b", 20)], schema)
    sessions = spark.createDataFrame([("a",), ("b",)], "session_key string")
    broken = spark.createDataFrame([("b",)], "session_key string")
    got = {r.session_key: r.total for r in ingest.swap_sessions(published, candidates, sessions, broken).collect()}
    assert got == {"a": 10, "b": 2, "c": 3}
