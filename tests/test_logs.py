import json

import pytest
from pyspark.sql import functions as F

from tallyline.operators import normalize as N
from tallyline.sources import logs as L

USAGE = {"input_tokens": 100, "cached_input_tokens": 40, "output_tokens": 20, "reasoning_output_tokens": 5, "total_tokens": 120}


def line(kind, payload=None, time=None, **more):
    record = {"type": kind, **more}
    if time is not None:
        record["timestamp"] = time
    if payload is not None:
        record["payload"] = payload
    return json.dumps(record, ensure_ascii=False)


def usage(last=None, total=None, window=None, **info):
    body = {k: v for k, v in (("last_token_usage", last), ("total_token_usage", total), ("model_context_window", window)) if v is not None}
    return {"type": "token_count", "info": {**body, **info}}


def frame(spark, texts):
    rows, at = [], 0
    for text in texts:
        size = len(text.encode()) + 1
        rows.append(("g1", at, at + size, text, False))
        at += size
    return spark.createDataFrame(rows, "file_generation_id string, byte_offset long, byte_end long, line string, oversized boolean")


def run(spark, *texts):
    return N.normalize(frame(spark, texts)).orderBy("byte_offset").collect()


def test_framing_matches_bytes(spark, tmp_path):
    tree = tmp_path / "sessions" / "a"
    tree.mkdir(parents=True)
    (tmp_path / "archived_sessions").mkdir()
    body = b""
    expected = []
    for n in range(4000):
        text = ("é" * (n % 7) + f"line {n}").encode() + (b"\r" if n % 3 == 0 else b"")
        expected.append((len(body), len(body) + len(text) + 1, text.rstrip(b"\r").decode()))
        body += text + b"\n"
    (tree / "one.jsonl").write_bytes(body + b'{"unfinished":')
    (tree / "skipped.txt").write_bytes(b"no log\n")
    (tmp_path / "archived_sessions" / "two.jsonl").write_bytes(b"only\n\xff\xfe\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = L.read_logs(spark, str(tmp_path))
        assert lines.select("path").distinct().count() == 2
        assert L.raw_lines(spark, str(tree)).select("block_start").distinct().count() > 5
        got = lines.where(F.col("path").endswith("one.jsonl")).orderBy("byte_offset").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r.byte_offset, r.byte_end, r.line) for r in got] == expected
    path = got[0].path
    committed = spark.createDataFrame([(path, expected[10][0], expected[20][0])], "path string, committed_offset long, upper_bound long")
    again = L.since(lines, committed).where(F.col("path") == path).count()
    assert again == 10


def test_record_kinds(spark):
    rows = run(
        spark,
        line("session_meta", {"id": "synthetic-session", "cwd": "E:\\synthetic\\项目"}, "1970-01-01T00:00:01Z"),
        line("turn_context", {"model": "synthetic-model", "turn_id": "turn-a"}, "1970-01-01T00:00:02Z"),
        line("event_msg", usage(USAGE, USAGE, 1000), "1970-01-01T00:00:03Z"),
        line("response_item", {"type": "message"}),
        line("event_msg", {"type": "token_count", "info": None}),
        line("turn_context", {"cwd": "E:\\synthetic\\next", "model": None}),
        line("event_msg", usage({"total_tokens": 9007199254740993})),
        line("event_msg", usage({"input_tokens": -1})),
        line("future_unverified_type", {"secret": "x"}),
    )
    assert [r.kind for r in rows] == ["session_metadata", "turn_metadata", "usage", "ignored", "ignored", "turn_metadata", "usage", "usage", "diagnostic"]
    assert rows[0].provider_session_id == "synthetic-session" and rows[0].event_time_ms == 1000
    assert rows[2].event_time_ms == 3000 and rows[2].model == "synthetic-model" and rows[2].turn_id == "turn-a"
    assert rows[2].last.asDict() == {
        "input_total": 100, "cached_input": 40, "cache_write_input": None, "output_total": 20, "reasoning_output": 5, "reported_total": 120,
    }
    assert rows[2].model_context_window == 1000 and rows[2].session_key == "codex:synthetic-session"
    assert rows[6].cwd == "E:\\synthetic\\next" and rows[6].model is None and rows[6].turn_id == "turn-a"
    assert rows[6].last.reported_total == 9007199254740993
    assert rows[7].last.input_total == -1
    assert rows[8].reason == "unsupported_record_type" and rows[8].code == "UNSUPPORTED_FORMAT"


HEAD = line("session_meta", {"id": "s"})
CASES = [
    ("{nope", "invalid_json_or_utf8"),
    ("[1]", "record_not_object"),
    ('{"type":5}', "missing_record_type"),
    (line("x", time=5), "invalid_timestamp"),
    (line("x", time="2024-01-01"), "invalid_timestamp"),
    (line("session_meta"), "missing_session_payload"),
    (line("session_meta", {"id": ""}), "missing_session_id"),
    (line("session_meta", {"id": "x" * 257}), "missing_session_id"),
    (line("session_meta", {"id": "x", "cwd": 3}), "invalid_session_metadata"),
    (line("turn_context"), "missing_turn_payload"),
    (line("turn_context", {"model": 1}), "invalid_turn_metadata"),
    (line("event_msg"), "missing_event_payload"),
    (line("event_msg", {"type": 1}), "missing_event_type"),
    (line("event_msg", {"type": "new"}), "unsupported_event_type"),
    (line("event_msg", {"type": "token_count"}), "missing_usage_info"),
    (line("event_msg", {"type": "token_count", "info": 1}), "invalid_usage_info"),
    (line("event_msg", usage({"input_tokens": 1.0})), "invalid_last_field"),
    (line("event_msg", usage({"input_tokens": "1"})), "invalid_last_field"),
    (line("event_msg", usage({"tokens": 1})), "invalid_last_field"),
    (line("event_msg", usage([1])), "invalid_last_field"),
    (line("event_msg", usage({"cache_write_tokens": 1, "cache_write_input_tokens": 2})), "invalid_last_field"),
    (line("event_msg", usage({"cache_write_tokens": 1, "cache_write_input_tokens": None})), "invalid_last_field"),
    (line("event_msg", usage(USAGE, {"input_tokens": 2**63})), "invalid_cumulative_field"),
    (line("event_msg", usage()), "usage_fields_missing"),
    (line("event_msg", usage(USAGE, window="x")), "invalid_context_window"),
]


def test_reasons(spark):
    rows = run(spark, HEAD, *[text for text, _ in CASES])
    assert [(r.kind, r.reason) for r in rows[1:]] == [("diagnostic", reason) for _, reason in CASES]


def test_reasons_before_a_header(spark):
    rows = run(spark, "  ", line("turn_context", {"model": 1}), line("event_msg", usage(USAGE)), line("event_msg", {"type": "warning"}))
    assert [r.reason for r in rows] == ["metadata_before_session_identity", "usage_without_session_identity", None]
    assert [r.code for r in rows] == ["AMBIGUOUS_USAGE", "AMBIGUOUS_USAGE", None]


@pytest.mark.parametrize("name", ["cache_write_tokens", "cache_write_input_tokens"])
def test_both_write_spellings(spark, name):
    rows = run(spark, HEAD, line("event_msg", usage({**USAGE, name: 7})), line("event_msg", usage({**USAGE, "cache_write_tokens": 7, "cache_write_input_tokens": 7})))
    assert [r.last.cache_write_input for r in rows[1:]] == [7, 7]


def test_request_evidence_needs_the_record_right_before(spark):
    proof = {
        "thread_id": "s", "turn_id": "t", "session_id": "s", "root_turn_id": "t", "response_id": "r1",
        "usage": USAGE, "thread_token_usage": USAGE, "turn_token_usage": USAGE,
    }
    record, event = line("token_usage_record", proof), line("event_msg", usage(USAGE, USAGE))
    rows = run(
        spark, HEAD, line("turn_context", {"turn_id": "t"}),
        record, "   ", event,
        record, line("response_item", {}), event,
        line("token_usage_record", {**proof, "turn_id": "other"}), event,
        line("token_usage_record", {**proof, "usage": {"total_tokens": 5}}), event,
        record, line("event_msg", usage(USAGE)),
    )
    found = [r.request_usage is not None for r in rows if r.kind == "usage"]
    assert found == [True, False, False, False, False]
    assert rows[3].request_usage.response_id == "r1"


def test_header_resets_metadata(spark):
    rows = run(
        spark, line("session_meta", {"id": "a", "model_provider": "p", "forked_from_id": "z"}), line("turn_context", {"model": "m", "turn_id": "t"}),
        line("session_meta", {"id": "b"}), line("event_msg", usage(USAGE)),
    )
    assert (rows[1].provider, rows[1].parent_provider_id, rows[1].model) == ("p", "z", "m")
    assert (rows[3].session_key, rows[3].provider, rows[3].model, rows[3].turn_id) == ("codex:b", None, None, None)


def test_rfc3339(spark):
    texts = ["2024-01-01T00:00:00Z", "2024-01-01t00:00:00.1239z", "2024-01-01T05:30:00.123456789+05:30", "2024-13-01T00:00:00Z", "2024-01-01T00:00:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.expr(N.rfc3339_ms("t")).alias("ms"))
    assert [r.ms for r in df.collect()] == [1704067200000, 1704067200123, 1704067200123, None, None]


def test_projects(spark):
    rows = spark.createDataFrame([("E:\\Work\\App",), ("e:/work/app",), ("/home/App/",), ("/home/app",), (None,)], "cwd string")
    found = N.projects_of(rows).collect()
    assert sorted(r.display_name for r in found) == ["App", "App", "app"]


def test_objects_are_told_from_all_else_without_their_schema(spark):
    shapes = {"object": '{"x":[1]}', "empty": "{}", "array": "[]", "text": '"{}"', "number": "5", "null": "null"}
    docs = spark.createDataFrame([(n, f'{{"payload":{{"info":{v}}}}}') for n, v in shapes.items()] + [("absent", '{"payload":{}}'), ("none", '{"payload":7}')], "name string, line string")
    parsed = docs.selectExpr("name", "parse_json(line) AS doc").selectExpr("name", f"{N.is_object('payload.info')} AS found")
    assert {r.name for r in parsed.collect() if r.found} == {"object", "empty"}
    assert {r.found for r in parsed.collect()} == {True, False}
    # The schema of an object spells out all that it holds: it was over half the cost of a line.
    assert "schema_of_variant" not in N.is_object("payload") and N.kind_at("payload.info") not in N.own_reason()
    texts = [line("session_meta", {"id": "a"})]
    texts += [f'{{"type":"event_msg","payload":{{"type":"token_count","info":{v}}}}}' for v in shapes.values()]
    texts += ['{"type":"event_msg","payload":{"type":"token_count"}}', '{"type":"event_msg","payload":7}', '{"type":"turn_context","payload":[]}']
    assert [(r.kind, r.reason) for r in run(spark, *texts)[1:]] == [
        ("diagnostic", "usage_fields_missing"), ("diagnostic", "usage_fields_missing"), ("diagnostic", "invalid_usage_info"), ("diagnostic", "invalid_usage_info"),
        ("diagnostic", "invalid_usage_info"), ("ignored", None), ("diagnostic", "missing_usage_info"), ("diagnostic", "missing_event_payload"), ("diagnostic", "missing_turn_payload"),
    ]
