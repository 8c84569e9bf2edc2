"""Continuous ingestion of growing logs.

Grown files arrive as landed chunks: framed lines with their file generation and byte
positions (a file source reads new files, never the new end of an old one). Each micro-batch
is normalised with the batch operator; what the next batch must know about a file is kept as
a few lines of log text, so there is one definition of the format. Batches are written under
their number, which makes a repeated batch harmless.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyline.functions import vectors as V
from tallyline.model import VECTOR_FIELDS
from tallyline.operators import accounting as A, normalize as N
from tallyline.session import cut_lineage
from tallyline.sources.sinks import write_batch

LINE_SCHEMA = "file_generation_id string, byte_offset long, byte_end long, line string, oversized boolean"
CONTEXT_SCHEMA = "file_generation_id string, after_offset long, context_lines array<struct<byte_offset:bigint,byte_end:bigint,line:string>>, batch_id long"


def landed_lines(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(LINE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _context_lines(rows: DataFrame) -> DataFrame:
    """The context after each file's last line, written back as log lines before its end.

    A session line resets and a turn line sets every field, so replaying the two gives the
    same context; a response record is kept whole because only the very next line may use it.
    """
    last = rows.groupBy("file_generation_id").agg(
        F.expr("max(byte_end) AS after_offset"),
        F.expr(
            "max_by(struct(context_session AS session, context_provider AS provider, context_model AS model, context_cwd AS cwd,"
            " context_turn_id AS turn_id, context_parent_provider_id AS parent, context_evidence AS proof), byte_offset) AS c"
        ),
    )
    quoted = lambda column: f"coalesce(regexp_replace(regexp_replace(to_json(array({column})), '^.', ''), '.$', ''), 'null')"
    header = (
        "concat('{\"type\":\"session_meta\",\"payload\":{\"id\":', " + quoted("c.session") + ", ',\"model_provider\":', " + quoted("c.provider")
        + ", ',\"cwd\":', " + quoted("c.cwd") + ", ',\"forked_from_id\":', " + quoted("c.parent") + ", '}}')"
    )
    turn = (
        "concat('{\"type\":\"turn_context\",\"payload\":{\"model\":', " + quoted("c.model") + ", ',\"turn_id\":', " + quoted("c.turn_id") + ", '}}')"
    )

    def counts(column: str) -> str:
        names = dict(zip(VECTOR_FIELDS, ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")))
        return "to_json(named_struct(" + ", ".join(f"'{key}', {column}.{name}" for name, key in names.items()) + "))"

    proof = (
        "concat('{\"type\":\"token_usage_record\",\"payload\":{\"thread_id\":', " + quoted("c.proof.thread_id") + ", ',\"turn_id\":', " + quoted("c.proof.turn_id")
        + ", ',\"session_id\":\"-\",\"root_turn_id\":\"-\",\"response_id\":', " + quoted("c.proof.response_id")
        + ", ',\"usage\":', " + counts("c.proof.usage") + ", ',\"thread_token_usage\":', " + counts("c.proof.thread_usage")
        + ", ',\"turn_token_usage\":', " + counts("c.proof.turn_usage") + ", '}}')"
    )
    entry = "named_struct('byte_offset', {0}, 'byte_end', {1}, 'line', {2})"
    before = "coalesce(c.proof.byte_offset, after_offset)"
    lines = ", ".join(
        [
            f"CASE WHEN c.session IS NOT NULL THEN {entry.format(f'{before} - 2', f'{before} - 1', header)} END",
            f"CASE WHEN c.session IS NOT NULL THEN {entry.format(f'{before} - 1', before, turn)} END",
            f"CASE WHEN c.proof IS NOT NULL THEN {entry.format('c.proof.byte_offset', 'c.proof.byte_end', proof)} END",
        ]
    )
    return last.selectExpr("file_generation_id", "after_offset", f"filter(array({lines}), x -> x IS NOT NULL) AS context_lines")


def normalize_batch(lines: DataFrame, contexts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(observations, contexts) of one micro-batch, given the contexts of earlier ones."""
    fed = lines.withColumn("replayed", F.lit(False))
    if contexts is not None:
        touched = lines.select("file_generation_id").distinct()
        known = (
            contexts.join(touched, "file_generation_id", "left_semi")
            .groupBy("file_generation_id")
            .agg(F.expr("max_by(context_lines, batch_id) AS context_lines"))
            .select("file_generation_id", F.explode("context_lines").alias("x"))
        )
        fed = fed.unionByName(
            known.selectExpr("file_generation_id", "x.byte_offset AS byte_offset", "x.byte_end AS byte_end", "x.line AS line", "false AS oversized", "true AS replayed")
        )
    fed = cut_lineage(fed)
    rows = cut_lineage(N.normalize(fed.drop("replayed"), keep_context=True))
    replayed = fed.where("replayed").select("file_generation_id", "byte_offset")
    fresh = rows.join(replayed, ["file_generation_id", "byte_offset"], "left_anti")
    shown = [c for c in rows.columns if not c.startswith("context_")]
    return fresh.select(*shown), _context_lines(rows)


def ingest(
    lines: DataFrame, observations_path: str, contexts_path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Normalise landed lines into an observations table; ``trigger`` is passed to the writer."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        earlier = _existing(spark, contexts_path, CONTEXT_SCHEMA)
        if earlier is not None:
            earlier = earlier.where(F.col("batch_id") < batch_id)
        observations, contexts = normalize_batch(batch, earlier)
        write_batch(observations, observations_path, batch_id)
        write_batch(contexts, contexts_path, batch_id)

    return lines.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _existing(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        return None
    return spark.read.schema(schema).parquet(path)


# --- accounting ---------------------------------------------------------------------------------

USAGE_SCHEMA = (
    "session_key string, file_generation_id string, byte_offset long, byte_end long, event_time_ms long, "
    f"last {V.VECTOR_TYPE}, cumulative {V.VECTOR_TYPE}, kind string"
)
RESULT_SCHEMA = (
    "session_key string, file_generation_id string, byte_offset long, event_time_ms long, method string, stream_key string, "
    f"episode_id string, usage {V.VECTOR_TYPE}, total_tokens long"
)
RESULT_COLUMNS = [c.strip().split(" ")[0] for c in RESULT_SCHEMA.replace(V.VECTOR_TYPE, "v").split(", ")]


def _load(text: str) -> A.Streams:
    saved = json.loads(text)
    return A.Streams({k: (e, tuple(c), None if s is None else tuple(s)) for k, (e, c, s) in saved.items()})


def _judge(streams: A.Streams, row: dict, first: bool) -> dict:
    last, cumulative = A.vector_of(row["last"]), A.vector_of(row["cumulative"])
    out = {"method": "ambiguous_usage", "stream_key": None, "episode_id": None, "delta": None}
    if any(v is not None and not A._sound(v) for v in (last, cumulative)):
        return {**out, "method": "invalid_usage"}
    if last is not None and A._total(last) is None:
        return out
    if cumulative is None:
        return {**out, "method": "last_only"} if last is not None else out
    return A.step(
        streams,
        {
            "op": "total" if last is None else "pair", "hint": None, "start": False, "independent": first, "last": last,
            "cumulative": cumulative, "tail": cumulative, "seed_key": None, "seed_episode": None,
            "position": A.position_key(row["session_key"], row["file_generation_id"], row["byte_offset"], row["byte_end"]),
        },
    )


def _account_session(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Judge a session's new records in byte order against its saved streams."""
    saved, seen = state.get if state.exists else ("{}", False)
    streams = _load(saved)
    # One micro-batch of one session, so its size is bounded by the trigger.
    rows = pd.concat(list(batches)).sort_values(["file_generation_id", "byte_offset"]).to_dict("records")
    results = []
    for row in rows:
        found = _judge(streams, row, not seen)
        seen = True
        undated = row["event_time_ms"] is None or row["event_time_ms"] != row["event_time_ms"]
        usage = found["delta"] if found["method"] == "cumulative_delta" else A.vector_of(row["last"])
        confirmed = found["method"] in A.CONFIRMED
        total = A._total(usage) if confirmed else None
        method = "unattributed_usage" if undated and total else found["method"]
        counted = bool(total) and not undated
        results.append(
            (key[0], row["file_generation_id"], row["byte_offset"], None if undated else int(row["event_time_ms"]), method, found["stream_key"],
             found["episode_id"], dict(zip(VECTOR_FIELDS, usage)) if counted else None, total if counted else None)
        )
    state.update((json.dumps(streams.by_key), seen))
    frame = pd.DataFrame(results, columns=RESULT_COLUMNS)
    for column in ("event_time_ms", "total_tokens"):
        frame[column] = frame[column].astype("Int64")
    yield frame


def account_stream(observations: DataFrame) -> DataFrame:
    """Stateful accounting of an observation stream; state lives in the state store.

    There is no watermark: a late record still counts in source order, and an undated one is
    kept apart as unattributed.
    """
    usage = observations.where("kind = 'usage'").select(
        "session_key", "file_generation_id", "byte_offset", "byte_end", "event_time_ms", "last", "cumulative"
    )
    return usage.groupBy("session_key").applyInPandasWithState(
        _account_session, RESULT_SCHEMA, "streams string, seen boolean", "append", GroupStateTimeout.NoTimeout
    )


def write_stream(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append to a parquet table exactly once per batch."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


# --- hourly aggregates -----------------------------------------------------------------------------


def hourly_totals(events: DataFrame, keys: list[str], lateness: str | None = None) -> DataFrame:
    """Tumbling UTC hours. An event of any age reaches its hour (use update or complete mode).
    ``lateness`` bounds the state instead: hours close once that watermark has passed."""
    timed = events.where("event_time_ms IS NOT NULL AND total_tokens > 0").withColumn("event_time", F.timestamp_millis("event_time_ms"))
    if lateness is not None:
        timed = timed.withWatermark("event_time", lateness)
    grouped = timed.groupBy(F.window("event_time", "1 hour"), *keys)
    return grouped.agg(F.expr("sum(CAST(total_tokens AS DECIMAL(38,0))) AS total_tokens"), F.expr("count(1) AS events")).select(
        F.expr("unix_millis(window.start) AS hour_start_ms"), *keys, "total_tokens", "events"
    )


def touched_hours(new_events: DataFrame) -> DataFrame:
    """(ledger, hour) pairs whose exact rollup has to be rebuilt after a batch."""
    return new_events.selectExpr("ledger_id", "occurred_at_ms - pmod(occurred_at_ms, 3600000L) AS hour_start_ms").distinct()


def refreshed_rollup(stored: DataFrame, facts: DataFrame, touched: DataFrame) -> DataFrame:
    """Rollup with the touched (ledger, hour) cohorts rebuilt from facts, others as stored."""
    from tallyline.operators.rollup import build_rollup

    stale = facts.withColumn("hour_start_ms", F.expr("occurred_at_ms - pmod(occurred_at_ms, 3600000L)")).join(
        touched, ["ledger_id", "hour_start_ms"], "left_semi"
    )
    kept = stored.join(touched, ["ledger_id", "hour_start_ms"], "left_anti")
    return kept.unionByName(build_rollup(stale.drop("hour_start_ms")).select(*kept.columns))


# --- replaced files -----------------------------------------------------------------------------------


def sessions_of_files(observations: DataFrame, files: DataFrame) -> DataFrame:
    """Sessions that have to be judged again when files were replaced or re-read."""
    return observations.join(files.select("file_generation_id"), "file_generation_id", "left_semi").select("session_key").where(
        "session_key IS NOT NULL"
    ).distinct()


def swap_sessions(published: DataFrame, candidates: DataFrame, sessions: DataFrame, broken: DataFrame) -> DataFrame:
    """Results after a re-read: candidates replace the sessions' rows, unless validation failed.

    ``broken`` lists sessions whose re-read did not validate; they keep their old result.
    """
    ready = sessions.join(broken.select("session_key"), "session_key", "left_anti")
    kept = published.join(ready, "session_key", "left_anti")
    fresh = candidates.join(ready, "session_key", "left_semi")
    return kept.unionByName(fresh)
