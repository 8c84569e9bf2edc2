"""The metering model over a directory of parquet tables (events, orders, lineitem, ...).

``UsageTables`` derives every table of the model from the stored ones, so all of them
grow with the data. Nothing here is collected; each property is a lazy DataFrame.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyline.functions import text as X
from tallyline.model import ACCOUNTING_V2, DAY_MS, HOUR_MS
from tallyline.session import cut_sizes

PARSER = "rollout-v1"


def epoch_ms(ts: str) -> str:
    """Milliseconds of a zoneless UTC timestamp, cut (not rounded), whatever the session zone."""
    days = f"CAST(datediff(CAST({ts} AS DATE), DATE'1970-01-01') AS BIGINT)"
    seconds = f"CAST(extract(SECOND FROM {ts}) * 1000 AS BIGINT)"
    return f"{days} * {DAY_MS}L + hour({ts}) * {HOUR_MS}L + minute({ts}) * 60000L + {seconds}"


def zoneless(ms: int) -> Column:
    """Literal zoneless timestamp for a UTC instant; comparisons with it reach the parquet scan."""
    from datetime import datetime, timedelta

    at = datetime(1970, 1, 1) + timedelta(milliseconds=ms)
    return F.expr(f"timestamp_ntz'{at.isoformat(sep=' ')}'")


class UsageTables:
    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def events_between(self, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
        """Stored events, with the half-open range pushed into the scan when given."""
        events = self.raw("events")
        if start_ms is not None:
            events = events.where(F.col("ts") >= zoneless(start_ms))
        if end_ms is not None:
            events = events.where(F.col("ts") < zoneless(end_ms))
        return events

    def usage(self, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
        """Confirmed usage events, one per stored event."""
        base = self.events_between(start_ms, end_ms).selectExpr(
            "event_id AS event_number",
            "lpad(CAST(event_id AS STRING), 12, '0') AS event_id",
            f"{epoch_ms('ts')} AS occurred_at_ms",
            "user_id",
            "event_type",
            "CAST(get_json_object(props, '$.k') AS INT) AS k",
            "CAST(round(value * 100) AS BIGINT) AS total_tokens",
        )
        split = base.selectExpr(
            "*",
            "CASE WHEN k % 10 <> 0 THEN total_tokens div 4 END AS output_total",
            "CASE WHEN k % 10 <> 0 THEN total_tokens - total_tokens div 4 END AS input_total",
        )
        named = split.selectExpr(
            "*",
            "concat('l', user_id) AS ledger_id",
            "concat('s', user_id) AS session_key",
            "CASE WHEN event_type <> 'error' THEN event_type END AS model",
            "CASE user_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' END AS provider",
            "CASE WHEN k % 7 <> 0 THEN concat('p', k % 7) END AS project_id",
            "CASE WHEN k % 11 <> 0 THEN concat('t', event_number div 5) END AS turn_id",
            "CASE WHEN k % 4 = 0 THEN array('src0', 'src1') ELSE array('src0') END AS source_ids",
            "CASE WHEN k % 10 > 1 THEN input_total div 2 END AS cached_input",
            "CASE WHEN k % 5 <> 0 THEN input_total div 8 END AS cache_write_input",
            "CASE WHEN k % 4 <> 0 THEN output_total div 3 END AS reasoning_output",
            "total_tokens AS reported_total",
            "'last_with_baseline' AS calculation_method",
            f"'{ACCOUNTING_V2}' AS accounting_version",
            f"'{PARSER}' AS parser_version",
        )
        return named.withColumn("model_key", X.model_key(F.col("provider"), F.col("model")))

    @cached_property
    def facts(self) -> DataFrame:
        return self.usage()

    @cached_property
    def sessions(self) -> DataFrame:
        """One row per session; parents are sessions of the same ten, some not published."""
        user = F.col("user_id")
        return (
            self.raw("events")
            .select("user_id")
            .distinct()
            .select(
                F.concat(F.lit("s"), user).alias("session_key"),
                F.when(user % 13 != 0, F.concat(F.lit("conv-"), user)).alias("provider_session_id"),
                F.when(user % 10 != 0, F.concat(F.lit("m"), F.expr("user_id div 10 * 10"))).alias("parent_key"),
                F.when(user % 10 != 0, F.concat(F.lit("conv-"), F.expr("user_id div 10 * 10"))).alias(
                    "parent_provider_id"
                ),
                F.when(user % 17 != 0, F.concat(F.lit("l"), user)).alias("active_ledger_id"),
            )
        )

    @cached_property
    def aliases(self) -> DataFrame:
        """Mirror key m<n> of the canonical session s<n>, for every tenth session."""
        user = F.expr("cast(substring(session_key, 2) as bigint)")
        return self.sessions.where(user % 10 == 0).select(
            F.concat(F.lit("m"), user).alias("alias_session_key"),
            F.col("session_key").alias("canonical_session_key"),
        )

    @cached_property
    def projects(self) -> DataFrame:
        number = F.expr("cast(substring(project_id, 2) as int)")
        return (
            self.facts.where(F.col("project_id").isNotNull())
            .select("project_id")
            .distinct()
            .select(
                "project_id",
                F.concat(F.lit("Project "), number).alias("display_name"),
                F.when(number % 3 == 0, F.concat(F.lit("Team "), number)).alias("user_alias"),
            )
        )

    @cached_property
    def ledgers(self) -> DataFrame:
        user = F.expr("cast(substring(session_key, 2) as bigint)")
        return self.sessions.select(
            F.concat(F.lit("l"), user).alias("ledger_id"),
            "session_key",
            F.when(user % 2 == 0, F.lit("rollout-v1")).otherwise(F.lit("rollout-v0")).alias("parser_version"),
            F.when(user % 3 == 0, F.lit("accounting-v1"))
            .otherwise(F.lit("accounting-v2"))
            .alias("accounting_version"),
        )

    @cached_property
    def provenance(self) -> DataFrame:
        """Event to observation: the first source is the origin, others are mirrors."""
        return self.facts.select(
            "event_id",
            "event_number",
            "user_id",
            F.explode("source_ids").alias("source_id"),
        ).select(
            "event_id",
            F.concat_ws("-", F.lit("o"), "event_id", "source_id").alias("observation_id"),
            F.when(F.col("source_id") == "src0", F.lit("origin")).otherwise(F.lit("mirror")).alias("role"),
            F.concat_ws("-", F.lit("g"), "source_id", "user_id").alias("file_generation_id"),
            (F.col("event_number") * 100).alias("byte_offset"),
        )

    @cached_property
    def generations(self) -> DataFrame:
        """One current generation per file; some have bytes that were seen but not committed."""
        user = F.expr("cast(split_part(file_generation_id, '-', 3) as bigint)")
        return (
            self.provenance.groupBy("file_generation_id")
            .agg((F.max("byte_offset") + 100).alias("observed_size"))
            .select(
                "file_generation_id",
                F.regexp_replace("file_generation_id", "^g-", "f-").alias("file_id"),
                F.lit("current").alias("state"),
                F.lit(3).cast("long").alias("checkpoint_revision"),
                "observed_size",
                (F.col("observed_size") - F.when(user % 23 == 0, 50).otherwise(0)).alias("committed_offset"),
            )
        )

    @cached_property
    def files(self) -> DataFrame:
        user = F.expr("cast(split_part(file_id, '-', 3) as bigint)")
        return self.generations.select(
            "file_id",
            F.split_part("file_id", F.lit("-"), F.lit(2)).alias("source_id"),
            F.concat(F.lit("/logs/"), F.col("file_id"), F.lit(".jsonl")).alias("canonical_path"),
            F.col("file_generation_id").alias("current_generation_id"),
            F.when(user % 19 == 0, F.lit("missing")).otherwise(F.lit("present")).alias("status"),
        )

    @cached_property
    def sources(self) -> DataFrame:
        """The sources that own files, plus one registered source without any."""
        used = self.files.select("source_id").distinct()
        idle = used.groupBy().agg(F.lit("src9").alias("source_id")).select("source_id")
        source = F.col("source_id")
        return used.unionByName(idle).select(
            "source_id",
            F.concat(F.lit("/roots/"), source).alias("root_path"),
            (source != "src9").alias("enabled"),
            F.when(source == "src1", F.lit("partially_readable")).otherwise(F.lit("readable")).alias("readability"),
            F.lit(1_706_000_000_000).cast("long").alias("last_success_ms"),
        )

    @cached_property
    def scan_state(self) -> DataFrame:
        source = F.col("source_id")
        return self.sources.where(source != "src9").select(
            "source_id",
            F.lit(7).cast("long").alias("scan_revision"),
            F.col("root_path").alias("source_root"),
            F.when(source == "src0", F.lit("ready")).otherwise(F.lit("incomplete")).alias("state"),
            F.lit(True).alias("discovery_complete"),
            F.lit(False).alias("invalidated"),
            F.lit(None).cast("string").alias("issue_code"),
        )

    @cached_property
    def scan_files(self) -> DataFrame:
        """The files the last scan listed; some were not confirmed, some have no known file yet."""
        user = F.expr("cast(split_part(f.file_id, '-', 3) as bigint)")
        listed = self.files.alias("f").join(
            self.generations.alias("g"),
            F.col("f.current_generation_id") == F.col("g.file_generation_id"),
        )
        confirmed = user % 29 != 0
        return listed.where(user % 19 != 0).select(
            F.col("f.source_id").alias("source_id"),
            F.lit(7).cast("long").alias("scan_revision"),
            "canonical_path",
            F.when(user % 31 != 0, F.col("f.file_id")).alias("file_id"),
            F.when(confirmed & (user % 31 != 0), F.col("g.file_generation_id")).alias("file_generation_id"),
            F.when(confirmed, F.col("checkpoint_revision")).alias("checkpoint_revision"),
            F.col("observed_size").alias("upper_bound"),
        )

    @cached_property
    def pending(self) -> DataFrame:
        """Observations that are not consumption: one beside every signup and error event."""
        k = F.col("k")
        kind = (
            F.when(k % 4 == 0, F.lit("pending"))
            .when(k % 4 == 1, F.lit("unattributed"))
            .when(k % 4 == 2, F.lit("duplicate"))
            .otherwise(F.lit("inherited"))
        )
        reason = (
            F.when(k % 4 == 0, F.lit("ambiguous_usage"))
            .when(k % 4 == 1, F.lit("unattributed_usage"))
            .when(k % 4 == 2, F.lit("repeated_snapshot"))
            .otherwise(F.lit("inherited"))
        )
        vector = F.when(
            k % 10 != 9,
            F.concat(
                F.lit('{"input_total":'),
                F.col("total_tokens").cast("string"),
                F.lit(',"output_total":1}'),
            ),
        ).otherwise(F.lit('{"input_total":1}'))
        return self.facts.where(F.col("event_type").isin("signup", "error")).select(
            F.concat(F.lit("pd"), F.col("event_id")).alias("pending_id"),
            F.concat(F.lit("q"), F.col("event_id")).alias("observation_id"),
            "ledger_id",
            "session_key",
            "provider",
            "model",
            "model_key",
            "project_id",
            F.lit("src0").alias("source_id"),
            F.concat(F.lit("g-src0-"), F.col("user_id")).alias("file_generation_id"),
            (F.col("event_number") * 100 + 50).alias("byte_offset"),
            F.when(k % 5 != 0, F.col("occurred_at_ms")).alias("observed_at_ms"),
            kind.alias("kind"),
            reason.alias("reason_code"),
            vector.alias("vector_json"),
        )

    @cached_property
    def contexts(self) -> DataFrame:
        return self.facts.where(F.col("input_total").isNotNull()).select(
            F.concat(F.lit("c"), F.col("event_id")).alias("context_id"),
            "ledger_id",
            "session_key",
            F.col("occurred_at_ms").alias("observed_at_ms"),
            (F.col("input_total") + F.col("output_total")).alias("context_tokens"),
            F.when(F.col("k") % 6 != 0, F.lit(4000)).cast("long").alias("model_context_window"),
            F.when(F.col("k") % 3 == 0, F.lit("pending")).otherwise(F.lit("confirmed")).alias("quality"),
        )

    @cached_property
    def diagnostics(self) -> DataFrame:
        """Problem occurrences: one per error event, before de-duplication."""
        k = F.col("k")
        return self.facts.where(F.col("event_type") == "error").select(
            F.concat_ws(":", F.concat(F.lit("d"), k % 6), F.concat(F.lit("s"), F.col("user_id"))).alias("dedup_key"),
            F.when(k % 6 < 3, F.lit("UNSUPPORTED_FORMAT")).otherwise(F.lit("INVALID_USAGE")).alias("code"),
            F.when(k % 6 == 1, F.lit("rollout-v0")).when(k % 6 == 2, F.lit("rollout-v1")).alias("parser_version"),
            F.lit("src0").alias("source_id"),
            F.concat(F.lit("g-src0-"), F.col("user_id")).alias("file_generation_id"),
            (F.col("event_number") * 100).alias("byte_offset"),
            F.col("occurred_at_ms").alias("seen_at_ms"),
            (F.col("user_id") % 3 == 0).alias("resolved"),
        )


# Tables beside the events that answers look things up in. Each holds a row per session, file, source
# or problem, not per event asked for.
SIDE_TABLES = ("sessions", "projects", "ledgers", "generations", "files", "sources", "scan_state", "scan_files", "pending", "contexts", "diagnostics")
_WRITTEN: dict[tuple, DataFrame] = {}


class StoredTables(UsageTables):
    """The model with its side tables written once per application and state of the directory.

    Derived in place, every look-up of a composite answer would read all events again. Written,
    each is read as often as asked, with its size known; events alone are scanned, and those scans
    carry the answer's range.
    """

    @cached_property
    def state(self) -> tuple:
        """What the written tables belong to: they are not used for another application or other events."""
        files = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.directory}/events.parquet")
        system = files.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = system.getFileStatus(files)
        return self.spark.sparkContext.applicationId, self.directory, found.getModificationTime(), system.getContentSummary(files).getLength()


def _written(name: str) -> cached_property:
    derived = getattr(UsageTables, name).func

    def read(self: StoredTables) -> DataFrame:
        key = (*self.state, name)
        if key not in _WRITTEN:
            _WRITTEN[key] = cut_sizes(derived(self))
        return _WRITTEN[key]

    found = cached_property(read)
    found.__set_name__(StoredTables, name)
    return found


for _name in SIDE_TABLES:
    setattr(StoredTables, _name, _written(_name))
