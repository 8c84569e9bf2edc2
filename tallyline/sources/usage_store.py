"""The published tables on disk: observations, ledgers and hourly rollups, kept by guarded batches.

Events belong to ledgers; a session shows the events of the one ledger that is active for it. A
rebuild writes its events under a new ledger and moves the session there, so nothing of the old
result changes before the new one is whole, and one revision makes the swap.

Rollups are stored by UTC day and maintained from what changed: the hours of new events and of
ledgers that were swapped in or out. A touched day is written anew from its untouched cohorts and
the facts of its touched hours; other days keep their files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tallyline.functions import vectors as V
from tallyline.model import HOUR_MS, VECTOR_FIELDS
from tallyline.operators import replay, rollup
from tallyline.operators.measures import PARTIAL_COUNTS, PARTIAL_SUMS
from tallyline.session import cut_lineage, passing_sizes, small_methods
from tallyline.sources.commits import CommitConflict, CommitLog, Revision

_COUNTS = ", ".join(f"{f} long" for f in VECTOR_FIELDS)
EVENTS = (
    f"event_id string, ledger_id string, session_key string, occurred_at_ms long, provider string, model string, project_id string, turn_id string,"
    f" source_ids array<string>, {_COUNTS}, total_tokens long, calculation_method string, observation_id string"
)
PENDING = "ledger_id string, session_key string, file_generation_id string, byte_offset long, observed_at_ms long, kind string, reason_code string"
PROVENANCE = "event_id string, observation_id string, role string"
CONTEXTS = (
    "session_key string, ledger_id string, file_generation_id string, byte_offset long, observed_at_ms long, context_tokens long, context_window long,"
    " context_quality string"
)
STREAMS = f"ledger_id string, session_key string, stream_key string, ordinal long, episode_id string, baseline {V.VECTOR_TYPE}, quality string"
SESSIONS = "session_key string, ledger_id string, revision long"
COHORT_KEYS = "ledger_id string, session_key string, hour_start_ms long, provider string, model string, project_id string, sources string"
PARTIALS = ", ".join([*[f"{c} decimal(38,0)" for c in PARTIAL_SUMS], *[f"{c} long" for c in PARTIAL_COUNTS]])
HOURS = f"{COHORT_KEYS}, {PARTIALS}, day date"
TURNS = f"{COHORT_KEYS}, turn_id string, day date"
SCHEMAS = {"events": EVENTS, "sessions": SESSIONS, "pending": PENDING, "provenance": PROVENANCE, "contexts": CONTEXTS, "streams": STREAMS}
DAY = "date_from_unix_date(CAST(floor({0} / 86400000) AS INT))"


def columns_of(schema: str) -> list[str]:
    """Column names of a schema text without nested commas outside of struct types."""
    plain = schema.replace(V.VECTOR_TYPE, "v")
    return [part.strip().split(" ")[0] for part in plain.split(",")]


def shaped(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` with exactly the columns of a stored table; what they lack is NULL."""
    held = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in held else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])


class UsageStore:
    """Tables under ``root``, a folder that every executor can reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.log = CommitLog(spark, root)

    # --- reading -----------------------------------------------------------------------------

    def sessions(self, revision: Revision | None = None) -> DataFrame:
        """The active ledger of each session: the one that was published last."""
        rows = self.log.read("sessions", SESSIONS, revision)
        return rows.groupBy("session_key").agg(F.max_by("ledger_id", "revision").alias("ledger_id"))

    def events(self, revision: Revision | None = None) -> DataFrame:
        """Events of active ledgers."""
        revision = revision or self.log.revision()
        return self.log.read("events", EVENTS, revision).join(self.sessions(revision), ["session_key", "ledger_id"], "left_semi")

    def pending(self, revision: Revision | None = None) -> DataFrame:
        revision = revision or self.log.revision()
        return self.log.read("pending", PENDING, revision).join(self.sessions(revision), ["session_key", "ledger_id"], "left_semi")

    def provenance(self, revision: Revision | None = None) -> DataFrame:
        return self.log.read("provenance", PROVENANCE, revision)

    def contexts(self, revision: Revision | None = None) -> DataFrame:
        return self.log.read("contexts", CONTEXTS, revision)

    def streams(self, revision: Revision | None = None) -> DataFrame:
        """The latest stored state of every stream of the active ledgers."""
        revision = revision or self.log.revision()
        rows = self.log.read("streams", STREAMS, revision).join(self.sessions(revision), ["session_key", "ledger_id"], "left_semi")
        kept = [c for c in columns_of(STREAMS) if c not in ("session_key", "stream_key")]
        latest = rows.groupBy("session_key", "stream_key").agg(F.max_by(F.struct(*kept), "ordinal").alias("row"))
        return latest.select("session_key", "stream_key", *[F.col("row")[c].alias(c) for c in kept])

    def hours(self, revision: Revision | None = None) -> DataFrame:
        return self.log.read("hours", HOURS, revision)

    def turns(self, revision: Revision | None = None) -> DataFrame:
        return self.log.read("turns", TURNS, revision)

    def ready_ledgers(self, revision: Revision | None = None) -> DataFrame:
        """Ledgers whose stored rollup is current: every active one, as each batch keeps it so."""
        return self.sessions(revision).select("ledger_id").distinct()

    # --- writing -----------------------------------------------------------------------------

    def append(
        self, writer: str, batch: int, events: DataFrame, *, pending: DataFrame | None = None, provenance: DataFrame | None = None,
        contexts: DataFrame | None = None, streams: DataFrame | None = None, offsets: DataFrame | None = None, expected: int | None = None,
    ) -> bool:
        """Add a batch of events to the ledgers they name, with their rollup hours; False if it was
        there before or is empty. A ledger not seen before becomes the active one of its session
        if the session has none."""
        at = self.log.revision()
        if at.writers.get(writer, -1) >= batch:
            return False
        with passing_sizes(self.spark) as cut:
            fresh = cut(shaped(events, EVENTS))
            known = self.sessions(at)
            named = fresh.select("session_key", "ledger_id").distinct()
            named = named.join(known.select("session_key"), "session_key", "left_anti").groupBy("session_key").agg(F.min("ledger_id").alias("ledger_id"))
            opened = cut(named.withColumn("revision", F.lit(at.number + 1).cast("long")))
            tables = {
                "events": fresh, "sessions": shaped(opened, SESSIONS), "pending": pending, "provenance": provenance, "contexts": contexts, "streams": streams,
            }
            # An event of a ledger that is not active is kept, but shown and counted nowhere.
            active = known.unionByName(opened.select("session_key", "ledger_id"))
            shown = fresh.join(active, ["session_key", "ledger_id"], "left_semi")
            return self._commit(writer, batch, at, tables, touched_hours(shown), shown, expected, offsets, cut)

    def swap(self, writer: str, batch: int, replayed: replay.Replayed, *, ledger: str, expected: int | None = None) -> bool:
        """Make the result of a replay the active one of its sessions, under new ledgers.

        ``ledger`` names the new ledger of a session (SQL over session_key). The old ledger's events
        stay stored and are no longer shown; the hours of both are rolled up anew.
        """
        at = self.log.revision()
        if at.writers.get(writer, -1) >= batch:
            return False
        named = lambda rows: rows.withColumn("ledger_id", F.expr(ledger))
        fresh = named(replayed.events)
        fresh = fresh.withColumn("event_id", F.concat_ws(":", "ledger_id", "observation_id"))
        with passing_sizes(self.spark) as cut:
            fresh = cut(shaped(fresh, EVENTS))
            opened = named(replayed.sessions).withColumn("revision", F.lit(at.number + 1).cast("long"))
            origin = fresh.select("event_id", "observation_id", F.lit("origin").alias("role"))
            old = self.events(at).join(opened.select("session_key"), "session_key", "left_semi")
            tables = {
                "events": fresh, "sessions": shaped(opened, SESSIONS), "pending": shaped(named(replayed.pending), PENDING), "provenance": shaped(origin, PROVENANCE),
                "contexts": shaped(named(replayed.contexts), CONTEXTS), "streams": shaped(named(replayed.streams), STREAMS),
            }
            touched = touched_hours(fresh.unionByName(old))
            return self._commit(writer, batch, at, tables, touched, fresh, expected, None, cut, opened.select("session_key"))

    def _commit(self, writer, batch, at, tables, touched, fresh, expected, offsets, cut: Callable[[DataFrame], DataFrame], moved: DataFrame | None = None) -> bool:
        rows = {t: shaped(df, SCHEMAS[t]) for t, df in tables.items() if df is not None}
        touched = cut(touched)
        days = [r.day for r in touched.select(F.expr(DAY.format("hour_start_ms")).cast("string").alias("day")).distinct().collect()]  # days of this batch
        hours, turns = self._refreshed(at, touched, fresh, moved, days, cut)
        # Rows of a day meet before they are written: every task would have a file of each day else.
        by_day = {"hours": hours.hint("rebalance", "day"), "turns": turns.hint("rebalance", "day")}
        with small_methods(self.spark):
            return self.log.commit(
                writer, batch, {**rows, **by_day}, at=at, expected=expected, offsets=offsets,
                replacing={"hours": days, "turns": days}, partitioned={"hours": "day", "turns": "day"},
            )

    def _refreshed(
        self, at: Revision, touched: DataFrame, fresh: DataFrame, moved: DataFrame | None, days: list[str], cut: Callable[[DataFrame], DataFrame]
    ) -> tuple[DataFrame, DataFrame]:
        """Cohorts and turns of the touched days: stored where no hour was touched, else from facts.

        ``fresh`` touches all hours it has; only stored facts are compared with the touched ones.
        """
        stored = self.events(at)
        if moved is not None:
            stored = stored.join(moved, "session_key", "left_anti")
        span = touched.agg(F.min("hour_start_ms").alias("low"), F.max("hour_start_ms").alias("high")).first()
        if span.low is not None:
            stored = stored.where(f"occurred_at_ms >= {span.low} AND occurred_at_ms < {span.high + HOUR_MS}")
        hour = F.expr(f"occurred_at_ms - pmod(occurred_at_ms, {HOUR_MS}L)")
        beside = stored.withColumn("hour_start_ms", hour).join(touched, ["session_key", "hour_start_ms"], "left_semi").drop("hour_start_ms")
        stale = cut(beside.unionByName(fresh.where("session_key IS NOT NULL AND occurred_at_ms IS NOT NULL")))
        day = F.expr(DAY.format("hour_start_ms"))
        new = {"hours": rollup.build_rollup(stale).withColumn("day", day), "turns": rollup.build_turns(stale).withColumn("day", day)}
        out = []
        for name, schema, table in (("hours", HOURS, self.hours(at)), ("turns", TURNS, self.turns(at))):
            kept = table.where(F.col("day").cast("string").isin(days)) if days else table.where("false")
            kept = kept.join(touched, ["session_key", "hour_start_ms"], "left_anti")
            out.append(shaped(kept, schema).unionByName(shaped(new[name], schema)))
        return out[0], out[1]


def touched_hours(events: DataFrame) -> DataFrame:
    """(session, hour) pairs whose stored cohorts a batch of events changes."""
    return events.selectExpr("session_key", f"occurred_at_ms - pmod(occurred_at_ms, {HOUR_MS}L) AS hour_start_ms").distinct()


# --- replaced files ---------------------------------------------------------------------------------


def replacement_faults(
    replayed: replay.Replayed, observations: DataFrame, generations: DataFrame, frozen: DataFrame, current: DataFrame
) -> DataFrame:
    """(fault, subject) of a candidate that was read anew; an empty table lets it take its place.

    A usage record that is not classified exactly once, a file that was not read to its end, and a
    file whose manifest row is not the one the reading began with.
    """
    from tallyline.operators import lineage

    unclassified = replay.unproven_positions(replayed, observations).selectExpr("'unclassified' AS fault", "observation_id AS subject")
    unread = generations.where("committed_offset IS NULL OR committed_offset <> observed_size").selectExpr("'incomplete' AS fault", "file_generation_id AS subject")
    changed = lineage.manifest_changes(frozen, current).selectExpr("'changed' AS fault", f"{frozen.columns[0]} AS subject")
    return unclassified.unionByName(unread).unionByName(changed).distinct()


def replace_files(
    store: UsageStore, writer: str, batch: int, observations: DataFrame, generations: DataFrame, *, frozen: DataFrame, current: DataFrame, ledger: str,
    expected: int | None = None, arrival: str | None = None,
) -> DataFrame:
    """Replay re-read files and swap their sessions, in two phases; the faults if it was refused.

    ``observations`` are those of every file of the touched sessions, the replaced ones as re-read.
    The candidate is computed and checked beside the published result, which stays as it is when
    there is a fault or another writer was first.
    """
    replayed = replay.replay(observations, generations, arrival=arrival)
    faults = cut_lineage(replacement_faults(replayed, observations, generations, frozen, current))
    if faults.isEmpty():
        try:
            store.swap(writer, batch, replayed, ledger=ledger, expected=expected)
        except CommitConflict as conflict:
            return store.spark.createDataFrame([("conflict", str(conflict))], "fault string, subject string")
    return faults
