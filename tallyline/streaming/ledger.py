"""Accounting of a growing observation table with its evidence in keyed state.

State is kept per session in a state store with one entry per thing that can change, so a batch
writes what it touched and nothing else:

* ``consumed``: the highest byte accounted for, per file generation. Bytes below it were read
  before (a chunk that landed twice, a re-read after a restart) and bill nothing;
* ``cursors``: where each file stands in the session's own sequence of records. A record that is
  equal to the slot at its file's cursor is a copy, one past the end is new, and any other takes
  its file out of the sequence and asks for a rebuild;
* ``slots``: the sequence itself, in blocks of signatures;
* ``streams``: the baseline of each counter stream.

The beginning of a fork belongs to another session, which this state cannot see: its records wait
as ``lineage_pending`` and ask for a rebuild. ``rebuilds`` replays the sessions that asked, with all
they depend on, and swaps their rows; after that the stored ledger equals a replay of everything.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyline.functions import vectors as V
from tallyline.model import VECTOR_FIELDS
from tallyline.operators import accounting as A, lineage, normalize, replay
from tallyline.session import cut_lineage

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BLOCK = 256  # slots in one state entry
SIGNATURE = 64  # characters of a signature

_SIX = ", ".join(f"{{0}}_{f} long" for f in VECTOR_FIELDS)
STREAM_SCHEMA = f"episode_id string, {_SIX.format('c')}, has_last boolean, {_SIX.format('l')}"
INPUT = [
    "session_key", "kind", "file_generation_id", "byte_offset", "byte_end", "event_time_ms", "parent_provider_id", "model_context_window", "last", "cumulative",
    "signature",
]
OUTPUT = (
    "session_key string, file_generation_id string, byte_offset long, byte_end long, row_id long, event_time_ms long, model_context_window long,"
    f" last {V.VECTOR_TYPE}, cumulative {V.VECTOR_TYPE}, base_method string, stream_key string, episode_id string, delta {V.VECTOR_TYPE}, candidates int, rebuild boolean"
)
Produced = Row(*[part.split(" ")[0] for part in OUTPUT.replace(V.VECTOR_TYPE, "v").split(", ")])


class SessionLedger(StatefulProcessor):
    """Judges the new records of one session; see the module for its state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streams = handle.getMapState("streams", "stream_key string", STREAM_SCHEMA)
        self.consumed = handle.getMapState("consumed", "file_generation_id string", "byte_end long")
        self.cursors = handle.getMapState("cursors", "file_generation_id string", "ordinal long, head boolean, aligned boolean")
        self.slots = handle.getMapState("slots", "block long", "signatures string, proven string")
        self.session = handle.getValueState("session", "length long, known boolean, created_ms long, parent string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = _Opened(self)
        # One batch of one session: bounded by what a trigger reads.
        for row in sorted(rows, key=lambda r: (r.file_generation_id, r.byte_offset)):
            if row.kind == "session_metadata":
                state.header(row)
            else:
                yield state.judged(key[0], row)
        state.save()

    def close(self) -> None:
        pass


class _Opened:
    """The parts of a session's state that a batch touches, read when asked and written once."""

    def __init__(self, processor: SessionLedger) -> None:
        self.stored = processor
        self.length, self.known, self.created, self.parent = processor.session.get() if processor.session.exists() else (0, False, None, None)
        self.streams = A.Streams({key[0]: _stream(value) for key, value in processor.streams.iterator()})
        self.before = dict(self.streams.by_key)
        self.consumed: dict[str, int] = {}
        self.cursors: dict[str, tuple] = {}
        self.blocks: dict[int, tuple[str, str]] = {}
        self.dirty: set[int] = set()

    def _consumed(self, generation: str) -> int:
        if generation not in self.consumed:
            held = self.stored.consumed.getValue((generation,)) if self.stored.consumed.containsKey((generation,)) else None
            self.consumed[generation] = held[0] if held else 0
        return self.consumed[generation]

    def _cursor(self, generation: str) -> tuple[int, bool, bool]:
        if generation not in self.cursors:
            held = self.stored.cursors.getValue((generation,)) if self.stored.cursors.containsKey((generation,)) else None
            self.cursors[generation] = tuple(held) if held else (0, False, True)
        return self.cursors[generation]

    def _block(self, number: int) -> tuple[str, str]:
        if number not in self.blocks:
            held = self.stored.slots.getValue((number,)) if self.stored.slots.containsKey((number,)) else None
            self.blocks[number] = tuple(held) if held else ("", "")
        return self.blocks[number]

    def header(self, row: Row) -> None:
        """The first bytes of a file name its session's start and parent; all its files must agree."""
        ordinal, head, aligned = self._cursor(row.file_generation_id)
        if row.byte_offset:
            return
        if not self.known:
            self.known, self.created, self.parent = True, row.event_time_ms, row.parent_provider_id
        same = (self.created, self.parent) == (row.event_time_ms, row.parent_provider_id)
        self.cursors[row.file_generation_id] = (ordinal, True, aligned and same)

    def judged(self, session: str, row: Row) -> Row:
        generation = row.file_generation_id
        ordinal, head, aligned = self._cursor(generation)
        found = {"method": "lineage_pending", "stream_key": None, "episode_id": None, "delta": None, "candidates": 0}
        place, rebuild = -1, False
        if row.byte_offset < self._consumed(generation):
            return _produced(session, row, place, {**found, "method": "physical_duplicate"}, False)
        self.consumed[generation] = row.byte_end
        if not head or not aligned:
            aligned, rebuild = False, True
        elif ordinal < self.length:
            signatures, proven = self._block(ordinal // BLOCK)
            at = ordinal % BLOCK
            if signatures[at * SIGNATURE : (at + 1) * SIGNATURE] != row.signature:
                aligned, rebuild = False, True
            elif proven[at] == "1":
                found["method"], place = "verified_duplicate", ordinal
        else:
            place, first = self.length, not self.length
            if self.parent is None or self.streams.by_key:
                found = _step(self.streams, session, row, first)
            else:
                rebuild = True
            self._append(row.signature, _proves(found["method"], row))
        self.cursors[generation] = (ordinal + (not rebuild or place >= 0), head, aligned)
        return _produced(session, row, place, found, rebuild)

    def _append(self, signature: str, proven: bool) -> None:
        number = self.length // BLOCK
        signatures, flags = self._block(number)
        self.blocks[number] = (signatures + signature, flags + "01"[proven])
        self.dirty.add(number)
        self.length += 1

    def save(self) -> None:
        stored = self.stored
        stored.session.update((self.length, self.known, self.created, self.parent))
        for generation, end in self.consumed.items():
            stored.consumed.updateValue((generation,), (end,))
        for generation, cursor in self.cursors.items():
            stored.cursors.updateValue((generation,), cursor)
        for number in self.dirty:
            stored.slots.updateValue((number,), self.blocks[number])
        for key, baseline in self.streams.by_key.items():
            if self.before.get(key) != baseline:
                episode, cumulative, last = baseline
                stored.streams.updateValue((key,), (episode, *cumulative, last is not None, *(last or (None,) * len(VECTOR_FIELDS))))


def _stream(value) -> tuple:
    n = len(VECTOR_FIELDS)
    return value[0], tuple(value[1 : n + 1]), tuple(value[n + 2 :]) if value[n + 1] else None


def _vector(value: Row | None) -> tuple | None:
    return None if value is None else tuple(value[f] for f in VECTOR_FIELDS)


def _step(streams: A.Streams, session: str, row: Row, first: bool) -> dict:
    """Judge a record that is the session's own, as the batch operator does."""
    last, cumulative = _vector(row.last), _vector(row.cumulative)
    out = {"method": "ambiguous_usage", "stream_key": None, "episode_id": None, "delta": None, "candidates": 0}
    if any(v is not None and not A._sound(v) for v in (last, cumulative)):
        return {**out, "method": "invalid_usage"}
    if last is not None and A._total(last) is None:
        return out
    if cumulative is None:
        return {**out, "method": "last_only"} if last is not None else out
    position = A.position_key(session, row.file_generation_id, row.byte_offset, row.byte_end)
    return A.step(
        streams,
        {
            "op": "total" if last is None else "pair", "hint": None, "start": False, "independent": first, "last": last, "cumulative": cumulative,
            "tail": cumulative, "seed_key": None, "seed_episode": None, "position": position,
        },
    )


def _proves(method: str, row: Row) -> bool:
    """Whether a copy of this record may be called a duplicate of it."""
    usage = _vector(row.last) or _vector(row.cumulative)
    settled = method in A.CONFIRMED or method in ("repeated_snapshot", "unattributed_anchor")
    return settled and usage is not None and A._total(usage) is not None


def _produced(session: str, row: Row, place: int, found: dict, rebuild: bool) -> Row:
    delta = found["delta"]
    return Produced(
        session, row.file_generation_id, row.byte_offset, row.byte_end, place, row.event_time_ms, row.model_context_window, row.last, row.cumulative,
        found["method"], found["stream_key"], found["episode_id"], None if delta is None else Row(**dict(zip(VECTOR_FIELDS, delta))), found["candidates"], rebuild,
    )


def account_observations(observations: DataFrame) -> DataFrame:
    """Results of an observation stream, one row per usage record and reading.

    Needs the columns of ``normalize.normalize``. The rows carry the columns of
    ``accounting.account`` (row_id is the place in the session, -1 for a record without one) and
    ``rebuild``: only a rebuild can settle the record.
    """
    observations.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    wanted = normalize.with_signature(observations.where("kind IN ('usage', 'session_metadata') AND session_key IS NOT NULL")).select(*INPUT)
    produced = wanted.groupBy("session_key").transformWithState(SessionLedger(), OUTPUT, "append", "none")
    return A.results_of(produced)


def split_results(results: DataFrame, ledger: str = "concat('ledger:', session_key)") -> tuple[DataFrame, DataFrame]:
    """(events, pending) of stored stream results."""
    return A.split_outputs(results, ledger, keep=("file_generation_id", "byte_offset", "rebuild"))


# --- rebuilds ---------------------------------------------------------------------------------------


def waiting_sessions(results: DataFrame) -> DataFrame:
    """Sessions with a record that only a rebuild can settle."""
    return results.where("rebuild").select("session_key").distinct()


def family_edges(observations: DataFrame) -> DataFrame:
    """(a, b): a session and the session that it was forked from, where both are known."""
    headers = observations.where("kind = 'session_metadata' AND byte_offset = 0").select("session_key", "provider_session_id", "parent_provider_id").distinct()
    parents = headers.select(F.col("provider_session_id").alias("parent_provider_id"), F.col("session_key").alias("b")).distinct()
    return headers.where("parent_provider_id IS NOT NULL").join(parents, "parent_provider_id").select(F.col("session_key").alias("a"), "b").where("a <> b")


def rebuilds(results: DataFrame, observations: DataFrame, generations: DataFrame) -> tuple[DataFrame, replay.Replayed | None]:
    """(sessions, their replay): every session that waits, with all its forks and parents.

    Only the observations of these sessions are read again; None when nothing waits.
    """
    asked = cut_lineage(waiting_sessions(results))
    if asked.isEmpty():
        return asked, None
    sessions = lineage.seeded_closure(cut_lineage(family_edges(observations)), asked.withColumnRenamed("session_key", "node")).withColumnRenamed("node", "session_key")
    sessions = cut_lineage(sessions)
    touched = observations.join(sessions, "session_key", "left_semi")
    return sessions, replay.replay(touched, generations)
