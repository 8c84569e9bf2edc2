"""Copies, forks and rebuilds of sessions.

A physical sequence is one file's usage records of one session. Two sequences are compared
by joining equal ordinals, so a comparison is spread over its records and every incoming
record meets exactly one reference record. What a sequence can prove about itself is three
minima over its records, whatever prefix is asked for later.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tallyline.functions import vectors as V
from tallyline.model import VECTOR_FIELDS
from tallyline.operators.scan import chunked_scan
from tallyline.session import cut_lineage, cut_sizes

NEVER = 2**62
MAX_SENT_NODES = 100_000  # nodes of a search that are broadcast

CREDIBLE = (
    "event_time_ms IS NOT NULL"
    f" AND (last IS NULL OR {V.total_error('last')} IS NULL)"
    f" AND (cumulative IS NULL OR {V.total_error('cumulative')} IS NULL)"
    f" AND coalesce({V.validated_total('last')}, {V.validated_total('cumulative')}) IS NOT NULL"
)


def _progression() -> str:
    """The counters moved by exactly this record's counts, field by field."""
    checks = []
    for name in VECTOR_FIELDS:
        before, after, last = f"before.{name}", f"cumulative.{name}", f"last.{name}"
        checks.append(
            f"(({before} IS NULL AND {after} IS NULL AND {last} IS NULL) OR coalesce(try_add({before}, {last}) = {after}, false))"
        )
    known = " AND ".join(f"{v}.{n} IS NOT NULL" for v in ("before", "cumulative", "last") for n in ("input_total", "output_total"))
    return f"{known} AND (last.input_total > 0 OR last.output_total > 0) AND {' AND '.join(checks)}"


def dense_ordinals(records: DataFrame, keys: list[str], order: str, chunk: str) -> DataFrame:
    """Number records 0, 1, 2, ... in order within each group, however large the group."""
    numbered = chunked_scan(records, keys, chunk, [order], sums={"__rank": "1L"})
    return numbered.withColumn("ordinal", F.col("__rank") - 1).drop("__rank")


def physical_sequences(
    observations: DataFrame, generations: DataFrame, cut: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(sequences, records) of usage observations, one sequence per (session, file generation).

    A sequence starts at its head when the session header is the first byte of the file, and
    is complete when all bytes seen were committed. With ``cut`` the records are written, and the
    sequences are found in what was written.
    """
    usage = observations.where("kind = 'usage'").withColumn(
        "sequence_key", F.concat_ws("|", "session_key", "file_generation_id")
    )
    more = [c for c in ("byte_end", "model_context_window") if c in usage.columns]
    records = dense_ordinals(
        usage.select("sequence_key", "session_key", "file_generation_id", "byte_offset", "event_time_ms", "last", "cumulative", "signature", *more),
        ["sequence_key"], "byte_offset", f"byte_offset div {64 * 1024 * 1024}",
    )
    records = cut(records) if cut else records
    headers = observations.where("kind = 'session_metadata'").groupBy("session_key", "file_generation_id").agg(
        F.expr("min(byte_offset) = 0 AS starts_at_head"),
        F.expr("min_by(event_time_ms, byte_offset) AS created_at_ms"),
        F.expr("min_by(parent_provider_id, byte_offset) AS parent_provider_id"),
        F.expr("min_by(provider_session_id, byte_offset) AS provider_session_id"),
    )
    sequences = (
        records.select("sequence_key", "session_key", "file_generation_id").distinct()
        .join(headers, ["session_key", "file_generation_id"], "left")
        .join(generations.selectExpr("file_generation_id", "committed_offset = observed_size AS scanned"), "file_generation_id", "left")
        .selectExpr(
            "sequence_key", "session_key AS owner_session_key", "split_part(session_key, ':', 1) AS namespace",
            "coalesce(provider_session_id, '') AS provider_session_id", "created_at_ms", "parent_provider_id",
            "coalesce(starts_at_head, false) AS starts_at_head", "coalesce(scanned, false) AS scanned",
            "false AS previously_canonical", "false AS has_trusted_history",
        )
    )
    return sequences, records


def proofs(records: DataFrame, chunk: str = "ordinal div 1000000") -> DataFrame:
    """Per sequence: length, first record that is not credible, first identity, first progression."""
    identity = "request_identity" if "request_identity" in records.columns else "CAST(NULL AS STRING)"
    stepped = chunked_scan(records, ["sequence_key"], chunk, ["ordinal"], previous={"before": "cumulative"})
    return stepped.groupBy("sequence_key").agg(
        F.expr("count(1) AS length"),
        F.expr(f"coalesce(min(CASE WHEN NOT ({CREDIBLE}) THEN ordinal END), {NEVER}) AS first_doubtful"),
        F.expr(f"coalesce(min(CASE WHEN {identity} <> '' THEN ordinal END), {NEVER}) AS first_identity"),
        F.expr(f"coalesce(min(CASE WHEN {_progression()} THEN ordinal END), {NEVER}) AS first_progression"),
    )


def common_prefixes(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Length of the equal beginning of each (reference_key, sequence_key) pair."""
    mine = pairs.join(records.select("sequence_key", "ordinal", "signature"), "sequence_key")
    theirs = records.selectExpr("sequence_key AS reference_key", "ordinal", "signature AS reference_signature")
    compared = mine.join(theirs, ["reference_key", "ordinal"], "left")
    differs = "CASE WHEN reference_signature IS NULL OR reference_signature <> signature THEN ordinal END"
    return compared.groupBy("reference_key", "sequence_key").agg(
        F.expr(f"coalesce(min({differs}), count(1)) AS prefix")
    )


PROVEN = "(s.first_doubtful >= prefix AND ({strong} OR s.first_identity < prefix OR s.first_progression < prefix))"


def _paired(pairs: DataFrame, sequences: DataFrame, proof: DataFrame, records: DataFrame) -> DataFrame:
    full = cut_sizes(sequences.join(proof, "sequence_key", "left").fillna({"length": 0, "first_doubtful": NEVER, "first_identity": NEVER, "first_progression": NEVER}))
    s = full.select("sequence_key", F.struct(*[c for c in full.columns]).alias("s"))
    r = s.select(F.col("sequence_key").alias("reference_key"), F.col("s").alias("r"))
    prefixed = pairs.join(common_prefixes(pairs, records), ["reference_key", "sequence_key"], "left").fillna({"prefix": 0})
    return prefixed.join(s, "sequence_key").join(r, "reference_key")


MIRROR_DECISION = f"""CASE
WHEN s.namespace <> r.namespace OR s.provider_session_id <> r.provider_session_id THEN 'unrelated'
WHEN s.created_at_ms <> r.created_at_ms OR s.parent_provider_id <> r.parent_provider_id THEN 'identity_conflict'
WHEN NOT (s.parent_provider_id <=> r.parent_provider_id) THEN 'pending_insufficient'
WHEN NOT (s.starts_at_head AND r.starts_at_head) THEN 'pending_incomplete'
WHEN prefix < least(s.length, r.length) THEN 'identity_conflict'
WHEN prefix = 0 THEN 'pending_incomplete'
WHEN NOT {PROVEN.format(strong='coalesce(s.created_at_ms = r.created_at_ms, false)')} THEN 'pending_insufficient'
WHEN s.length > prefix AND NOT r.scanned THEN 'pending_incomplete'
ELSE 'mirror' END"""


def align_mirrors(pairs: DataFrame, sequences: DataFrame, records: DataFrame, proof: DataFrame) -> DataFrame:
    """Decide for each (reference_key, sequence_key) pair whether the second is a copy of the first."""
    judged = _paired(pairs, sequences, proof, records)
    return judged.selectExpr(
        "reference_key", "sequence_key", f"{MIRROR_DECISION} AS decision", "prefix", "s.length - prefix AS continuation",
        "s.length AS length", "r.length AS reference_length",
    )


LINEAGE_DECISION = f"""CASE
WHEN NOT (r.starts_at_head AND s.starts_at_head AND r.scanned) THEN 'pending_incomplete'
WHEN prefix = 0 OR NOT {PROVEN.format(strong='true')} THEN 'pending_insufficient'
WHEN prefix = s.length AND NOT s.scanned THEN 'pending_incomplete'
ELSE 'inherited' END"""


def align_lineage(sequences: DataFrame, records: DataFrame, proof: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """For each sequence that names a parent: what it inherited from it."""
    parents = sequences if parents is None else parents
    heads = parents.selectExpr("namespace", "provider_session_id AS parent_provider_id", "sequence_key AS reference_key")
    counted = heads.groupBy("namespace", "parent_provider_id").agg(
        F.expr("count(1) AS candidates"), F.expr("min(reference_key) AS reference_key")
    )
    children = sequences.where("parent_provider_id IS NOT NULL").join(counted, ["namespace", "parent_provider_id"], "left")
    early = """CASE WHEN parent_provider_id = provider_session_id THEN 'identity_conflict'
    WHEN candidates > 1 THEN 'pending_multiple' WHEN candidates IS NULL THEN 'pending_incomplete' END"""
    sorted_out = children.withColumn("decision", F.expr(early))
    pairs = sorted_out.where("decision IS NULL").select("reference_key", "sequence_key")
    judged = _paired(pairs, sequences, proof, records).selectExpr(
        "reference_key", "sequence_key", f"{LINEAGE_DECISION} AS decision", "prefix", "s.length - prefix AS continuation"
    )
    none = sorted_out.where("decision IS NOT NULL").selectExpr(
        "CAST(NULL AS STRING) AS reference_key", "sequence_key", "decision", "0L AS prefix", "0L AS continuation"
    )
    return judged.unionByName(none)


def canonical_plan(sequences: DataFrame, records: DataFrame, proof: DataFrame) -> DataFrame:
    """One row per sequence: its group, role and reason.

    Roles: primary, member (a proven copy) or isolated (with the decision that isolated it).
    Also primary_key, longest_key, their lengths, and group_session_key (the owner the group
    counts for). Groups are chosen with aggregates, so a group of many copies stays spread.
    """
    grouped = sequences.withColumn(
        "group_id", F.expr("CASE WHEN provider_session_id = '' THEN concat('?', sequence_key) ELSE concat('=', provider_session_id) END")
    )
    chosen = grouped.groupBy("namespace", "group_id").agg(
        F.expr(
            """CASE WHEN count_if(previously_canonical) = 1 THEN min(CASE WHEN previously_canonical THEN sequence_key END)
            WHEN count_if(has_trusted_history) = 1 THEN min(CASE WHEN has_trusted_history THEN sequence_key END)
            ELSE min(sequence_key) END AS primary_key"""
        )
    )
    members = cut_sizes(
        grouped.join(chosen, ["namespace", "group_id"])
        .join(proof.select("sequence_key", "length"), "sequence_key", "left")
        .fillna({"length": 0})
    )
    others = members.where("sequence_key <> primary_key").selectExpr("primary_key AS reference_key", "sequence_key")
    first = cut_sizes(
        align_mirrors(others, sequences, records, proof).select("sequence_key", F.col("decision").alias("first_decision"))
    )
    tried = members.join(first, "sequence_key", "left").withColumn(
        "proven", F.expr("sequence_key = primary_key OR first_decision = 'mirror'")
    )
    longest = tried.where("proven").groupBy("primary_key").agg(
        F.expr("min_by(sequence_key, struct(-length, sequence_key)) AS longest_key")
    )
    with_longest = tried.join(longest, "primary_key")
    overlap = with_longest.where("proven AND sequence_key NOT IN (primary_key, longest_key)").selectExpr(
        "longest_key AS reference_key", "sequence_key"
    )
    second = cut_sizes(
        align_mirrors(overlap, sequences, records, proof).select("sequence_key", F.col("decision").alias("second_decision"))
    )
    checked = with_longest.join(second, "sequence_key", "left").withColumn(
        "isolated_reason",
        F.expr(
            """CASE WHEN sequence_key = primary_key THEN NULL WHEN NOT coalesce(proven, false) THEN first_decision
            WHEN second_decision <> 'mirror' THEN 'identity_conflict' END"""
        ),
    )
    # A conflict among longer continuations leaves no branch that can be trusted.
    facts = checked.groupBy("primary_key").agg(
        F.expr("max(CASE WHEN sequence_key = primary_key THEN length END) AS primary_length"),
        F.expr("max(CASE WHEN sequence_key = primary_key THEN owner_session_key END) AS group_session_key"),
        F.expr("coalesce(max(CASE WHEN isolated_reason = 'identity_conflict' THEN length END), -1) AS conflict_length"),
    )
    ruled = checked.join(facts, "primary_key").withColumn("split", F.expr("conflict_length > primary_length"))
    final = ruled.withColumn(
        "isolated_reason",
        F.expr("CASE WHEN isolated_reason IS NULL AND split AND sequence_key <> primary_key THEN 'identity_conflict' ELSE isolated_reason END"),
    )
    tail = final.where("isolated_reason IS NULL").groupBy("primary_key").agg(
        F.expr("min_by(sequence_key, struct(-length, sequence_key)) AS longest"), F.expr("max(length) AS record_count")
    )
    return final.join(tail, "primary_key").selectExpr(
        "namespace", "group_id", "sequence_key", "owner_session_key", "group_session_key", "primary_key",
        "longest AS longest_key", "primary_length", "record_count",
        "CASE WHEN sequence_key = primary_key THEN 'primary' WHEN isolated_reason IS NULL THEN 'member' ELSE 'isolated' END AS role",
        "isolated_reason",
    )


def plan_aliases(plan: DataFrame) -> DataFrame:
    """Mirror session keys of each canonical session."""
    return (
        plan.where("role = 'member' AND owner_session_key <> group_session_key")
        .selectExpr("owner_session_key AS alias_session_key", "group_session_key AS canonical_session_key")
        .distinct()
    )


def canonical_records(plan: DataFrame, records: DataFrame) -> DataFrame:
    """The records each canonical session counts: the primary's, then the longest copy's tail."""
    primary = plan.where("role = 'primary'").selectExpr("group_session_key", "primary_key AS sequence_key", "0L AS from_ordinal")
    tails = plan.where("role = 'primary' AND record_count > primary_length").selectExpr(
        "group_session_key", "longest_key AS sequence_key", "primary_length AS from_ordinal"
    )
    return (
        records.join(primary.unionByName(tails), "sequence_key").where("ordinal >= from_ordinal").drop("from_ordinal")
    )


def classify_copies(plan: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(provenance, pending) of records that are not canonical themselves.

    Copies of a canonical slot become mirror evidence and a verified_mirror duplicate;
    records of isolated sequences stay pending with the reason they were isolated for.
    Positions and times go along where the records have them.
    """
    more = [c for c in ("file_generation_id", "byte_offset", "event_time_ms") if c in records.columns]
    roles = plan.select("sequence_key", "role", "group_session_key", "longest_key", "primary_length", "isolated_reason")
    placed = records.join(roles, "sequence_key")
    is_origin = "(role = 'primary' OR (sequence_key = longest_key AND ordinal >= primary_length))"
    copies = placed.where(f"role <> 'isolated' AND NOT {is_origin}")
    provenance = copies.selectExpr("group_session_key", "ordinal", "sequence_key", "'mirror' AS role", *more)
    duplicates = copies.selectExpr("sequence_key", "ordinal", "'duplicate' AS kind", "'verified_mirror' AS reason_code", *more)
    isolated = placed.where("role = 'isolated'").selectExpr(
        "sequence_key", "ordinal", "'pending' AS kind", "isolated_reason AS reason_code", *more
    )
    return provenance, duplicates.unionByName(isolated)


def lineage_evidence(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Mark each child's records for accounting: inherited prefix, pending, or its own."""
    marks = decisions.selectExpr("sequence_key", "decision", "prefix AS inherited_prefix")
    return records.join(marks, "sequence_key", "left").withColumn(
        "lineage",
        F.expr(
            """CASE WHEN decision IS NULL OR decision = 'unrelated' THEN 'independent'
            WHEN decision <> 'inherited' THEN 'pending' WHEN ordinal < inherited_prefix THEN 'inherited' ELSE 'independent' END"""
        ),
    ).drop("decision", "inherited_prefix")


def request_identities(observations: DataFrame) -> DataFrame:
    """Compare each later use of a request identity in a session with its first use."""
    named = observations.where("request_namespace <> '' AND request_id <> ''")
    first = named.groupBy("session_key", "request_namespace", "request_id").agg(
        F.expr("min(row_id) AS first_row"), F.expr("min_by(struct(last), row_id) AS reference")
    )
    same = f"last <=> reference.last AND {V.validated_total('last')} IS NOT NULL"
    return named.join(first, ["session_key", "request_namespace", "request_id"]).where("row_id <> first_row").selectExpr(
        "session_key", "row_id", "first_row",
        f"CASE WHEN last IS NULL OR reference.last IS NULL THEN 'insufficient' WHEN {same} THEN 'duplicate' ELSE 'conflict' END AS decision",
    )


def cursor_decisions(incoming: DataFrame, canonical: DataFrame) -> DataFrame:
    """Place new records of a file against its canonical session: copy, append or rebuild.

    Both sides hold session_key, ordinal and signature. From a file's first mismatch on, all
    of its records ask for a rebuild.
    """
    slots = canonical.selectExpr("session_key", "ordinal", "signature AS slot")
    placed = incoming.join(slots, ["session_key", "ordinal"], "left")
    first_bad = placed.groupBy("session_key", "file_generation_id").agg(
        F.expr(f"coalesce(min(CASE WHEN slot <> signature THEN ordinal END), {NEVER}) AS first_bad")
    )
    return placed.join(first_bad, ["session_key", "file_generation_id"]).selectExpr(
        "session_key", "file_generation_id", "ordinal",
        "CASE WHEN ordinal >= first_bad THEN 'rebuild_required' WHEN slot IS NULL THEN 'append' ELSE 'copy' END AS decision",
    )


def parent_levels(edges: DataFrame) -> DataFrame:
    """Replay level of each session: parents before children, NULL for members of a cycle.

    ``edges``: session_key, parent_key (NULL for roots). Ancestors are found by pointer
    doubling, so rounds grow with the logarithm of the deepest fork chain.
    """
    known = edges.select("session_key", F.lit(True).alias("known"))
    rooted = edges.join(known.selectExpr("session_key AS parent_key", "known"), "parent_key", "left").selectExpr(
        "session_key", "CASE WHEN known THEN parent_key END AS ancestor"
    )
    state = cut_lineage(rooted.selectExpr("session_key", "ancestor", "CASE WHEN ancestor IS NULL THEN 0L ELSE 1L END AS level"))
    open_before = None
    while True:
        open_now = state.where("ancestor IS NOT NULL").count()
        if open_now == 0 or open_now == open_before:
            break
        open_before = open_now
        hop = state.selectExpr("session_key AS ancestor", "ancestor AS further", "level AS more")
        state = cut_lineage(
            state.join(hop, "ancestor", "left").selectExpr("session_key", "further AS ancestor", "level + coalesce(more, 0L) AS level")
        )
    return state.selectExpr("session_key", "CASE WHEN ancestor IS NULL THEN level END AS level")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph (a, b): each node with its smallest member.

    Labels spread to neighbours and are shortened through their own labels each round.
    """
    both = edges.selectExpr("a", "b").unionByName(edges.selectExpr("b AS a", "a AS b")).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy("a").agg(F.expr("least(a, min(b)) AS label")).selectExpr("a AS node", "label"))
    while True:
        offered = both.join(labels.selectExpr("node AS b", "label"), "b").groupBy("a").agg(F.expr("min(label) AS offer"))
        nearer = labels.join(offered.withColumnRenamed("a", "node"), "node").selectExpr(
            "node", "label AS old", "least(label, offer) AS label"
        )
        jump = nearer.selectExpr("node AS label", "label AS further")
        moved = cut_lineage(
            nearer.join(jump, "label", "left").selectExpr("node", "old", "least(label, coalesce(further, label)) AS label")
        )
        if moved.where("label <> old").isEmpty():
            return moved.select("node", F.col("label").alias("component"))
        labels = moved.select("node", "label")


def seeded_closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): all nodes that undirected ``edges`` (a, b) tie to the ``seeds`` (node), seeds included.

    A search from the seeds: each round reads the edges against the nodes found in the round
    before and keeps what is new. While those nodes are few they are sent to the edges, so only
    matches are shuffled and written; the rest of the graph is scanned and left alone. The rounds
    follow the distance of the farthest node.
    """
    both = edges.selectExpr("a", "b").unionByName(edges.selectExpr("b AS a", "a AS b"))
    frontier = reached = cut_lineage(seeds.select("node").distinct())
    while found := frontier.count():
        asked = frontier.withColumnRenamed("node", "a")
        met = both.join(F.broadcast(asked) if found <= MAX_SENT_NODES else asked, "a", "left_semi").select(F.col("b").alias("node"))
        frontier = cut_lineage(met.distinct().join(reached, "node", "left_anti"))
        reached = reached.unionByName(frontier)
    return reached


def dependency_closure(sessions: DataFrame, aliases: DataFrame, seeds: DataFrame) -> DataFrame:
    """All sessions tied to the seeds by parent, same provider id or alias edges.

    Sessions of one provider id are tied through a node of that id, so no group is ever paired.
    """
    parents = sessions.where("parent_key IS NOT NULL").selectExpr("concat('s', session_key) AS a", "concat('s', parent_key) AS b")
    mirrors = aliases.selectExpr("concat('s', alias_session_key) AS a", "concat('s', canonical_session_key) AS b")
    same = sessions.where("provider_session_id IS NOT NULL").selectExpr("concat('s', session_key) AS a", "concat('i', provider_session_id) AS b")
    ends = sessions.select("session_key").unionByName(sessions.where("parent_key IS NOT NULL").selectExpr("parent_key AS session_key"))
    ends = ends.unionByName(aliases.selectExpr("explode(array(alias_session_key, canonical_session_key)) AS session_key"))
    known = seeds.select("session_key").join(ends, "session_key", "left_semi").selectExpr("concat('s', session_key) AS node")
    found = seeded_closure(parents.unionByName(mirrors).unionByName(same), known)
    return found.where("startswith(node, 's')").selectExpr("substring(node, 2) AS session_key")


def manifest_changes(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """Rows by which a frozen input manifest and the present one differ; empty means fresh."""
    current = current.select(*frozen.columns)
    gone = frozen.exceptAll(current).withColumn("change", F.lit("gone"))
    return gone.unionByName(current.exceptAll(frozen).withColumn("change", F.lit("new")))


def unclassified(usage: DataFrame, events: DataFrame, pending: DataFrame) -> DataFrame:
    """Usage observations that are not exactly one of event or non-event; must be empty."""
    marks = usage.selectExpr("observation_id", "1 AS asked", "0 AS marks", "0 AS as_event", "0 AS as_pending").unionByName(
        events.selectExpr("observation_id", "0 AS asked", "1 AS marks", "1 AS as_event", "0 AS as_pending")
    ).unionByName(
        pending.where("kind IS NOT NULL").selectExpr(
            "observation_id", "0 AS asked", "1 AS marks", "0 AS as_event", "CASE WHEN kind <> 'unattributed' THEN 1 ELSE 0 END AS as_pending"
        )
    )
    counted = marks.groupBy("observation_id").agg(*[F.sum(c).alias(c) for c in ("asked", "marks", "as_event", "as_pending")])
    doubtful = "observation_id IS NULL OR marks = 0 OR as_event > 1 OR (as_event = 1 AND as_pending > 0)"
    return counted.where(f"asked > 0 AND ({doubtful})").selectExpr("explode(array_repeat(observation_id, CAST(asked AS INT))) AS observation_id")


def rebuild_audit(old_events: DataFrame, new_events: DataFrame) -> DataFrame:
    """Old and new event counts and totals per session, for the audit row of a publication."""

    def side(events: DataFrame, name: str) -> DataFrame:
        return events.groupBy("session_key").agg(
            F.expr(f"count(1) AS {name}_events"), F.expr(f"sum(CAST(total_tokens AS DECIMAL(38,0))) AS {name}_total")
        )

    both = side(old_events, "old").unionByName(side(new_events, "new"), allowMissingColumns=True)
    return both.groupBy("session_key").agg(
        *[F.expr(f"coalesce(sum({c}), 0) AS {c}") for c in ("old_events", "new_events")],
        *[F.expr(f"coalesce(sum({c}), CAST(0 AS DECIMAL(38,0))) AS {c}") for c in ("old_total", "new_total")],
    )


def publish_ledger(sessions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Point sessions at their validated candidate ledger; all others stay as they are."""
    return sessions.join(candidates.selectExpr("session_key", "ledger_id AS next_ledger"), "session_key", "left").withColumn(
        "active_ledger_id", F.coalesce("next_ledger", "active_ledger_id")
    ).drop("next_ledger")


def resolve_parents(sessions: DataFrame, canonical: DataFrame) -> DataFrame:
    """parent_key from the parent's provider id, set only if exactly one canonical session has it."""
    owners = canonical.groupBy(F.col("provider_session_id").alias("parent_provider_id")).agg(
        F.expr("CASE WHEN count(DISTINCT session_key) = 1 THEN min(session_key) END AS resolved_parent")
    )
    return sessions.join(owners, "parent_provider_id", "left").select("session_key", "parent_provider_id", "resolved_parent")


def stream_frontier(states: DataFrame, order: str = "ordinal") -> DataFrame:
    """Latest state of every stream of a session."""
    kept = [c for c in states.columns if c not in ("session_key", "stream_key")]
    latest = states.groupBy("session_key", "stream_key").agg(F.expr(f"max_by(struct({', '.join(kept)}), {order}) AS row"))
    return latest.select("session_key", "stream_key", *[F.col(f"row.{c}").alias(c) for c in kept])


def proof_candidates(sessions: DataFrame, pending: DataFrame, attempts: DataFrame, limit: int = 3) -> DataFrame:
    """Sessions with unproven evidence that changed since the last try and has tries left."""
    evidence = (
        pending.where("kind = 'pending'")
        .groupBy("session_key")
        .agg(F.expr("count(1) AS unproven"), F.expr("sum(CAST(xxhash64(pending_id) AS DECIMAL(38,0))) AS evidence"))
        .withColumn("evidence", F.expr("sha2(CAST(evidence AS STRING), 256)"))
    )
    joined = sessions.where("active_ledger_id IS NOT NULL").join(evidence, "session_key").join(attempts, "session_key", "left")
    return joined.where(f"tries IS NULL OR last_evidence <> evidence OR tries < {limit}").select("session_key", "unproven", "evidence")


EVIDENCE_OF_PENDING = ["session_key", "file_generation_id", "byte_offset", "observed_at_ms", "reason_code", "vector_json"]


def proof_jobs(
    sessions: DataFrame, aliases: DataFrame, ledgers: DataFrame, pending: DataFrame, attempts: DataFrame, parser: str, accounting: str, limit: int = 3
) -> DataFrame:
    """(session_key, why, unproven, job_hash, tries): sessions to be judged again.

    A published session that is no alias is due while it holds unproven records or was judged by
    other versions than ``parser`` and ``accounting``. What a job would look at is hashed, contents
    and target versions: a job that was done is not repeated before something of it changes, one
    that failed is repeated up to ``limit`` times. ``attempts``: session_key, job_hash, tries, done.
    """
    from tallyline.operators.rollup import content_digest

    unproven = pending.where("kind = 'pending'")
    evidence = content_digest(unproven.select(*EVIDENCE_OF_PENDING), ["session_key"])
    counts = unproven.groupBy("session_key").agg(F.count("*").alias("unproven"))
    live = sessions.where("active_ledger_id IS NOT NULL").join(aliases.selectExpr("alias_session_key AS session_key"), "session_key", "left_anti")
    versions = ledgers.selectExpr("ledger_id AS active_ledger_id", f"NOT (parser_version <=> '{parser}' AND accounting_version <=> '{accounting}') AS outdated")
    due = (
        live.select("session_key", "active_ledger_id").join(versions, "active_ledger_id")
        .join(counts, "session_key", "left").join(evidence, "session_key", "left")
        .where("outdated OR unproven > 0")
        .withColumn("job_hash", F.sha2(F.concat_ws("|", F.coalesce("digest", F.lit("none")), F.lit(parser), F.lit(accounting)), 256))
    )
    tried = attempts.selectExpr("session_key", "job_hash AS last_hash", "tries AS last_tries", "done AS last_done")
    judged = due.join(tried, "session_key", "left").where(
        f"last_hash IS NULL OR last_hash <> job_hash OR (NOT last_done AND last_tries < {limit})"
    )
    return judged.selectExpr(
        "session_key", "CASE WHEN outdated THEN 'upgrade' ELSE 'unproven' END AS why", "coalesce(unproven, 0L) AS unproven", "job_hash",
        "CASE WHEN last_hash = job_hash THEN last_tries ELSE 0 END AS tries",
    )


def record_attempts(attempts: DataFrame, jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The retry ledger after ``jobs`` that ended (outcomes: session_key, done); one row a session."""
    ended = jobs.join(outcomes, "session_key").selectExpr("session_key", "job_hash", "tries + 1 AS tries", "done")
    return attempts.join(ended, "session_key", "left_anti").select("session_key", "job_hash", "tries", "done").unionByName(ended)
