"""Quota readings kept as a log: one JSON text per reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyline.model import QUOTA_STALE_MS, WEEK_MINUTES
from tallyline.functions import text as X
from tallyline.session import cut_sizes, small_methods

# Names a reading and its answers use.
DEFAULT_LIMIT = "codex"
LEGACY_LIMIT = "legacy"
WINDOWS = ("primary", "secondary")


def _at(path: str, base: str = "doc") -> str:
    return f"variant_get({base}, '$.{path}', 'variant')"


def _kind(value: str) -> str:
    return f"coalesce(schema_of_variant({value}), 'VOID')"


def _object(value: str) -> str:
    """Only an object becomes a struct; its kind would spell out the types of all it holds."""
    return f"(try_variant_get({value}, '$', 'struct<type:variant>') IS NOT NULL)"


def _absent(value: str) -> str:
    return f"({value} IS NULL OR is_variant_null({value}))"


def _text(value: str) -> str:
    return f"CASE WHEN {_kind(value)} = 'STRING' THEN CAST({value} AS STRING) END"


def _named(text: str) -> str:
    return f"coalesce(octet_length({text}) BETWEEN 1 AND 256 AND NOT {text} RLIKE '[\\\\x00-\\\\x1f\\\\x7f-\\\\x9f]', false)"


def parse_readings(readings: DataFrame) -> DataFrame:
    """One row per limit of each reading (account, seq, at_ms, is_read, reading).

    kind: replace (a full read, or a map of limits), limit (an update of one named limit) or
    unidentified (an update without a name). A reading with any unusable limit is rejected
    as a whole.
    """
    # The limits of a reading meet again in the end, so readings are dealt out before they are parsed.
    dealt = readings.where("account IS NOT NULL AND seq IS NOT NULL").repartition("account", "seq")
    doc = dealt.withColumn("doc", F.expr("try_parse_json(reading)")).withColumns(
        {"many": F.expr(_at("rateLimitsByLimitId")), "single": F.expr(_at("rateLimits"))}
    )
    listed = doc.withColumn(
        "entries",
        F.expr(
            f"CASE WHEN {_object('many')} THEN"
            f" transform(map_entries(CAST(many AS MAP<STRING, VARIANT>)), e -> named_struct('map_id', e.key, 'body', e.value))"
            f" WHEN {_absent('many')} AND NOT {_absent('single')} THEN array(named_struct('map_id', CAST(NULL AS STRING), 'body', single)) END"
        ),
    )
    exploded = listed.select(
        "account", "seq", "at_ms", F.expr(f"is_read OR NOT {_absent('many')}").alias("is_full"),
        F.expr("entries IS NULL").alias("bad_shape"),
        F.expr("explode_outer(entries) AS e"),
    ).select("*", F.expr("e.map_id AS map_id"), F.expr("e.body AS body")).drop("e")
    found = {"declared_id": F.expr(_at("limitId", "body")), "label": F.expr(_at("limitName", "body"))}
    found |= {w: F.expr(_at(w, "body")) for w in WINDOWS}
    named = exploded.withColumns(found).withColumns(
        {"declared_kind": F.expr(_kind("declared_id")), "declared": F.expr(_text("declared_id")), "label": F.expr(_text("label"))}
    )
    limit_id = f"coalesce(map_id, declared, '{LEGACY_LIMIT}')"
    bad = (
        f"bad_shape OR NOT {_object('body')} OR declared_kind NOT IN ('VOID', 'STRING')"
        f" OR (declared IS NOT NULL AND NOT {_named('declared')}) OR coalesce(map_id <> declared, false) OR NOT {_named(limit_id)}"
        + "".join(f" OR (NOT {_absent(w)} AND NOT {_object(w)})" for w in WINDOWS)
    )
    fields = {"used": "usedPercent", "mins": "windowDurationMins", "reset": "resetsAt"}
    parts = {f"{w}_{n}": F.expr(_at(field, w)) for w in WINDOWS for n, field in fields.items()}
    checked = named.withColumn("limit_bad", F.expr(f"coalesce({bad}, true)")).withColumns(parts)
    numbers = ("'BIGINT'", "'DOUBLE'", "'FLOAT'")

    def values(name: str) -> dict[str, str]:
        used, mins, reset = (f"{name}_{n}" for n in fields)
        return {
            used: f"CASE WHEN {_kind(used)} IN ({', '.join(numbers)}) OR {_kind(used)} LIKE 'DECIMAL%' THEN try_variant_get({used}, '$', 'double') END",
            mins: f"CASE WHEN {_kind(mins)} = 'BIGINT' THEN try_variant_get({mins}, '$', 'bigint') END",
            reset: f"CASE WHEN {_kind(reset)} = 'BIGINT' THEN try_multiply(try_variant_get({reset}, '$', 'bigint'), 1000L) END",
        }

    def window(name: str) -> str:
        used, mins, reset = (f"{name}_{n}" for n in fields)
        return (
            f"CASE WHEN {_object(name)} THEN named_struct('window_id', '{name}',"
            f" 'duration_mins', CASE WHEN {mins} BETWEEN 1 AND 4294967295 THEN {mins} END, 'used_percent', {used},"
            f" 'remaining_percent', greatest(least(100.0D - ({used}), 100.0D), 0.0D) + 0.0D * ({used}),"
            f" 'resets_at_ms', CASE WHEN {reset} BETWEEN -8640000000000000 AND 8640000000000000 THEN {reset} END) END"
        )

    checked = checked.withColumns({n: F.expr(e) for w in WINDOWS for n, e in values(w).items()})
    windows = f"filter(array({', '.join(window(w) for w in WINDOWS)}), w -> w IS NOT NULL)"
    rows = checked.selectExpr(
        "account", "seq", "at_ms", "is_full", "limit_bad", f"{limit_id} AS limit_id",
        f"CASE WHEN {_named('label')} THEN label END AS display_name",
        "map_id IS NULL AND declared IS NULL AS unnamed",
        f"CASE WHEN NOT limit_bad THEN {windows} END AS windows",
    )
    # A reading holds at most 128 limits, so its verdict is a small window; texts are parsed once.
    judged = rows.withColumn("rejected", F.bool_or("limit_bad").over(Window.partitionBy("account", "seq")))
    return judged.where("NOT rejected").selectExpr(
        "account", "seq", "at_ms", "CASE WHEN is_full THEN 'replace' WHEN unnamed THEN 'unidentified' ELSE 'limit' END AS kind",
        "limit_id", "display_name", "unnamed AS legacy_identity", "windows",
    )


def with_roles(limits: DataFrame) -> DataFrame:
    """Weekly and shortest windows, by duration alone and only when unambiguous."""
    weekly = f"filter(windows, w -> w.duration_mins = {WEEK_MINUTES})"
    shorter = f"array_min(transform(filter(windows, w -> w.duration_mins < {WEEK_MINUTES}), w -> w.duration_mins))"
    return (
        limits.withColumn("weekly_all", F.expr(weekly))
        .withColumn("shortest_mins", F.expr(shorter))
        .withColumn("shortest_all", F.expr("filter(windows, w -> w.duration_mins = shortest_mins)"))
        .withColumns(
            {
                "weekly": F.expr("CASE WHEN size(weekly_all) = 1 THEN weekly_all[0] END"),
                "shortest": F.expr("CASE WHEN size(shortest_all) = 1 THEN shortest_all[0] END"),
            }
        )
        .drop("weekly_all", "shortest_all", "shortest_mins")
    )


def current_book(limits: DataFrame) -> DataFrame:
    """Limits in force per account after applying all readings in order.

    The last full reading starts the book; an unidentified update replaces it while a single
    unnamed limit is all it holds; later named updates replace their own limit. Updates
    before the first full reading do not count.
    """
    with small_methods(limits.sparkSession):
        limits = cut_sizes(limits)  # read five times below, and parsing is the costly part
    fulls = limits.where("kind = 'replace'").groupBy("account", "seq").agg(
        F.expr("count(1) AS limit_count"), F.expr("bool_and(legacy_identity) AS all_legacy")
    )
    last_full = fulls.groupBy("account").agg(
        F.expr("max(seq) AS full_seq"), F.expr("max_by(limit_count = 1 AND all_legacy, seq) AS full_is_legacy")
    )
    later = limits.join(last_full, "account").where("seq > full_seq")
    first_named = later.where("kind = 'limit'").groupBy("account").agg(F.expr("min(seq) AS named_seq"))
    unnamed = (
        later.where("kind = 'unidentified' AND full_is_legacy")
        .join(first_named, "account", "left")
        .where("named_seq IS NULL OR seq < named_seq")
        .groupBy("account")
        .agg(F.expr("max(seq) AS legacy_seq"))
    )
    base = last_full.join(unnamed, "account", "left").selectExpr("account", "greatest(full_seq, legacy_seq) AS base_seq")
    kept = limits.join(base, "account").where("seq = base_seq OR (kind = 'limit' AND seq > base_seq)")
    latest = kept.groupBy("account", "limit_id").agg(
        F.expr("max_by(struct(seq, at_ms, kind, display_name, legacy_identity, windows), seq) AS row")
    )
    return latest.select("account", "limit_id", "row.*")


def selected_limit(book: DataFrame, explicit: str | None = None) -> DataFrame:
    """The limit to show per account: the explicit one, else the default name, else the only one."""
    picked = book.groupBy("account").agg(
        F.expr(f"count_if(limit_id = '{explicit or ''}') AS explicit_found"),
        F.expr(f"count_if(limit_id = '{DEFAULT_LIMIT}') AS default_found"),
        F.expr("count(1) AS limits"),
        F.expr("min(limit_id) AS only_id"),
    )
    if explicit is not None:
        choice = f"CASE WHEN explicit_found > 0 THEN '{explicit}' END"
    else:
        choice = f"CASE WHEN default_found > 0 THEN '{DEFAULT_LIMIT}' WHEN limits = 1 THEN only_id END"
    return picked.selectExpr("account", f"{choice} AS limit_id")


def with_staleness(book: DataFrame, as_of_ms: int) -> DataFrame:
    return book.withColumn("stale", F.lit(as_of_ms) - F.col("at_ms") >= QUOTA_STALE_MS)


def period_label(mins: str) -> str:
    return (
        f"CASE WHEN {mins} IS NULL THEN '未知周期' WHEN {mins} = {WEEK_MINUTES} THEN '周额度'"
        f" WHEN {mins} > 0 AND {mins} % 60 = 0 THEN concat({mins} div 60, ' 小时额度') ELSE concat({mins}, ' 分钟额度') END"
    )


def countdown(reset_ms: str, now_ms: str) -> str:
    minutes = f"CAST(ceil(({reset_ms} - {now_ms}) / 60000) AS BIGINT)"
    return (
        f"CASE WHEN {reset_ms} IS NULL THEN '时间未提供' WHEN {reset_ms} <= {now_ms} THEN '等待额度更新'"
        f" WHEN {minutes} >= 1440 THEN concat({minutes} div 1440, '天 ', {minutes} % 1440 div 60, '小时')"
        f" WHEN {minutes} >= 60 THEN concat({minutes} div 60, '小时 ', {minutes} % 60, '分钟') ELSE concat({minutes}, '分钟') END"
    )


def window_rows(book: DataFrame, now_ms: int) -> DataFrame:
    """One row per window as it is displayed."""
    rows = book.select("*", F.explode("windows").alias("w")).select(*[c for c in book.columns if c != "windows"], "w.*")
    return rows.withColumns(
        {
            "period": F.expr(period_label("duration_mins")),
            "resets_in": F.expr(countdown("resets_at_ms", f"{now_ms}L")),
            "remaining_text": X.percent_text(F.col("remaining_percent")),
            "low": X.low_remaining(F.col("remaining_percent")),
        }
    )
