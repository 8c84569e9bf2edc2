"""Published rate catalogs: validation, flat and conditional quotes, history by time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyline.functions import text as X, vectors as V
from tallyline.model import MAX_CATALOG_ENTRIES, SHORT_CONTEXT_MAX_INPUT
from tallyline.operators import pricing as P
from tallyline.session import require_at_most

# Tiers and context bands of a quote.
TIERS = ("standard", "batch", "flex", "fast", "ultrafast")
BANDS = ("all", "short", "long")
RATE_TEXTS = ("input_per_million", "cached_per_million", "cache_write_per_million", "output_per_million")
RATE_COLUMNS = ("input_rate_atoms", "cached_rate_atoms", "cache_write_rate_atoms", "output_rate_atoms")


def quotes(catalogs: DataFrame) -> DataFrame:
    """One row per quote of each published catalog document."""
    header = [c for c in catalogs.columns if c != "entries"]
    return catalogs.select(*header, F.explode("entries").alias("entry")).select(*header, "entry.*")


def with_rates(quoted: DataFrame) -> DataFrame:
    return quoted.withColumns({c: X.rate_atoms(F.col(t)) for c, t in zip(RATE_COLUMNS, RATE_TEXTS)})


def catalog_problems(catalogs: DataFrame) -> DataFrame:
    """Quotes and headers that break the catalog contract: (catalog_id, model_exact, problem)."""
    rated = with_rates(quotes(catalogs))
    bad_rate: Column = F.lit(False)
    for rate, text in zip(RATE_COLUMNS, RATE_TEXTS):
        bad_rate = bad_rate | (F.col(text).isNotNull() & F.col(rate).isNull())
    bad_rate = bad_rate | F.col("input_per_million").isNull() | F.col("output_per_million").isNull()
    per_quote = rated.select(
        "catalog_id",
        "model_exact",
        F.when(~F.coalesce(F.col("model_exact").rlike("^[a-z0-9.-]{1,128}$"), F.lit(False)), F.lit("bad_model"))
        .when(~F.coalesce(F.col("tier").isin(*TIERS) & F.col("context").isin(*BANDS), F.lit(False)), F.lit("bad_tier"))
        .when(bad_rate, F.lit("bad_rate"))
        .alias("problem"),
    ).where(F.col("problem").isNotNull())
    doubled = (
        rated.groupBy("catalog_id", "model_exact", "tier", "context")
        .count()
        .where(F.col("count") > 1)
        .select("catalog_id", "model_exact", F.lit("repeated_quote").alias("problem"))
    )
    is_all = F.col("context") == "all"
    mixed = (
        rated.groupBy("catalog_id", "model_exact", "tier")
        .agg(F.bool_or(is_all).alias("flat"), F.bool_or(~is_all).alias("banded"))
        .where(F.col("flat") & F.col("banded"))
        .select("catalog_id", "model_exact", F.lit("mixed_bands").alias("problem"))
    )
    size = F.size("entries")
    header = catalogs.select(
        "catalog_id",
        F.lit(None).cast("string").alias("model_exact"),
        F.when(F.col("format_version") != 1, F.lit("bad_version"))
        .when((size < 1) | (size > MAX_CATALOG_ENTRIES), F.lit("bad_size"))
        .when(F.col("short_context_max_input") != SHORT_CONTEXT_MAX_INPUT, F.lit("bad_band_limit"))
        .when(~F.col("currency").rlike("^[A-Z]{3}$"), F.lit("bad_currency"))
        .alias("problem"),
    ).where(F.col("problem").isNotNull())
    return per_quote.unionByName(doubled).unionByName(mixed).unionByName(header)


def flat_standard_rules(catalogs: DataFrame) -> DataFrame:
    """Quotes an aggregate vector can be priced with: standard tier, one band, no write rate."""
    flat = with_rates(quotes(catalogs)).where(
        (F.col("tier") == "standard") & (F.col("context") == "all") & F.col("cache_write_per_million").isNull()
    )
    return _as_rules(flat, F.concat_ws("/", F.lit("offline"), "catalog_id", "model_exact"))


def conditional_quotes(catalogs: DataFrame) -> DataFrame:
    """Every quote as an immutable rule with a stable identity, plus its tier and band."""
    rated = with_rates(quotes(catalogs))
    identity = F.concat_ws("/", F.lit("offline"), "catalog_id", "model_exact", "tier", "context")
    return _as_rules(rated, identity, "catalog_id", "tier", "context", "reference_basis")


def _as_rules(rated: DataFrame, identity: Column, *extra: str) -> DataFrame:
    return rated.select(
        identity.alias("rule_id"),
        F.col("introduced_revision").cast("long").alias("introduced_revision"),
        F.lit(None).cast("long").alias("retired_revision"),
        "provider",
        "model_exact",
        F.lit(None).cast("string").alias("source_id"),
        "currency",
        F.col("verified_at_ms").alias("effective_from_ms"),
        F.lit(None).cast("long").alias("effective_to_ms"),
        F.lit(0).alias("priority"),
        *RATE_COLUMNS,
        F.lit("offline").alias("origin"),
        *extra,
    )


def historical_rule_id(revision: Column, rule_id: Column) -> Column:
    """Identity of a closed flat rule, hashed over the JSON pair [revision, rule id]."""
    quoted = F.regexp_replace(F.to_json(F.array(rule_id)), r"^\[", "")
    pair = F.concat(F.lit("["), revision.cast("string"), F.lit(","), quoted)
    return F.concat(F.lit("offline-history/"), X.sha(pair))


def publish(rules: DataFrame, catalog: DataFrame, revision: int) -> DataFrame:
    """Rate table after publishing a catalog (one row, with introduced_revision = revision).

    The open flat rules of the former catalog retire, and live on as history rows that end
    where the new catalog was verified; older revisions keep seeing what they saw.
    """
    verified = catalog.select(F.col("verified_at_ms").alias("new_verified_ms"))
    # One catalog row: a fixed-size side.
    rules = rules.join(F.broadcast(verified), F.lit(True))
    ours = (
        (F.col("origin") == "offline")
        & F.col("rule_id").startswith("offline/")
        & F.col("retired_revision").isNull()
    )
    closed = rules.withColumn(
        "retired_revision", F.when(ours, F.lit(revision).cast("long")).otherwise(F.col("retired_revision"))
    )
    history = rules.where(ours & (F.col("effective_from_ms") < F.col("new_verified_ms"))).withColumns(
        {
            "rule_id": historical_rule_id(F.lit(revision), F.col("rule_id")),
            "introduced_revision": F.lit(revision).cast("long"),
            "effective_to_ms": F.col("new_verified_ms"),
        }
    )
    fresh = flat_standard_rules(catalog)
    return closed.drop("new_verified_ms").unionByName(history.drop("new_verified_ms")).unionByName(fresh)


def publication_models(publications: DataFrame, revision: int) -> DataFrame:
    """(provider, publication, model) rows: its interval, its flat rule now, and its quotes.

    ``publications`` are catalog documents with introduced_revision. A later publication
    closes the interval of the former one of the same provider, so a model that was dropped
    never falls back to an older quote.
    """
    seen = publications.where(F.col("introduced_revision") <= revision)
    order = Window.partitionBy("provider").orderBy("introduced_revision")
    later = Window.partitionBy("provider").orderBy("verified_at_ms", "introduced_revision")
    # Publications are few: their quotes together are checked below.
    dated = seen.withColumns(
        {
            "next_revision": F.lead("introduced_revision").over(order),
            "until_ms": F.lead("verified_at_ms").over(later),
        }
    )
    rated = with_rates(quotes(dated))
    flat = (F.col("tier") == "standard") & (F.col("context") == "all") & F.col("cache_write_per_million").isNull()
    first_id = F.concat_ws("/", F.lit("offline"), "catalog_id", "model_exact")
    now_id = F.when(F.col("next_revision").isNull(), first_id).otherwise(
        historical_rule_id(F.col("next_revision"), first_id)
    )
    quote = F.struct(
        F.concat_ws("/", F.lit("offline"), "catalog_id", "model_exact", "tier", "context").alias("rule_id"),
        "introduced_revision",
        F.lit(None).cast("string").alias("source_id"),
        "currency",
        F.col("verified_at_ms").alias("effective_from_ms"),
        F.lit(None).cast("long").alias("effective_to_ms"),
        F.lit(0).alias("priority"),
        *RATE_COLUMNS,
        F.lit("offline").alias("origin"),
        F.lit(100_000).alias("rank"),
        "tier",
        "context",
    )
    return rated.groupBy(
        F.col("provider").alias("pub_provider"),
        F.col("model_exact").alias("pub_model"),
        "catalog_id",
        "reference_basis",
        "verified_at_ms",
        "until_ms",
        "short_context_max_input",
    ).agg(
        F.max(F.when(flat, now_id)).alias("flat_rule_id"),
        F.collect_list(quote).alias("quotes"),
    )


# What a response proved about an event; NULL where there is no such proof.
REQUEST_EVIDENCE = {"actual_tier": "string", "request_input": "struct<input_tokens:bigint,binding:string>"}


def with_request_evidence(events: DataFrame) -> DataFrame:
    """Events with the columns that ``with_catalog`` reads, NULL where the events have none."""
    return events.withColumns({n: F.lit(None).cast(t) for n, t in REQUEST_EVIDENCE.items() if n not in events.columns})


def published_rules(rules: DataFrame, publications: DataFrame, revisions: Sequence[int]) -> DataFrame:
    """The rate table after publishing each revision's catalog in turn.

    A catalog that was published before, under whatever revision, adds nothing: its rules are
    known by the catalog's id.
    """
    for revision in sorted(revisions):
        document = publications.where(F.col("introduced_revision") == revision)
        known = rules.where("origin = 'offline'").select(F.split_part("rule_id", F.lit("/"), F.lit(2)).alias("catalog_id")).distinct()
        if not document.join(known, "catalog_id", "left_anti").isEmpty():
            rules = publish(rules, document, revision)
    return rules


def with_catalog(selected: DataFrame, publications: DataFrame, revision: int) -> DataFrame:
    """Refine chosen rules with the catalog that was in force at the priced time.

    ``selected`` carries rule, rule_ambiguous, price_at_ms and, where a response confirmed
    them, actual_tier and request_input (struct of input_tokens and binding).
    """
    table = require_at_most(
        publication_models(publications, revision), 64 * MAX_CATALOG_ENTRIES, "catalog history"
    )
    versions = table.groupBy(F.col("pub_provider"), F.col("pub_model")).agg(
        F.collect_list(
            F.struct(
                "verified_at_ms",
                "until_ms",
                "catalog_id",
                "reference_basis",
                "short_context_max_input",
                "flat_rule_id",
                "quotes",
            )
        ).alias("versions")
    )
    joined = selected.join(
        F.broadcast(versions),
        (F.col("provider") == F.col("pub_provider")) & (F.col("canonical_model") == F.col("pub_model")),
        "left",
    )
    at = F.col("price_at_ms")
    in_force = F.filter(
        "versions", lambda v: (v.verified_at_ms <= at) & (v.until_ms.isNull() | (at < v.until_ms))
    )
    joined = joined.withColumn("reference", F.get(in_force, F.lit(0)))
    owns_flat = (
        "coalesce(rule.origin = 'offline' AND rule.priority = 0 AND rule.rule_id = reference.flat_rule_id, false)"
    )
    quote_fits = "q.tier = actual_tier AND (q.context = 'all' OR q.context = band)"
    rule_fields = ", ".join(f"'{f}', quote.{f}" for f in (*P.RULE_FIELDS, "rank"))
    return (
        joined.withColumns(
            {
                "owns_flat": F.expr(owns_flat),
                "band": F.expr(
                    "CASE WHEN request_input.input_tokens <= reference.short_context_max_input"
                    " THEN 'short' ELSE 'long' END"
                ),
            }
        )
        .withColumns(
            {
                "confirmed": F.expr(
                    "reference IS NOT NULL AND (rule IS NULL OR owns_flat)"
                    " AND actual_tier IS NOT NULL AND NOT rule_ambiguous"
                ),
                "quote": F.expr(
                    "CASE WHEN request_input.binding = 'full_request'"
                    f" THEN get(filter(reference.quotes, q -> {quote_fits}), 0) END"
                ),
            }
        )
        .withColumns(
            {
                "conditions_missing": F.expr(
                    "CASE WHEN confirmed THEN quote IS NULL ELSE rule IS NULL AND reference IS NOT NULL"
                    " AND reference.flat_rule_id IS NULL END"
                ),
                "selection": F.expr(
                    "CASE WHEN confirmed THEN CASE WHEN quote IS NOT NULL THEN 'request' END"
                    " WHEN owns_flat THEN 'offline_standard' WHEN rule IS NOT NULL THEN 'rule' END"
                ),
                "reference_catalog_id": F.expr("CASE WHEN confirmed OR owns_flat THEN reference.catalog_id END"),
                "quote_context": F.expr("CASE WHEN confirmed THEN quote.context END"),
                "rule": F.expr(
                    f"CASE WHEN confirmed THEN CASE WHEN quote IS NOT NULL THEN named_struct({rule_fields}) END"
                    " ELSE rule END"
                ),
            }
        )
        .drop("versions", "pub_provider", "pub_model", "reference", "quote", "band", "owns_flat", "confirmed")
    )


def explanation(priced: DataFrame) -> DataFrame:
    """Kind of the rule that decided an outcome, as shown beside an event."""
    kind = (
        F.when(F.col("selection") == "request", F.lit("offline_request_reference"))
        .when(F.col("selection") == "offline_standard", F.lit("offline_standard_reference"))
        .when(F.col("rule.origin") == "custom", F.lit("custom_rule"))
        .when(F.col("rule").isNotNull(), F.lit("offline_rule"))
    )
    chosen = F.col("rule").isNotNull() & ~F.col("rule_ambiguous")
    return priced.withColumns(
        {
            "matched_kind": F.when(chosen, kind),
            "matched_rule_id": F.when(chosen, F.col("rule.rule_id")),
            "matched_source_specific": F.when(
                chosen & (F.col("rule.origin") == "custom"), F.col("rule.source_id").isNotNull()
            ),
        }
    )


def request_input(evidence: str, turn_id: str, generation: str, offset: str,
                  last: str, cumulative: str, consumption: str) -> str:
    """Exact request input of an event, where the response record proves it (SQL text).

    ``evidence`` is a struct of response_id, turn_id, file_generation_id, byte_end, usage and
    thread_usage. The record must name the same turn, precede the usage in the same file and
    agree with its last and cumulative counts.
    """
    e = evidence
    named = " AND ".join(
        rf"length({e}.{c}) BETWEEN 1 AND 256 AND NOT {e}.{c} RLIKE '\\p{{Cntrl}}'" for c in ("response_id", "turn_id")
    )
    agrees = (
        f"{turn_id} = {e}.turn_id AND {generation} = {e}.file_generation_id AND {e}.byte_end <= {offset}"
        f" AND {last} <=> {e}.usage AND {cumulative} <=> {e}.thread_usage"
        f" AND {e}.usage.output_total IS NOT NULL AND {e}.usage.input_total IS NOT NULL"
    )
    response, thread = V.validated_total(f"{e}.usage"), V.validated_total(f"{e}.thread_usage")
    # The parts a response may not exceed its thread in.
    exceeds = " OR ".join(
        f"coalesce({e}.usage.{n} > {e}.thread_usage.{n}, false)"
        for n in ("input_total", "cached_input", "cache_write_input", "output_total", "reasoning_output")
    )
    binding = f"CASE WHEN {consumption} <=> {e}.usage THEN 'full_request' ELSE 'different_consumption' END"
    return (
        f"CASE WHEN {e} IS NOT NULL AND {named} AND {agrees} AND {thread} >= {response} AND NOT ({exceeds})"
        f" AND {V.validated_total(consumption)} IS NOT NULL"
        f" THEN named_struct('input_tokens', {e}.usage.input_total, 'binding', {binding}) END"
    )
