"""The small rate tables used by the registered checks, for Spark and as SQL VALUES."""

from __future__ import annotations

import hashlib
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from tallyline.model import CATALOG, MODEL_ALIAS, PRICE_RULE

REVISION = 2
MID = 1_705_000_000_000
FAR = 1_600_000_000_000

# rule_id, introduced, retired, provider, model, source, currency, from, to, priority,
# input, cached, write, output, origin
RULES = [
    ("r-old", 1, 2, "alpha", "view", None, "USD", FAR, None, 5, 9, 9, 9, 9, "custom"),
    ("r-view", 1, None, "alpha", "view", None, "USD", FAR, MID, 5, 2_000_000_000, 500_000_000, 2_500_000_000, 8_000_000_000, "custom"),
    ("r-view-late", 2, None, "alpha", "view", None, "USD", MID, None, 5, 3_000_000_000, 600_000_000, None, 9_000_000_000, "custom"),
    ("r-view-src1", 1, None, "alpha", "view", "src1", "EUR", FAR, None, 1, 1_000_000_000, 100_000_000, 1_000_000_000, 4_000_000_000, "custom"),
    ("r-view-off", 1, None, "alpha", "view", None, "USD", FAR, None, 0, 7, 7, None, 7, "offline"),
    ("r-click-off", 1, None, "alpha", "click", None, "USD", FAR, None, 0, 1_250_000_000, 1_250_000_000, None, 10_000_000_000, "offline"),
    ("r-purchase-a", 1, None, "alpha", "purchase", None, "USD", MID, None, 3, 1_000_000_000, None, None, 1_000_000_000, "custom"),
    ("r-beta-1", 1, None, "beta", "purchase", None, "USD", FAR, None, 9, 10, 10, 10, 10, "custom"),
    ("r-beta-2", 2, None, "beta", "purchase", None, "USD", FAR, None, 9, 20, 20, 20, 20, "custom"),
    ("r-beta-3", 1, None, "beta", "purchase", None, "USD", FAR, None, 8, 30, 30, 30, 30, "custom"),
    ("r-beta-signup", 1, None, "beta", "signup", None, "GBP", FAR, None, 0, 123_456_789, None, 123_456_789, 987_654_321, "custom"),
    ("r-beta-view", 1, None, "beta", "view", None, "USD", FAR, None, 0, 40, 4, 50, 400, "custom"),
    ("r-beta-later", 3, None, "beta", "view", None, "USD", FAR, None, 9, 1, 1, 1, 1, "custom"),
]
# alias_id, provider, alias, canonical, introduced, retired
ALIASES = [
    ("a1", "beta", "click", "view", 1, None),
    ("a2", "alpha", "signup", "view", 1, None),
    ("a3", "alpha", "signup", "click", 2, None),
    ("a4", "beta", "view", "signup", 1, 2),
]

RULE_COLUMNS = tuple(f.name for f in PRICE_RULE.fields)
ALIAS_COLUMNS = tuple(f.name for f in MODEL_ALIAS.fields)


def rules(spark: SparkSession, table: list[tuple] = RULES) -> DataFrame:
    rows = [r[:10] + tuple(None if v is None else Decimal(v) for v in r[10:14]) + r[14:] for r in table]
    return spark.createDataFrame(rows, PRICE_RULE)


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, MODEL_ALIAS)


def _literal(value) -> str:
    if value is None:
        return "NULL"
    return f"'{value}'" if isinstance(value, str) else str(value)


def values(rows, columns, name: str) -> str:
    body = ", ".join("(" + ",".join(_literal(v) for v in row) + ")" for row in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


def _quote(model, tier, context, rates, reference="price-list"):
    return (model, tier, context, *rates, reference)


# catalog_id, verified_at, introduced_revision, entries
CATALOGS = [
    (
        "text-2023-12",
        1_703_000_000_000,
        1,
        [
            _quote("click", "standard", "all", ("1.25", "1.25", None, "10")),
            _quote("click", "flex", "all", ("0.6", "0.06", None, "5")),
            _quote("signup", "standard", "short", ("3", "0.3", "3.75", "15")),
            _quote("signup", "standard", "long", ("6", "0.6", "7.5", "22.5")),
            _quote("purchase", "standard", "all", ("0.5", None, None, "2")),
        ],
    ),
    (
        "text-2024-01",
        MID,
        2,
        [
            _quote("click", "standard", "all", ("1.5", "0.15", None, "12")),
            _quote("click", "batch", "short", ("0.75", "0.075", None, "6")),
            _quote("click", "batch", "long", ("1.5", "0.15", None, "9.000000001")),
            _quote("signup", "flex", "all", ("2", "0.2", "2.5", "9")),
        ],
    ),
]


def catalogs(spark: SparkSession, up_to: int | None = None) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType([*CATALOG.fields, T.StructField("introduced_revision", T.LongType())])
    rows = [
        (1, cid, verified, "alpha", "USD", 272_000, "global_list", entries, revision)
        for cid, verified, revision, entries in CATALOGS
        if up_to is None or revision <= up_to
    ]
    return spark.createDataFrame(rows, schema)


def catalog_values(name: str = "catalog_quotes") -> str:
    columns = ("catalog_id", "verified_at_ms", "introduced_revision", "model_exact", "tier", "context",
               "input_rate", "cached_rate", "write_rate", "output_rate")
    rows = []
    for cid, verified, revision, entries in CATALOGS:
        for model, tier, context, i, c, w, o, _ in entries:
            atoms = [None if t is None else int(Decimal(t) * 10**9) for t in (i, c, w, o)]
            rows.append((cid, verified, revision, model, tier, context, *atoms))
    return values(rows, columns, name)


# The rules beside the catalogs: click is left to them, and one rule of a shipped table stays.
BESIDE_CATALOGS = [
    *[r for r in RULES if r[0] not in ("r-click-off", "r-beta-signup")],
    ("r-beta-signup-off", 1, None, "beta", "signup", None, "GBP", FAR, None, 0, 123_456_789, None, 123_456_789, 987_654_321, "offline"),
]


def _closed(rule_id: str) -> str:
    return "offline-history/" + hashlib.sha256(f'[2,"{rule_id}"]'.encode()).hexdigest()


def published_rows() -> list[tuple]:
    """What publishing both catalogs leaves in the rate table, for the SQL twin."""
    first, second = (c[0] for c in CATALOGS)
    flat = {"click": (1_250_000_000, 1_250_000_000, None, 10_000_000_000), "purchase": (500_000_000, None, None, 2_000_000_000)}
    closed = [(_closed(f"offline/{first}/{m}"), 2, None, "alpha", m, None, "USD", CATALOGS[0][1], MID, 0, *r, "offline") for m, r in flat.items()]
    return [*closed, (f"offline/{second}/click", 2, None, "alpha", "click", None, "USD", MID, None, 0, 1_500_000_000, 150_000_000, None, 12_000_000_000, "offline")]


def catalog_priced_sql(where: str) -> str:
    """CTEs ending in ``priced`` with the catalogs: also selection, matched_kind and matched_rule_id.
    The facts carry tier, full_request and band."""
    (first, since, *_), (second, *_) = CATALOGS
    refs = [
        (first, m, since, MID, _closed(f"offline/{first}/{m}") if m != "signup" else None) for m in ("click", "signup", "purchase")
    ] + [(second, "click", MID, None, f"offline/{second}/click"), (second, "signup", MID, None, None)]
    base = priced_sql(where, table=[*BESIDE_CATALOGS, *published_rows()]).split("judged AS (")[0]
    return f"""{catalog_values()}, {values(refs, ("ref_id", "ref_model", "ref_from", "ref_to", "flat_id"), "refs")}, {base}
refd AS (SELECT *, CASE WHEN same=1 THEN best_rule END AS own_rule, coalesce(same=1 AND origin='offline' AND best_rule=flat_id,false) AS owns
  FROM rated LEFT JOIN refs ON provider='alpha' AND ref_model=canonical AND ref_from<=price_at AND (ref_to IS NULL OR price_at<ref_to)),
sure AS (SELECT *, ref_id IS NOT NULL AND (own_rule IS NULL OR owns) AND tier IS NOT NULL AND NOT (alias_amb OR same>1) AS confirmed FROM refd),
quoted AS (SELECT s.*, q.model_exact IS NOT NULL AS has_quote, q.context, q.input_rate, q.cached_rate, q.write_rate, q.output_rate FROM sure s LEFT JOIN catalog_quotes q
  ON s.confirmed AND s.full_request AND q.catalog_id=s.ref_id AND q.model_exact=s.canonical AND q.tier=s.tier AND (q.context='all' OR q.context=s.band)),
settled AS (SELECT * REPLACE (CASE WHEN confirmed THEN input_rate ELSE ri END AS ri, CASE WHEN confirmed THEN cached_rate ELSE rc END AS rc,
  CASE WHEN confirmed THEN write_rate ELSE rw END AS rw, CASE WHEN confirmed THEN output_rate ELSE ro END AS ro,
  CASE WHEN confirmed THEN 'USD' ELSE rule_currency END AS rule_currency),
  CASE WHEN confirmed THEN CASE WHEN has_quote THEN 'offline/'||ref_id||'/'||canonical||'/'||tier||'/'||context END ELSE own_rule END AS final_rule,
  CASE WHEN confirmed THEN NOT has_quote ELSE own_rule IS NULL AND ref_id IS NOT NULL AND flat_id IS NULL END AS conditions_missing FROM quoted),
judged AS (SELECT *, CASE WHEN provider IS NULL OR model IS NULL THEN 'unknown_model'
  WHEN alias_amb OR same>1 THEN 'ambiguous_rule' WHEN conditions_missing THEN 'incomplete_pricing_conditions' WHEN final_rule IS NULL THEN 'missing_rule'
  WHEN input_total IS NULL OR output_total IS NULL OR remaining<0 THEN 'insufficient_usage'
  WHEN coalesce(cached_input,0)<>0 AND rc IS NULL THEN 'insufficient_usage'
  WHEN cached_input IS NULL AND NOT (remaining=0 OR coalesce(rc=ri,false)) THEN 'insufficient_usage'
  WHEN coalesce(cache_write_input,0)<>0 AND rw IS NULL THEN 'insufficient_usage'
  WHEN cache_write_input IS NULL AND NOT (remaining=0 OR coalesce(rw=ri,false) OR rw IS NULL) THEN 'insufficient_usage' END AS reason FROM settled),
priced AS (SELECT *, CASE WHEN reason IS NULL THEN rule_currency END AS currency,
  CASE WHEN final_rule IS NOT NULL AND NOT (alias_amb OR same>1) THEN final_rule END AS matched_rule_id,
  CASE WHEN final_rule IS NOT NULL AND NOT (alias_amb OR same>1) THEN CASE WHEN confirmed THEN 'offline_request_reference' WHEN owns THEN 'offline_standard_reference'
    WHEN origin='custom' THEN 'custom_rule' ELSE 'offline_rule' END END AS matched_kind,
  CASE WHEN reason IS NULL THEN CAST(remaining AS HUGEINT)*ri+CAST(coalesce(cached_input,0) AS HUGEINT)*coalesce(rc,0)
    +CAST(coalesce(cache_write_input,0) AS HUGEINT)*coalesce(rw,0)+CAST(output_total AS HUGEINT)*ro END AS cost_atoms FROM judged)"""


def priced_sql(
    where: str = "true", revision: int = REVISION, specified_ms: int | None = None, facts: str = "facts", table: list[tuple] = RULES
) -> str:
    """CTEs ending in ``priced``: facts with reason, rule_id, currency and cost."""
    at = str(specified_ms) if specified_ms is not None else "f.occurred_at_ms"
    live = f"introduced_revision<={revision} AND (retired_revision IS NULL OR retired_revision>{revision})"
    return f"""{values(table, RULE_COLUMNS, 'all_rules')},
{values(ALIASES, ALIAS_COLUMNS, 'all_aliases')},
al AS (SELECT provider AS ap, alias, count(DISTINCT canonical_model) AS n, min(canonical_model) AS target
  FROM all_aliases WHERE {live} GROUP BY 1, 2),
named AS (SELECT f.*, {at} AS price_at, coalesce(al.n>1,false) AS alias_amb,
  CASE WHEN coalesce(al.n,1)=1 THEN coalesce(al.target,f.model) END AS canonical
  FROM {facts} f LEFT JOIN al ON al.ap=f.provider AND al.alias=f.model WHERE {where}),
cand AS (SELECT n.event_id, r.rule_id, r.currency AS rule_currency, r.input_rate_atoms, r.cached_rate_atoms,
  r.cache_write_rate_atoms, r.output_rate_atoms, r.origin, r.source_id,
  (CASE WHEN origin='offline' THEN 1 WHEN source_id IS NULL THEN 2 ELSE 3 END)*100000+priority AS rk
  FROM named n JOIN all_rules r ON r.provider=n.provider AND r.model_exact=n.canonical
  AND r.introduced_revision<={revision} AND (r.retired_revision IS NULL OR r.retired_revision>{revision})
  AND r.effective_from_ms<=n.price_at AND (r.effective_to_ms IS NULL OR n.price_at<r.effective_to_ms)
  AND (r.source_id IS NULL OR list_contains(n.source_ids, r.source_id))),
ranked AS (SELECT *, rank() OVER (PARTITION BY event_id ORDER BY rk DESC) AS place,
  count(*) OVER (PARTITION BY event_id, rk) AS same FROM cand),
best AS (SELECT DISTINCT ON (event_id) * FROM ranked WHERE place=1 ORDER BY event_id, rule_id),
rated AS (SELECT n.*, b.rule_id AS best_rule, b.rule_currency, b.input_rate_atoms AS ri, b.cached_rate_atoms AS rc,
  b.cache_write_rate_atoms AS rw, b.output_rate_atoms AS ro, b.origin, b.source_id AS rule_source,
  coalesce(b.same,0) AS same,
  n.input_total-coalesce(n.cached_input,0)-coalesce(n.cache_write_input,0) AS remaining
  FROM named n LEFT JOIN best b ON b.event_id=n.event_id),
judged AS (SELECT *, CASE WHEN provider IS NULL OR model IS NULL THEN 'unknown_model'
  WHEN alias_amb OR same>1 THEN 'ambiguous_rule' WHEN best_rule IS NULL THEN 'missing_rule'
  WHEN input_total IS NULL OR output_total IS NULL OR remaining<0 THEN 'insufficient_usage'
  WHEN coalesce(cached_input,0)<>0 AND rc IS NULL THEN 'insufficient_usage'
  WHEN cached_input IS NULL AND NOT (remaining=0 OR coalesce(rc=ri,false)) THEN 'insufficient_usage'
  WHEN coalesce(cache_write_input,0)<>0 AND rw IS NULL THEN 'insufficient_usage'
  WHEN cache_write_input IS NULL AND NOT (remaining=0 OR coalesce(rw=ri,false) OR rw IS NULL) THEN 'insufficient_usage'
  END AS reason FROM rated),
priced AS (SELECT *, CASE WHEN reason IS NULL THEN best_rule END AS rule_id,
  CASE WHEN reason IS NULL THEN rule_currency END AS currency,
  CASE WHEN reason IS NULL THEN CAST(remaining AS HUGEINT)*ri+CAST(coalesce(cached_input,0) AS HUGEINT)*coalesce(rc,0)
    +CAST(coalesce(cache_write_input,0) AS HUGEINT)*coalesce(rw,0)+CAST(output_total AS HUGEINT)*ro END AS cost_atoms
  FROM judged)"""
