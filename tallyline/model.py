"""Types and fixed values of the metering model."""

from __future__ import annotations

from pyspark.sql import types as T

# Limits, versions and names that results depend on.
MAX_BUCKETS = 2000
MAX_PRICE_RULES = 4096
MAX_ALIASES = 4096
MAX_SELECTION_IDS = 100
MAX_SOURCES = 32
MAX_CATALOG_ENTRIES = 1024
MAX_RATE_ATOMS = 1_000_000_000_000_000
MAX_LINE_BYTES = 8 * 1024 * 1024
MAX_EPOCH_MS = 8_640_000_000_000_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000
SHORT_CONTEXT_MAX_INPUT = 272_000
QUOTA_STALE_MS = 300_000
WEEK_MINUTES = 10_080
ACCOUNTING_V1 = "accounting-v1"
ACCOUNTING_V2 = "accounting-v2"
UNKNOWN_MODEL_LABEL = "未知模型"
UNKNOWN_PROJECT_LABEL = "未知项目"

VECTOR_FIELDS = (
    "input_total",
    "cached_input",
    "cache_write_input",
    "output_total",
    "reasoning_output",
    "reported_total",
)
VECTOR = T.StructType([T.StructField(name, T.LongType()) for name in VECTOR_FIELDS])

# The six parts that are reported beside the total, in reporting order.
MEASURES = (
    "input_total",
    "cached_input",
    "noncached_input",
    "output_total",
    "reasoning_output",
    "cache_write_input",
)

USAGE_EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType(), False),
        T.StructField("ledger_id", T.StringType()),
        T.StructField("session_key", T.StringType(), False),
        T.StructField("occurred_at_ms", T.LongType(), False),
        T.StructField("provider", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("project_id", T.StringType()),
        T.StructField("turn_id", T.StringType()),
        T.StructField("source_ids", T.ArrayType(T.StringType())),
        *[T.StructField(name, T.LongType()) for name in VECTOR_FIELDS],
        T.StructField("total_tokens", T.LongType(), False),
        T.StructField("calculation_method", T.StringType()),
        T.StructField("accounting_version", T.StringType()),
    ]
)

PRICE_RULE = T.StructType(
    [
        T.StructField("rule_id", T.StringType(), False),
        T.StructField("introduced_revision", T.LongType(), False),
        T.StructField("retired_revision", T.LongType()),
        T.StructField("provider", T.StringType(), False),
        T.StructField("model_exact", T.StringType(), False),
        T.StructField("source_id", T.StringType()),
        T.StructField("currency", T.StringType(), False),
        T.StructField("effective_from_ms", T.LongType(), False),
        T.StructField("effective_to_ms", T.LongType()),
        T.StructField("priority", T.IntegerType(), False),
        T.StructField("input_rate_atoms", T.DecimalType(16, 0), False),
        T.StructField("cached_rate_atoms", T.DecimalType(16, 0)),
        T.StructField("cache_write_rate_atoms", T.DecimalType(16, 0)),
        T.StructField("output_rate_atoms", T.DecimalType(16, 0), False),
        T.StructField("origin", T.StringType(), False),
    ]
)

MODEL_ALIAS = T.StructType(
    [
        T.StructField("alias_id", T.StringType(), False),
        T.StructField("provider", T.StringType(), False),
        T.StructField("alias", T.StringType(), False),
        T.StructField("canonical_model", T.StringType(), False),
        T.StructField("introduced_revision", T.LongType(), False),
        T.StructField("retired_revision", T.LongType()),
    ]
)

CATALOG_ENTRY = T.StructType(
    [
        T.StructField("model_exact", T.StringType()),
        T.StructField("tier", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("input_per_million", T.StringType()),
        T.StructField("cached_per_million", T.StringType()),
        T.StructField("cache_write_per_million", T.StringType()),
        T.StructField("output_per_million", T.StringType()),
        T.StructField("reference", T.StringType()),
    ]
)

CATALOG = T.StructType(
    [
        T.StructField("format_version", T.IntegerType()),
        T.StructField("catalog_id", T.StringType()),
        T.StructField("verified_at_ms", T.LongType()),
        T.StructField("provider", T.StringType()),
        T.StructField("currency", T.StringType()),
        T.StructField("short_context_max_input", T.LongType()),
        T.StructField("reference_basis", T.StringType()),
        T.StructField("entries", T.ArrayType(CATALOG_ENTRY)),
    ]
)
