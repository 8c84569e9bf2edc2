import itertools
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyline.model import MODEL_ALIAS, PRICE_RULE
from tallyline.operators import catalog, pricing, rate_edits
from tallyline.plans import rates

EVENT = (
    "event_id string, provider string, model string, source_ids array<string>, occurred_at_ms long, input_total long, cached_input long, "
    "cache_write_input long, output_total long, reasoning_output long, reported_total long, total_tokens long"
)


def rule(name, **kw):
    base = dict(
        rule_id=name, introduced_revision=1, retired_revision=None, provider="p", model_exact="m", source_id=None, currency="USD",
        effective_from_ms=0, effective_to_ms=None, priority=0, input_rate_atoms=2, cached_rate_atoms=None, cache_write_rate_atoms=None,
        output_rate_atoms=7, origin="custom",
    )
    base.update(kw)
    for k in ("input_rate_atoms", "cached_rate_atoms", "cache_write_rate_atoms", "output_rate_atoms"):
        base[k] = None if base[k] is None else Decimal(base[k])
    return tuple(base[f.name] for f in PRICE_RULE.fields)


def no_aliases(spark):
    return spark.createDataFrame([], MODEL_ALIAS)


def plain_cost(v, rates_):
    """Independent integer formula over (input, cached, write, output)."""
    i, c, w, o = v
    ri, rc, rw, ro = rates_
    if i is None or o is None:
        return None
    if any(x is not None and x > i for x in (c, w)) or (c is not None and w is not None and c + w > i):
        return None
    rest = i - (c or 0) - (w or 0)
    cost = rest * ri + o * ro
    for part, rate, is_write in ((c, rc, False), (w, rw, True)):
        if part is None:
            if not (rest == 0 or rate == ri or (is_write and rate is None)):
                return None
        elif part:
            if rate is None:
                return None
            cost += part * rate
    return cost


def test_every_small_vector_and_rate_shape(spark):
    vectors = list(itertools.product([None, 0, 1, 3], [None, 0, 1, 3], [None, 0, 2], [None, 0, 5]))
    shapes = [(2, None, None, 7), (2, 1, None, 7), (2, 2, None, 7), (2, 1, 3, 7), (2, 2, 2, 7), (2, None, 2, 0)]
    rules = [
        rule(f"r{n}", model_exact=f"m{n}", input_rate_atoms=a, cached_rate_atoms=b, cache_write_rate_atoms=c, output_rate_atoms=d)
        for n, (a, b, c, d) in enumerate(shapes)
    ]
    events, expected = [], {}
    for n, shape in enumerate(shapes):
        for k, (i, c, w, o) in enumerate(vectors):
            name = f"{n}-{k}"
            events.append((name, "p", f"m{n}", ["s"], 5, i, c, w, o, None, None, 0))
            expected[name] = plain_cost((i, c, w, o), shape)
    priced = pricing.with_cost(
        pricing.price_events(spark.createDataFrame(events, EVENT), spark.createDataFrame(rules, PRICE_RULE), no_aliases(spark), 1)
    ).select("event_id", "reason", "cost_atoms")
    for row in priced.collect():
        want = expected[row.event_id]
        assert (None if row.cost_atoms is None else int(row.cost_atoms)) == want, row
        assert row.reason == (None if want is not None else "insufficient_usage")


def test_large_amounts_stay_exact(spark):
    big = 2**62
    events = spark.createDataFrame([(str(n), "p", "m", ["s"], 5, big, 0, 0, 0, None, big, big) for n in range(5)], EVENT)
    rules = spark.createDataFrame([rule("r", input_rate_atoms=10**15)], PRICE_RULE)
    row = pricing.currency_totals(pricing.price_events(events, rules, no_aliases(spark), 1)).collect()[0]
    assert int(row.cost_atoms) == 5 * big * 10**15 and int(row.priced_total_tokens) == 5 * big


def test_rate_edits_are_versioned(spark):
    table = spark.createDataFrame([rule("a", effective_to_ms=100), rule("off", origin="offline")], PRICE_RULE)
    draft = lambda **kw: spark.createDataFrame([rule("new", **kw)], PRICE_RULE)
    edited = rate_edits.edit_rule(table, 2, draft(effective_from_ms=100))
    assert pricing.visible_at(edited, 1).count() == 2 and pricing.visible_at(edited, 2).count() == 3
    with pytest.raises(rate_edits.RateConflict):
        rate_edits.edit_rule(edited, 3, draft(effective_from_ms=99, effective_to_ms=101))
    rate_edits.edit_rule(edited, 3, draft(priority=1))
    replaced = rate_edits.edit_rule(edited, 3, draft(effective_from_ms=0, effective_to_ms=50), retire="a")
    assert {r.rule_id for r in pricing.visible_at(replaced, 3).collect()} == {"new", "off"}
    with pytest.raises(ValueError):
        rate_edits.edit_rule(table, 2, retire="off")


def test_alias_edits_never_chain(spark):
    schema = MODEL_ALIAS
    table = spark.createDataFrame([("alias-custom-1", "p", "x", "y", 1, None)], schema)
    for alias, target in (("x", "z"), ("w", "x"), ("y", "z")):
        with pytest.raises(rate_edits.RateConflict):
            rate_edits.edit_alias(table, 2, spark.createDataFrame([("n", "p", alias, target, 0, None)], schema))
    ok = rate_edits.edit_alias(table, 2, spark.createDataFrame([("n", "p", "w", "y", 0, None)], schema), retire="alias-custom-1")
    assert {(r.alias, r.retired_revision) for r in ok.collect()} == {("x", 2), ("w", None)}


def test_publishing_a_catalog_keeps_history(spark):
    first, second = rates.catalogs(spark, 1), rates.catalogs(spark).where("introduced_revision = 2")
    empty = spark.createDataFrame([], PRICE_RULE)
    one = catalog.publish(empty, first, 1)
    assert {r.rule_id for r in one.collect()} == {"offline/text-2023-12/click", "offline/text-2023-12/purchase"}
    two = catalog.publish(one, second, 2)
    old = pricing.visible_at(two, 1).collect()
    assert {r.rule_id for r in old} == {"offline/text-2023-12/click", "offline/text-2023-12/purchase"}
    now = {(r.model_exact, r.effective_from_ms, r.effective_to_ms) for r in pricing.visible_at(two, 2).collect()}
    assert now == {("click", 1_703_000_000_000, rates.MID), ("purchase", 1_703_000_000_000, rates.MID), ("click", rates.MID, None)}
    flat_ids = {r.flat_rule_id for r in catalog.publication_models(rates.catalogs(spark), 2).where("catalog_id = 'text-2023-12'").collect()}
    history = {r.rule_id for r in pricing.visible_at(two, 2).where("effective_to_ms IS NOT NULL").collect()}
    assert history == flat_ids - {None}
    assert catalog.catalog_problems(rates.catalogs(spark)).isEmpty()
    doubled = rates.catalogs(spark, 1).withColumn("entries", F.expr("concat(entries, slice(entries, 1, 1))"))
    assert {r.problem for r in catalog.catalog_problems(doubled).collect()} == {"repeated_quote"}
    quotes = catalog.conditional_quotes(rates.catalogs(spark))
    assert quotes.count() == quotes.select("rule_id").distinct().count() == 9


def test_request_input_needs_full_agreement(spark):
    vector = "named_struct('input_total', {0}L, 'cached_input', CAST(NULL AS BIGINT), 'cache_write_input', CAST(NULL AS BIGINT), 'output_total', 5L, 'reasoning_output', CAST(NULL AS BIGINT), 'reported_total', CAST(NULL AS BIGINT))"
    rows = spark.createDataFrame([("t", "g", 10, 10), ("x", "g", 10, 10), ("t", "h", 10, 10), ("t", "g", 19, 10), ("t", "g", 10, 11)], "turn string, gen string, ends int, used long")
    evidence = f"named_struct('response_id', 'r', 'turn_id', 't', 'file_generation_id', 'g', 'byte_end', ends, 'usage', {vector.format(10)}, 'thread_usage', {vector.format(30)})"
    consumed = vector.format(10).replace("10L", "used")
    shaped = rows.withColumns({"e": F.expr(evidence), "l": F.expr(vector.format(10)), "c": F.expr(vector.format(30)), "v": F.expr(consumed)})
    text = catalog.request_input("e", "turn", "gen", "15L", "l", "c", "v")
    got = [None if r.q is None else (r.q.input_tokens, r.q.binding) for r in shaped.select(F.expr(text).alias("q")).collect()]
    assert got == [(10, "full_request"), None, None, None, (10, "different_consumption")]


def test_catalog_documents_load(spark, tmp_path):
    import json

    from tallyline.sources.rate_files import read_catalogs

    entry = {"model_exact": "m-1", "tier": "standard", "context": "all", "input_per_million": "1.5", "output_per_million": "6", "reference": "list"}
    document = {
        "format_version": 1, "catalog_id": "c-1", "verified_at_ms": 5, "provider": "p", "currency": "USD", "short_context_max_input": 272000,
        "reference_basis": "global", "entries": [entry, {**entry, "tier": "flex", "input_per_million": "0.0000000001"}],
    }
    (tmp_path / "c.json").write_text(json.dumps(document, indent=1))
    loaded = read_catalogs(spark, str(tmp_path / "c.json"))
    assert {(r.model_exact, r.problem) for r in catalog.catalog_problems(loaded).collect()} == {("m-1", "bad_rate")}
    flat = catalog.flat_standard_rules(loaded.withColumn("introduced_revision", F.lit(1))).collect()
    assert [(r.rule_id, int(r.input_rate_atoms), r.cached_rate_atoms) for r in flat] == [("offline/c-1/m-1", 1_500_000_000, None)]
