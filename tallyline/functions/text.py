"""Keys, identifiers, number texts and display forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyline.model import HOUR_MS, MAX_EPOCH_MS, MAX_RATE_ATOMS

INTEGER_TEXT = "^(0|[1-9][0-9]*)$"
DASH = "—"


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def model_key(provider: Column, model: Column) -> Column:
    """Opaque key of (provider, model); NULL exactly when the model is unknown."""
    pair = F.to_json(F.array(provider, model))
    return F.when(model.isNotNull(), F.concat(F.lit("model:"), sha(pair)))


def model_label(provider: Column, model: Column, unknown: str) -> Column:
    shown = F.concat(model, F.coalesce(F.concat(F.lit(" · "), provider), F.lit("")))
    return F.when(model.isNull(), F.lit(unknown)).otherwise(shown)


def search_contains(text: Column, needle: str) -> Column:
    """Case-insensitive literal search; no wildcard has a meaning."""
    return F.lower(text).contains(needle.lower())


def namespaced_id(namespace: str, value: Column) -> Column:
    return F.concat(F.lit(namespace + "-"), sha(value))


def observation_id(generation: Column, offset: Column) -> Column:
    return namespaced_id("observation", F.concat_ws(":", generation, offset.cast("string")))


def event_id(ledger: Column, observation: Column) -> Column:
    return namespaced_id("event", F.concat_ws(":", ledger, observation))


def project_path(cwd: Column) -> Column:
    """Comparable path: drive and network paths fold case and slash direction."""
    windows = (F.substring(cwd, 2, 1) == ":") | cwd.startswith("\\\\")
    return F.when(windows, F.lower(F.translate(cwd, "\\", "/"))).otherwise(cwd)


def project_id(cwd: Column) -> Column:
    return F.when(cwd.isNotNull(), namespaced_id("project", project_path(cwd)))


def project_name(cwd: Column) -> Column:
    """Last part of a path, whichever way its slashes lean."""
    return F.regexp_extract(F.regexp_replace(cwd, r"[\\/]+$", ""), r"([^\\/]*)$", 1)


def is_canonical_integer(text: Column) -> Column:
    return F.coalesce(text.rlike(INTEGER_TEXT), F.lit(False))


def is_epoch_ms(ms: Column) -> Column:
    return F.coalesce(ms.between(-MAX_EPOCH_MS, MAX_EPOCH_MS), F.lit(False))


def utc_hour(ms: Column) -> Column:
    """Start of the UTC hour; the floor also holds before 1970."""
    return ms - F.pmod(ms, F.lit(HOUR_MS))


def _split(value: Column, unit: Column) -> tuple[Column, Column]:
    """Whole part and rest of a division; the rest goes first so that nothing is rounded."""
    rest = F.pmod(value, unit)
    return ((value - rest) / unit).cast("decimal(38,0)"), rest


def _whole(number: int) -> Column:
    return F.lit(number).cast("decimal(38,0)")


SMALL = 10**14  # counts up to here keep every product below within a long


def _small(value: Column, most: int = SMALL) -> tuple[Column, Column]:
    """Whether a whole number is at least 0 and at most ``most``, and it as a long (else NULL).
    Arithmetic on longs costs a small part of that on 38 digits."""
    fits = value.between(F.lit(0), F.lit(most))
    return fits, F.when(fits, value).cast("long")


def _div(value: Column, unit: Column) -> Column:
    """Whole part of a division of longs that are not negative."""
    return F.call_function("div", value, unit)


def whole_division(value: Column, unit: Column) -> Column:
    """value / unit cut to a whole number; 0 where the unit is 0."""
    safe = F.when(unit == 0, _whole(1)).otherwise(unit.cast("decimal(38,0)"))
    return F.when(unit == 0, _whole(0)).otherwise(_split(value, safe)[0])


def rate_atoms(price: Column) -> Column:
    """Rate text per million to whole atoms (nine decimals), NULL when out of form or range."""
    shaped = price.rlike(r"^(0|[1-9][0-9]{0,6})(\.[0-9]{1,9})?$")
    safe = F.when(shaped, price).otherwise(F.lit("0"))
    atoms = (safe.cast("decimal(16,9)") * F.lit(10**9).cast("decimal(10,0)")).cast("decimal(18,0)")
    return F.when(shaped & (atoms <= F.lit(MAX_RATE_ATOMS)), atoms.cast("decimal(16,0)"))


def _point_text(atoms: Column, places: int) -> Column:
    digits = F.lpad(atoms.cast("decimal(38,0)").cast("string"), 39, "0")
    whole = F.regexp_replace(F.substring(digits, 1, 39 - places), r"^0+(?=\d)", "")
    if places == 0:
        return whole
    return F.concat(whole, F.lit("."), F.substring(digits, 40 - places, places))


def rate_per_million(atoms: Column) -> Column:
    return F.regexp_replace(_point_text(atoms, 9), r"\.?0+$", "")


def money_from_atoms(atoms: Column) -> Column:
    """Cost atoms to money text with 15 decimals, by moving the point and never dividing."""
    return _point_text(atoms, 15)


def money_rounded(atoms: Column, places: int = 2) -> Column:
    """Half-up rounding of cost atoms to a number of places, as text."""
    value = atoms.cast("decimal(38,0)")
    if places == 15:
        return money_from_atoms(atoms)
    unit = 10 ** (15 - places)
    whole, rest = _split(value, _whole(unit))
    up = F.when(rest >= F.lit(unit // 2), F.lit(1)).otherwise(F.lit(0))
    wide = _point_text((whole + up).cast("decimal(38,0)"), places)
    fits, n = _small(atoms, 10**18)
    rounded, part = _div(n + F.lit(unit // 2), F.lit(unit)), F.lit(10**places)
    short = rounded.cast("string")
    if places:
        short = F.concat(_div(rounded, part).cast("string"), F.lit("."), F.lpad((rounded % part).cast("string"), places, "0"))
    return F.when(fits, short).otherwise(wide)


def compact_tokens(tokens: Column) -> Column:
    """1234 -> 1.2K, with tenths rounded half up; small counts stay whole."""
    value = tokens.cast("decimal(38,0)")
    shown = F.when(value.isNull(), F.lit(DASH))
    for scale, mark in ((10**9, "B"), (10**6, "M"), (10**3, "K")):
        whole, rest = _split(value, _whole(scale))
        tenths, _ = _split((rest * 10 + scale // 2).cast("decimal(38,0)"), _whole(scale))
        tenths = (whole * 10 + tenths).cast("decimal(38,0)")
        text = F.concat(_point_text(tenths, 1), F.lit(mark))
        shown = shown.when(value >= F.lit(scale), text)
    fits, n = _small(tokens)
    short = F.when(n < 1000, n.cast("string"))
    for scale, mark in ((10**9, "B"), (10**6, "M"), (10**3, "K")):
        tenths = _div(n * 10 + F.lit(scale // 2), F.lit(scale))
        text = F.concat(_div(tenths, F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(mark))
        short = short.when(n >= scale, text)
    return F.when(fits, short).otherwise(shown.otherwise(value.cast("string")))


def percentage(numerator: Column, denominator: Column) -> Column:
    """Percent to two places, half up; NULL when unknown, over 100 or over nothing."""
    n, d = numerator.cast("decimal(30,0)"), denominator.cast("decimal(30,0)")
    usable = F.coalesce((d != 0) & (n <= d), F.lit(False))
    safe = F.when(usable, d).otherwise(F.lit(1)).cast("decimal(38,0)")
    half = _split(safe, _whole(2))[0]
    scaled = (F.when(usable, n).otherwise(F.lit(0)).cast("decimal(33,0)") * 10000).cast("decimal(38,0)")
    hundredths, _ = _split((scaled + half).cast("decimal(38,0)"), safe)
    wide = F.when(usable, hundredths.cast("double") / F.lit(100.0))
    (n_fits, a), (d_fits, b) = _small(numerator), _small(denominator)
    over = F.when(b > 0, b).otherwise(F.lit(1))
    short = F.when((b > 0) & (a <= b), _div(a * 10_000 + _div(over, F.lit(2)), over).cast("double") / F.lit(100.0))
    return F.when(n_fits & d_fits, short).otherwise(wide)


def percent_text(value: Column) -> Column:
    text = F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
    return F.when(value.isNull(), F.lit(DASH)).otherwise(F.concat(text, F.lit("%")))


def low_remaining(value: Column) -> Column:
    return F.coalesce(value <= 20.0, F.lit(False))


def local_date(ms: Column, zone: str) -> Column:
    """Calendar date of an instant in a zone, without leaning on the session's own zone."""
    instant = F.timestamp_millis(ms).cast("timestamp_ntz")
    local = F.convert_timezone(F.current_timezone(), F.lit(zone), instant)
    return F.date_format(local, "yyyy-MM-dd")
