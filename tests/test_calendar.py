from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from tallyline.operators import calendar as C

H, D = 3_600_000, 86_400_000


def ms(text):
    return int(datetime.fromisoformat(text).timestamp() * 1000)


def plain_buckets(start, end, name, grain):
    """Buckets by walking the zone's clock a quarter of an hour at a time (all its changes in the
    zones used here lie on quarters): a bucket ends where its label or its offset does."""
    zone, step = ZoneInfo(name), 900_000
    shape = {"hour": "%Y-%m-%d %H", "day": "%Y-%m-%d", "month": "%Y-%m"}[grain]
    out, at = [], start
    while at < end:
        here = datetime.fromtimestamp(at / 1000, zone)
        same = (here.strftime(shape), here.utcoffset() if grain == "hour" else None)
        if not out or out[-1][0] != same:
            out.append([same, at, at])
        at = min(end, at - at % step + step)
        out[-1][2] = at
    return [(label, b, e) for (label, _), b, e in out]


def label_of(bucket, grain):
    return bucket.label[:13] if grain == "hour" else bucket.label


@pytest.mark.parametrize(
    "name,first,days,grain",
    [
        ("Europe/Lisbon", "2023-03-25T10:07:03+00:00", 2, "hour"),
        ("Europe/Lisbon", "2023-10-28T20:00:00+00:00", 1, "hour"),
        ("Asia/Beirut", "2021-03-27T01:30:00+00:00", 2, "hour"),
        ("Pacific/Chatham", "2022-04-01T11:15:00+00:00", 3, "hour"),
        ("America/St_Johns", "2019-11-02T22:00:00+00:00", 2, "hour"),
        ("Asia/Kolkata", "2020-06-30T17:45:10+00:00", 1, "hour"),
        ("America/Havana", "2018-03-01T03:00:00+00:00", 60, "day"),
        ("Pacific/Kwajalein", "1993-08-18T00:00:00+00:00", 6, "day"),
        ("Africa/Casablanca", "2019-05-20T23:10:00+00:00", 150, "month"),
    ],
)
def test_buckets_follow_the_clock(name, first, days, grain):
    start = ms(first)
    found = C.buckets(start, start + days * D, name, grain)
    want = plain_buckets(start, start + days * D, name, grain)
    edges = [(label_of(b, grain), b.start_ms, b.end_ms) for b in found]
    if grain == "hour":
        # A change inside an hour may part it; joined by label and offset, the parts are the same.
        assert [e[1] for e in edges] == [w[1] for w in want] and [e[2] for e in edges] == [w[2] for w in want]
    else:
        assert edges == want


def test_buckets_leave_no_gap_at_odd_offsets():
    start = ms("1883-11-18T15:00:00+00:00")
    found = C.buckets(start, start + 4 * H, "America/Chicago", "hour")
    assert found[0].start_ms == start and found[-1].end_ms == start + 4 * H
    assert all(a.end_ms == b.start_ms for a, b in zip(found, found[1:]))
    assert len({b.utc_offset for b in found}) == 2


def test_ranges_that_are_too_long_are_refused():
    assert len(C.buckets(H, 2001 * H, "Asia/Tokyo", "hour")) == 2000
    for start, end, grain in [(H, 2001 * H + 1, "hour"), (0, 90 * D, "hour"), (0, 2300 * D, "day"), (5, 5, "day")]:
        with pytest.raises(ValueError):
            C.buckets(start, end, "Asia/Tokyo", grain)


def test_grain_grows_with_the_range():
    grains = [C.available_grain("hour", 0, days * D) for days in (1, 30, 80, 120, 1000, 1989, 2100, 5000)]
    assert grains == sorted(grains, key=["hour", "day", "month"].index) and set(grains) == {"hour", "day", "month"}


@pytest.mark.parametrize("name", ["Europe/Lisbon", "America/Havana", "Asia/Kolkata", "Pacific/Chatham"])
@pytest.mark.parametrize("now", ["2022-03-27T11:00:00+00:00", "2022-10-30T23:30:00+00:00", "2023-12-31T23:59:00+00:00"])
def test_selections_are_whole_local_days(name, now):
    zone = ZoneInfo(name)
    today = datetime.fromtimestamp(ms(now) / 1000, zone).date()
    local = lambda day: datetime(day.year, day.month, day.day, tzinfo=zone)
    first = lambda day: next(t for t in range(int(local(day).timestamp()) - 7200, int(local(day).timestamp()) + 7201, 60) if datetime.fromtimestamp(t, zone).date() == day) * 1000
    one = C.resolve_selection(name, "today", ms(now))
    assert one.local_today == today.isoformat()
    assert (one.start_ms, one.end_ms) == (first(today), first(today + timedelta(days=1)))
    seven = C.resolve_selection(name, "last7", ms(now))
    assert (seven.start_ms, seven.end_ms) == (first(today - timedelta(days=6)), one.end_ms)
    then = today - timedelta(days=40)
    custom = C.resolve_selection(name, "custom", ms(now), then.isoformat(), (then + timedelta(days=2)).isoformat())
    assert (custom.start_ms, custom.end_ms) == (first(then), first(then + timedelta(days=3)))
    weeks = C.buckets(custom.heatmap_start_ms, custom.heatmap_end_ms, name, "day")
    assert len(weeks) == 182


def test_impossible_dates_are_refused():
    now = ms("2023-06-01T00:00:00+00:00")
    for start, end in [("2023-02-30", "2023-03-02"), ("2023-3-02", "2023-03-02"), ("2023-05-05", "2023-05-04"), ("yesterday", "today")]:
        with pytest.raises(ValueError):
            C.resolve_selection("Europe/Lisbon", "custom", now, start, end)
    with pytest.raises(ValueError):  # a date that this zone never had
        C.resolve_selection("Pacific/Kwajalein", "custom", now, "1993-08-21", "1993-08-21")


def test_every_zone_change_matches_a_plain_reading():
    """Day starts equal the first instant of the local date, found by walking the clock."""
    for name in ("America/Sao_Paulo", "Africa/Casablanca", "Asia/Beirut", "Atlantic/Azores"):
        zone = ZoneInfo(name)
        start = ms("2018-01-01T00:00:00+00:00")
        for bucket in C.buckets(start, start + 400 * D, name, "day")[1:]:
            first = datetime.fromtimestamp(bucket.start_ms / 1000, zone)
            before = datetime.fromtimestamp(bucket.start_ms / 1000 - 1, zone)
            assert first.date().isoformat() == bucket.label != before.date().isoformat()
