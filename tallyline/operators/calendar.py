"""Calendar buckets of a time zone as half-open UTC intervals.

At most 2000 buckets exist per request, so they are worked out when the plan is built and
become a small table (or a literal array) the facts are matched against.

A zone is read as a list of stretches with one fixed offset each; inside a stretch local
wall-clock boundaries are plain arithmetic.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from tallyline.model import DAY_MS, HOUR_MS, MAX_BUCKETS

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
# The longest range of each grain in days, and the display formats.
MAX_SPAN_DAYS = {"hour": 84, "day": 2200, "month": 64_100}
LABEL_FORMAT = {"hour": "%Y-%m-%d %H:%M", "day": "%Y-%m-%d", "month": "%Y-%m"}
# Headroom below the bucket limit for zone changes.
AVAILABLE_STEPS = 1990


@dataclass(frozen=True)
class Bucket:
    index: int
    start_ms: int
    end_ms: int
    label: str
    utc_offset: str


def _at(ms: int) -> datetime:
    return EPOCH + timedelta(milliseconds=ms)


def _offset_ms(zone: ZoneInfo, ms: int) -> int:
    return int(_at(ms).astimezone(zone).utcoffset() / timedelta(milliseconds=1))


def _change_point(zone: ZoneInfo, low: int, high: int) -> int:
    """First millisecond with a different offset than ``low`` has, in (low, high]."""
    before = _offset_ms(zone, low)
    steps = range(low, high + 1)
    return steps[bisect_right(steps, False, key=lambda ms: _offset_ms(zone, ms) != before)]


def _stretches(zone: ZoneInfo, start: int, end: int, step: int) -> list[tuple[int, int, int]]:
    """(start, end, offset) pieces of constant offset that cover [start, end)."""
    pieces, left, offset, probe = [], start, _offset_ms(zone, start), start
    while probe < end:
        ahead = min(probe + step, end)
        if _offset_ms(zone, ahead) != offset:
            change = _change_point(zone, probe, ahead)
            pieces.append((left, change, offset))
            left, offset, probe = change, _offset_ms(zone, change), change
        else:
            probe = ahead
    pieces.append((left, end, offset))
    return pieces


def _local_ms(day: date) -> int:
    return (day - date(1970, 1, 1)).days * DAY_MS


def _start_of(wall: int, pieces: list[tuple[int, int, int]]) -> int:
    """UTC instant of a wall-clock time: the earlier of two, or the end of a gap."""
    for start, end, offset in pieces:
        if start + offset > wall:
            return start  # the wall time fell into the gap that ends here
        if wall < end + offset:
            return wall - offset
    raise ValueError("local date out of range")


def midnight_ms(day: date, zone: ZoneInfo) -> int:
    """UTC start of a local date."""
    wall = _local_ms(day)
    return _start_of(wall, _stretches(zone, wall - 2 * DAY_MS, wall + 2 * DAY_MS, HOUR_MS // 4))


def _midnights(days: list[date], zone: ZoneInfo) -> list[int]:
    """UTC starts of ascending dates, from one reading of the zone; skipped dates vanish."""
    first, last = _local_ms(days[0]) - 2 * DAY_MS, _local_ms(days[-1]) + 2 * DAY_MS
    step = HOUR_MS if last - first <= 2300 * DAY_MS else 6 * HOUR_MS
    pieces = _stretches(zone, first, last, step)
    points, at = [], 0
    for day in days:
        wall = _local_ms(day)
        while pieces[at][1] + pieces[at][2] <= wall:
            at += 1
        points.append(_start_of(wall, pieces[at:]))
    return sorted(set(points))


def _hour_points(zone: ZoneInfo, start: int, end: int) -> list[int]:
    points = set()
    pieces = _stretches(zone, start - 2 * DAY_MS, end + 2 * DAY_MS, HOUR_MS // 4)
    for number, (left, right, offset) in enumerate(pieces):
        if number:
            points.add(left)  # every offset change starts a bucket
        first = left + (-(left + offset)) % HOUR_MS
        points.update(range(first, right, HOUR_MS))
    return sorted(points)


def _local_date(zone: ZoneInfo, ms: int) -> date:
    return _at(ms).astimezone(zone).date()


def _day_points(zone: ZoneInfo, start: int, end: int) -> list[int]:
    first = _local_date(zone, start) - timedelta(days=2)
    count = (_local_date(zone, end) - first).days + 3
    return _midnights([first + timedelta(days=n) for n in range(count)], zone)


def _month_points(zone: ZoneInfo, start: int, end: int) -> list[int]:
    first, last = _local_date(zone, start), _local_date(zone, end)
    months = range(first.year * 12 + first.month - 1, last.year * 12 + last.month + 1)
    return _midnights([date(m // 12, m % 12 + 1, 1) for m in months], zone)


def offset_text(offset_ms: int) -> str:
    seconds = abs(offset_ms) // 1000
    text = f"{'-' if offset_ms < 0 else '+'}{seconds // 3600:02d}:{seconds // 60 % 60:02d}"
    return text if seconds % 60 == 0 else f"{text}:{seconds % 60:02d}"


def buckets(start_ms: int, end_ms: int, zone_name: str, grain: str) -> list[Bucket]:
    """Buckets clipped to the range; labels and offsets are those of the unclipped start."""
    zone = ZoneInfo(zone_name)
    if not start_ms < end_ms or end_ms - start_ms > MAX_SPAN_DAYS[grain] * DAY_MS:
        raise ValueError(f"range not usable with {grain} buckets")
    make = {"hour": _hour_points, "day": _day_points, "month": _month_points}[grain]
    points = make(zone, start_ms, end_ms)
    result = []
    for left, right in zip(points, points[1:]):
        start, end = max(left, start_ms), min(right, end_ms)
        if start >= end:
            continue
        label = _at(left).astimezone(zone).strftime(LABEL_FORMAT[grain])
        result.append(Bucket(len(result), start, end, label, offset_text(_offset_ms(zone, left))))
    if len(result) > MAX_BUCKETS:
        raise ValueError("too many buckets")
    if not result or result[0].start_ms != start_ms or result[-1].end_ms != end_ms:
        raise ValueError("buckets do not cover the range")
    return result


@dataclass(frozen=True)
class ResolvedRange:
    start_ms: int
    end_ms: int
    heatmap_start_ms: int
    heatmap_end_ms: int
    local_today: str


def _date_range(first: date, last: date, zone: ZoneInfo) -> tuple[int, int]:
    start, end = midnight_ms(first, zone), midnight_ms(last + timedelta(days=1), zone)
    if first > last or start >= end:
        raise ValueError("the dates hold no time")
    return start, end


def resolve_selection(
    zone_name: str,
    selection: str,
    now_ms: int,
    start_date: str | None = None,
    end_date: str | None = None,
) -> ResolvedRange:
    """today, last7, last30 or custom (inclusive dates), and the 182 days of the heatmap."""
    zone = ZoneInfo(zone_name)
    today = _local_date(zone, now_ms)
    days_back = {"today": 0, "last7": 6, "last30": 29}
    if selection == "custom":
        first, last = (_strict_date(text) for text in (start_date, end_date))
    else:
        first, last = today - timedelta(days=days_back[selection]), today
    start, end = _date_range(first, last, zone)
    heat = _date_range(today - timedelta(days=181), today, zone)
    return ResolvedRange(start, end, *heat, today.isoformat())


def _strict_date(text: str | None) -> date:
    value = datetime.strptime(text or "", "%Y-%m-%d").date()
    if value.isoformat() != text:
        raise ValueError("dates are written YYYY-MM-DD")
    return value


def available_grain(grain: str, start_ms: int, end_ms: int) -> str:
    """Coarsen a grain until the range fits below the bucket limit."""
    span = end_ms - start_ms
    if grain == "hour" and span > AVAILABLE_STEPS * HOUR_MS:
        grain = "day"
    if grain == "day" and span > AVAILABLE_STEPS * DAY_MS:
        grain = "month"
    return grain


def small_scope_range(zone_name: str, scope: str, now_ms: int, started_ms: int | None = None):
    """Range of the compact view: today, or one session since a fixed start; both end after now."""
    if scope == "today":
        start = midnight_ms(_local_date(ZoneInfo(zone_name), now_ms), ZoneInfo(zone_name))
    else:
        start = started_ms
    if start is None or start > now_ms:
        raise ValueError("the scope starts after now")
    return start, now_ms + 1
