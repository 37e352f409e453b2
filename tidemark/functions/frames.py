"""Time frames: parsing, bucket expressions, and which frame may serve which grouping."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_FRAMES = "1m,1d,1M"
_FIXED = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
_CALENDAR = {"M": ("month", 1), "mo": ("month", 1), "mon": ("month", 1), "month": ("month", 1), "Q": ("quarter", 3), "quarter": ("quarter", 3), "Y": ("year", 12), "year": ("year", 12)}
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


@dataclass(frozen=True, order=True)
class Frame:
    """A bucket length: fixed seconds, or whole calendar months in a time zone. `order` sorts by length."""

    order: int
    name: str
    seconds: int = 0
    months: int = 0
    zone: str = "UTC"

    def bucket(self, t: Column) -> Column:
        """Start of the bucket of t (epoch seconds), as epoch seconds; buckets before 1970 are floored too."""
        if self.seconds:
            return t - F.pmod(t, F.lit(self.seconds))
        local = F.from_utc_timestamp(F.timestamp_seconds(t), self.zone)
        month = (F.year(local) * 12 + F.month(local) - 1).cast("int")
        first = month - F.pmod(month, F.lit(self.months))
        start = F.make_timestamp(F.floor(first / 12).cast("int"), (F.pmod(first, F.lit(12)) + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        return F.unix_seconds(F.to_utc_timestamp(start, self.zone))

    def after(self, start: Column) -> Column:
        """End of the bucket that starts at start, as epoch seconds."""
        return start + self.seconds if self.seconds else self.bucket(start + (self.months * 31 + 1) * 86400)

    def floor(self, t: int) -> int:
        if self.seconds:
            return t - t % self.seconds
        local = (_EPOCH + timedelta(seconds=t)).astimezone(ZoneInfo(self.zone))
        month = local.year * 12 + local.month - 1
        return self._start(month - month % self.months)

    def ceil(self, t: int) -> int:
        low = self.floor(t)
        return low if low == t else self.next(low)

    def next(self, start: int) -> int:
        """End of the bucket that starts at start."""
        if self.seconds:
            return start + self.seconds
        local = (_EPOCH + timedelta(seconds=start)).astimezone(ZoneInfo(self.zone))
        return self._start(local.year * 12 + local.month - 1 + self.months)

    def _start(self, month: int) -> int:
        return int(datetime(month // 12, month % 12 + 1, 1, tzinfo=ZoneInfo(self.zone)).timestamp())


def parse_frames(text: str | None = None, zone: str = "UTC") -> list[Frame]:
    """Frames of a comma list, shortest first. 1m is a minute, 1M a month; a bare number means seconds; what can't be read is left out."""
    found = {}
    for part in (text or DEFAULT_FRAMES).split(","):
        m = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]*)\s*", part)
        if not m or int(m[1]) <= 0:
            continue
        n, unit = int(m[1]), m[2]
        if unit in _FIXED or not unit:
            frame = Frame(n * _FIXED.get(unit, 1), f"{n}{unit or 's'}", seconds=n * _FIXED.get(unit, 1))
        elif unit in _CALENDAR:
            months = n * _CALENDAR[unit][1]
            frame = Frame(months * 2_592_000, f"{n}{'mo' if _CALENDAR[unit][0] == 'month' else unit[0].lower() if unit in 'QY' else unit}", months=months, zone=zone)
        else:
            continue
        found.setdefault(frame.order, frame)
    return sorted(found.values())


def offsets(zone: str, t0: int, t1: int) -> set[int]:
    """Every UTC offset that the zone has between two times, in seconds."""
    z = ZoneInfo(zone)
    at = lambda t: int((_EPOCH + timedelta(seconds=t)).astimezone(z).utcoffset().total_seconds())
    return {at(t) for t in [*range(t0, t1, 86400), t1]}


def refines(frame: Frame, grain: str | None, zone: str, t0: int, t1: int) -> bool:
    """Whether every bucket of frame within [t0, t1) lies in one group of date_trunc(grain) in the zone."""
    if grain is None:
        return True
    if frame.months:
        length = {"month": 1, "quarter": 3, "year": 12}.get(grain)
        return length is not None and frame.zone == zone and length % frame.months == 0
    shifts = offsets(zone, t0, t1)
    fixed = {"second": 1, "minute": 60, "hour": 3600}.get(grain)
    if fixed:
        return frame.seconds <= fixed and fixed % frame.seconds == 0 and all(s % frame.seconds == 0 for s in shifts)
    return 86400 % frame.seconds == 0 and all(s % frame.seconds == 0 for s in shifts)


def trunc(grain: str, t: Column, zone: str) -> Column:
    """date_trunc(grain) of epoch seconds in a time zone, as epoch seconds."""
    local = F.from_utc_timestamp(F.timestamp_seconds(t), zone)
    return F.unix_seconds(F.to_utc_timestamp(F.date_trunc(grain, local), zone))


def epoch_seconds(t: Column, kind: str) -> Column:
    """Whole seconds since 1970 of a timestamp, date or number (already seconds)."""
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return t.cast("long")
    return F.floor(F.unix_micros(t.cast("timestamp")) / 1_000_000) if kind != "date" else F.unix_seconds(t.cast("timestamp"))


def from_epoch(t: Column) -> Column:
    """Timestamp of epoch seconds."""
    return F.timestamp_seconds(t)
