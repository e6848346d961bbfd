"""Dates as people and mail clients write them, read in UTC where no offset is given."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
# Fixed values.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_ISO = re.compile(r"(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,6})\d*)?)?)?\s*(Z|[+-]\d{2}:?\d{2})?\Z", re.I)
_CLOCK = re.compile(r"(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([ap]\.?m\.?)?", re.I)
_ZONE = re.compile(r"(?:GMT|UTC|UT)?\s*([+-]\d{2}):?(\d{2})\b|\b(?:GMT|UTC|UT|Z)\b", re.I)
_MONTH_DAY = re.compile(r"(?:(?:%s)[a-z]*\s+\d{1,2}|\d{1,2}\s+(?:%s)[a-z]*)" % ("|".join(MONTHS), "|".join(MONTHS)), re.I)
_NAMED = re.compile(r"\b(%s)[a-z]*\.?" % "|".join(MONTHS), re.I)
_OFFSET = re.compile(r"[+-]\d{2}:?\d{2}\b|\b(?:GMT|UTC|UT|Z)\b|\dZ\Z", re.I)


def to_ms(when: datetime | None) -> int | None:
    if when is None:
        return None
    when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
    return (when - EPOCH) // timedelta(milliseconds=1)


def from_ms(ms: int | None) -> datetime | None:
    return None if ms is None else EPOCH + timedelta(milliseconds=ms)


def iso(ms: int) -> str:
    return from_ms(ms).strftime("%Y-%m-%dT%H:%M:%S.") + f"{ms % 1000:03d}Z"


def instant(text: str) -> int | None:
    """The instant that a complete date names, in milliseconds; None where it cannot be read."""
    text = text.strip()
    try:
        if m := _ISO.match(text):
            y, mo, d, h, mi, s, frac, zone = m.groups()
            at = datetime(int(y), int(mo), int(d), int(h or 0), int(mi or 0), int(s or 0), int((frac or "0").ljust(6, "0")), timezone.utc)
            return to_ms(at) - _shift(zone)
        clock = _CLOCK.search(text)
        hours = minutes = seconds = shift = 0
        if clock:
            hours, minutes, seconds = int(clock[1]), int(clock[2]), int(clock[3] or 0)
            if clock[4]:
                if not 1 <= hours <= 12:
                    return None
                hours = hours % 12 + (12 if clock[4][0].lower() == "p" else 0)
            tail = text[clock.end() :]
            if zone := _ZONE.search(tail):
                shift = _shift(zone[1] + zone[2] if zone[1] else None)
                tail = tail[: zone.start()] + " " + tail[zone.end() :]
            text = text[: clock.start()] + " " + tail
        if m := re.search(r"\b(\d{1,2})[/.](\d{1,2})[/.](\d{4})\b", text):
            month, day, year = int(m[1]), int(m[2]), int(m[3])
        else:
            named, year_at = _NAMED.search(text), re.search(r"\b((?:19|20)\d{2})\b", text)
            if not named or not year_at:
                return None
            month, year = MONTHS.index(named[1].lower()) + 1, int(year_at[1])
            days = re.search(r"\b(\d{1,2})(?:st|nd|rd|th)?\b", text[: year_at.start()] + " " + text[year_at.end() :])
            if not days:
                return None
            day = int(days[1])
        return to_ms(datetime(year, month, day, hours, minutes, seconds, tzinfo=timezone.utc)) - shift
    except (ValueError, OverflowError):
        return None


def _shift(zone: str | None) -> int:
    if not zone or zone.upper() == "Z":
        return 0
    sign = -1 if zone[0] == "-" else 1
    return sign * (int(zone[1:3]) * 60 + int(zone[-2:])) * 60_000


def has_zone(text: str) -> bool:
    """F9 on a string."""
    return bool(_OFFSET.search(text))


def mail_date(raw: str, fallback: int) -> tuple[int, bool]:
    """(instant, whether it is an estimate). A date without a year takes the fallback's, or the one before if that lies more than a day ahead."""
    text = re.sub(r",?\s+at\s+", " ", raw, count=1, flags=re.I).replace(" ", " ").replace(" ", " ")
    text = re.sub(r"\s*\([^)]*ago\)\s*\Z", "", text, flags=re.I).strip()
    if re.search(r"\b(?:19|20)\d{2}\b", text):
        at = instant(text)
        return (fallback, True) if at is None else (at, False)
    named = _MONTH_DAY.search(text)
    if not named:
        return fallback, True
    year = from_ms(fallback).year
    at = instant(f"{text[: named.end()]} {year}{text[named.end() :]}")
    if at is not None and at > fallback + 86_400_000:
        at = instant(f"{text[: named.end()]} {year - 1}{text[named.end() :]}")
    return (fallback if at is None else at), True
