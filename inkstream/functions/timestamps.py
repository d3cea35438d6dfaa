"""Parsing of timestamps as web pages print them.

``parse_epoch`` takes one raw string with the zone and the date order of the place it was written in and
returns the UTC instant in whole seconds (rounded down), or ``None`` when the string does not denote a
real date with a time of day.
"""

from __future__ import annotations

import calendar
import math
import re
import unicodedata
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

# Month names and their usual abbreviations, by language, January first.
MONTH_NAMES = {
    "en": "january february march april may june july august september october november december",
    "en_short": "jan feb mar apr may jun jul aug sep oct nov dec",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "bn": "জানুয়ারি ফেব্রুয়ারি মার্চ এপ্রিল মে জুন জুলাই আগস্ট সেপ্টেম্বর অক্টোবর নভেম্বর ডিসেম্বর",
}
# Further spellings of single months.
MONTH_EXTRA = {
    "sept": 9, "janv": 1, "févr": 2, "avr": 4, "juil": 7, "déc": 12, "jän": 1, "jänner": 1, "mär": 3, "mrz": 3,
    "okt": 10, "dez": 12, "ene": 1, "abr": 4, "ago": 8, "set": 9, "setiembre": 9, "dic": 12,
    "জানুয়ারী": 1, "ফেব্রুয়ারী": 2, "আগষ্ট": 8,
}
MONTHS = {
    unicodedata.normalize("NFC", name): number
    for names in MONTH_NAMES.values()
    for number, name in enumerate(names.split(), 1)
} | {unicodedata.normalize("NFC", k): v for k, v in MONTH_EXTRA.items()}

# Zone abbreviations in use in each zone's country, minutes east of UTC.
ABBREVIATIONS = {
    "Asia/Dhaka": {"BST": 360, "BDT": 360, "BDST": 420},
    "Asia/Kolkata": {"IST": 330},
    "Europe/London": {"BST": 60, "WET": 0},
    "America/New_York": {
        "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
        "AKST": -540, "AKDT": -480, "HST": -600,
    },
    "Europe/Berlin": {"CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120},
    "Europe/Paris": {"CET": 60, "CEST": 120},
    "Europe/Madrid": {"CET": 60, "CEST": 120, "WET": 0, "WEST": 60},
    "Australia/Sydney": {"AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "EST": 600, "EDT": 660},
}
UNIVERSAL = {"Z": 0, "UTC": 0, "GMT": 0, "UT": 0}

_TIME = (
    r"(?P<h>\d{1,2})(?:[:.h](?P<mi>\d{2}))(?:[:.](?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?"
    r"\s*(?P<ap>[AaPp]\.?\s?[Mm]\.?)?(?:\s*(?:Uhr|h|hrs|Std)\b\.?)?"
)
_ZONE = r"(?:\s*\(?(?:(?P<za>[A-Za-z]{1,5})(?![A-Za-z]))?\s*(?P<zo>[+\-−]\d{1,2}(?::?\d{2})?)?\)?)"
_SEP = r"(?:\s*(?:,|T|t|·|\||-|–|—|à|at|um|a las|at:|kl)\s*|\s+)+"
_DAYNAME = r"(?:[^\W\d_]{2,12}\.?,?\s+)?"
_W = r"[^\W\d_][\wঀ-৿.]*"
_SHAPES = [
    ("ymd", re.compile(rf"(?P<y>\d{{4}})[-/.](?P<m>\d{{1,2}})[-/.](?P<d>\d{{1,2}}){_SEP}{_TIME}{_ZONE}")),
    ("ymd", re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})[Tt ](?P<h>\d{{2}}):?(?P<mi>\d{{2}})(?::?(?P<s>\d{{2}})(?:[.,](?P<f>\d{{1,9}}))?)?(?P<ap>)?{_ZONE}")),
    ("num", re.compile(rf"{_DAYNAME}(?P<a>\d{{1,2}})[-/.](?P<b>\d{{1,2}})[-/.](?P<y>\d{{4}}){_SEP}{_TIME}{_ZONE}")),
    ("dMy", re.compile(rf"{_DAYNAME}(?P<d>\d{{1,2}})(?:st|nd|rd|th|er|\.)?\s+(?:de\s+|of\s+)?(?P<M>{_W}),?\s+(?:de\s+|del\s+)?(?P<y>\d{{4}}){_SEP}{_TIME}{_ZONE}")),
    ("Mdy", re.compile(rf"{_DAYNAME}(?P<M>{_W})\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}){_SEP}{_TIME}{_ZONE}")),
    ("tdMy", re.compile(rf"{_TIME}{_ZONE},?\s+{_DAYNAME}(?P<d>\d{{1,2}})\.?\s+(?P<M>{_W}),?\s+(?P<y>\d{{4}})")),
]
_EPOCH = re.compile(r"(?P<n>\d{10}|\d{13}|\d{16}|\d{19})(?:\.(?P<f>\d+))?")
_NON_ASCII_DIGIT = re.compile(r"[^\W_a-zA-Z0-9]")


@lru_cache(maxsize=64)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


def _ascii_digits(text: str) -> str:
    return _NON_ASCII_DIGIT.sub(lambda m: str(unicodedata.digit(m[0])) if m[0].isdecimal() else m[0], text)


def parse_epoch(raw: str | None, tz_name: str | None, date_order: str | None) -> int | None:
    """UTC seconds of ``raw``, or None.

    Values without zone are local to ``tz_name``: a local time that occurs twice means the earlier instant,
    one that the clocks skip is read with the offset before the change. ``date_order`` ("dmy" or "mdy")
    decides all-numeric dates. Null, blank, relative ("yesterday"), date-only and impossible values give None;
    a zoneless value whose zone is unknown gives None as well.
    """
    if raw is None:
        return None
    text = " ".join(_ascii_digits(unicodedata.normalize("NFC", raw)).split())
    if not text:
        return None
    if m := _EPOCH.fullmatch(text):
        digits = m["n"]
        return int(digits) // 10 ** (len(digits) - 10)
    for shape, pattern in _SHAPES:
        m = pattern.fullmatch(text)
        if not m:
            continue
        g = m.groupdict()
        if shape == "num":
            day, month = (g["b"], g["a"]) if date_order == "mdy" else (g["a"], g["b"])
        elif shape == "ymd":
            day, month = g["d"], g["m"]
        else:
            day, month = g["d"], MONTHS.get(g["M"].lower().rstrip("."))
        if month is None:
            continue
        return _instant(int(g["y"]), int(month), int(day), g, tz_name)
    return None


def _instant(year: int, month: int, day: int, g: dict, tz_name: str | None) -> int | None:
    hour, minute, second = int(g["h"]), int(g["mi"] or 0), int(g["s"] or 0)
    if g.get("ap"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if g["ap"][0] in "pP" else 0)
    if not 1 <= month <= 12 or year < 1 or not 1 <= day <= calendar.monthrange(year, month)[1]:
        return None
    whole_day = hour == 24 and not minute and not second
    if minute > 59 or second > 59 or hour > 23 and not whole_day:
        return None
    local = datetime(year, month, day, 0 if whole_day else hour, minute, second) + timedelta(days=whole_day)
    abbreviation, offset = g.get("za"), g.get("zo")
    east = None
    if abbreviation:
        known = UNIVERSAL | ABBREVIATIONS.get(tz_name or "", {})
        east = known.get(abbreviation.upper())
        if east is None:
            return None
    if offset:
        digits = offset[1:].replace(":", "")
        hours, minutes = int(digits[:2]), int(digits[2:] or 0)
        if hours > 15 or minutes > 59:
            return None
        east = (east or 0) + (hours * 60 + minutes) * (-1 if offset[0] != "+" else 1)
    if east is not None:
        return calendar.timegm(local.timetuple()) - east * 60
    zone = _zone(tz_name) if tz_name else None
    if zone is None:
        return None
    return math.floor(local.replace(tzinfo=zone, fold=0).astimezone(timezone.utc).timestamp())
