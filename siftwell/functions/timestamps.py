"""Reading a written timestamp: every valid interpretation of a value, as plain Python for Arrow functions.

An interpretation is (microseconds since 1970 UTC, format number, cost). The cost ranks readings by
convention: 0 for the reading that convention names, CONVENTION for another that the digits also allow.
Values that name only a day, and values that cannot be read, have none.
"""

from __future__ import annotations

import re
from datetime import UTC, date, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

#: Dearer than all that a record's two neighbours can save, so that context never overrules a convention.
CONVENTION = 20.0

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}

# Zone abbreviations, each with the offsets in minutes that it is used for.
ABBREVIATIONS = {
    "Z": (0,), "UTC": (0,), "GMT": (0,), "UT": (0,), "WET": (0,), "WEST": (60,), "BST": (60,), "CET": (60,), "CEST": (120,), "EET": (120,), "EEST": (180,),
    "MSK": (180,), "IST": (330, 120, 60), "JST": (540,), "KST": (540,), "AEST": (600,), "AEDT": (660,), "CST": (-360, 480), "CDT": (-300,), "EST": (-300,), "EDT": (-240,),
    "MST": (-420,), "MDT": (-360,), "PST": (-480,), "PDT": (-420,), "BRT": (-180,),
}

_TIME = r"(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d{1,9}))?)?\s*([AaPp]\.?[Mm]\.?)?"
_ZONE = r"(?:\s*([+-]\d\d(?::?\d\d)?)|\s*(?!\d)([A-Z]{1,4})(?![A-Za-z/])|\s+([A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)+))?(?:\s*\[[^\]]*\])?"
_DAYNAME = r"(?:[A-Za-z]{3,9}\.?,?\s+)?"
_PATTERNS = [
    ("ymd", re.compile(rf"(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:[Tt]|\s+){_TIME}{_ZONE}$")),
    ("compact", re.compile(r"(\d{4})(\d\d)(\d\d)[Tt]?(\d\d)(\d\d)(\d\d)(?:[.,](\d{1,9}))?\s*(Z|[+-]\d\d(?::?\d\d)?)?$")),
    ("dmy_name", re.compile(rf"{_DAYNAME}(\d{{1,2}})[ -]([A-Za-z]{{3,9}})\.?,?[ -](\d{{4}}),?(?:\s+at)?\s+{_TIME}{_ZONE}$")),
    ("mdy_name", re.compile(rf"{_DAYNAME}([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?(?:\s+at)?\s+{_TIME}{_ZONE}$")),
    ("ctime", re.compile(r"[A-Za-z]{3}\s+([A-Za-z]{3})\s+(\d{1,2})\s+(\d\d):(\d\d):(\d\d)\s+(?:([A-Z]{1,5})\s+)?(\d{4})$")),
    ("xxy", re.compile(rf"(\d{{1,2}})([/.-])(\d{{1,2}})\2(\d{{4}}),?(?:\s+at)?\s+{_TIME}{_ZONE}$")),
    ("han", re.compile(rf"(\d{{4}})\s*年\s*(\d{{1,2}})\s*月\s*(\d{{1,2}})\s*日\s*{_TIME}{_ZONE}$")),
    ("epoch", re.compile(r"(\d{10}|\d{13}|\d{16}|\d{19})$")),
]
FORMATS = {name: i for i, name in enumerate([*(n for n, _ in _PATTERNS), "month_first", "day_first"])}


@lru_cache(maxsize=2048)
def zone(name: str | None) -> ZoneInfo | None:
    """The named zone, or None where there is no such zone."""
    if not name or name.startswith("/") or ".." in name:
        return None
    try:
        return ZoneInfo(name.strip())
    except Exception:
        return None


def _micros(d: datetime) -> int:
    delta = d - EPOCH
    return (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds


def _instants(y, mo, d, h, mi, s, frac, ampm, offset, abbreviation, region, local) -> list[int]:
    """Microseconds of a civil time under its own zone, else the local one; empty when it isn't a time.

    A clock time that a zone shows twice gives both, the first before the second; one that it skips keeps the offset before the gap.
    """
    h, mi, s = int(h), int(mi), int(s or 0)
    if ampm:
        if not 1 <= h <= 12:
            return []
        h = h % 12 + (12 if ampm[0] in "pP" else 0)
    carry = 0
    if h == 24 and mi == 0 and s == 0:
        h, carry = 0, 86400
    if s == 60:
        s, carry = 59, carry + 1
    try:
        civil = datetime(int(y), int(mo), int(d), h, mi, s, int((frac or "0")[:6].ljust(6, "0")))
        if offset:
            digits = offset[1:].replace(":", "")
            minutes = int(digits[:2]) * 60 + int(digits[2:] or 0)
            if minutes > 18 * 60 or int(digits[2:] or 0) > 59:
                return []
            minutes = -minutes if offset[0] == "-" else minutes
            found = [_micros(civil.replace(tzinfo=UTC)) - minutes * 60_000_000]
        elif abbreviation:
            if abbreviation not in ABBREVIATIONS:
                return []
            found = [_micros(civil.replace(tzinfo=UTC)) - m * 60_000_000 for m in ABBREVIATIONS[abbreviation]]
        else:
            tz = zone(region) if region else local
            if tz is None:
                return []
            first, second = civil.replace(tzinfo=tz, fold=0), civil.replace(tzinfo=tz, fold=1)
            found = [_micros(first.astimezone(UTC))]
            if second.utcoffset() < first.utcoffset():
                found.append(_micros(second.astimezone(UTC)))
    except (ValueError, OverflowError):
        return []
    return [f + carry * 1_000_000 for f in found]


def _month(name: str) -> int | None:
    return MONTHS.get(name[:3].lower())


def interpretations(value: str | None, local: ZoneInfo | None) -> list[tuple[int, int, float]]:
    """All valid readings of one value; `local` is the zone of values that name none (None reads as UTC)."""
    if value is None:
        return []
    text, local = value.strip(), local or UTC
    out: list[tuple[int, int, float]] = []

    def add(fmt: int, cost: float, *given) -> None:
        found = _instants(*given, local)
        # several uses of an abbreviation are equals; of a clock time shown twice the first is the usual one
        twice = given[9] is None and not given[8]
        out.extend((u, fmt, cost + CONVENTION * (twice and k > 0)) for k, u in enumerate(found))

    for name, pattern in _PATTERNS:
        m = pattern.match(text)
        if not m:
            continue
        g, code = m.groups(), FORMATS[name]
        if name == "ymd":
            add(code, 0.0, g[0], g[2], g[3], *g[4:9], *g[9:12])
        elif name == "compact":
            z = g[7]
            add(code, 0.0, *g[:6], g[6], None, None if z == "Z" else z, "Z" if z == "Z" else None, None)
        elif name == "dmy_name" and _month(g[1]):
            add(code, 0.0, g[2], _month(g[1]), g[0], *g[3:8], *g[8:11])
        elif name == "mdy_name" and _month(g[0]):
            add(code, 0.0, g[2], _month(g[0]), g[1], *g[3:8], *g[8:11])
        elif name == "ctime" and _month(g[0]):
            add(code, 0.0, g[6], _month(g[0]), g[1], *g[2:5], None, None, None, g[5], None)
        elif name == "han":
            add(code, 0.0, *g[:3], *g[3:8], *g[8:11])
        elif name == "epoch":
            micros = int(g[0]) * 10**6 // 10 ** {10: 0, 13: 3, 16: 6, 19: 9}[len(g[0])]
            out.append((micros, code, 0.0))
        elif name == "xxy":
            # slashes: month first by convention; dots and hyphens: day first
            for fmt, mo, d in (("month_first", g[0], g[2]), ("day_first", g[2], g[0])):
                usual = (fmt == "month_first") == (g[1] == "/")
                add(FORMATS[fmt], 0.0 if usual else CONVENTION, g[3], mo, d, *g[4:9], *g[9:12])
        if out:
            break
    if least := min((c for _, _, c in out), default=0.0):
        out = [(u, f, c - least) for u, f, c in out]  # the usual reading isn't a date: what is left is no breach
    return list(dict.fromkeys(out))


def day_only(value: str | None) -> bool:
    """Whether a value names a day and no time."""
    m = re.fullmatch(r"(\d{4})[-/.]?(\d\d)[-/.]?(\d\d)", (value or "").strip())
    if not m:
        return False
    try:
        date(*map(int, m.groups()))
    except ValueError:
        return False
    return True


def item_interpretations(published: str | None, raw: str | None, feed_zone: str | None, source_zone: str | None) -> list[tuple[int, int, float]]:
    """Readings of a record's own value, else those of the text its feed wrote."""
    local = zone(feed_zone) or zone(source_zone) or UTC
    return interpretations(published, local) or interpretations(raw, local)


def civil(micros: int) -> datetime:
    return EPOCH + timedelta(microseconds=micros)
