"""Clock strings and seconds as Column functions; every reading rule keeps its own name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemograph.functions.text import fixed

#: Seconds from one recorded day to the next, and each day's recording start (fixed values).
DAY_OFFSET = 100_000
RECORDING_START = {
    1: 11 * 3600 + 9 * 60 + 42,
    2: 10 * 3600 + 44 * 60 + 25,
    3: 11 * 3600 + 17 * 60 + 27,
    4: 10 * 3600 + 48 * 60 + 20,
    5: 11 * 3600 + 0 * 60 + 31,
    6: 9 * 3600 + 49 * 60 + 33,
    7: 11 * 3600 + 56 * 60 + 8,
}
CLOCK = r"([0-9]{1,2}):([0-9]{2}):([0-9]{2})$"


def _whole(sec: Column) -> Column:
    return sec.cast("long")


def hms(sec: Column) -> Column:
    """HH:MM:SS of seconds, cut and not rounded."""
    s = _whole(sec)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def day_hms(sec: Column) -> Column:
    """DAYn HH:MM:SS of seconds since the first day."""
    s = _whole(sec)
    return F.concat(F.lit("DAY"), (F.floor(s / DAY_OFFSET) + 1).cast("string"), F.lit(" "), hms(F.pmod(s, F.lit(DAY_OFFSET))))


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm of whole milliseconds."""
    m = ms.cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(m / 3_600_000), F.floor(m % 3_600_000 / 60_000), F.floor(m % 60_000 / 1000), m % 1000)


def scaled(sec: Column, longest: Column) -> Column:
    """h:mm:ss.s, m:ss.s or s.s with an s by the longest time shown beside it."""
    h, m, s = F.floor(sec / 3600), F.floor(sec % 3600 / 60), sec % 60
    tenth = fixed(s, 1, "%04.1f")
    return (
        F.when(longest >= 3600, F.concat(h.cast("string"), F.lit(":"), F.format_string("%02d", m), F.lit(":"), tenth))
        .when(longest >= 60, F.concat(F.floor(sec / 60).cast("string"), F.lit(":"), tenth))
        .otherwise(fixed(sec, 1, "%.1fs"))
    )


def _clock(text: Column, pattern: str, first: int) -> Column:
    """Seconds of the three groups from ``first`` on; null without a match."""
    h, m, s = (F.regexp_extract(text, pattern, first + i).try_cast("double") for i in range(3))
    return h * 3600 + m * 60 + s


def _day(text: Column, pattern: str) -> Column:
    return (F.regexp_extract(text, pattern, 1).try_cast("double") - 1) * DAY_OFFSET + _clock(text, pattern, 2)


def parse_item(text: Column) -> Column:
    """Item of a time range: a number, dayN_ and DAYN clocks, a clock at the end, else 0.0."""
    t = F.trim(text)
    return F.coalesce(t.try_cast("double"), _day(t, "^(?i:day)([0-9]+)_" + CLOCK), _day(t, r"^DAY([0-9]+)\s+" + CLOCK), _clock(t, CLOCK, 1), F.lit(0.0))


def parse_day_argument(text: Column) -> Column:
    """DAYN H:MM:SS at the start; null otherwise."""
    return _day(F.trim(text), r"^DAY([0-9]+)\s+([0-9]{1,2}):([0-9]{2}):([0-9]{2})")


def parse_plain(text: Column) -> Column:
    """A number or a clock at the end; null otherwise."""
    t = F.trim(text)
    return F.coalesce(t.try_cast("double"), _clock(t, CLOCK, 1))


def parse_day_based(text: Column) -> Column:
    """A number or dayN_ / dayN clocks in any case; null otherwise."""
    t = F.trim(text)
    return F.coalesce(t.try_cast("double"), _day(t, "^(?i:day)([0-9]+)[_ ]" + CLOCK))


def _folded(text: Column) -> Column:
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("double"))
    return F.when(F.size(parts) <= 3, F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p))


def parse_build(text: Column) -> Column:
    """H:M:S, M:S or seconds; null where the text is none of them."""
    return _folded(text)


def parse_shared(text: Column) -> Column:
    """As ``parse_build``, and a trailing s is allowed."""
    return _folded(F.trim(F.regexp_replace(F.trim(text), "s$", "")))


def day_base(day: Column) -> Column:
    """Seconds at which a recorded day's own clock starts."""
    start = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in RECORDING_START.items() for x in kv)), day.cast("int")), F.lit(0))
    return (day - 1) * DAY_OFFSET + start


def range_text(start: Column, end: Column, days: bool = False) -> Column:
    """"a - b" of a range; null unless both ends are there."""
    f = day_hms if days else hms
    return F.when(start.isNotNull() & end.isNotNull(), F.concat(f(start), F.lit(" - "), f(end)))
