"""Time: parsing with a status, local days, windows and the announcement calendar. The session's zone is UTC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIL = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm z", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm")


def parsed(value: Column) -> Column:
    """The instant of a mail-style or ISO timestamp, null if it's neither; without a zone it is UTC."""
    text = F.trim(value)
    mail = F.regexp_replace(text, r"^[A-Za-z]{3,9},\s*", "")
    iso = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]{1,9})?)?\s*(Z|[+-][0-9]{2}(:?[0-9]{2})?)?)?$"), F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp"))
    return F.coalesce(iso, *(F.when(mail.rlike("^[0-9]{1,2} [A-Za-z]{3} [0-9]{4} "), F.try_to_timestamp(mail, F.lit(f))) for f in _MAIL))


def parsed_or(value: Column, fallback: Column) -> tuple[Column, Column]:
    """(instant, verified): the parsed instant or the fallback, and whether it was parsed."""
    found = parsed(value)
    return F.coalesce(found, fallback), found.isNotNull()


def local_date(instant: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, zone))


def local_day(instant: Column, zone: str) -> tuple[Column, Column]:
    """The UTC bounds of the local day of an instant, the upper one open."""
    day = local_date(instant, zone)
    return F.to_utc_timestamp(day.cast("timestamp"), zone), F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)


def local_minute(instant: Column, zone: str) -> Column:
    """Minute of the local day."""
    local = F.from_utc_timestamp(instant, zone)
    return F.hour(local) * 60 + F.minute(local)


def phase(minute: Column, bounds: Sequence[tuple[str, int, int]]) -> Column:
    """The first phase (name, from, to) whose half-open minutes hold the minute; 'none' otherwise."""
    out = F.lit("none")
    for name, low, high in reversed(list(bounds)):
        out = F.when((minute >= low) & (minute < high), F.lit(name)).otherwise(out)
    return out


def shown_local(instant: Column, zone: str, fallback: Column, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(instant, zone), pattern), fallback)


def step_by_age(age_hours: Column, steps: Sequence[tuple[float, float]], beyond: float) -> Column:
    """The value of the first step (hours, value) that isn't younger than the age."""
    out = F.lit(float(beyond))
    for hours, value in reversed(list(steps)):
        out = F.when(age_hours <= hours, F.lit(float(value))).otherwise(out)
    return out


def retry_wait(value: Column, now: Column) -> Column:
    """Seconds that a Retry-After header asks for: a number, or the time until a date; else 0."""
    text = F.trim(F.coalesce(value, F.lit("")))
    until = (F.unix_micros(parsed(text)) - F.unix_micros(now)) / 1e6
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("double")).otherwise(F.greatest(F.lit(0.0), F.coalesce(until, F.lit(0.0))))


def period_bounds(now: Column, zone: str, kind: str, period: str, hours: int, lag_days: int = 0) -> tuple[Column, Column, Column]:
    """(day, since, before) of a named period, half-open and in UTC, as expressions over the instant `now`.

    Periods are `today` (a local day), `recent` (so many hours) and `all` (null bounds); `auto` is today for papers and recent for news.
    Papers look back from the end of the local day `lag_days` before, news from now; what is dated ahead is cut off for papers only.
    """
    if kind not in ("news", "paper") or period not in ("auto", "today", "recent", "all"):
        raise ValueError(f"no window for {kind} and {period}")
    back = lag_days if kind == "paper" else 0
    day = F.date_sub(local_date(now, zone), back)
    opens, closes = (F.to_utc_timestamp(F.date_add(day, k).cast("timestamp"), zone) for k in (0, 1))
    never = F.lit(None).cast("timestamp")
    if period == "all":
        return day, never, never
    if period == "today" or (period == "auto" and kind == "paper"):
        return day, opens, closes
    seen_from = closes - F.expr("interval 1 microsecond") if back else now
    return day, seen_from - F.make_dt_interval(F.lit(0), F.lit(max(1, int(hours)))), closes if kind == "paper" else never


def reference_instant(day: Column, now: Column, zone: str) -> Column:
    """The instant that a day stands for: now where it's blank or today, its last microsecond where it's past; null if it isn't a day or lies ahead."""
    asked = F.when(day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), day.try_cast("date"))
    today = local_date(now, zone)
    ends = F.to_utc_timestamp(F.date_add(asked, 1).cast("timestamp"), zone) - F.expr("interval 1 microsecond")
    return F.when((F.coalesce(day, F.lit("")) == "") | (asked == today), now).when(asked < today, ends)


def announcement_calendar(spark: SparkSession, first: str, last: str, deferred: Sequence[str] = (), zone: str = "America/New_York", hour: int = 20, deadline: int = 14) -> DataFrame:
    """(day, since, before, announced): announcements from `first` to `last` and the submissions each one covers.

    Announced Sunday to Thursday at `hour` local time, except deferred days, whose submissions carry forward. A day's deadline
    is its own at `deadline` o'clock, Sunday's that of Friday; dates are moved as local dates, then taken to UTC.
    """
    days = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(first).cast("date"), 40), F.lit(last).cast("date"))).alias("day"))
    days = days.where(F.weekday("day").isin(0, 1, 2, 3, 6) & ~F.col("day").cast("string").isin(list(deferred)))
    due = F.when(F.weekday("day") == 6, F.date_sub("day", 2)).otherwise(F.col("day"))

    def at(d: Column, h: int) -> Column:
        return F.to_utc_timestamp(d.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(h)), zone)

    days = days.select("day", due.alias("due")).withColumn("earlier", F.expr("lag(due) over (order by day)"))  # one row a day
    days = days.where((F.col("day") >= F.lit(first).cast("date")) & F.col("earlier").isNotNull())
    return days.select("day", at(F.col("earlier"), deadline).alias("since"), at(F.col("due"), deadline).alias("before"), at(F.col("day"), hour).alias("announced"))
