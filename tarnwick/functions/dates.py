"""Dates and durations (DAT-*). The clock is always an argument; sessions run in UTC."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

IST = "Asia/Kolkata"
HOUR, YEAR = 3600.0, 365.2425 * 86400

# Upper bounds of a band in hours, and its name.
BANDS = ((6, "HOT_0_6H"), (24, "EARLY_6_24H"), (96, "FRESH_1_3D"), (192, "OPEN_4_7D"), (360, "AGING_8_14D"))


def hours_between(earlier: Column, later: Column) -> Column:
    """Exact to the microsecond; both sides of one timestamp type."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(3.6e9)


def freshness_band(age_max: Column, baseline: Column) -> Column:
    """DAT-02; null age tells whether the first sight was the baseline. Negative ages give null."""
    named = F.lit("STALE_15D_PLUS")
    for bound, name in reversed(BANDS):
        named = F.when(age_max < bound, name).otherwise(named)
    unknown = F.when(baseline, "BASELINE_DATE_UNKNOWN").otherwise("OBSERVED_NEW_DATE_UNKNOWN")
    return F.when(age_max.isNull(), unknown).when(age_max >= 0, named)


def month_first(month: Column) -> Column:
    return F.when(month.rlike(r"^\d{4}-\d{2}$"), F.try_to_timestamp(F.concat(month, F.lit("-01")), F.lit("yyyy-MM-dd")))


def month_last(month: Column) -> Column:
    """DAT-03: the last second of the month."""
    return F.timestamp_add("SECOND", F.lit(-1), F.timestamp_add("MONTH", F.lit(1), month_first(month)))


def tenure_years(now: Column, start: Column, intern_start: Column, intern_end: Column, count_internship: Column) -> Column:
    """DAT-04: struct(low, high) of years since a month known to the month."""
    seconds = lambda a, b: F.timestamp_diff("SECOND", a, b).cast("double")
    first, last = month_first(start), month_last(start)
    counted = count_internship & intern_start.isNotNull() & intern_end.isNotNull()
    more_low = F.when(counted, F.greatest(F.lit(0.0), seconds(month_last(intern_start), F.least(month_first(intern_end), first, now)))).otherwise(0.0)
    more_high = F.when(counted, F.greatest(F.lit(0.0), seconds(month_first(intern_start), F.least(month_last(intern_end), first, now)))).otherwise(0.0)
    low = (F.greatest(F.lit(0.0), seconds(last, now)) + more_low) / YEAR
    high = (F.greatest(F.lit(0.0), seconds(first, now)) + more_high) / YEAR
    return F.struct(low.alias("low"), high.alias("high"))


def business_days_after(day: Column, n: int = 5) -> Column:
    """DAT-05: the date n weekdays later."""
    following = F.filter(F.sequence(F.date_add(day, 1), F.date_add(day, 2 * n + 7)), lambda d: F.weekday(d) < 5)
    return F.get(following, F.lit(n - 1))


def ist(x: Column, pattern: str = "yyyy-MM-dd HH:mm 'IST'") -> Column:
    """DAT-06."""
    return F.date_format(F.from_utc_timestamp(x, IST), pattern)


_OFFSET = r"(?:[Zz]|[+-]\d{2}:?\d{2})$"


def instant(x: Column) -> Column:
    """DAT-09: an ISO date-time with an offset, else null; naive values are not guessed at."""
    return F.when(x.rlike(_OFFSET), F.try_to_timestamp(x))


def due_now(x: Column, now: Column) -> Column:
    """DAT-07: an offset date-time, or a local IST minute; anything else is not due."""
    local = F.to_utc_timestamp(F.when(x.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2} IST$"), F.try_to_timestamp(F.substring(x, 1, 16), F.lit("yyyy-MM-dd HH:mm"))), IST)
    return F.coalesce(F.coalesce(instant(x), local) <= now, F.lit(False))


def digest_window(now: Column, evening: Column) -> Column:
    """DAT-08: 08:11 or 19:11 IST of the day, in UTC."""
    midnight = F.date_trunc("day", F.from_utc_timestamp(now, IST))
    minutes = F.when(evening, 19 * 60 + 11).otherwise(8 * 60 + 11)
    return F.to_utc_timestamp(F.timestamp_add("MINUTE", minutes, midnight), IST)


_UNITS = {"hour": 1, "day": 24, "week": 168}


def posted_date(text: Column, now: Column, zone: Column) -> Column:
    """DAT-01: struct(value, confidence, age_min, age_max, error).

    Relative texts are uncertain by their unit, dates by the length of the local
    day, offset date-times and RFC 2822 dates not at all. Naive, invalid and future
    values keep only their error.
    """
    raw = F.trim(text)
    today = F.to_date(F.from_utc_timestamp(now, zone))
    day = F.when(F.lower(raw) == "today", today).when(F.lower(raw) == "yesterday", F.date_sub(today, 1)).when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(raw, "yyyy-MM-dd"))
    is_day = F.lower(raw).isin("today", "yesterday") | raw.rlike(r"^\d{4}-\d{2}-\d{2}$")
    relative = r"(?i)^(\d{1,9})\s*(hour|day|week)s?\s+ago$"
    is_relative = raw.rlike(relative)
    unit = reduce(lambda c, kv: c.when(F.lower(F.regexp_extract(raw, relative, 2)) == kv[0], kv[1]), _UNITS.items(), F.when(F.lit(False), 0))
    count = F.when(is_relative, F.regexp_extract(raw, relative, 1).cast("long"))
    begin = F.to_utc_timestamp(day.cast("timestamp"), zone)
    end = F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)
    mail = F.regexp_replace(raw, r"^[A-Za-z]{3},\s*", "")
    mail_offset = F.regexp_replace(F.regexp_replace(mail, r"(?:GMT|UT|UTC|Z)$", "+0000"), r"\s+", " ")
    by_mail = F.when(mail_offset.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"), F.try_to_timestamp(mail_offset, F.lit("d MMM yyyy HH:mm:ss Z")))
    is_iso = raw.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")
    by_iso = F.when(is_iso & raw.rlike(_OFFSET), F.try_to_timestamp(raw))
    naive = is_iso & ~raw.rlike(_OFFSET) & F.try_to_timestamp(raw).isNotNull()
    value = F.when(is_relative, F.timestamp_add("HOUR", (-count * unit).cast("int"), now)).when(is_day, begin).otherwise(F.coalesce(by_iso, by_mail))
    age = hours_between(value, now)
    error = F.when(F.coalesce(text, F.lit("")) == "", "").when(naive, "NAIVE_POSTED_DATE").when(value.isNull(), "INVALID_POSTED_DATE").when(age < 0, "FUTURE_POSTED_DATE").otherwise("")
    good = (error == "") & value.isNotNull()
    low = F.when(is_day, F.greatest(F.lit(0.0), age - hours_between(begin, end))).otherwise(age)
    high = F.when(is_relative, age + unit).otherwise(age)
    confidence = F.when(~good, "MISSING").when(is_relative, "RELATIVE_PARSED").when(is_day, "DATE_ONLY").otherwise("EXACT")
    return F.struct(F.when(good, value).alias("value"), F.coalesce(confidence, F.lit("MISSING")).alias("confidence"), F.when(good, low).alias("age_min"), F.when(good, high).alias("age_max"), error.alias("error"))
