"""Dates said in words: a column of phrases to the times they mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units and days of a phrase.
DAYS = {"월요일": 0, "화요일": 1, "수요일": 2, "목요일": 3, "금요일": 4, "토요일": 5, "일요일": 6}
BACK = {"오늘": 0, "어제": 1, "그제": 2, "그저께": 2}
AGO = r"^(\d{1,6})\s*(일|주|개월|달|년)\s*전$"
LAST_DAY = f"^지난\\s*({'|'.join(DAYS)})$"


def said_time(phrase: Column, now: Column) -> Column:
    """The moment a phrase means, seen from ``now``: the begin of a day, week (from Monday) or month; an ISO date or time is itself; null if it is neither.

    Months and years back keep the day of the month and run over into the next month where that is too short.
    """
    s = F.trim(phrase, F.lit(" \t\n\r"))
    today = F.to_date(now)
    first = F.to_date(F.trunc(today, "month"))
    n, unit = F.regexp_extract(s, AGO, 1).try_cast("int"), F.regexp_extract(s, AGO, 2)
    months = F.when(unit == "년", 12 * n).otherwise(n)
    same_day = F.date_add(F.add_months(first, -months), F.dayofmonth(today) - 1)
    ago = F.when(unit == "일", F.date_sub(today, n)).when(unit == "주", F.date_sub(today, 7 * n)).otherwise(same_day)
    word = F.regexp_replace(s, r"\s+", "")
    monday = F.date_sub(today, F.weekday(today))
    back = F.create_map(*(F.lit(x) for kv in BACK.items() for x in kv))
    day = F.create_map(*(F.lit(x) for kv in DAYS.items() for x in kv))[F.regexp_extract(s, LAST_DAY, 1)]
    # the day before today that has the name; today's own is a week ago
    gap = F.pmod(F.weekday(today) - day - 1, F.lit(7)) + 1
    found = (
        F.when(s.rlike(AGO), ago)
        .when(back[word].isNotNull(), F.date_sub(today, back[word]))
        .when(word == "이번주", monday)
        .when(word == "지난주", F.date_sub(monday, 7))
        .when(word == "이번달", first)
        .when(word == "지난달", F.add_months(first, -1))
        .when(s.rlike(LAST_DAY), F.date_sub(today, gap))
    )
    return F.coalesce(found.cast("timestamp_ntz"), s.try_cast("timestamp_ntz"))


def said_range(begin: Column, end: Column, now: Column) -> Column:
    """(since, until) of two phrases, either of which may be null; what isn't understood bounds nothing."""
    return F.struct(said_time(begin, now).alias("since"), said_time(end, now).alias("until"))
