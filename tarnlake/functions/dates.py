"""Dates in text, deadlines and what is left until them. `as_of` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnlake.functions import rules


def _month(name: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in rules.MONTHS.items() for x in pair))[F.lower(name)]


def _made(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def parse_date(c: Column) -> Column:
    """ISO day, else ISO month (its first day), else `9 June 2026`, else `June 9, 2026`; the first form found decides."""
    c = F.trim(F.coalesce(c, F.lit("")))
    iso, ym = r"\b(20\d{2})-(\d{2})-(\d{2})\b", r"\b(20\d{2})-(\d{2})\b"
    dmy, mdy = r"\b(\d{1,2})\s+([A-Za-z]+)\s+20(\d{2})\b", r"\b([A-Za-z]+)\s+(\d{1,2}),?\s+20(\d{2})\b"
    g = lambda p, k: F.regexp_extract(c, p, k)
    year = lambda p: F.concat(F.lit("20"), g(p, 3))
    text = lambda m: m.cast("string")
    return (
        F.when(c.rlike(iso), _made(g(iso, 1), g(iso, 2), g(iso, 3)))
        .when(c.rlike(ym), _made(g(ym, 1), g(ym, 2), F.lit("01")))
        .when(c.rlike(dmy) & _month(g(dmy, 2)).isNotNull(), _made(year(dmy), text(_month(g(dmy, 2))), g(dmy, 1)))
        .when(c.rlike(mdy) & _month(g(mdy, 1)).isNotNull(), _made(year(mdy), text(_month(g(mdy, 1))), g(mdy, 2)))
    )


def applicant_group(given: Column, round_: Column) -> Column:
    """The given group if it is a known one, else what the round's label says; Non-EU is tested before EU."""
    low = F.lower(round_)
    compact = F.regexp_replace(low, "[ -]", "")
    has = lambda *parts: low.rlike("|".join(parts))
    said = F.when(F.contains(compact, F.lit("noneu")) | has("non-eu", "international", "visa", "residence"), "Non-EU").when(has("^eu", " eu", "/eu", "eea"), "EU").otherwise("Unknown")
    return F.when(given.isin("EU", "Non-EU", "All", "Unknown"), given).otherwise(said)


def deadlines(c: Column, as_of: Column) -> Column:
    """array<struct<round,date,applicantGroup>> parsed, from as_of on, distinct by round and date, by date."""
    named = F.transform(c, lambda d: F.struct(F.coalesce(F.nullif(F.trim(d["round"]), F.lit("")), F.lit("Application")).alias("round"), parse_date(d["date"]).alias("date"), d["applicantGroup"].alias("g")))
    due = F.filter(named, lambda d: d["date"] >= as_of)
    first = F.filter(due, lambda d, i: ~F.exists(F.slice(due, F.lit(1), i), lambda e: (e["round"] == d["round"]) & (e["date"] == d["date"])))
    grouped = F.transform(first, lambda d: F.struct(d["date"].alias("date"), d["round"].alias("round"), applicant_group(d["g"], d["round"]).alias("applicantGroup")))
    return F.transform(F.array_sort(grouped), lambda d: F.struct(d["round"].alias("round"), d["date"].alias("date"), d["applicantGroup"].alias("applicantGroup")))


def days_until(day: Column, as_of: Column) -> Column:
    """Whole days from as_of to the day, part days counted as whole ones (as_of may be a timestamp)."""
    return F.ceil((F.unix_micros(day.cast("timestamp")) - F.unix_micros(as_of.cast("timestamp"))) / 86400000000).cast("int")


def tone(days: Column) -> Column:
    return F.when(days.isNull(), "dim").when(days < 0, "bad").when(days <= 21, "soon").otherwise("ok")


# What pages write beside a deadline that is past, due today or due tomorrow.
PAST, TODAY, TOMORROW = "过期 ", "今日截止", "明日截止"


def countdown(days: Column) -> Column:
    """Days up to 30, whole months of 30 days beyond."""
    d = lambda c: F.concat(c.cast("string"), F.lit("d"))
    return (
        F.when(days.isNull(), "-").when(days < 0, F.concat(F.lit(PAST), d(-days))).when(days == 0, TODAY).when(days == 1, TOMORROW).when(days <= 30, d(days))
        .otherwise(F.concat(F.floor(days / 30).cast("string"), F.lit("mo")))
    )


def iso_stamp(c: Column) -> Column:
    """A timestamp in UTC as ISO text that ends in Z."""
    return F.concat(F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.0+$", ""), F.lit("Z"))


def capture_stamp(c: Column) -> Column:
    """A timestamp in UTC as the compact text of capture folders."""
    return F.date_format(c, "yyyyMMdd'T'HHmmssSSSSSS'Z'")


# Words near which a date is an application deadline, and ones of dates that are none.
DEADLINE_CONTEXT = r"deadline|closing date|apply by|application(?:s)? close|submit by|due date"
EVENT_CONTEXT = r"open day|webinar|info(?:rmation)? session|semester starts|begins on|orientation|graduation"
_ANY_DATE = r"20\d{2}-\d{2}-\d{2}|\d{1,2}\s+[A-Za-z]{3,9}\s+20\d{2}|[A-Za-z]{3,9}\s+\d{1,2},?\s+20\d{2}"


def mined_deadlines(c: Column, window: int = 80, most: int = 8) -> Column:
    """array<date> of the first dates that stand within `window` characters after a word of deadlines, those of events left out, in order of the text.

    `most` is the feature's own limit (a page names few deadlines). Each date is looked at with what lies between it and the date before.
    """
    dates = F.regexp_extract_all(c, F.lit(f"({_ANY_DATE})"), F.lit(1))
    before = F.transform(F.slice(F.split(c, _ANY_DATE, -1), F.lit(1), F.size(dates)), lambda t: F.lower(F.right(t, F.lit(window))))
    both = F.arrays_zip(dates.alias("d"), before.alias("b"))
    near = F.filter(both, lambda x: x["b"].rlike(DEADLINE_CONTEXT) & ~x["b"].rlike(EVENT_CONTEXT))
    return F.slice(F.array_distinct(F.array_compact(F.transform(near, lambda x: parse_date(x["d"])))), 1, most)
