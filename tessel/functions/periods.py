"""Periods named in words, as date bounds."""

from __future__ import annotations

import calendar
import re
from datetime import date, timedelta

DAYS = {"day": 1, "week": 7}
AGE = re.compile(r"(\d+|an?|one|two|three|four|five|six)\s+(day|week|month|year)s?")
#: Numbers written out. Fixed values.
NUMBER = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6}


def back(today: date, n: int, unit: str) -> date:
    """The day n units before; a month or year keeps the day of the month where it exists."""
    if unit in DAYS:
        return today - timedelta(days=n * DAYS[unit])
    months = today.year * 12 + today.month - 1 - (n if unit == "month" else 12 * n)
    year, month = divmod(months, 12)
    return date(year, month + 1, min(today.day, calendar.monthrange(year, month + 1)[1]))


def period(phrase: str, today: date) -> tuple[str | None, str | None]:
    """(since, until) of: this or last day, week, month or year; recently; in the last N units; N units ago; more than N units ago.

    ``until`` is included. ``N years ago`` stands for the year and those beside it. Other phrases have no bounds.
    """
    p = " ".join(phrase.lower().split())
    if p in ("recent", "recently", "lately"):
        return back(today, 180, "day").isoformat(), None
    if m := re.search(r"\b(this|last) (week|month|year)\b", p):
        at = today if m[1] == "this" else back(today, 1, m[2])
        if m[2] == "week":
            monday = at - timedelta(days=at.weekday())
            return monday.isoformat(), (monday + timedelta(days=6)).isoformat()
        name = at.isoformat()[: 7 if m[2] == "month" else 4]
        return name, name
    m = AGE.search(p)
    if not m:
        return None, None
    n = int(m[1]) if m[1].isdigit() else NUMBER[m[1]]
    at = back(today, n, m[2])
    if re.search(r"\b(?:more|longer) than\b|\bover\b", p):
        return None, at.isoformat()
    if re.search(r"\b(?:last|past|within)\b", p):
        return at.isoformat(), None
    if "ago" in p:
        if m[2] == "year":
            return str(at.year - 1), str(at.year + 1)
        return back(at, 1, m[2]).isoformat(), back(at, -1, m[2]).isoformat()
    return None, None


def checked_range(since: str | None, until: str | None, today: date, days: int = 30, most: int = 366) -> tuple[str, str]:
    """[since, until) of a report: the last ``days`` days unless given, ``most`` days at most, until excluded."""
    end = date.fromisoformat(until) if until else today + timedelta(days=1)
    start = date.fromisoformat(since) if since else end - timedelta(days=days)
    if not start < end:
        raise ValueError("the range is empty")
    if (end - start).days > most:
        raise ValueError(f"the range has more than {most} days")
    return start.isoformat(), end.isoformat()
