"""Dates in claims, English and German: what day a user says it is, and what relative phrases mean on that day.

Each phrase kind is a pattern and a function of the day; Spark calls them through Arrow batches."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Month and weekday names, number words.
MONTHS = (("january", "jan", "januar", "jänner"), ("february", "feb", "februar"), ("march", "mar", "märz", "maerz"), ("april", "apr"), ("may", "mai"), ("june", "jun", "juni"), ("july", "jul", "juli"), ("august", "aug"), ("september", "sep", "sept"), ("october", "oct", "oktober", "okt"), ("november", "nov"), ("december", "dec", "dezember", "dez"))
DAYS = (("monday", "montag"), ("tuesday", "dienstag"), ("wednesday", "mittwoch"), ("thursday", "donnerstag"), ("friday", "freitag"), ("saturday", "samstag"), ("sunday", "sonntag"))
NUMBERS = (("one", "a", "an", "einem", "einer"), ("two", "zwei"), ("three", "drei"), ("four", "vier"), ("five", "fünf"), ("six", "sechs"), ("seven", "sieben"), ("eight", "acht"), ("nine", "neun"), ("ten", "zehn"))
_month = {n: k for k, names in enumerate(MONTHS, 1) for n in names}
_day = {n: k for k, names in enumerate(DAYS) for n in names}
_number = {n: k for k, names in enumerate(NUMBERS, 1) for n in names}
_alt = lambda names: "|".join(sorted(names, key=len, reverse=True))
_SAYS = r"(?:today is|today's date is|today's date:|the date today is|heute ist|wir haben heute|heutiges datum:|date:|datum:)\s+(?:(?:der|den|the)\s+)?(?:(?:" + _alt(_day) + r")\.?,?\s+)?(?:(?:der|den|the)\s+)?"
_SHAPES: list[tuple[str, tuple[int, int, int]]] = [  # pattern; which groups are year, month, day
    (r"(\d{4})[-/](\d{2})[-/](\d{2})", (1, 2, 3)),
    (r"(\d{1,2})\.\s?(\d{1,2})\.\s?(\d{4})", (3, 2, 1)),
    (rf"(\d{{1,2}})(?:st|nd|rd|th|\.)?\s+(?:of\s+)?({_alt(_month)})\.?,?\s+(\d{{4}})", (3, 2, 1)),
    (rf"({_alt(_month)})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})", (3, 1, 2)),
]
_STATED = [(re.compile(rf"\[?\s*{_SAYS}{p}\s*\]?", re.I), order) for p, order in _SHAPES]


def stated_date(text: str | None) -> dt.date | None:
    """The day that a message says it is; the earliest statement counts, None if it is no date."""
    found = [(m.start(), m, order) for p, order in _STATED if (m := p.search(text or ""))]
    if not found:
        return None
    _, m, order = min(found, key=lambda x: x[0])
    y, mo, d = (m[k] for k in order)
    try:
        return dt.date(int(y), _month.get(mo.lower()) or int(mo), int(d))
    except ValueError:
        return None


def strip_statement(text: str | None) -> str:
    for p, _ in _STATED:
        text = p.sub("", text or "")
    return text.strip()


def _ago(days: int) -> Callable[[dt.date, re.Match], str]:
    return lambda day, m: (day - dt.timedelta(days)).isoformat()


def _count(day: dt.date, m: re.Match) -> str:
    n = int(m[1]) if m[1].isdigit() else _number[m[1].lower()]
    return (day - dt.timedelta(n * (7 if m[2].lower()[0] == "w" else 1))).isoformat()


def _weekday(day: dt.date, m: re.Match) -> str:
    return (day - dt.timedelta((day.weekday() - _day[m[1].lower()]) % 7 or 7)).isoformat()


_NUM = rf"(\d{{1,3}}|{_alt(_number)})"
_PHRASES = [
    (r"the day before yesterday|vorgestern", _ago(2)),
    (r"yesterday|gestern", _ago(1)),
    (r"tomorrow", _ago(-1)),
    (r"today|tonight|this (?:morning|afternoon|evening)|heute(?: morgen| abend)?", _ago(0)),
    (rf"(?:last|this past|letzten|letzte|vergangenen) ({_alt(_day)})", _weekday),
    (rf"{_NUM} (days?|weeks?) ago", _count),
    (rf"vor {_NUM} (tag(?:en)?|wochen?)", _count),
    (r"last week|letzte woche|vergangene woche", lambda day, m: f"≈ {(day - dt.timedelta(7)).isoformat()}"),
    (r"last month|letzten monat|vergangenen monat", lambda day, m: (day.replace(day=1) - dt.timedelta(1)).strftime("%Y-%m")),
    (r"this month|diesen monat", lambda day, m: day.strftime("%Y-%m")),
]
_ANY = re.compile("|".join(rf"\b(?:{re.sub(r'\((?!\?)', '(?:', p)})\b" for p, _ in _PHRASES), re.I)
_EACH = [(re.compile(p, re.I), f) for p, f in _PHRASES]
_DONE = re.compile(r"\s*\((?:\d{4}-\d{2}|≈)")


def resolve(text: str, day: dt.date) -> str:
    """Relative phrases get the date that they mean behind them, unless they have one."""

    def say(m: re.Match) -> str:
        if _DONE.match(text, m.end()):
            return m[0]
        p, f = next((x, f) for x, f in _EACH if x.fullmatch(m[0]))
        return f"{m[0]} ({f(day, p.fullmatch(m[0]))})"

    return _ANY.sub(say, text)


def bare(text: str) -> str:
    return re.sub(r"\s*\(stated \d{4}-\d{2}-\d{2}\)\s*$", "", text)


def annotate(text: str | None, day: dt.date | None) -> str | None:
    return text if not text or day is None else f"{resolve(bare(text), day).rstrip()} (stated {day.isoformat()})"


@F.pandas_udf(T.DateType())
def stated(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(stated_date)


@F.pandas_udf(T.StringType())
def annotated(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, day in rows:
        yield pd.Series([annotate(t, d) for t, d in zip(text, day)], dtype=object)
