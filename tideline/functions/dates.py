"""Dates as the sources write them. Whatever does not parse is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
#: What the tilde source writes for a date before its records begin.
BEFORE_RECORDS = "Approved Prior to Jan 1, 1982"


def _month(name: Column) -> Column:
    """The number of a month by its first three letters, or null."""
    at = F.instr(F.lit(_MONTHS), F.lower(F.substring(name, 1, 3)))
    return F.when(at % 3 == 1, (at / 3).cast("int") + 1)


def _whole(year: Column, month: Column, day: Column) -> Column:
    """A date of three numbers, null if there is no such day. Each is looked at once, as all of them come out of texts."""
    return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.coalesce(month.cast("string"), F.lit("no month")), day.cast("string")).try_cast("date")


def _named_month_date(text: Column, letters: str) -> Column:
    t = F.trim(text)
    before, behind = F.substring_index(t, ",", 1), F.substring_index(t, ",", -1)
    return F.when(t.rlike(rf"^[A-Za-z]{{{letters}}} \d{{1,2}}, (?!0000)\d{{4}}$"), _whole(F.substring(behind, 2, 4), _month(t), F.substring_index(before, " ", -1)))


def short_month_date(text: Column) -> Column:
    """``Mmm D, YYYY``; the text for dates before 1982 is null, like any other."""
    return _named_month_date(text, "3")


def long_month_date(text: Column) -> Column:
    """``Month D, YYYY``, by the month's first three letters."""
    return _named_month_date(text, "3,9")


def pivot_year_date(text: Column, pivot: int = 50) -> Column:
    """``D-Mon-YY`` (years up to the pivot are of this century) or ``Month D, YYYY``; a date to be determined is null."""
    t = F.trim(text)
    part = lambda k: F.substring_index(F.substring_index(t, "-", k), "-", -1)
    yy = F.substring(part(3), 1, 2).try_cast("int")
    short = F.when(t.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{2}$"), _whole(yy + F.when(yy <= pivot, 2000).otherwise(1900), _month(part(2)), part(1)))
    return F.coalesce(short, long_month_date(text))


def rolling_date(text: Column) -> Column:
    """``M/D/YYYY``; a month or day beyond its range rolls over into the next."""
    t = F.trim(text)
    part = lambda k: F.regexp_extract(t, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", k).try_cast("int")
    return F.date_add(F.add_months(F.make_date(part(3), F.lit(1), F.lit(1)), part(1) - 1), part(2) - 1)


def shown_date(date: Column) -> Column:
    """``Aug 24, 2031``."""
    return F.date_format(date, "MMM d, yyyy")


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def urgency(date: Column, as_of: Column) -> Column:
    """open, imminent (180 days), upcoming (two years) or distant."""
    d = F.datediff(date, as_of)
    return F.when(d <= 0, "open").when(d <= 180, "imminent").when(d <= 730, "upcoming").when(d.isNotNull(), "distant")


def relative_days(date: Column, as_of: Column) -> Column:
    """``in 3 days``, ``2 months ago``, ``in 5 years``, ``Today``."""
    d = F.datediff(date, as_of)
    n = F.abs(d)
    amount = (
        F.when(n < 60, F.concat(n.cast("string"), F.when(n == 1, " day").otherwise(" days")))
        .when(n < 730, F.concat(F.round(n / 30.44).cast("int").cast("string"), F.lit(" months")))
        .otherwise(F.concat(F.round(n / 365.25).cast("int").cast("string"), F.lit(" years")))
    )
    return F.when(d == 0, "Today").when(d > 0, F.concat(F.lit("in "), amount)).when(d < 0, F.concat(amount, F.lit(" ago")))


def term_expiry(nominal: Column, filing: Column, patent_number: Column, days: Column) -> Column:
    """Twenty years from filing for numbers of digits alone, else the nominal date; plus the adjustment."""
    standard = F.coalesce(patent_number.rlike("^[0-9]+$"), F.lit(False)) & filing.isNotNull()
    return F.date_add(F.when(standard, F.add_months(filing, 240)).otherwise(nominal), F.coalesce(days, F.lit(0)))
