"""Dates of zones and records: two-digit years, validity, decay, relative time.

Every verdict takes a reference date; nothing reads a clock.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_AGE = 120


def _part(yymmdd: Column, at: int) -> Column:
    return F.when(yymmdd.rlike("^[0-9]{6}$"), F.substring(yymmdd, at, 2)).cast("int")


def days_in_month(year: Column, month: Column) -> Column:
    """Days of a month, by the Gregorian rule for leap years."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(month.isin(4, 6, 9, 11), 30).when((month == 2) & leap, 29).when(month == 2, 28).otherwise(31)


def date_fault(yymmdd: Column) -> Column:
    """Which part of a date can't be: month or day, else null. 29 February may be, as the century isn't known."""
    month, day = _part(yymmdd, 3), _part(yymmdd, 5)
    return F.when((month < 1) | (month > 12), "month").when((day < 1) | (day > days_in_month(F.lit(2000), month)), "day")


def _dated(year: Column, yymmdd: Column) -> Column:
    """The date in a year, null if the calendar lacks it."""
    return F.try_to_date(F.concat(F.lpad(year.cast("string"), 4, "0"), F.substring(yymmdd, 3, 4)), "yyyyMMdd")


def birth_date(yymmdd: Column, reference: Column) -> Column:
    """This century's day, unless after the reference; then the previous century's, up to 120 years back; else null."""
    century = F.floor(F.year(reference) / 100).cast("int") * 100
    fits = lambda d: F.when((d <= reference) & (F.add_months(d, 12 * MAX_AGE) >= reference), d)
    year = _part(yymmdd, 1)
    return F.coalesce(fits(_dated(century + year, yymmdd)), fits(_dated(century - 100 + year, yymmdd)))


def expiry_date(yymmdd: Column, reference: Column) -> Column:
    """This century's day, unless before the reference; then the next century's; null if neither is a day from the reference on."""
    century = F.floor(F.year(reference) / 100).cast("int") * 100
    year = _part(yymmdd, 1)
    this, following = _dated(century + year, yymmdd), _dated(century + 100 + year, yymmdd)
    return F.coalesce(F.when(this >= reference, this), F.when(following >= reference, following))


def expiry_status(expiry: Column, reference: Column) -> Column:
    return F.when(expiry.isNull(), "undetermined").when(expiry < reference, "expired").when(expiry == reference, "expiring_today").otherwise("valid")


def issue_status(issue: Column, reference: Column) -> Column:
    return F.when(issue.isNull(), "undetermined").when(issue > reference, "not_yet_valid").otherwise("issued")


def birth_status(birth: Column, reference: Column) -> Column:
    """Implausible after the reference, or over 120 years before."""
    return F.when(birth.isNull(), "undetermined").when((birth > reference) | (F.add_months(birth, 12 * MAX_AGE) < reference), "implausible").otherwise("plausible")


def order_status(issue: Column, expiry: Column) -> Column:
    return F.when(issue.isNull() | expiry.isNull(), "undetermined").when(issue > expiry, "issue_after_expiry").otherwise("consistent")


def printed_date(text: Column) -> Column:
    """A day as printed, 12 AUG 1974, in ISO form; other text unchanged."""
    day = F.try_to_date(F.when(F.upper(text).rlike(r"^[0-9]{1,2} (JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC) [0-9]{4}$"), F.initcap(F.lower(text))), "d MMM yyyy")
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), text)


def decay(age_days: Column, half_life_days: float) -> Column:
    """0.5 to the power of age over half-life."""
    return F.pow(F.lit(0.5), age_days / F.lit(half_life_days))


def utc_text(moment: Column) -> Column:
    """ISO 8601 in UTC, to the second."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def relative_time(moment: Column, now: Column) -> Column:
    """just now, or n minutes, hours or days ago."""
    seconds = F.unix_micros(now.cast("timestamp")) - F.unix_micros(moment.cast("timestamp"))
    minutes = F.floor(seconds / 60_000_000)
    of = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, of(minutes, "minute")).when(minutes < 1440, of(F.floor(minutes / 60), "hour")).otherwise(of(F.floor(minutes / 1440), "day"))
