"""Period keys and labels.  A day is labelled by its start; weeks, months and years by their last day.

On CF calendars (noleap, all_leap, 360_day) a time is a struct of year, month, day
and second_of_day, because such dates need not exist in Spark's calendar; labels are
structs of the same kind.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FREQUENCIES = ("date", "week", "month", "year")
CALENDARS = ("standard", "noleap", "all_leap", "360_day")
#: Other names under which files carry the calendars.
CALENDAR_NAMES = {"gregorian": "standard", "proleptic_gregorian": "standard", "365_day": "noleap", "366_day": "all_leap"}


def calendar_of(name: str) -> str:
    found = CALENDAR_NAMES.get(name, name)
    if found not in CALENDARS:
        raise ValueError(f"calendar {name!r} is not one of {', '.join(CALENDARS)}")
    return found


def _checked(frequency: str) -> None:
    if frequency not in FREQUENCIES:
        raise KeyError(frequency)


def label(time: Column, frequency: str) -> Column:
    """The label of the period that `time` falls into, as a date."""
    _checked(frequency)
    if frequency == "date":
        return F.to_date(time)
    if frequency == "week":
        return F.date_add(F.to_date(F.date_trunc("week", time)), 6)
    if frequency == "month":
        return F.last_day(time)
    return F.make_date(F.year(time), F.lit(12), F.lit(31))


def month_days(calendar: str, month: Column) -> Column:
    if calendar == "360_day":
        return F.lit(30)
    february = 28 if calendar == "noleap" else 29
    return F.when(month == 2, F.lit(february)).when(month.isin(4, 6, 9, 11), F.lit(30)).otherwise(F.lit(31))


def cf_label(time: Column, frequency: str, calendar: str) -> Column:
    """The label on a CF calendar, as struct<year, month, day, second_of_day>.  Such calendars have no weeks."""
    _checked(frequency)
    if frequency == "week":
        raise NotImplementedError(f"weeks are not defined on the {calendar} calendar")
    year, month, day = time["year"], time["month"], time["day"]
    if frequency == "month":
        day = month_days(calendar, month)
    elif frequency == "year":
        month, day = F.lit(12), F.lit(30 if calendar == "360_day" else 31)
    return F.struct(year.cast("int").alias("year"), month.cast("int").alias("month"), day.cast("int").alias("day"), F.lit(0).alias("second_of_day"))


def cf_ordinal(time: Column, calendar: str) -> Column:
    """Days since year 0 on a CF calendar."""
    year, month, day = time["year"], time["month"], time["day"]
    if calendar == "360_day":
        return (year * 360 + (month - 1) * 30 + day - 1).cast("long")
    length = 365 if calendar == "noleap" else 366
    before = F.element_at(F.array(*[F.lit(x) for x in _month_starts(calendar)]), month.cast("int"))
    return (year * length + before + day - 1).cast("long")


def _month_starts(calendar: str) -> list[int]:
    days = [31, 28 if calendar == "noleap" else 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    return [sum(days[:i]) for i in range(12)]


def cf_string(time: Column) -> Column:
    """Like 2000-02-30."""
    return F.format_string("%04d-%02d-%02d", time["year"], time["month"], time["day"])


def period_number(of_label: Column, frequency: str, calendar: str = "standard") -> Column:
    """A running number of the label's period, so that neighbours differ by one."""
    _checked(frequency)
    if calendar != "standard":
        if frequency == "date":
            return cf_ordinal(of_label, calendar)
        years = of_label["year"].cast("long")
        return years if frequency == "year" else years * 12 + of_label["month"] - 1
    if frequency == "date":
        return F.unix_date(of_label).cast("long")
    if frequency == "week":  # Sundays: day 3 of 1970 was the first
        return F.floor((F.unix_date(of_label) - 3) / 7).cast("long")
    years = F.year(of_label).cast("long")
    return years if frequency == "year" else years * 12 + F.month(of_label) - 1


def label_of_number(number: Column, frequency: str, calendar: str = "standard") -> Column:
    """The label of a period number: the other way round."""
    _checked(frequency)
    if calendar != "standard":
        if frequency == "date":
            raise NotImplementedError("days of CF calendars are not listed from numbers")
        year = number if frequency == "year" else F.floor(number / 12)
        month = F.lit(12) if frequency == "year" else F.pmod(number, F.lit(12)) + 1
        return cf_label(F.struct(year.alias("year"), month.alias("month"), F.lit(1).alias("day")), frequency, calendar)
    if frequency == "date":
        return F.date_from_unix_date(number.cast("int"))
    if frequency == "week":
        return F.date_from_unix_date((number * 7 + 3).cast("int"))
    if frequency == "month":
        return F.last_day(F.make_date(F.floor(number / 12).cast("int"), (F.pmod(number, F.lit(12)) + 1).cast("int"), F.lit(1)))
    return F.make_date(number.cast("int"), F.lit(12), F.lit(31))
