"""Partial dates as closed intervals, and ages in completed years and days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_interval(text: Column) -> Column:
    """``YYYY``, ``YYYY-MM``, ``YYYY/YYYY`` or ``YYYY-MM-DD`` as struct(earliest, latest).

    Null for anything else, for impossible dates and for reversed ranges. The form is told apart
    before any cast: a cast alone would read a year as its first of January.
    """
    x = F.trim(text)
    year = F.substring(x, 1, 4).cast("int")
    first = F.make_date(year, F.lit(1), F.lit(1))
    month = F.try_to_date(F.concat(x, F.lit("-01")), "yyyy-MM-dd")
    day = F.try_to_date(x, "yyyy-MM-dd")
    later = F.make_date(F.substring(x, 6, 4).cast("int"), F.lit(12), F.lit(31))
    made = (
        F.when(x.rlike(r"^[0-9]{4}$") & (x > "0000"), F.struct(first.alias("earliest"), F.make_date(year, F.lit(12), F.lit(31)).alias("latest")))
        .when(x.rlike(r"^[0-9]{4}-[0-9]{2}$"), F.struct(month.alias("earliest"), F.last_day(month).alias("latest")))
        .when(x.rlike(r"^[0-9]{4}/[0-9]{4}$") & (F.substring(x, 6, 4) >= F.substring(x, 1, 4)) & (x >= "0001"), F.struct(first.alias("earliest"), later.alias("latest")))
        .when(x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.struct(day.alias("earliest"), day.alias("latest")))
    )
    return F.when(made["earliest"].isNotNull(), made)


def attained_age(birth: Column, end: Column) -> Column:
    """struct(years, days) completed between two dates; a birthday on 29 February falls on the
    28th in other years. Null if ``end`` comes before ``birth``."""
    whole = F.year(end) - F.year(birth)
    years = F.when(F.add_months(birth, 12 * whole) > end, whole - 1).otherwise(whole)
    days = F.datediff(end, F.add_months(birth, 12 * years))
    return F.when(end >= birth, F.struct(years.alias("years"), days.alias("days")))


def age_key(years: Column, days: Column) -> Column:
    """One number that orders ages like (years, days)."""
    return (years * 1000 + days).cast("long")


def age_label(years: Column, days: Column) -> Column:
    return F.format_string("%d years, %d days", years, days)


def compare_age(birth: Column, death: Column, cutoff: Column, reference: Column) -> Column:
    """Status of the oldest age that a person can have reached by ``cutoff``.

    ``birth`` and ``death`` are intervals (death may be null), ``reference`` an age key. Exact
    statuses need both dates exact and a death by the cutoff; else an upper bound below the
    reference excludes, and anything else is possible.
    """
    end = F.least(F.coalesce(death["latest"], cutoff), cutoff)
    upper = attained_age(birth["earliest"], end)
    key = age_key(upper["years"], upper["days"])
    exact = F.coalesce((birth["earliest"] == birth["latest"]) & (death["earliest"] == death["latest"]) & (death["latest"] <= cutoff), F.lit(False))
    return (
        F.when(key.isNull(), F.lit("insufficient_age_evidence"))
        .when(exact & (key < reference), F.lit("exact_below"))
        .when(exact & (key == reference), F.lit("exact_equal"))
        .when(exact, F.lit("exact_above"))
        .when(key < reference, F.lit("bounded_below"))
        .otherwise(F.lit("possible_above"))
    )


def census_earliest_birth(census_year: Column, age: Column) -> Column:
    """Earliest birth for an age reported on 1 April of a census year."""
    return F.make_date(census_year - age - 1, F.lit(4), F.lit(2))


def birth_year_age(year: Column, cutoff: str) -> Column:
    """Age key of the oldest that someone born in a year can be by ``cutoff``."""
    age = attained_age(F.make_date(year, F.lit(1), F.lit(1)), F.lit(cutoff).cast("date"))
    return age_key(age["years"], age["days"])


def birth_disposition(year: Column, approximate: Column, cutoff: str, reference: int) -> Column:
    """What a stated birth year means for a comparison with the age key ``reference``: an approximate
    year is muted, a late one excludes, any other needs a death or a census."""
    return F.when(year.isNull(), F.lit(None)).when(F.coalesce(approximate, F.lit(False)), "muted_approximate").when(birth_year_age(year, cutoff) < reference, "exclude_by_birth_year").otherwise("needs_death_or_census")
