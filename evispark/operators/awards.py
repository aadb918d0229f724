"""Comparison of award recipients with a reference age: adjudication, envelopes, collectives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates

EXCLUDED = ("exact_below", "bounded_below")


def adjudicate(people: DataFrame, reviews: DataFrame, cutoff: str, reference_years: int, reference_days: int, key: str = "person_id") -> DataFrame:
    """Status of each person from at most one review.

    No review: insufficient_age_evidence. A conflict: identity_conflict. Muted stays muted. A birth
    is compared (a *died-by* bound, ``death_not_after``, gives only bounded or possible). A
    reported whole age below the reference's years excludes if death by the cutoff is documented.
    Dates that cannot be read are a conflict. Adds ``status``, ``class`` (unknown for conflicts),
    ``priority`` and the age envelope's key ``upper_age``.
    """
    c, end = F.col, F.lit(cutoff).cast("date")
    reference = F.lit(reference_years * 1000 + reference_days)
    birth = dates.parse_interval(c("birth"))
    bound = c("death").isNull() & c("death_not_after").isNotNull()
    text = F.coalesce("death", "death_not_after")
    death = dates.parse_interval(text)
    broken = (c("birth").isNotNull() & birth.isNull()) | (text.isNotNull() & c("birth").isNotNull() & (death.isNull() | (death["latest"] < birth["earliest"]))) | (c("completed_age_years") < 0)
    upper = dates.attained_age(birth["earliest"], F.least(F.coalesce(death["latest"], end), end))
    dated = dates.compare_age(birth, death, end, reference)
    dated = F.when(bound, F.when(dated.isin(*EXCLUDED), "bounded_below").otherwise("possible_above")).otherwise(dated)
    reported = F.when((c("completed_age_years") < reference_years) & F.coalesce("death_by_cutoff", F.lit(False)), "bounded_below").otherwise("insufficient_age_evidence")
    status = (
        F.when(~F.coalesce("_reviewed", F.lit(False)), "insufficient_age_evidence")
        .when(c("conflict").isNotNull(), "identity_conflict")
        .when(c("disposition") == "muted_edge_case", "muted")
        .when(F.coalesce(broken, F.lit(False)), "identity_conflict")
        .when(c("birth").isNotNull(), dated)
        .otherwise(reported)
    )
    joined = people.join(reviews.withColumn("_reviewed", F.lit(True)), key, "left").withColumn("status", status)
    unknown = ~F.coalesce("_reviewed", F.lit(False)) | (c("status") == "identity_conflict")
    kind = F.when(unknown, "unknown").otherwise(F.coalesce("class", F.lit("unknown")))
    out = c("status").isin(*EXCLUDED)
    late = F.coalesce(F.year(birth["earliest"]) >= F.year(end) - reference_years, F.lit(False)) & ~c("status").isin("identity_conflict", "muted")
    return joined.select(
        *people.columns, "status", kind.alias("class"),
        F.when((kind == "female") & ~out, 4).when(out | late, 2).otherwise(0).alias("priority"),
        F.when(c("birth").isNotNull(), dates.age_key(upper["years"], upper["days"])).alias("upper_age"),
    )


def age_envelope(status: Column, upper_age: Column, reported_years: Column) -> Column:
    """struct(lower, upper, exclusive) of age keys: exact, capped, or a reported whole age."""
    exact = status.isin("exact_below", "exact_equal", "exact_above")
    whole = (reported_years.isNotNull()) & upper_age.isNull() & (status == "bounded_below")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    start = (reported_years * 1000).cast("long")

    def make(lower: Column, upper: Column, exclusive: bool) -> Column:
        return F.struct(lower.alias("lower"), upper.alias("upper"), F.lit(exclusive).alias("exclusive"))

    return F.when(exact, make(upper_age, upper_age, False)).when(whole, make(start, start + 1000, True)).when(status == "bounded_below", make(zero, upper_age, False)).otherwise(make(zero, none, False))


def award_status(awards: DataFrame, members: DataFrame, award: str = "award_id") -> DataFrame:
    """Whether each award is fully excluded: it has members, all are excluded and it is not open."""
    m = members.groupBy(award).agg(F.count("*").alias("n_members"), F.bool_and(F.col("status").isin(*EXCLUDED)).alias("_all"))
    return awards.join(m, award, "left").select(*awards.columns, F.coalesce("n_members", F.lit(0)).alias("n_members"), (F.coalesce("_all", F.lit(False)) & ~F.coalesce("open", F.lit(True))).alias("fully_excluded"))


def group_screen(df: DataFrame, reference: int, cutoff: str) -> DataFrame:
    """Screen a whole group by the oldest stated age: the oldest birth is as_of - stated -
    tolerance - 1; tolerances under 5 years and dates after the cutoff do not count."""
    end = F.lit(cutoff).cast("date")
    oldest = F.make_date(F.year("as_of") - F.col("stated_age") - F.col("tolerance") - 1, F.lit(1), F.lit(1))
    age = dates.attained_age(oldest, end)
    ok = (F.col("tolerance") >= 5) & (F.col("as_of") <= end) & (dates.age_key(age["years"], age["days"]) < reference)
    return df.withColumn("oldest_birth", oldest).withColumn("screened", F.coalesce(ok, F.lit(False)))


def finder_plans(people: DataFrame, census_years: list[int], finders: list[tuple[str, str]]) -> DataFrame:
    """A plan row per person, census year and finder URL template (``{name}``, ``{year}``); plans
    are never executed here."""
    plans = F.explode(F.array(*[F.struct(F.lit(y).alias("year"), F.lit(f).alias("finder"), F.lit(u).alias("template")) for y in census_years for f, u in finders]))
    p = people.select("person_id", "name", plans.alias("p"))
    url = F.replace(F.replace(F.col("p.template"), F.lit("{name}"), F.url_encode("name")), F.lit("{year}"), F.col("p.year").cast("string"))
    return p.select("person_id", F.col("p.year").alias("year"), F.col("p.finder").alias("finder"), url.alias("url"))
