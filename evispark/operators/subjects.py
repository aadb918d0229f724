"""Subjects of a comparison: sex, identity links, coverage, missing awards, population ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .awards import EXCLUDED
from .ranking import rank_envelope

# Confidences of an identity match, and those that let identifiers be cited together.
MATCHES = ["verified_match", "probable", "possible_match", "rejected_match", "needs_review"]
LINKED = ["verified_match", "probable"]


def documented_sex(label: Column) -> Column:
    """male or female where a review says so, else unknown; names and pronouns do not count."""
    said = F.lower(F.trim(label))
    return F.when(said.isin("male", "female"), said).otherwise("unknown")


def alias_linkage(explicit: Column) -> Column:
    return F.when(explicit, "same_person").otherwise("distinct_until_documented")


def crosswalk(confidence: Column) -> Column:
    """struct(identity_match_confidence, identifiers_may_be_cited_together)."""
    valid = F.when(confidence.isin(MATCHES), confidence).otherwise("needs_review")
    return F.struct(valid.alias("identity_match_confidence"), valid.isin(LINKED).alias("identifiers_may_be_cited_together"))


def relationship_episode(df: DataFrame) -> DataFrame:
    """Observed relationships; an end, a rank or a genetic tie is never inferred from one."""
    never = ["end_established", "divorce_or_death_inferred", "supports_longevity_rank", "supports_genetic_relationship"]
    return df.select("subject", "counterpart", "role", "observed_context", "source_role", *[F.lit(False).alias(n) for n in never])


def association(award_id: Column, year: Column, label: Column, individual: Column) -> Column:
    """How a person is tied to an award; a member of a collective holds no fellowship of their own."""
    relation = F.when(individual, "named_recipient").otherwise("award_year_collective_member")
    return F.struct(award_id.alias("award_id"), year.alias("award_year"), label.alias("label"), relation.alias("relationship"), individual.alias("individual_fellowship_asserted"))


def male_coverage(people: DataFrame, reference_id: str) -> DataFrame:
    """One row: open subjects other than the reference that are known to be male, and of unknown sex."""
    open_ = (F.col("person_id") != reference_id) & ~F.coalesce(F.col("status").isin(*EXCLUDED), F.lit(False))
    return people.agg(F.count_if(open_ & (F.col("sex") == "male")).alias("known_male_unresolved_count"), F.count_if(open_ & (F.col("sex") == "unknown")).alias("sex_unknown_unresolved_count"))


def missing_awards(awards: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Awards that no reviewed cohort covers, as open boundaries."""
    return awards.join(reviewed.select("profile_url"), "profile_url", "left_anti").withColumn("status", F.lit("group_membership_unresolved"))


def distinct_sources(sources: DataFrame, order: str) -> DataFrame:
    """The last of the sources with one URL and hash."""
    rest = [c for c in sources.columns if c not in ("source_url", "source_sha256", order)]
    return sources.groupBy("source_url", "source_sha256").agg(F.max_by(F.struct(order, *rest), order).alias("_s")).select("source_url", "source_sha256", "_s.*")


def population_ranking(people: DataFrame, open_awards: DataFrame, lower: str, upper: str, exclusive: str | None = None) -> DataFrame:
    """Rank envelopes of a population; the comparison is conditional while any award is open."""
    status = open_awards.agg(F.when(F.count("*") > 0, "conditional_comparison").otherwise("complete_comparison").alias("comparison"))  # one row
    return rank_envelope(people, lower, upper, exclusive).crossJoin(F.broadcast(status))
