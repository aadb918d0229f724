"""Research registers, scenarios and citations as finding rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.web import clean_url, prohibited_claim
from .validators import filled

#: Rank bands, gates of rank A, markers and vocabularies.
RANKS = ["A", "B", "C", "D"]
RANK_A_VALUES = {
    "power_status": "completed_adequate",
    "participant_overlap_status": "verified_none",
    "access_status": "verified",
    "replication_status": "independent_completed",
    "multiplicity_status": "locked_and_corrected",
    "analysis_status": "frozen_before_replication",
    "license_or_terms_status": "verified_compatible",
    "power_result": "prospective_power_completed_at_corrected_alpha",
    "participant_overlap_check": "verified_no_participant_overlap",
}
GATES = ["power_result", "participant_overlap_check", "access_verified_on", "license_or_terms_status"]
UNRESOLVED = ["blocked", "not_assessed", "pending", "to_be_identified", "to_be_verified", "unknown", "unresolved", "unverified"]
CONTRADICTORY = ["access denied", "inadequate power", "insufficient power", "overlap detected", "reuse prohibited", "underpowered", "unusable"]
MUST_NOT_SUPPORT = ["causation", "diagnosis", "individual_prediction", "leaderboard_ranking", "n_of_1_significance", "payout", "prize_qualification"]
FACTOR_ROLES_DENIED = ["ace_exposure", "event_presence", "genetic_memory", "memory_accuracy", "recollection_accuracy"]
EVIDENCE_LEVELS = ["observed", "derived", "assumption"]
INDEPENDENCE = ["independent", "overlapping", "unknown"]


def _findings(df: DataFrame, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(record_id, severity, code) for each rule whose test does not hold; null does not hold."""
    rows = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(code).alias("code"))) for s, code, ok in rules]
    return df.select(F.col(key).alias("record_id"), F.explode(F.array_compact(F.array(*rows))).alias("f")).select("record_id", "f.severity", "f.code")


def hypothesis_findings(df: DataFrame, key: str = "hypothesis_id") -> DataFrame:
    """Findings of hypotheses: errors of any rank, and blockers where rank A is claimed before its
    gates are met. Needs the gate columns of RANK_A_VALUES, status, rank_band, privacy_label,
    share_status, unknowns, cannot_support, cannot_support_categories, source_urls,
    origin_evidence_roles, array_confirmation_status, reference_build, orientation_status."""
    c = F.col
    none = F.array().cast("array<string>")
    rank_a = F.coalesce(c("rank_band") == "A", F.lit(False))
    urls = F.coalesce("source_urls", none)
    roles = F.coalesce("origin_evidence_roles", none)
    arrays = F.arrays_overlap(roles, F.array(F.lit("array_call"), F.lit("ancestry_array_call")))
    gate_text = F.lower(F.concat_ws(" ", *GATES))

    def resolved(name: str) -> Column:
        return filled(c(name)) & ~F.lower(c(name)).rlike("|".join(UNRESOLVED))

    rules = [
        ("error", "rank_band_invalid", c("rank_band").isin(RANKS)),
        ("error", "privacy_tier_not_r4", c("privacy_label") == "R4"),
        ("error", "share_status_not_do_not_share", c("share_status") == "do_not_share"),
        ("error", "cannot_support_categories_incomplete", F.size(F.array_except(F.array(*map(F.lit, MUST_NOT_SUPPORT)), "cannot_support_categories")) == 0),
        ("error", "cannot_support_contradictory", ~prohibited_claim(c("cannot_support"))),
        ("error", "source_url_not_https", F.forall(urls, lambda u: u.startswith("https://"))),
        ("error", "source_url_not_clean", F.forall(urls, clean_url)),
    ]
    gates = [("status_not_confirmatory_ready", c("status") == "confirmatory_ready")]
    gates += [(f"{n}_unresolved", resolved(n)) for n in GATES]
    gates += [("unknowns_present", F.size("unknowns") == 0)]
    gates += [(f"{n}_not_met", c(n) == want) for n, want in RANK_A_VALUES.items()]
    gates += [
        ("access_date_invalid", F.try_to_date("access_verified_on", "yyyy-MM-dd").isNotNull()),
        ("gate_text_contradictory", ~gate_text.rlike("|".join(CONTRADICTORY))),
        ("array_confirmation_not_met", F.when(arrays, c("array_confirmation_status") == "independently_confirmed").otherwise(c("array_confirmation_status") == "not_applicable")),
        ("genome_harmonization_missing", ~arrays | (resolved("reference_build") & resolved("orientation_status"))),
    ]
    rules += [("blocker", f"rank_a_{code}", ~rank_a | F.coalesce(ok, F.lit(False))) for code, ok in gates]
    return _findings(df, key, rules)


def rank_counts(df: DataFrame) -> DataFrame:
    """Hypotheses of each rank band, zero-filled, in one row."""
    return df.agg(*[F.count_if(F.col("rank_band") == r).alias(r) for r in RANKS])


def scenario(base_low: float, base_high: float, factors: DataFrame, key: str = "scenario_id") -> DataFrame:
    """Interval of a scenario: the base times the product of all factors, at the low and the high
    ends, with display bounds and warnings."""
    c = F.col
    warn = F.array_compact(F.array(F.when(c("evidence_level") == "assumption", F.concat("id", F.lit(" is an assumption"))), F.when(c("independence") != "independent", F.concat("id", F.lit(" may overlap other factors")))))
    out = factors.withColumn("w", warn).groupBy(key).agg((F.product("low") * base_low).alias("low"), (F.product("high") * base_high).alias("high"), F.flatten(F.collect_list("w")).alias("w"))
    return out.select(key, "low", "high", F.floor("low").alias("display_low"), F.ceil("high").alias("display_high"), F.array_join(F.array_sort(F.array_distinct("w")), "; ").alias("warnings"))


def factor_findings(factors: DataFrame) -> DataFrame:
    """Findings of scenario factors: roles that must not be numbers, vocabularies, bounds, source."""
    c = F.col
    rules = [
        ("error", "id_missing", filled(c("id"))),
        ("error", "role_prohibited", F.coalesce(~c("role").isin(FACTOR_ROLES_DENIED), F.lit(True))),
        ("error", "evidence_level_invalid", c("evidence_level").isin(EVIDENCE_LEVELS)),
        ("error", "independence_invalid", c("independence").isin(INDEPENDENCE)),
        ("error", "interval_invalid", (c("low") >= 0) & (c("low") <= c("high")) & (c("high") <= 1)),
        ("error", "source_url_missing", c("source_url").startswith("https://")),
    ]
    return _findings(factors, "id", rules)


def generation_matches(people: DataFrame, year: str, ranges: DataFrame) -> DataFrame:
    """A row per person and convention range (label, start_year, end_year) that holds the year;
    ranges are exploded to years and equi-joined, and overlapping ranges all count."""
    years = ranges.select("convention", "label", F.explode(F.sequence("start_year", "end_year")).alias("_y"))
    return people.join(years, F.col(year) == F.col("_y")).drop("_y")


def citation_findings(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations without a registered source of the same URL and hash, or whose excerpt, white
    space squeezed, is not in the source's text."""
    squeeze = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    known = sources.select("source_url", "source_sha256", squeeze(F.col("text")).alias("_text"), F.lit(True).alias("_known")).dropDuplicates(["source_url", "source_sha256"])
    joined = citations.join(known, ["source_url", "source_sha256"], "left")
    found = F.col("_text").isNull() | F.col("_text").contains(squeeze(F.col("excerpt")))
    rules = [("error", "source_not_registered", F.col("_known")), ("error", "excerpt_missing", filled(F.col("excerpt")) & filled(F.col("rationale"))), ("error", "excerpt_not_in_source", found)]
    return _findings(joined, "citation_id", rules)


def forbidden_terms(paths: DataFrame, texts: DataFrame, terms: list[str], limit: int = 2 * 1024 * 1024) -> DataFrame:
    """(kind, path, term): the first forbidden term in each path and in each text up to ``limit``
    bytes, the size that the audit covers."""

    def first(value: Column) -> Column:
        return F.coalesce(*[F.when(F.lower(value).contains(t.lower()), F.lit(t)) for t in terms])

    a = paths.select(F.lit("path").alias("kind"), "path", first(F.col("path")).alias("term"))
    b = texts.where(F.octet_length("text") <= limit).select(F.lit("text").alias("kind"), "path", first(F.col("text")).alias("term"))
    return a.unionByName(b).where("term is not null")


def coverage(df: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, problem) where the reviewed keys are not exactly the expected ones, each once."""
    got = df.groupBy(key).agg(F.count("*").alias("n"))
    want = expected.select(key).distinct().withColumn("w", F.lit(True))
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("w").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return got.join(want, key, "full").select(key, problem.alias("problem")).where("problem is not null")
