"""Validators of what is published or promoted: findings as rows, nothing is dropped or repaired."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import attained_age
from ..functions.text import is_placeholder, stable_id
from .evidence import rule_errors

DIGEST = "^[0-9a-f]{64}$"
# Fields and vocabularies of questions and of research manifests.
QUESTION_FIELDS = ["id", "question", "falsifier", "status"]
QUESTION_STATUS = ["open", "designed", "blocked", "withdrawn", "answered_null"]
PRIVACY_VALUES = {"sensitivity_ceiling": ("R4", "manifest_privacy_tier_not_r4"), "share_status": ("do_not_share", "manifest_share_status_not_do_not_share")}
PRIVACY_FALSE = {"external_writes_allowed": "manifest_external_writes_not_disabled", "public_derivative_allowed": "manifest_public_derivative_not_disabled", "case_data_in_final_chat": "manifest_case_data_not_disabled"}
CONTROL_LISTS = ["always_blocked_inputs", "required_controls", "stop_conditions"]


def findings(df: DataFrame, key: str, rules: list[tuple[str, Column]], severity: str = "error") -> DataFrame:
    """(record_id, code, severity) of each rule that does not hold; a null counts as not held."""
    return df.select(F.col(key).cast("string").alias("record_id"), F.explode(F.split(rule_errors(rules), "; ")).alias("code")).where("code <> ''").withColumn("severity", F.lit(severity))


def lifespan_findings(df: DataFrame, key: str, cutoff: str) -> DataFrame:
    """Rows whose exact lifespan (``birth``, ``death``, ``days``, ``lower``, ``upper``, ``exclusive``) does
    not recompute, and bounds that claim exact days."""
    c = F.col
    age = attained_age(c("birth"), c("death"))
    same = [(c(b)["years"] == age["years"]) & (c(b)["days"] == age["days"]) for b in ("lower", "upper")]
    replays = (F.datediff(c("death"), c("birth")) == c("days")) & (c("death") >= c("birth")) & (c("death") <= F.lit(cutoff).cast("date")) & same[0] & same[1] & ~c("exclusive")
    return findings(df, key, [("lifespan:replay", ~c("exact") | F.coalesce(replays, F.lit(False))), ("lifespan:bound_with_days", c("exact") | c("days").isNull())])


def count_findings(df: DataFrame, key: str) -> DataFrame:
    """Releases whose counts do not reconcile with each other."""
    c = F.col
    rules = [
        ("counts:subjects", c("identified_subjects") == c("n_rows")),
        ("counts:named", c("named_fellows") == c("n_named")),
        ("counts:boundaries", c("open_boundaries") == c("n_open")),
        ("counts:order", (c("fully_resolved") <= c("resolved")) & (c("resolved") <= c("inventoried")) & (c("inventoried") == c("official"))),
        ("counts:closure", c("resolved") + c("open_boundaries") == c("official")),
    ]
    return findings(df, key, rules)


def question_findings(questions: DataFrame, declared: DataFrame) -> DataFrame:
    """Findings of discovery questions: placeholder fields, unknown statuses, references to sources that
    are not declared exactly once (or by the register they name), repeated ids."""
    rules = [(f"{f}:missing", ~is_placeholder(F.col(f))) for f in QUESTION_FIELDS]
    rules += [(f"{f}:missing", F.coalesce(F.size(f), F.lit(0)) > 0) for f in ("source_refs", "cannot_support")]
    rules.append(("status:unknown", F.col("status").isNull() | F.col("status").isin(QUESTION_STATUS)))
    own = findings(questions, "id", rules)
    refs = questions.select("id", F.explode("source_refs").alias("ref"))
    bare = declared.groupBy(F.col("source_id").alias("ref")).agg(F.count_distinct("register").alias("n"))
    qualified = declared.select(F.concat_ws(":", "register", "source_id").alias("ref"), F.lit(1).cast("long").alias("n")).distinct()
    lost = refs.join(bare.unionByName(qualified), "ref", "left").where("coalesce(n, 0) <> 1")
    code = F.when(F.col("n").isNull(), "source_refs:undeclared").otherwise("source_refs:ambiguous")
    twice = questions.groupBy("id").count().where("count > 1")
    tail = [lost.select(F.col("id").cast("string").alias("record_id"), code.alias("code")), twice.select(F.col("id").cast("string").alias("record_id"), F.lit("id:repeated").alias("code"))]
    return reduce(DataFrame.unionByName, [own, *[t.withColumn("severity", F.lit("error")) for t in tail]])


def manifest_findings(df: DataFrame, key: str, payload: str, allowed: list[str]) -> DataFrame:
    """Findings of research manifests given as JSON texts. Values must have the exact JSON type."""
    v = F.try_parse_json(payload)

    def text(path: str) -> Column:
        return F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant")) == "STRING", F.try_variant_get(v, f"$.{path}", "string"))

    def is_false(path: str) -> Column:
        return (F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant")) == "BOOLEAN") & ~F.try_variant_get(v, f"$.{path}", "boolean")

    def filled(path: str) -> Column:
        listed = F.try_variant_get(v, f"$.{path}", "array<string>")
        return (F.size(listed) > 0) & F.forall(listed, lambda x: F.trim(x) != "")

    keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    rules = [("manifest_not_an_object", F.json_object_keys(payload).isNotNull()), ("manifest_unknown_field", F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) == 0)]
    rules += [(f"manifest_required_string_missing:{f}", F.trim(text(f)) != "") for f in ("run_id", "question", "objective")]
    rules.append(("manifest_schema_version_invalid", text("schema_version") == "1.0"))
    rules += [(code, text(f"privacy.{f}") == want) for f, (want, code) in PRIVACY_VALUES.items()]
    rules += [(code, is_false(f"privacy.{f}")) for f, code in PRIVACY_FALSE.items()]
    rules += [(f"manifest_required_control_list_missing:{f}", filled(f)) for f in CONTROL_LISTS]
    return findings(df, key, rules)


def program_status(found: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row: errors, blockers and hypotheses of rank A; ready for review only without either and
    with a rank A, else blocked."""
    totals = found.agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "blocker").alias("n_blockers"))
    first = ranks.agg(F.count_if(F.col("rank") == "A").alias("n_rank_a"))
    rows = totals.crossJoin(first)  # one row each
    held = (F.col("n_errors") > 0) | (F.col("n_blockers") > 0) | (F.col("n_rank_a") == 0)
    return rows.withColumn("status", F.when(held, "blocked").otherwise("ready_for_independent_review"))


#: Problems of a review in the order of the checks.
REVIEW_PROBLEMS = [
    "subject_attribution_not_reviewed", "no_hash_bound_source", "evidence_file_unavailable_or_outside_data", "evidence_file_hash_mismatch",
    "evidence_record_missing", "review_dates_differ_from_evidence_record", "review_age_differs_from_evidence_record", "review_hash_differs_from_retrieval_receipt",
    "cache_path_outside_local_vault", "cached_source_hash_mismatch", "review_excerpt_missing_from_source",
]


def verify_reviews(reviews: DataFrame, profiles: DataFrame, evidence: DataFrame, records: DataFrame, caches: DataFrame) -> DataFrame:
    """``reviews`` with ``problems``, against evidence files, their records and cached sources.

    ``profiles``: profile_url, profile_sha256, cache_path. ``evidence``: path, sha256, lf_sha256 (of the
    text with line feeds). ``records``: path, source_id, birth_date, death_date, death_not_after,
    completed_age_years, ordinal. ``caches``: path, sha256, text. Each file is hashed and parsed once,
    by its own reader, and reviews meet it by joins. Of a file's problems the first alone is named, in
    the order of REVIEW_PROBLEMS; the cache's are named together. An absent cache is no problem. Empty
    texts count as null; paths with ``..`` lie outside. Repeated keys: the first record by
    ``ordinal``, else the largest row.
    """
    blank = lambda name: F.nullif(F.trim(F.col(name)), F.lit(""))
    inside = lambda path, folder: path.startswith(f"{folder}/") & ~path.rlike(r"(^|/)\.\.(/|$)")
    one = lambda df, keys, prefix, *rest: df.groupBy(*(F.col(k).alias(f"{prefix}{k}") for k in keys)).agg(F.max(F.struct(*rest)).alias(prefix.strip("_")))
    p = one(profiles, ["profile_url"], "p_", "profile_sha256", "cache_path")
    e = one(evidence, ["path"], "e_", "sha256", "lf_sha256")
    c = one(caches, ["path"], "c_", "sha256", "text")
    r = records.groupBy(F.col("path").alias("r_path"), F.col("source_id").alias("r_id")).agg(F.min_by(F.struct("birth_date", "death_date", "death_not_after", "completed_age_years"), "ordinal").alias("r"))
    file = blank("evidence_file")
    rows = reviews.join(p, F.col("profile_url") == F.col("p_profile_url"), "left").join(e, file == F.col("e_path"), "left")
    rows = rows.join(r, (file == F.col("r_path")) & (F.col("evidence_source_id") == F.col("r_id")), "left").join(c, F.col("p.cache_path") == F.col("c_path"), "left")
    expected, cache = blank("source_sha256"), F.nullif(F.col("p.cache_path"), F.lit(""))
    digest = F.when(F.col("evidence_hash_normalization") == "lf_text", F.col("e.lf_sha256")).otherwise(F.col("e.sha256"))
    other = lambda mine, theirs: F.coalesce(blank(mine).isNotNull() & ~F.col(mine).eqNullSafe(F.col(f"r.{theirs}")), F.lit(False))
    dates = other("birth", "birth_date") | other("death", "death_date") | other("death_not_after", "death_not_after")
    of_file = (
        F.when(F.col("e_path").isNull() | ~inside(file, "data"), F.lit(REVIEW_PROBLEMS[2])).when(~digest.eqNullSafe(F.col("evidence_sha256")), F.lit(REVIEW_PROBLEMS[3]))
        .when(F.col("r_id").isNull(), F.lit(REVIEW_PROBLEMS[4])).when(dates, F.lit(REVIEW_PROBLEMS[5]))
        .when(F.col("completed_age_years").isNotNull() & ~F.col("completed_age_years").eqNullSafe(F.col("r.completed_age_years")), F.lit(REVIEW_PROBLEMS[6]))
    )
    cached = cache.isNotNull() & expected.isNotNull()
    read = cached & inside(cache, "local-vault") & F.col("c_path").isNotNull()
    found = [
        F.when(~F.coalesce("subject_reviewed", F.lit(False)) | blank("rationale").isNull(), F.lit(REVIEW_PROBLEMS[0])),
        F.when(expected.isNull() & (file.isNull() | blank("evidence_sha256").isNull()), F.lit(REVIEW_PROBLEMS[1])),
        F.when(file.isNotNull(), of_file),
        F.when(expected.isNotNull() & ~expected.eqNullSafe(F.col("p.profile_sha256")), F.lit(REVIEW_PROBLEMS[7])),
        F.when(cached & ~inside(cache, "local-vault"), F.lit(REVIEW_PROBLEMS[8])),
        F.when(read & ~F.col("c.sha256").eqNullSafe(expected), F.lit(REVIEW_PROBLEMS[9])),
        F.when(read & blank("excerpt").isNotNull() & ~F.contains(F.coalesce("c.text", F.lit("")), F.col("excerpt")), F.lit(REVIEW_PROBLEMS[10])),
    ]
    return rows.select(*(F.col(x) for x in reviews.columns), F.array_compact(F.array(*found)).alias("problems"))


def review_problems(reviews: DataFrame, profiles: DataFrame, ledger: DataFrame, key: str = "review_id") -> DataFrame:
    """``reviews`` with ``problems``: unsupported claims, hashes that differ from the retrieval receipt,
    and dates or ages that differ from the ledger's record that the review names."""
    p = profiles.dropDuplicates(["profile_url"]).select(F.col("profile_url").alias("_url"), F.col("profile_sha256").alias("_receipt"))
    e = ledger.dropDuplicates(["source_id"]).select(F.col("source_id").alias("_source"), F.struct("birth_date", "death_date", "death_not_after", "completed_age").alias("_e"))
    rows = reviews.join(p, reviews["profile_url"] == p["_url"], "left").join(e, reviews["evidence_source_id"] == e["_source"], "left")
    c = F.col
    named = c("evidence_source_id").isNotNull()
    differs = reduce(lambda a, b: a | b, [F.coalesce((c(mine) != "") & ~c(mine).eqNullSafe(c(f"_e.{theirs}")), F.lit(False)) for mine, theirs in (("birth", "birth_date"), ("death", "death_date"), ("death_not_after", "death_not_after"))])
    found = [
        ("subject_attribution_not_reviewed", ~F.coalesce(c("subject_reviewed"), F.lit(False)) | (F.coalesce("rationale", F.lit("")) == "")),
        ("no_hash_bound_source", c("source_sha256").isNull() & ~(named & c("evidence_sha256").isNotNull())),
        ("evidence_record_missing", named & c("_source").isNull()),
        ("review_dates_differ_from_evidence_record", named & c("_source").isNotNull() & differs),
        ("review_age_differs_from_evidence_record", named & c("_source").isNotNull() & ~differs & c("completed_age").isNotNull() & ~c("completed_age").eqNullSafe(c("_e.completed_age"))),
        ("review_hash_differs_from_retrieval_receipt", c("source_sha256").isNotNull() & ~c("source_sha256").eqNullSafe(c("_receipt"))),
    ]
    problems = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in found]))
    return rows.select(*[reviews[x] for x in reviews.columns], problems.alias("problems"))


def reviewed_award_findings(awards: DataFrame, expected: DataFrame, roster: DataFrame, receipts: DataFrame, citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Findings of reviewed cohorts: coverage of every expected award exactly once, the inventory's year,
    a membership rationale, the official profile's hash, and citations of registered sources."""
    def out(df: DataFrame, code: str) -> DataFrame:
        return df.select(F.col("profile_url").alias("record_id"), F.lit(code).alias("code"), F.lit("error").alias("severity"))

    known = awards.join(roster.select("profile_url", F.col("award_year").alias("_year")), "profile_url")
    official = sources.join(receipts, (sources["source_url"] == receipts["profile_url"]) & (sources["source_sha256"] == receipts["profile_sha256"])).select(receipts["profile_url"]).distinct()
    parts = [
        out(expected.join(awards, "profile_url", "left_anti"), "coverage:missing"),
        out(awards.join(expected, "profile_url", "left_anti"), "coverage:unexpected"),
        out(awards.groupBy("profile_url").count().where("count > 1"), "coverage:repeated"),
        out(known.where("not (award_year <=> _year)"), "award_year:differs"),
        out(awards.where("coalesce(membership_rationale, '') = ''"), "membership_rationale:missing"),
        out(awards.join(official, "profile_url", "left_anti"), "official_profile:differs"),
        out(citations.join(sources.select("source_url", "source_sha256"), ["source_url", "source_sha256"], "left_anti"), "citation:unregistered"),
        out(citations.where("coalesce(excerpt, '') = '' or coalesce(rationale, '') = ''"), "citation:unattributed"),
    ]
    return reduce(DataFrame.unionByName, parts)


def resolve_inventory(roster: DataFrame, collectives: DataFrame, members: DataFrame, reviews: DataFrame, prior: DataFrame) -> DataFrame:
    """A row per person of the roster's awards: the members of a collective, the recipient of any other
    award; ``review`` says where the age review comes from (member, review, prior ledger, none)."""
    group = collectives.select("profile_url", F.lit(True).alias("_group"))
    rows = roster.join(group, "profile_url", "left")
    inside = rows.where("_group").join(members, "profile_url")
    joint = inside.select("profile_url", "award_year", F.concat(F.col("profile_url"), F.lit("#member:"), F.col("name")).alias("_key"), "name", F.when(F.col("reviewed"), "member").otherwise("none").alias("review"))
    alone = rows.where("_group is null").join(reviews.select("profile_url", F.lit(True).alias("_new")), "profile_url", "left").join(prior.select("profile_url", F.lit(True).alias("_old")), "profile_url", "left")
    single = alone.select("profile_url", "award_year", F.concat(F.col("profile_url"), F.lit("#recipient")).alias("_key"), F.col("recipient_label").alias("name"), F.when(F.col("_new"), "review").when(F.col("_old"), "prior").otherwise("none").alias("review"))
    return joint.unionByName(single).select(stable_id("person", F.col("_key")).alias("person_id"), stable_id("award", F.col("profile_url")).alias("award_id"), "name", "award_year", "review")


def checksum_findings(receipt: DataFrame, files: DataFrame, required: list[str]) -> DataFrame:
    """Published files (``name``, ``sha256``) against a receipt of the same shape that must list the
    ``required`` ones and no others."""
    want = receipt.sparkSession.createDataFrame([(n,) for n in required], "name string")
    rows = want.join(receipt.select("name", F.col("sha256").alias("_said"), F.lit(True).alias("_listed")), "name", "full").join(files.select("name", F.col("sha256").alias("_is")), "name", "left")
    code = F.when(F.col("_listed").isNull(), "checksum:unlisted").when(~F.col("name").isin(required), "checksum:unexpected").when(~F.col("_said").eqNullSafe(F.col("_is")), "checksum:differs")
    return rows.select(F.col("name").alias("record_id"), code.alias("code"), F.lit("error").alias("severity")).where("code is not null")
