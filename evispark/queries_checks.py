"""Validators, registers, scenarios and screens as queries over the given tables, and their SQL.

Rows carry planted faults by key, so that every rule named in the SQL both holds and fails.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .operators import awards, research, validators
from .plans import executor
from .queries import query


def _text(c):
    return F.col(c).cast("string")


def _strings(*values):
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


@query("""SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'privacy_tier:required; privacy_tier:vocabulary' WHEN 1 THEN 'consent_scopes:tier' WHEN 2 THEN 'source_confidence:inference'
  WHEN 3 THEN 'local_locator_ref:opaque' WHEN 4 THEN 'provenance.capture_method:required; secret_keys' WHEN 5 THEN 'integrity_sha256:digest' ELSE '' END AS errors FROM customer""")
def envelope_errors(t):
    k = F.col("c_custkey") % 7
    plain = {"schema_version": "1.0", "recorded_at": "2020", "source_class": "user_export", "privacy_label": "public_ok", "source_confidence": "confirmed"}
    rows = t("customer").select(
        "c_custkey", _text("c_custkey").alias("envelope_id"), *[F.lit(v).alias(n) for n, v in plain.items()],
        F.when(k == 0, " ").when(k == 1, "R3").otherwise("R1").alias("privacy_tier"), F.when(k == 2, "hypothesis").otherwise("observation").alias("evidence_role"),
        F.when(k == 1, _strings("public_release")).otherwise(_strings("private_research")).alias("consent_scopes"), _strings("p").alias("subject_ids"), _strings().alias("claim_ids"),
        F.struct(F.when(k != 4, "m").alias("capture_method"), F.lit("t").alias("captured_at"), F.lit("o").alias("source_owner")).alias("provenance"),
        F.when(k == 5, "abc").when(k == 6, F.sha2("c_name", 256)).alias("integrity_sha256"), F.when(k == 3, "/home/x").when(k == 6, "ref-1").alias("local_locator_ref"),
        F.when(k == 4, _strings("a.token")).otherwise(_strings()).alias("secret_keys"),
    )
    return validators.envelope_errors(rows).select("c_custkey", "errors")


def _claims(t):
    k, relation = F.col("event_id") % 5, F.when(F.col("event_type") == "purchase", "supports").when(F.col("event_type") == "error", "refutes").otherwise("contextualizes")
    link = lambda n: F.struct(F.concat(F.lit("e"), (F.col("event_id") % n).cast("string")).alias("envelope_id"), relation.alias("relation"))
    claims = t("events").select(
        F.concat(F.lit("c"), F.when(k == 4, F.col("event_id") - 1).otherwise(F.col("event_id")).cast("string")).alias("claim_id"), F.when(k == 0, " ").otherwise("s").alias("statement"), F.lit("t").alias("claim_type"),
        F.lit("public_ok").alias("privacy_label"), F.when(k == 1, "done").otherwise("draft").alias("review_status"), _strings("p").alias("subject_ids"), _strings().alias("limitations"), F.array(link(2500), link(7)).alias("evidence_links"),
    )
    return claims, t("part").where("p_size > 25").select(F.concat(F.lit("e"), _text("p_partkey")).alias("envelope_id"), F.lit("public_ok").alias("privacy_label"))


CLAIM_SQL = """c AS (SELECT event_id, event_id % 5 AS k, 'c' || CASE WHEN event_id % 5 = 4 THEN event_id - 1 ELSE event_id END AS claim_id,
  CASE event_type WHEN 'purchase' THEN 'supports' WHEN 'error' THEN 'refutes' ELSE 'contextualizes' END AS relation FROM events),
l AS (SELECT claim_id, 'e' || event_id % 2500 AS e, relation FROM c UNION ALL SELECT claim_id, 'e' || event_id % 7, relation FROM c)"""


@query(f"""WITH {CLAIM_SQL}, f AS (SELECT claim_id, 'statement:required' AS code FROM c WHERE k = 0 UNION ALL SELECT claim_id, 'review_status:vocabulary' FROM c WHERE k = 1
  UNION ALL SELECT claim_id, 'evidence_links:relation' FROM c WHERE relation = 'refutes' UNION ALL SELECT claim_id, 'claim_id:repeated' FROM c GROUP BY 1 HAVING count(*) > 1
  UNION ALL SELECT claim_id, 'evidence_links:missing' FROM l WHERE e NOT IN (SELECT 'e' || p_partkey FROM part WHERE p_size > 25)) SELECT claim_id AS record_id, code, 'blocker' AS severity FROM f""")
def claim_findings(t):
    return validators.claim_findings(*_claims(t))


@query(f"WITH {CLAIM_SQL} SELECT DISTINCT claim_id AS to_node, e AS from_node, relation FROM l")
def claim_graph_edges(t):
    return validators.claim_graph(*_claims(t))[1].select(F.col("to").alias("to_node"), F.col("from").alias("from_node"), "relation")


@query(f"WITH {CLAIM_SQL} SELECT claim_id AS id, 'claim' AS kind, 'public_ok' AS privacy_label FROM c UNION ALL SELECT 'e' || p_partkey, 'evidence', 'public_ok' FROM part WHERE p_size > 25")
def claim_graph_nodes(t):
    return validators.claim_graph(*_claims(t))[0]


RECEIPT = {"boundary_contract": "b.v1", "cannot_support": validators.MUST_NOT_SUPPORT, "consent_scope": "public_release", "contains": dict.fromkeys(validators.CONTENT_FLAGS, False), "human_reviewed": True, "privacy_label": "public_ok", "privacy_tier": "P0", "private_content_withheld": True, "producer": "p", "projection_kind": "archive_metadata", "public_projection_sha256": "a" * 64, "public_projection_item_count": 3, "receipt_id": "r-123", "schema_version": "s.v1", "source_schema": "x/y.v1"}
FAULTS = [
    ({}, ""),
    ({"extra": 1}, "fields:unknown"),
    ({"public_projection_item_count": True}, "public_projection_item_count:range"),
    ({"public_projection_item_count": 1_000_001}, "public_projection_item_count:range"),
    ({"human_reviewed": "true"}, "human_reviewed:value"),
    ({"producer": "q", "projection_kind": "raw"}, "producer:value; projection_kind:vocabulary"),
    ({"cannot_support": ["claim_validation"]}, "cannot_support:required"),
    ({"contains": RECEIPT["contains"] | {"genotypes": True}}, "contains.genotypes"),
]


@query(f"SELECT o_orderkey, list_extract([{', '.join(repr(e) for _, e in FAULTS)}], CAST(o_orderkey % {len(FAULTS)} + 1 AS INTEGER)) AS errors FROM orders")
def receipt_errors(t):
    bodies = _strings(*[json.dumps(RECEIPT | fault) for fault, _ in FAULTS])
    rows = t("orders").select("o_orderkey", F.element_at(bodies, (F.col("o_orderkey") % len(FAULTS) + 1).cast("int")).alias("payload"))
    return validators.receipt_errors(rows, "payload", "p", "s.v1", "b.v1").select("o_orderkey", "errors")


@query("""WITH s AS (SELECT s_suppkey % 3 AS register, s_suppkey // 2 AS id, s_suppkey % 6 AS k FROM supplier)
  SELECT register, id, code, 'blocker' AS severity FROM s, (VALUES (0, 'title:required'), (1, 'urls:https'), (2, 'cannot_support:required'), (3, 'urls:required')) v(w, code) WHERE k = w
  UNION ALL SELECT o_custkey % 3, o_custkey, 'id:repeated', 'blocker' FROM orders GROUP BY o_custkey HAVING count(*) > 1""")
def source_findings(t):
    k = F.col("s_suppkey") % 6
    body = lambda faults: [F.when(faults == 0, "").otherwise("t").alias("title"), F.lit("s").alias("source_type"), F.lit("e").alias("evidence_role"), F.when(faults == 3, _strings()).when(faults == 1, _strings("https://x.org", "http://x.org")).otherwise(_strings("https://x.org")).alias("urls"), _strings("s").alias("supports"), F.when(faults != 2, _strings("c")).alias("cannot_support")]
    own = t("supplier").select((F.col("s_suppkey") % 3).alias("register"), F.floor(F.col("s_suppkey") / 2).alias("id"), *body(k))
    more = t("orders").select((F.col("o_custkey") % 3).alias("register"), F.col("o_custkey").alias("id"), *body(F.lit(9)))
    return validators.source_findings(own).unionByName(validators.source_findings(more))


HYPOTHESES = [
    ({}, []),
    ({"rank_band": "Z"}, [("error", "rank_band_invalid")]),
    ({"rank_band": "B", "power_status": "pending"}, []),
    ({"power_status": "pending"}, [("blocker", "rank_a_power_status_not_met")]),
    ({"source_urls": ["http://x.org"]}, [("error", "source_url_not_https"), ("error", "source_url_not_clean")]),
    ({"privacy_label": "R3", "share_status": "share"}, [("error", "privacy_tier_not_r4"), ("error", "share_status_not_do_not_share")]),
    ({"unknowns": ["x"]}, [("blocker", "rank_a_unknowns_present")]),
    ({"access_verified_on": "soon"}, [("blocker", "rank_a_access_date_invalid")]),
]
HYPOTHESIS = research.RANK_A_VALUES | {"status": "confirmatory_ready", "rank_band": "A", "privacy_label": "R4", "share_status": "do_not_share", "unknowns": [], "cannot_support": "It cannot prove kinship.", "cannot_support_categories": research.MUST_NOT_SUPPORT, "source_urls": ["https://x.org/a"], "origin_evidence_roles": ["public_record"], "array_confirmation_status": "not_applicable", "reference_build": None, "orientation_status": None, "access_verified_on": "2026-01-02"}


def _hypotheses(t):
    def value(name):
        make = lambda v: _strings(*v) if isinstance(v, list) else F.lit(v).cast("string")
        out = make(HYPOTHESIS[name])
        for i, (changes, _) in enumerate(HYPOTHESES):
            if name in changes:
                out = F.when(F.col("p_partkey") % len(HYPOTHESES) == i, make(changes[name])).otherwise(out)
        return out.alias(name)

    return t("part").select(F.col("p_partkey").alias("hypothesis_id"), *map(value, HYPOTHESIS))


@query(f"""SELECT p_partkey AS record_id, severity, code FROM part JOIN (VALUES {', '.join(f"({i}, '{s}', '{code}')" for i, (_, found) in enumerate(HYPOTHESES) for s, code in found)}) v(k, severity, code) ON p_partkey % {len(HYPOTHESES)} = k""")
def hypothesis_findings(t):
    return research.hypothesis_findings(_hypotheses(t))


@query(f"SELECT count(*) FILTER (k NOT IN (1, 2)) AS A, count(*) FILTER (k = 2) AS B, 0 AS C, 0 AS D FROM (SELECT p_partkey % {len(HYPOTHESES)} AS k FROM part)")
def hypothesis_ranks(t):
    return research.rank_counts(_hypotheses(t))


@query("""SELECT l_orderkey AS scenario_id, CAST(floor(1000 * product(CASE l_returnflag WHEN 'R' THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END)) AS BIGINT) AS display_low, CAST(ceil(2000 * product(CASE l_linestatus WHEN 'F' THEN 1::DOUBLE ELSE 0.875::DOUBLE END)) AS BIGINT) AS display_high,
  coalesce(string_agg(DISTINCT w, '; ' ORDER BY w), '') AS warnings FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN 'f' || l_linenumber || ' is an assumption' END AS w FROM lineitem) GROUP BY 1""")
def scenario_interval(t):
    flag = F.col("l_returnflag")
    factors = t("lineitem").select(F.col("l_orderkey").alias("scenario_id"), F.concat(F.lit("f"), _text("l_linenumber")).alias("id"), F.when(flag == "R", 0.5).otherwise(0.75).alias("low"), F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.875).alias("high"), F.when(flag == "A", "assumption").otherwise("observed").alias("evidence_level"), F.lit("independent").alias("independence"))
    return research.scenario(1000.0, 2000.0, factors).select("scenario_id", "display_low", "display_high", "warnings")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS record_id, 'error' AS severity, code FROM part JOIN (VALUES (0, 'role_prohibited'), (1, 'evidence_level_invalid'), (2, 'independence_invalid'), (3, 'interval_invalid'), (4, 'source_url_missing')) v(k, code) ON p_partkey % 6 = k""")
def factor_findings(t):
    k = F.col("p_partkey") % 6
    rows = t("part").select(_text("p_partkey").alias("id"), F.when(k == 0, "event_presence").otherwise("share").alias("role"), F.when(k == 1, "guess").otherwise("derived").alias("evidence_level"), F.when(k == 2, "").otherwise("unknown").alias("independence"), F.when(k == 3, 0.5).otherwise(0.1).alias("low"), F.lit(0.25).alias("high"), F.when(k != 4, "https://x.org").alias("source_url"))
    return research.factor_findings(rows)


@query("""WITH r(convention, label, a, b) AS (VALUES ('x', 'early', 1990, 1995), ('x', 'late', 1996, 2000), ('y', 'middle', 1994, 1997)) SELECT o_orderkey, convention, label FROM orders JOIN r ON year(o_orderdate) BETWEEN a AND b""")
def generation_labels(t):
    orders = t("orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    ranges = orders.sparkSession.createDataFrame([("x", "early", 1990, 1995), ("x", "late", 1996, 2000), ("y", "middle", 1994, 1997)], "convention string, label string, start_year int, end_year int")
    return research.generation_matches(orders, "y", ranges).select("o_orderkey", "convention", "label")


@query("""SELECT doc_id AS record_id, 'error' AS severity, code FROM documents JOIN (VALUES (0, 'source_not_registered'), (1, 'excerpt_not_in_source'), (2, 'excerpt_missing'), (2, 'excerpt_not_in_source'), (3, 'excerpt_missing')) v(k, code) ON doc_id % 5 = k""")
def citation_findings(t):
    k, url = F.col("doc_id") % 5, _text("doc_id").alias("source_url")
    cites = t("documents").select(F.col("doc_id").alias("citation_id"), url, F.when(k == 0, "x").otherwise("h").alias("source_sha256"), F.when(k == 1, "other words").when(k != 2, F.concat("lang", F.lit(" said  "), "source")).alias("excerpt"), F.when(k != 3, "r").alias("rationale"))
    sources = t("documents").select(url, F.lit("h").alias("source_sha256"), F.concat(F.lit("They  "), "lang", F.lit("\n said\t"), "source", F.lit(" so.")).alias("text"))
    return research.citation_findings(cites, sources)


@query("""SELECT 'path' AS kind, 'd/' || source || '/' || doc_id AS path, 'web' AS term FROM documents WHERE contains(lower(source), 'web') UNION ALL
  SELECT 'text', 'd/' || source || '/' || doc_id, CASE WHEN contains(lower(text), 'web') THEN 'web' ELSE 'license' END FROM documents WHERE contains(lower(text), 'web') OR contains(lower(text), 'license')""")
def forbidden_terms(t):
    rows = t("documents").select(F.concat_ws("/", F.lit("d"), "source", _text("doc_id")).alias("path"), "text")
    return research.forbidden_terms(rows.select("path"), rows, ["web", "license"])


@query("""SELECT coalesce(o_custkey, c_custkey) AS c_custkey, CASE WHEN n IS NULL THEN 'missing' WHEN c_custkey IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
  FULL JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey WHERE n IS NULL OR c_custkey IS NULL OR n > 1""")
def review_coverage(t):
    got = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return research.coverage(got, t("customer").where("c_acctbal > 0"), "c_custkey")


@query("""SELECT c_custkey, make_date(CAST(2000 - c_custkey % 90 - c_custkey % 9 - 1 AS INTEGER), 1, 1) AS oldest_birth,
  c_custkey % 9 >= 5 AND c_custkey % 4 <> 0 AND 2026 - (2000 - c_custkey % 90 - c_custkey % 9 - 1) <= 107 AS screened FROM customer""")
def group_screen(t):
    k = F.col("c_custkey")
    rows = t("customer").select("c_custkey", F.when(k % 4 == 0, "2000-02-30").otherwise("2000-06-01").alias("d"), (k % 90).cast("int").alias("stated_age"), (k % 9).cast("int").alias("tolerance"))
    rows = rows.withColumn("as_of", F.when(k % 4 == 0, F.lit("2030-01-01")).otherwise(F.col("d")).cast("date"))
    rows = rows.withColumn("stated_age", F.when(k % 4 == 0, F.col("stated_age") + 30).otherwise(F.col("stated_age")))
    return awards.group_screen(rows, 107307, "2026-10-23").select("c_custkey", "oldest_birth", "screened")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS person_id, y AS year, f AS finder, 'https://x.org/' || f || '?n=' || replace(s_name, '#', '%23') || '&y=' || y AS url FROM supplier, (VALUES (1940), (1950)) a(y), (VALUES ('one'), ('two')) b(f)""")
def finder_plans(t):
    people = t("supplier").select(_text("s_suppkey").alias("person_id"), F.col("s_name").alias("name"))
    return awards.finder_plans(people, [1940, 1950], [(f, f"https://x.org/{f}?n={{name}}&y={{year}}") for f in ("one", "two")])


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 1 THEN 'identity_conflict' WHEN 2 THEN 'muted' WHEN 3 THEN 'exact_below' WHEN 4 THEN 'bounded_below' ELSE 'insufficient_age_evidence' END AS status,
  CASE WHEN c_custkey % 6 IN (0, 1) THEN 'unknown' ELSE 'female' END AS class, CASE c_custkey % 6 WHEN 2 THEN 4 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 4 ELSE 0 END AS priority FROM customer""")
def award_adjudication(t):
    k = F.col("c_custkey") % 6
    none = F.lit(None).cast("string")
    reviews = t("customer").where(k != 0).select("c_custkey", F.when(k == 3, "1900-05-01").alias("birth"), F.when(k == 3, "1950-06-01").alias("death"), none.alias("death_not_after"), F.when(k >= 4, 80).alias("completed_age_years"), (k == 4).alias("death_by_cutoff"), F.when(k == 1, "two births").alias("conflict"), F.when(k == 2, "muted_edge_case").alias("disposition"), F.lit("female").alias("class"))
    return awards.adjudicate(t("customer").select("c_custkey"), reviews, "2026-10-23", 107, 307, "c_custkey").select("c_custkey", "status", "class", "priority")


@query("SELECT o_orderkey, o_custkey AS fingerprint FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def reusable_slices(t):
    o = t("orders").select("o_orderkey", F.col("o_custkey").alias("fingerprint"), F.when(F.col("o_orderstatus") == "P", "complete").otherwise("failed").alias("status"))
    return executor.reusable_slices(o.select("o_orderkey", "fingerprint"), o)
