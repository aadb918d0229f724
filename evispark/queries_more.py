"""Further operators as queries over the given tables, most with planted values, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import dates, html, text, web
from .operators import awards, genome, keyed, publication, subjects
from .plans import adapters
from .queries import query
from .sources import files, json_walk, stores

CUTOFF, REFERENCE = "2026-10-23", 107307


@query("""SELECT doc_id, CASE WHEN k IN (0, 5) THEN 1850 + CAST(doc_id % 140 AS INTEGER) WHEN k = 3 THEN 1900 END AS birth_year,
  CASE WHEN k = 0 THEN CASE WHEN 1850 + doc_id % 140 > 1919 THEN 'exclude_by_birth_year' WHEN 1850 + doc_id % 140 = 1919 THEN 'exclude_by_birth_year' ELSE 'needs_death_or_census' END
    WHEN k = 5 THEN 'muted_approximate' WHEN k = 3 THEN 'needs_death_or_census' END AS disposition
  FROM (SELECT doc_id, doc_id % 7 AS k FROM documents)""")
def birth_statement(t):
    k, year = F.col("doc_id") % 7, (1850 + F.col("doc_id") % 140).cast("string")
    told = (
        F.when(k == 0, F.concat(F.lit("The singer Ann Álpha was born in "), year, F.lit(" in Ohio.")))
        .when(k == 1, F.concat(F.lit("Ann Alpha sings. Her grandmother was born in "), year, F.lit(".")))
        .when(k == 2, F.lit("Ann Alpha was born in the 1920s."))
        .when(k == 3, F.concat(F.lit("Home Bio "), F.repeat(F.lit("word "), 40), F.lit("was born in 1900 to farmers.")))
        .when(k == 4, F.lit("Ann Alpha, born Kansas, was honored in 1990."))
        .when(k == 5, F.concat(F.lit("Ann Alpha was born about "), year, F.lit(".")))
        .otherwise(F.lit("Bob Beta was born in 1901."))
    )
    rows = t("documents").select("doc_id", html.birth_statement(told, F.lit("Ann Alpha"), F.lit(1990)).alias("b"))
    return rows.select("doc_id", "b.birth_year", dates.birth_disposition(F.col("b.birth_year"), F.col("b.approximate"), CUTOFF, REFERENCE).alias("disposition"))


@query("""SELECT doc_id, 'T' || doc_id || ' Hello & ' || lang || ' end' AS text, CASE doc_id % 3 WHEN 0 THEN 'https://a.org/' || doc_id WHEN 1 THEN 'https://a.org/1 https://b.org/2' ELSE '' END AS urls FROM documents""")
def page_text(t):
    k = F.col("doc_id") % 3
    own = F.when(k == 0, F.concat(F.lit('<link rel="canonical" href="https://a.org/'), F.col("doc_id").cast("string"), F.lit('">'))).when(k == 1, F.lit('<meta property="og:url" content="https://b.org/2"><link rel="canonical" href="https://a.org/1">')).otherwise(F.lit('<link rel="next" href="https://c.org/"><meta property="og:url" content="/local">'))
    page = F.concat(F.lit("<html><head><title>T"), F.col("doc_id").cast("string"), F.lit("</title><style>p {}</style>"), own, F.lit("</head><body><script>var x = 'no';</script><p>Hello &amp;\n "), F.col("lang"), F.lit("</p><a href='https://d.org/'>end</a></body></html>"))
    return t("documents").select("doc_id", html.page_text(page).alias("p")).select("doc_id", "p.text", F.array_join("p.urls", " ").alias("urls"))


@query("""SELECT page_id, page_id % 5 IN (0, 1) AS unsafe FROM pages""")
def unsafe_text(t):
    k = F.col("page_id") % 5
    said = F.when(k == 0, F.lit("see C%3A%5CUsers%5Cme")).when(k == 1, F.lit("a %2567enotype table")).when(k == 2, F.lit("100%25 plain + text")).when(k == 3, F.lit(None).cast("string")).otherwise(F.lit("a%zzb"))
    return t("pages").select("page_id", web.unsafe_text(said).alias("unsafe"))


URLS = ["https://x.org/a", "https://www.ancestry.com/a", "https://github.com/x/y", "https://db.corp/a", "https://x.org/?jwt=1", "https://x.org/#x-amz-date=1", "https://10.0.0.1/", "http://x.org/?q=1", "https://u:p@x.org/"]


@query(f"SELECT event_id, event_id % {len(URLS)} IN (0, 7) AS public FROM events")
def public_url_rules(t):
    url = F.element_at(F.array(*map(F.lit, URLS)), (F.col("event_id") % len(URLS) + 1).cast("int"))
    return t("events").select("event_id", web.public_url(url).alias("public"))


@query("SELECT event_id, event_id % 4 IN (0, 3) AS claims FROM events")
def prohibited_claims(t):
    k = F.col("event_id") % 4
    said = F.when(k == 0, F.lit("This confirms parentage.")).when(k == 1, F.lit("It does not prove identity.")).when(k == 2, F.lit("A ranking without claims.")).otherwise(F.lit("Causation and replication have been fully guaranteed."))
    return t("events").select("event_id", web.prohibited_claim(said).alias("claims"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a[0].userPassword,token_count' WHEN event_id % 3 = 1 THEN 'refresh_token' ELSE '' END AS forbidden, CASE WHEN event_id % 3 = 1 THEN 'refresh_token' ELSE '' END AS sensitive FROM events")
def json_keys(t):
    k = F.col("event_id") % 3
    body = F.when(k == 0, F.lit('{"a": [{"userPassword": 1}], "token_count": 2}')).when(k == 1, F.lit('{"refresh_token": "x", "plain": 1}')).otherwise(F.lit('{"plain": [1, 2]}'))
    rows = t("events").select(F.col("event_id").cast("string").alias("id"), body.alias("body"))
    walked = json_walk.walk(rows, "id", "body")
    marked = walked.select("key", "path", json_walk.forbidden_key(F.col("name")).alias("f"), F.lower("name").isin(json_walk.SENSITIVE).alias("s"))
    out = marked.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("f"), F.col("path")))), ",").alias("forbidden"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("s"), F.col("path")))), ",").alias("sensitive"))
    return out.select(F.col("key").cast("long").alias("event_id"), "forbidden", "sensitive")


@query("SELECT p_partkey, p_partkey % 4 IN (0, 1) AS filler FROM part")
def placeholder_fields(t):
    k = F.col("p_partkey") % 4
    return t("part").select("p_partkey", text.is_placeholder(F.when(k == 0, F.lit(" NA ")).when(k == 1, F.lit("?")).when(k == 2, F.lit("unknown")).otherwise(F.col("p_name"))).alias("filler"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'public_ok' WHEN c_custkey % 3 = 1 THEN 'odd' ELSE 'private_family_only' END AS label, CASE c_custkey % 4 WHEN 0 THEN 'a|b' WHEN 1 THEN 'one note' ELSE '' END AS notes,
  CASE c_custkey % 2 WHEN 0 THEN 'application/pdf' END AS mime FROM customer""")
def label_fallbacks(t):
    k, allowed = F.col("c_custkey"), ["public_ok", "private_family_only"]
    first = F.when(k % 3 == 0, F.lit("wrong"))
    second = F.when(k % 3 == 0, F.lit("public_ok")).when(k % 3 == 1, F.lit("odd"))
    label = text.last_truthy("private_family_only", allowed, first, second)
    notes = text.notes_list(F.when(k % 4 == 0, F.lit('["a", " ", "b"]')).when(k % 4 == 1, F.lit("one note")).when(k % 4 == 2, F.lit("  ")))
    mime = text.mime_guess(F.when(k % 2 == 0, F.lit("x/File.PDF")).otherwise(F.lit("x/file.unknown")))
    return t("customer").select("c_custkey", label.alias("label"), F.array_join(notes, "|").alias("notes"), mime.alias("mime"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'male' WHEN c_custkey % 3 = 1 THEN 'female' ELSE 'unknown' END AS sex,
  CASE c_custkey % 4 WHEN 0 THEN 'verified_match' WHEN 1 THEN 'probable' WHEN 2 THEN 'rejected_match' ELSE 'needs_review' END AS match, c_custkey % 4 IN (0, 1) AS together,
  CASE WHEN c_custkey % 2 = 0 THEN 'same_person' ELSE 'distinct_until_documented' END AS alias,
  CASE WHEN c_custkey % 5 = 0 THEN 'named_recipient' ELSE 'award_year_collective_member' END AS relationship FROM customer""")
def subject_classification(t):
    k = F.col("c_custkey")
    sex = subjects.documented_sex(F.when(k % 3 == 0, F.lit(" Male ")).when(k % 3 == 1, F.lit("FEMALE")).otherwise(F.lit("she")))
    match = subjects.crosswalk(F.when(k % 4 == 0, F.lit("verified_match")).when(k % 4 == 1, F.lit("probable")).when(k % 4 == 2, F.lit("rejected_match")).otherwise(F.lit("sure")))
    tie = subjects.association(k, F.lit(1990), F.col("c_name"), k % 5 == 0)
    return t("customer").select("c_custkey", sex.alias("sex"), match["identity_match_confidence"].alias("match"), match["identifiers_may_be_cited_together"].alias("together"), subjects.alias_linkage(k % 2 == 0).alias("alias"), tie["relationship"].alias("relationship"))


@query("""SELECT count(*) FILTER (c_custkey % 3 = 0) AS known_male_unresolved_count, count(*) FILTER (c_custkey % 3 = 1) AS sex_unknown_unresolved_count FROM customer WHERE c_custkey <> 5 AND c_acctbal >= 0""")
def male_coverage(t):
    k = F.col("c_custkey")
    rows = t("customer").select(k.cast("string").alias("person_id"), F.when(k % 3 == 0, "male").when(k % 3 == 1, "unknown").otherwise("female").alias("sex"), F.when(F.col("c_acctbal") < 0, "exact_below").otherwise("possible_above").alias("status"))
    return subjects.male_coverage(rows, "5")


GENO = "(SELECT l_orderkey AS o, l_linenumber AS n, 'RS' || l_partkey AS rsid, l_orderkey * 10 + l_linenumber AS line_no, CASE WHEN l_linenumber = 7 THEN 'malformed' ELSE 'row' END AS kind, CASE WHEN l_returnflag = 'R' THEN '--' ELSE l_returnflag END AS a1, l_linestatus AS a2 FROM lineitem)"


def _genotypes(t):
    line = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no")
    rows = t("lineitem").select(line, F.when(F.col("l_linenumber") == 7, "malformed").otherwise("row").alias("kind"), F.concat(F.lit("RS"), F.col("l_partkey").cast("string")).alias("rsid"), F.lit("1").alias("chromosome"), F.col("l_suppkey").cast("string").alias("position"), F.when(F.col("l_returnflag") == "R", "--").otherwise(F.col("l_returnflag")).alias("allele1"), F.col("l_linestatus").alias("allele2"))
    wl = t("part").where("p_size > 25").select(F.concat(F.lit("rs"), F.col("p_partkey").cast("string")).alias("rsid"), F.col("p_brand").alias("gene"))
    return rows, wl


SEEN = f"g AS {GENO}, w AS (SELECT 'rs' || p_partkey AS rsid, p_brand AS gene FROM part WHERE p_size > 25), h AS (SELECT w.rsid, gene, min(line_no) AS line_no, count(*) - 1 AS n_duplicates, arg_min(CASE WHEN a1 IN ('0', '-', '--', 'N', '') OR a2 IN ('0', '-', '--', 'N', '') THEN 'no_call' ELSE 'called' END, line_no) AS call_status FROM w JOIN g ON lower(g.rsid) = w.rsid WHERE kind = 'row' GROUP BY ALL)"


@query(f"WITH {SEEN} SELECT rsid, gene, line_no, n_duplicates, call_status FROM h")
def genotype_observed(t):
    return files.genotype_hits(*_genotypes(t))[0].select("rsid", "gene", "line_no", "n_duplicates", "call_status")


@query("SELECT 'rs' || p_partkey * 2 AS rsid, p_brand AS gene FROM part WHERE p_partkey * 2 NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber <> 7)")
def genotype_unobserved(t):
    wl = t("part").select(F.concat(F.lit("rs"), (F.col("p_partkey") * 2).cast("string")).alias("rsid"), F.col("p_brand").alias("gene"))
    return files.genotype_hits(_genotypes(t)[0], wl)[1].select("rsid", "gene")


@query("""SELECT count(*) FILTER (o_orderstatus = 'F') AS n_errors, count(*) FILTER (o_orderstatus = 'P') AS n_blockers, (SELECT count(*) FROM nation WHERE n_regionkey = 0) AS n_rank_a,
  CASE WHEN count(*) FILTER (o_orderstatus IN ('F', 'P')) > 0 OR (SELECT count(*) FROM nation WHERE n_regionkey = 0) = 0 THEN 'blocked' ELSE 'ready_for_independent_review' END AS status FROM orders""")
def program_status(t):
    found = t("orders").select(F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "P", "blocker").otherwise("review").alias("severity"))
    return publication.program_status(found, t("nation").select(F.when(F.col("n_regionkey") == 0, "A").otherwise("B").alias("rank")))


@query("""SELECT 'f' || n_nationkey AS record_id, CASE WHEN n_nationkey % 3 = 0 THEN 'checksum:unlisted' WHEN n_nationkey % 3 = 1 THEN 'checksum:differs' END AS code, 'error' AS severity FROM nation WHERE n_nationkey % 3 < 2
  UNION ALL SELECT 'extra', 'checksum:unexpected', 'error'""")
def checksum_set(t):
    n = F.col("n_nationkey")
    name = F.concat(F.lit("f"), n.cast("string")).alias("name")
    receipt = t("nation").where(n % 3 != 0).select(name, F.lit("h").alias("sha256")).unionByName(t("nation").where(n == 0).select(F.lit("extra").alias("name"), F.lit("h").alias("sha256")))
    published = t("nation").select(name, F.when(n % 3 == 1, "x").otherwise("h").alias("sha256"))
    return publication.checksum_findings(receipt, published, [f"f{i}" for i in range(25)])


@query("SELECT page_id, 'perma' AS service, false AS enabled, true AS dry_run, url FROM pages")
def disabled_plan(t):
    return adapters.disabled_plan(t("pages").select("page_id", "url"), "perma", ["page_id", "url"]).select("payload.page_id", "service", "enabled", "dry_run", "payload.url")


@query("SELECT c_custkey AS subject, 'guest' AS role, false AS end_established, false AS divorce_or_death_inferred, false AS supports_longevity_rank, false AS supports_genetic_relationship FROM customer")
def relationship_episodes(t):
    rows = t("customer").select(F.col("c_custkey").alias("subject"), F.col("c_name").alias("counterpart"), F.lit("guest").alias("role"), F.lit("c").alias("observed_context"), F.lit("s").alias("source_role"))
    return subjects.relationship_episode(rows).drop("counterpart", "observed_context", "source_role")

@query(f"""WITH {SEEN} SELECT h.rsid, CASE WHEN p_size > 35 THEN p_type END AS category, CASE WHEN p_size > 35 THEN 'Educational metadata only; not medical, diagnostic, or deterministic.' END AS interpretation_scope FROM h JOIN part ON 'rs' || p_partkey = h.rsid""")
def genotype_crossref(t):
    known = t("part").where("p_size > 35").select(F.concat(F.lit("Rs"), F.col("p_partkey").cast("string")).alias("rsid"), F.col("p_type").alias("category"))
    return genome.crossref(files.genotype_hits(*_genotypes(t))[0], known).select("rsid", "category", "interpretation_scope")


@query(f"""WITH {SEEN} SELECT (SELECT count(*) FROM g) AS rows_read, (SELECT count(*) FROM g WHERE kind = 'malformed') AS malformed_row_count, (SELECT count(*) FROM h) AS hit_count, (SELECT count(*) FROM w) - (SELECT count(*) FROM h) AS missing_count, (SELECT count(*) FROM h WHERE n_duplicates > 0) AS duplicate_rsid_count, 'public_summary_only' AS privacy_label""")
def genotype_manifest(t):
    rows, wl = _genotypes(t)
    manifest = genome.parse_manifest(rows, *files.genotype_hits(rows, wl))
    return manifest.join(genome.public_summary(manifest).select("privacy_label")).select("rows_read", "malformed_row_count", "hit_count", "missing_count", "duplicate_rsid_count", "privacy_label")


@query("""SELECT user_id, arg_min(c, event_id) FILTER (c LIKE '%date%') AS generated_at, arg_min(c, event_id) FILTER (c LIKE '%chip%' ) AS array_version, arg_min(c, event_id) FILTER (c LIKE '%build%') AS reference_build_note
  FROM (SELECT user_id, event_id, '#' || CASE event_type WHEN 'click' THEN 'date' WHEN 'view' THEN 'chip' WHEN 'signup' THEN 'build' ELSE 'note' END || event_id AS c FROM events) GROUP BY user_id""")
def header_metadata(t):
    word = F.when(F.col("event_type") == "click", "date").when(F.col("event_type") == "view", "chip").when(F.col("event_type") == "signup", "build").otherwise("note")
    rows = t("events").select("user_id", "event_id", F.concat(F.lit("#"), word, F.col("event_id").cast("string")).alias("c"))
    return genome.header_metadata(rows, "event_id", "c", ["user_id"]).select("user_id", "generated_at", "array_version", "reference_build_note")


LINK_SQL = """r AS (SELECT o_orderkey AS ord, 'Dir/F' || o_custkey % 400 || '.TXT' AS p, CASE WHEN o_orderkey % 2 = 0 THEN 'ART-' || o_custkey % 300 END AS a, o_custkey % 1000 AS who, CASE WHEN o_orderpriority = '1-URGENT' THEN 'public_ok' ELSE 'odd' END AS label FROM orders),
known AS (SELECT r.*, 'P' || c_custkey AS person_id FROM r JOIN customer ON c_custkey = who AND c_nationkey < 20),
k AS (SELECT 'path:' || lower(p) AS key, ord, person_id, label FROM known UNION ALL SELECT 'artifact:' || a, ord, person_id, label FROM known WHERE a IS NOT NULL),
links AS (SELECT key, arg_max(person_id, ord) AS person_id, arg_max(label, ord) AS label FROM k GROUP BY key)"""


def _links(t):
    o = F.col("o_custkey")
    records = t("orders").select(
        F.col("o_orderkey").alias("ord"), F.concat(F.lit("Dir\\F"), (o % 400).cast("string"), F.lit(".TXT")).alias("relative_path"), F.lit("").alias("local_path"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("ART-"), (o % 300).cast("string"))).alias("artifact_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("P"), (o % 1000).cast("string"))).alias("person_id"), F.lit(None).cast("string").alias("person_slug"),
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("I"), (o % 1000).cast("string"))).alias("gedcom_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "public_ok").otherwise("odd").alias("privacy_label"), F.lit("probable").alias("source_confidence"), F.lit("n").alias("notes"),
    )
    people = t("customer").where("c_nationkey < 20").select(F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("person_id"), F.concat(F.lit("I"), F.col("c_custkey").cast("string")).alias("gedcom_id"))
    return keyed.explicit_links(records, people, "ord")


@query(f"WITH {LINK_SQL} SELECT key, person_id, label AS privacy_label FROM links")
def explicit_links(t):
    return _links(t).select("key", "person_id", "privacy_label")


@query(f"""WITH {LINK_SQL}, m AS (SELECT doc_id, 'dir/f' || doc_id % 500 || '.txt' AS p, 'ART-' || doc_id % 350 AS a, lang FROM documents)
  SELECT doc_id, regexp_replace(p, '[^a-z0-9]+', '-', 'g') || '--' || coalesce(x.person_id, y.person_id, 'needs-review') AS link_id,
  CASE WHEN x.key IS NULL AND y.key IS NULL THEN 'needs_review' ELSE 'manual_config' END AS match_method, CASE WHEN x.key IS NULL AND y.key IS NULL THEN 'needs_review' ELSE 'probable' END AS match_confidence,
  CASE WHEN coalesce(x.label, y.label) = 'public_ok' OR lang = 'en' THEN 'public_ok' ELSE 'private_family_only' END AS privacy_label,
  'Mapped' || CASE WHEN x.key IS NULL AND y.key IS NULL THEN '' ELSE '|n' END AS notes
  FROM m LEFT JOIN links x ON x.key = 'path:' || p LEFT JOIN links y ON y.key = 'artifact:' || a""")
def link_rows(t):
    k = F.col("doc_id")
    m = t("documents").select("doc_id", F.concat(F.lit("dir/f"), (k % 500).cast("string"), F.lit(".txt")).alias("relative_path"), F.concat(F.lit("ART-"), (k % 350).cast("string")).alias("artifact_id"), F.when(F.col("lang") == "en", "public_ok").alias("privacy_label"), F.lit("confirmed").alias("source_confidence"))
    rows = keyed.with_link(m, _links(t), "match")
    out = keyed.link_rows(rows.withColumn("artifact_id", F.concat_ws("#", "artifact_id", k.cast("string"))), F.lit("manual_config"), "match", F.lit("Mapped"), "private_family_only", "needs_review")
    return out.select(F.split_part("artifact_id", F.lit("#"), F.lit(2)).cast("long").alias("doc_id"), "link_id", "match_method", "match_confidence", "privacy_label", F.array_join("review_notes", "|").alias("notes"))


@query("""WITH c AS (SELECT n_nationkey AS ord, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE 'fam/' || n_regionkey || CASE WHEN n_nationkey % 2 = 0 THEN '/' || n_nationkey ELSE '' END || '/' END AS prefix, CASE WHEN n_nationkey % 3 = 0 THEN 'a.zip' ELSE '' END AS zip FROM nation),
  m AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'a.zip' ELSE 'b.zip' END AS zip, 'fam/' || s_nationkey % 5 || '/' || s_nationkey || '/x.jpg/' AS path FROM supplier)
  SELECT s_suppkey, (SELECT ord FROM c WHERE (c.zip = '' OR c.zip = m.zip) AND starts_with(m.path, c.prefix) ORDER BY length(c.prefix) DESC, ord LIMIT 1) AS context FROM m""")
def zip_context(t):
    n = F.col("n_nationkey")
    prefix = F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("Fam\\"), F.col("n_regionkey").cast("string"), F.when(n % 2 == 0, F.concat(F.lit("/"), n.cast("string"))).otherwise("")))
    contexts = t("nation").select(n.alias("ord"), prefix.alias("member_prefix"), F.when(n % 3 == 0, "old/A.zip").alias("zip_filename"))
    s = F.col("s_nationkey")
    members = t("supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "/d/a.zip").otherwise("/d/b.zip").alias("zip_path"), F.concat(F.lit("fam/"), (s % 5).cast("string"), F.lit("/"), s.cast("string"), F.lit("/x.jpg")).alias("member_path"))
    found = keyed.context_match(members.select("zip_path", "member_path").distinct(), contexts)
    return members.join(found, ["zip_path", "member_path"]).select("s_suppkey", "context")


@query("""SELECT s_suppkey, CASE WHEN s_nationkey % 4 = 3 THEN NULL WHEN s_nationkey % 4 = 2 THEN 'X' || s_nationkey WHEN s_nationkey % 4 = 0 THEN 'P' || s_nationkey END AS person_id,
  CASE WHEN s_nationkey % 4 = 0 THEN 'I' || s_nationkey WHEN s_nationkey % 4 = 1 THEN 'J' || s_nationkey END AS gedcom_id, CASE WHEN s_nationkey % 4 = 3 THEN 3 ELSE 2 END AS n_notes FROM supplier""")
def context_people(t):
    n = F.col("n_nationkey")
    contexts = t("nation").select(n.alias("ord"), F.when(n % 4 == 2, F.concat(F.lit("X"), n.cast("string"))).alias("person_id"), F.when(n % 4 == 0, F.concat(F.lit("I"), n.cast("string"))).when(n % 4 == 1, F.concat(F.lit("J"), n.cast("string"))).alias("gedcom_id"), F.lit(None).cast("string").alias("notes"))
    people = t("nation").select(F.concat(F.lit("P"), n.cast("string")).alias("person_id"), F.concat(F.lit("I"), n.cast("string")).alias("gedcom_id"))
    members = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("context"))
    return keyed.context_people(members, contexts, people).select("s_suppkey", "person_id", "gedcom_id", F.size("review_notes").alias("n_notes"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS record_id, 'lifespan:replay' AS code, 'error' AS severity FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 7 = 0
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'lifespan:bound_with_days', 'error' FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 11 = 0""")
def lifespan_replay(t):
    birth, death = F.col("o_orderdate").cast("date"), F.date_add(F.col("o_orderdate").cast("date"), 900)
    age, exact = dates.attained_age(birth, death), F.col("o_orderstatus") == "F"
    days = F.when(exact, F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(900)).when(F.col("o_orderkey") % 11 == 0, 1)
    rows = t("orders").select("o_orderkey", birth.alias("birth"), death.alias("death"), exact.alias("exact"), days.alias("days"), age.alias("lower"), age.alias("upper"), F.lit(False).alias("exclusive"))
    return publication.lifespan_findings(rows, "o_orderkey", CUTOFF)


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS record_id, 'counts:subjects' AS code, 'error' AS severity FROM nation WHERE n_nationkey % 3 = 0
  UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'counts:closure', 'error' FROM nation WHERE n_nationkey % 4 = 0""")
def count_reconciliation(t):
    n = F.col("n_nationkey")
    rows = t("nation").select("n_nationkey", F.lit(10).alias("identified_subjects"), F.when(n % 3 == 0, 9).otherwise(10).alias("n_rows"), *[F.lit(5).alias(c) for c in ("named_fellows", "n_named")], F.lit(2).alias("open_boundaries"), F.lit(2).alias("n_open"), F.lit(1).alias("fully_resolved"), F.when(n % 4 == 0, 3).otherwise(4).alias("resolved"), F.lit(6).alias("inventoried"), F.lit(6).alias("official"))
    return publication.count_findings(rows, "n_nationkey")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS record_id, 'falsifier:missing' AS code, 'error' AS severity FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'status:unknown', 'error' FROM part WHERE p_partkey % 5 = 0
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'source_refs:undeclared', 'error' FROM part WHERE p_size > 25
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'source_refs:ambiguous', 'error' FROM part WHERE p_size = 7""")
def question_findings(t):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    ref = F.when(F.col("p_size") == 8, F.lit("b:7")).otherwise(size)
    questions = t("part").select(k.cast("string").alias("id"), F.col("p_name").alias("question"), F.when(k % 3 == 0, "TODO").otherwise("f").alias("falsifier"), F.when(k % 5 == 0, "maybe").otherwise("open").alias("status"), F.array(ref).alias("source_refs"), F.array(F.lit("x")).alias("cannot_support"))
    declared = t("nation").select(F.lit("a").alias("register"), (F.col("n_nationkey") + 1).cast("string").alias("source_id")).unionByName(t("region").limit(1).select(F.lit("b").alias("register"), F.lit("7").alias("source_id")))
    return publication.question_findings(questions, declared)


@query("""SELECT CAST(c_custkey AS VARCHAR) AS record_id, code, 'error' AS severity FROM customer, (VALUES (0, 'manifest_privacy_tier_not_r4'), (1, 'manifest_external_writes_not_disabled'), (2, 'manifest_unknown_field'), (3, 'manifest_required_control_list_missing:stop_conditions')) v(k, code) WHERE c_custkey % 5 = k""")
def manifest_findings(t):
    k = F.col("c_custkey") % 5
    body = F.concat(F.lit('{"run_id": "r", "question": "q", "objective": "o", "schema_version": "1.0", "privacy": {"sensitivity_ceiling": "'), F.when(k == 0, "R3").otherwise("R4"), F.lit('", "share_status": "do_not_share", "external_writes_allowed": '), F.when(k == 1, '"false"').otherwise("false"), F.lit(', "public_derivative_allowed": false, "case_data_in_final_chat": false}, "always_blocked_inputs": ["a"], "required_controls": ["b"], "stop_conditions": '), F.when(k == 3, "[]").otherwise('["c"]'), F.when(k == 2, ', "extra": 1}').otherwise("}"))
    allowed = ["run_id", "question", "objective", "schema_version", "privacy", "always_blocked_inputs", "required_controls", "stop_conditions"]
    return publication.manifest_findings(t("customer").select("c_custkey", body.alias("body")), "c_custkey", "body", allowed)


@query("""SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 3 = 0 THEN 'subject_attribution_not_reviewed' END, CASE WHEN doc_id % 5 = 0 AND quality IS NULL THEN 'no_hash_bound_source' END,
  CASE WHEN quality IS NOT NULL AND doc_id % 7 = 0 THEN 'review_dates_differ_from_evidence_record' END, CASE WHEN doc_id % 5 <> 0 AND doc_id % 4 = 0 THEN 'review_hash_differs_from_retrieval_receipt' END) AS problems FROM documents LEFT JOIN labels USING (doc_id)""")
def review_problems(t):
    k = F.col("doc_id")
    rows = t("documents").join(t("labels"), "doc_id", "left").select(
        "doc_id", k.cast("string").alias("profile_url"), (k % 3 != 0).alias("subject_reviewed"), F.lit("why").alias("rationale"), F.when(k % 5 != 0, F.lit("h")).alias("source_sha256"),
        F.when(F.col("quality").isNotNull(), k.cast("string")).alias("evidence_source_id"), F.lit("e").alias("evidence_sha256"), F.when(k % 7 == 0, "1901").otherwise("1900").alias("birth"), F.lit("").alias("death"), F.lit(None).cast("string").alias("death_not_after"), F.lit(None).cast("int").alias("completed_age"),
    )
    profiles = t("documents").select(k.cast("string").alias("profile_url"), F.when(k % 4 == 0, "other").otherwise("h").alias("profile_sha256"))
    ledger = t("labels").select(k.cast("string").alias("source_id"), F.lit("1900").alias("birth_date"), F.lit(None).cast("string").alias("death_date"), F.lit(None).cast("string").alias("death_not_after"), F.lit(None).cast("int").alias("completed_age"))
    return publication.review_problems(rows, profiles, ledger, "doc_id").select("doc_id", F.array_join("problems", ",").alias("problems"))


@query("""SELECT 'u' || o_orderkey AS record_id, code, 'error' AS severity FROM orders, (VALUES (0, 'award_year:differs'), (1, 'membership_rationale:missing'), (2, 'official_profile:differs'), (3, 'citation:unregistered')) v(k, code) WHERE o_orderkey % 6 = k AND o_orderstatus = 'O'
  UNION ALL SELECT 'u' || o_orderkey, 'coverage:missing', 'error' FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'u' || o_orderkey, 'citation:unattributed', 'error' FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 6 = 4""")
def reviewed_awards(t):
    k, url = F.col("o_orderkey") % 6, F.concat(F.lit("u"), F.col("o_orderkey").cast("string"))
    o, mine = t("orders"), t("orders").where("o_orderstatus = 'O'")
    found = mine.select(url.alias("profile_url"), F.when(k == 0, 1).otherwise(2).alias("award_year"), F.when(k == 1, "").otherwise("r").alias("membership_rationale"))
    expected = o.where("o_orderstatus in ('O', 'F')").select(url.alias("profile_url"))
    sources = mine.select(url.alias("source_url"), F.when(k == 2, "x").otherwise("h").alias("source_sha256"))
    cites = mine.where("o_orderkey % 6 <> 2").select(url.alias("profile_url"), url.alias("source_url"), F.when(k == 3, "z").otherwise("h").alias("source_sha256"), F.when(k == 4, "").otherwise("e").alias("excerpt"), F.lit("r").alias("rationale"))
    return publication.reviewed_award_findings(found, expected, o.select(url.alias("profile_url"), F.lit(2).alias("award_year")), o.select(url.alias("profile_url"), F.lit("h").alias("profile_sha256")), cites, sources)


@query("""WITH p AS (SELECT o_orderkey, 'u' || o_orderkey AS url, CASE WHEN o_orderstatus = 'P' THEN 'u' || o_orderkey || '#member:' || l_linenumber ELSE 'u' || o_orderkey || '#recipient' END AS k,
  CASE WHEN o_orderstatus = 'P' THEN CASE WHEN l_returnflag = 'R' THEN 'member' ELSE 'none' END WHEN o_orderpriority = '1-URGENT' THEN 'review' WHEN o_orderpriority = '5-LOW' THEN 'prior' ELSE 'none' END AS review
  FROM orders LEFT JOIN lineitem ON o_orderstatus = 'P' AND l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' OR l_orderkey IS NOT NULL)
  SELECT 'person-' || substr(sha256(k), 1, 20) AS person_id, 'award-' || substr(sha256(url), 1, 20) AS award_id, review FROM p""")
def inventory_resolution(t):
    url = F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("profile_url")
    o = t("orders")
    members = t("lineitem").select(F.concat(F.lit("u"), F.col("l_orderkey").cast("string")).alias("profile_url"), F.col("l_linenumber").cast("string").alias("name"), (F.col("l_returnflag") == "R").alias("reviewed"))
    roster = o.select(url, F.lit(1990).alias("award_year"), F.lit("x").alias("recipient_label"))
    found = publication.resolve_inventory(roster, o.where("o_orderstatus = 'P'").select(url), members, o.where("o_orderpriority = '1-URGENT'").select(url), o.where("o_orderpriority = '5-LOW'").select(url))
    return found.select("person_id", "award_id", "review")


@query("SELECT 'u' || o_orderkey AS profile_url, 'group_membership_unresolved' AS status FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def missing_awards(t):
    reviewed = t("lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("u"), F.col("l_orderkey").cast("string")).alias("profile_url"))
    return subjects.missing_awards(t("orders").select(F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("profile_url")), reviewed)


@query("SELECT 's' || l_suppkey AS source_url, l_returnflag AS source_sha256, max(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem GROUP BY ALL")
def distinct_sources(t):
    rows = t("lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_url"), F.col("l_returnflag").alias("source_sha256"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return subjects.distinct_sources(rows, "ord")


@query("""WITH b AS (SELECT o_custkey, CAST(min(o_totalprice) AS BIGINT) // 1000 AS lo, CAST(max(o_totalprice) AS BIGINT) // 1000 AS hi FROM orders GROUP BY 1)
  SELECT o_custkey, 1 + (SELECT count(*) FROM b o WHERE o.lo > b.hi) AS rank_min, 1 + (SELECT count(*) FROM b o WHERE o.o_custkey <> b.o_custkey AND o.hi > b.lo) AS rank_max, 'conditional_comparison' AS comparison FROM b""")
def population_ranking(t):
    whole = lambda c: F.floor(F.round(c).cast("long") / 1000)
    people = t("orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("a"), F.max("o_totalprice").alias("b")).select("o_custkey", whole("a").alias("lo"), whole("b").alias("hi"))
    return subjects.population_ranking(people, t("nation"), "lo", "hi").select("o_custkey", "rank_min", "rank_max", "comparison")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE 0 END AS position, CASE WHEN event_id % 4 = 0 THEN 'https://x.org/' || event_id END AS url, event_id % 4 <> 0 AS invalid,
  CASE event_id % 3 WHEN 0 THEN 'access_block' WHEN 1 THEN 'rate_limit' ELSE 'http_error' END AS kind, event_id % 3 < 2 AS halt FROM events""")
def search_results(t):
    k = F.col("event_id") % 4
    url = F.when(k == 0, F.concat(F.lit("https://x.org/"), F.col("event_id").cast("string"))).when(k == 1, "ftp://x.org/").otherwise("no url")
    body = F.when(k == 3, F.lit('{"error": 1}')).otherwise(F.concat(F.lit('{"results": [{"url": "'), url, F.lit('", "title": "t", "secret": "s"}]}')))
    hits = adapters.search_hits(t("events").select("event_id", body.alias("body")), "event_id", "body", "search")
    status = F.when(F.col("event_id") % 3 == 0, 403).when(F.col("event_id") % 3 == 1, 429).otherwise(500)
    return hits.withColumn("e", adapters.error_kind(status)).select("event_id", "position", "url", "invalid", F.col("e.kind").alias("kind"), F.col("e.halt_batch").alias("halt"))


@query("""SELECT 'f' || p_partkey || '.txt' AS relative_path, CASE WHEN p_partkey % 2 = 0 THEN '/a/b/f' || p_partkey || '.txt' WHEN p_partkey % 3 = 0 THEN '/a/f' || p_partkey || '.txt' END AS local_path FROM part""")
def resolved_paths(t):
    k = F.col("p_partkey")
    name = F.concat(F.lit("f"), k.cast("string"), F.lit(".txt"))
    listing = t("part").where(k % 2 == 0).select(F.concat(F.lit("/a/b/"), name).alias("path")).unionByName(t("part").where(k % 3 == 0).select(F.concat(F.lit("/a/"), name).alias("path")))
    return stores.resolve_paths(t("part").select(name.alias("relative_path")), listing, "/a/b")


@query("""SELECT o_orderkey, count(l_orderkey) AS n_members, count(l_orderkey) > 0 AND coalesce(bool_and(l_returnflag <> 'R'), false) AND any_value(o_orderstatus) <> 'O' AS fully_excluded
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def award_status(t):
    members = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") != "R", "exact_below").otherwise("possible_above").alias("status"))
    return awards.award_status(t("orders").select("o_orderkey", (F.col("o_orderstatus") == "O").alias("open")), members, "o_orderkey").select("o_orderkey", "n_members", "fully_excluded")
