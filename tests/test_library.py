"""Operators on small synthetic fixtures: dates, GEDCOM, files, validators, awards, packets."""

import datetime
import json
import random
import zipfile
import zlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from evispark.functions import dates, html, text, web
from evispark.operators import awards, evidence, linking, ranking, validators
from evispark.operators.policy import export_decision, packet_keeps
from evispark.plans import packet, queue
from evispark.sources import files, gedcom, sinks


def column(spark, values, kind, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", make(F.col("v"))).orderBy("i").collect()]


def test_intervals(spark):
    d = datetime.date
    got = column(spark, ["1919", "1900/1902", "2000-02", "2000-02-29", "2001-02-29", "1902/1900", "about 1900", "1919-13", " 1950 ", None, ""], "string", dates.parse_interval)
    want = [(d(1919, 1, 1), d(1919, 12, 31)), (d(1900, 1, 1), d(1902, 12, 31)), (d(2000, 2, 1), d(2000, 2, 29)), (d(2000, 2, 29),) * 2, None, None, None, None, (d(1950, 1, 1), d(1950, 12, 31)), None, None]
    assert [tuple(x) if x else None for x in got] == want


def naive_age(birth, end):
    def anniversary(year):
        try:
            return birth.replace(year=year)
        except ValueError:
            return birth.replace(year=year, day=28)

    years = end.year - birth.year - (anniversary(end.year) > end)
    return years, (end - anniversary(birth.year + years)).days


def test_attained_age_against_naive(spark):
    rng = random.Random(1)
    first = datetime.date(1890, 1, 1).toordinal()
    pairs = [tuple(sorted(datetime.date.fromordinal(first + rng.randrange(48_000)) for _ in range(2))) for _ in range(1500)]
    pairs += [(datetime.date(1904, 2, 29), datetime.date(y, m, d)) for y, m, d in ((1905, 2, 27), (1905, 2, 28), (1908, 2, 28), (1908, 2, 29), (1904, 2, 29))]
    df = spark.createDataFrame([Row(b=b, e=e) for b, e in pairs])
    got = df.select("b", "e", dates.attained_age(F.col("b"), F.col("e")).alias("a")).collect()
    assert all(tuple(r.a) == naive_age(r.b, r.e) for r in got)
    assert df.select(dates.attained_age(F.col("e"), F.date_sub("b", 1)).alias("a")).where("a is not null").count() == 0


def test_rank_envelope_against_naive(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        lo = rng.randrange(40)
        up = rng.choice([None, lo, lo + rng.randrange(10)])
        rows.append((i, lo, up, up is not None and rng.random() < 0.3))
    got = {r.i: (r.rank_min, r.rank_max) for r in ranking.rank_envelope(spark.createDataFrame(rows, "i int, lo long, up long, ex boolean"), "lo", "up", "ex").collect()}
    for i, lo, up, ex in rows:
        others = [r for r in rows if r[0] != i]
        best = 1 if up is None else 1 + sum(o[1] > up or (ex and o[1] == up) for o in others)
        worst = 1 + sum(o[2] is None or o[2] > lo for o in others)
        assert got[i] == (best, worst)


def test_shared_origin_groups_against_naive(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "", f"h{rng.randrange(40)}"]), rng.choice([None, f"h{rng.randrange(60)}"])) for i in range(80)]
    got = {r.k: r.group_id for r in evidence.shared_origin_groups(spark.createDataFrame(rows, "k long, a string, b string"), "k", [F.col("a"), F.col("b")]).collect()}
    root = {i: i for i, *_ in rows}
    for _ in rows:
        for i, *a in rows:
            for j, *b in rows:
                if {x for x in a if x} & {x for x in b if x}:
                    root[i] = root[j] = min(root[i], root[j])
    assert got == root


GED = """0 HEAD
0 @I1@ INDI
1 NAME Ann /Alpha/
1 SEX F
1 BIRT
2 DATE 1900
2 PLAC Town
1 NOTE long
2 CONC note
2 CONT next
1 FAMS @F1@
0 @I2@ INDI
1 NAME Bob /Beta/
1 DEAT
2 DATE 1950
1 FAMS @F1@
0 @I3@ INDI
1 NAME
1 FAMC @F1@
0 @F1@ FAM
1 HUSB @I2@
1 WIFE @I1@
1 CHIL @I3@
1 MARR
2 DATE 1920
"""


def test_gedcom(spark, tmp_path):
    (tmp_path / "t.ged").write_text("﻿" + GED)
    nodes = gedcom.read_nodes(spark, str(tmp_path / "t.ged")).cache()
    people = {r.person_id: r for r in gedcom.persons(nodes).collect()}
    assert (people["I1"].given_name, people["I1"].surname, people["I1"].birth_place, people["I1"].is_potentially_living) == ("Ann", "Alpha", "Town", True)
    assert people["I2"].death_date == "1950" and not people["I2"].is_potentially_living and people["I3"].display_name == "Unknown"
    family = gedcom.families(nodes).collect()[0]
    assert (family.husband_id, family.wife_id, family.child_ids, family.marriage_date) == ("I2", "I1", ["I3"], "1920")
    assert gedcom.assembled(nodes).where("tag = 'NOTE'").first().value == "long note\nnext"
    links = {tuple(r) for r in gedcom.relationships(gedcom.persons(nodes), gedcom.families(nodes)).collect()}
    assert ("I3", "parent", "I1") in links and ("I1", "spouse", "I2") in links and len(links) == 6
    (tmp_path / "bad.ged").write_text("0 HEAD\nx y\n")
    with pytest.raises(Exception, match="not a GEDCOM line"):
        gedcom.read_nodes(spark, str(tmp_path / "bad.ged")).collect()


def test_files(spark, tmp_path):
    root = tmp_path / "tree"
    for name, body in {"a/ABC-12-x_p.html": b"<html><title> A  &amp; b</title><link rel=canonical href='https://x.org/y'></html>", "a/p.pdf": b"%PDF /Type /Page /Type /Pages /Type /Page", "b/q.pdf": b"no", "node_modules/z.txt": b"", "s.json": b'{"records": [{"x": 1}, 3]}', "t.csv": b"x,y\n1,2\n", "u.yaml": b"- x: 1\n- x: 2\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    with zipfile.ZipFile(root / "w.wacz", "w") as z:
        z.writestr("m/one.txt", "one")
        z.writestr("two.txt", "")
    scanned = files.scan_files(spark, str(root))
    rows = {r.relative_path: r for r in files.manifest(scanned).collect()}
    assert len(rows) == 7 and rows["a/ABC-12-x_p.html"].file_category == "web_snapshot" and rows["w.wacz"].file_category == "archive"
    formats = {r.relative_path: r for r in files.inspect_formats(scanned).collect()}
    assert formats["a/ABC-12-x_p.html"].html_title == "A & b" and formats["a/ABC-12-x_p.html"].probable_source_url == "https://x.org/y"
    assert formats["a/p.pdf"].pdf_page_count == 2 and formats["b/q.pdf"].pdf_page_count is None
    members = {r.member_path: r for r in files.zip_members(scanned).collect()}
    assert members["m/one.txt"].crc32 == f"{zlib.crc32(b'one'):08x}" and members["two.txt"].size_bytes == 0
    records = sorted((r.relative_path, r.ordinal, r.record) for r in files.read_sidecars(scanned).collect())
    assert [r[:2] for r in records] == [("s.json", 0), ("t.csv", 0), ("u.yaml", 0), ("u.yaml", 1)]


def test_genotypes(spark, tmp_path):
    (tmp_path / "g.txt").write_text("#c one\nrsid chromosome position allele1 allele2\nrs1 1 10 A -\nrs1 1 10 C C\nrs9 1 2 A A\nrs3 1\n")
    rows = files.read_genotypes(spark, str(tmp_path / "g.txt"))
    assert {r.kind: r["count"] for r in rows.groupBy("kind").count().collect()} == {"comment": 1, "header": 1, "row": 3, "malformed": 1}
    hits, missing = files.genotype_hits(rows, spark.createDataFrame([("RS1", "g"), ("rs2", "h")], "rsid string, gene string"))
    h = hits.collect()
    assert len(h) == 1 and (h[0].allele1, h[0].n_duplicates, h[0].call_status) == ("A", 1, "no_call")
    assert [r.rsid for r in missing.collect()] == ["rs2"]


def test_strict_json_and_sinks(spark, tmp_path):
    for i, bad in enumerate(['{"a": 1, "A": 2}', '{"a": NaN}', "[1]"]):
        (tmp_path / f"{i}.json").write_text(bad)
        with pytest.raises(ValueError):
            files.strict_json(str(tmp_path / f"{i}.json"))
    sinks.replace_file(str(tmp_path / "x.json"), sinks.canonical_json({"b": 1, "a": "é"}))
    assert (tmp_path / "x.json").read_text() == '{"a":"é","b":1}' and files.strict_json(str(tmp_path / "x.json"))["b"] == 1
    df = spark.createDataFrame([("x", ["p", "q"]), (None, [])], "a string, n array<string>")
    sinks.write_guarded_csv(df, str(tmp_path / "csv"), ["n", "a"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["n", "a"]
    for cell in ("=1", " +x", "-", "@a"):
        with pytest.raises(ValueError, match="formula"):
            sinks.write_guarded_csv(spark.createDataFrame([(cell,)], "a string"), str(tmp_path / "no"), ["a"])
    with pytest.raises(ValueError):
        sinks.require_private(str(tmp_path / "out"), [str(tmp_path / "private")])
    sinks.require_private(str(tmp_path / "private" / "out"), [str(tmp_path / "private")])


GOOD = dict(envelope_id="e1", schema_version="1.0", recorded_at="2020", source_class="user_export", evidence_role="observation", privacy_tier="R1", privacy_label="public_ok", source_confidence="confirmed", consent_scopes=["private_research"], subject_ids=["p"], claim_ids=[], provenance=("m", "t", "o"), integrity_sha256=None, local_locator_ref=None, secret_keys=[])
SCHEMA = "envelope_id string, schema_version string, recorded_at string, source_class string, evidence_role string, privacy_tier string, privacy_label string, source_confidence string, consent_scopes array<string>, subject_ids array<string>, claim_ids array<string>, provenance struct<capture_method:string,captured_at:string,source_owner:string>, integrity_sha256 string, local_locator_ref string, secret_keys array<string>"


def test_envelopes(spark):
    changes = [({}, ""), ({"envelope_id": " "}, "envelope_id:required"), ({"source_class": "x"}, "source_class:vocabulary"), ({"subject_ids": None}, "subject_ids:list"), ({"privacy_tier": "R4", "consent_scopes": ["public_release"]}, "consent_scopes:tier"), ({"evidence_role": "inference"}, "source_confidence:inference"), ({"integrity_sha256": "12"}, "integrity_sha256:digest"), ({"local_locator_ref": "C:\\x"}, "local_locator_ref:opaque"), ({"provenance": ("m", None, "o")}, "provenance.captured_at:required"), ({"secret_keys": ["a.password"]}, "secret_keys"), ({"recorded_at": None, "privacy_label": "z"}, "recorded_at:required; privacy_label:vocabulary")]
    df = spark.createDataFrame([tuple((GOOD | c).values()) for c, _ in changes], SCHEMA)
    assert [r.errors for r in validators.envelope_errors(df).collect()] == [e for _, e in changes]


def test_claims(spark):
    links = "array<struct<envelope_id:string,relation:string>>"
    schema = f"claim_id string, statement string, claim_type string, privacy_label string, review_status string, subject_ids array<string>, limitations array<string>, evidence_links {links}"
    rows = [("c1", "s", "t", "public_ok", "draft", ["p"], [], [("e1", "supports")]), ("c2", "s", "t", "public_ok", "draft", [], [], [("e9", "refutes")]), ("c2", "", "t", "public_ok", "done", [], [], [])]
    claims, envelopes = spark.createDataFrame(rows, schema), spark.createDataFrame([("e1", "public_ok")], "envelope_id string, privacy_label string")
    got = sorted((r.record_id, r.code) for r in validators.claim_findings(claims, envelopes).collect())
    assert got == [("c2", "claim_id:repeated"), ("c2", "evidence_links:missing"), ("c2", "evidence_links:relation"), ("c2", "review_status:vocabulary"), ("c2", "statement:required")]
    nodes, edges = validators.claim_graph(claims.limit(1), envelopes)
    assert nodes.count() == 2 and [tuple(r) for r in edges.collect()] == [("c1", "e1", "supports")]


def test_receipts(spark):
    good = {"boundary_contract": "b.v1", "cannot_support": list(validators.MUST_NOT_SUPPORT), "consent_scope": "public_release", "contains": {f: False for f in validators.CONTENT_FLAGS}, "human_reviewed": True, "privacy_label": "public_ok", "privacy_tier": "P0", "private_content_withheld": True, "producer": "p", "projection_kind": "archive_metadata", "public_projection_sha256": "a" * 64, "public_projection_item_count": 3, "receipt_id": "r-123", "schema_version": "s.v1", "source_schema": "x/y.v1"}
    cases = [(good, ""), (good | {"extra": 1}, "fields:unknown"), (good | {"public_projection_item_count": True}, "public_projection_item_count:range"), (good | {"human_reviewed": "true"}, "human_reviewed:value"), (good | {"contains": good["contains"] | {"genotypes": True}}, "contains.genotypes"), (good | {"cannot_support": ["claim_validation"]}, "cannot_support:required"), (good | {"producer": "q"}, "producer:value")]
    df = spark.createDataFrame([(json.dumps(c),) for c, _ in cases], "payload string")
    assert [r.errors for r in validators.receipt_errors(df, "payload", "p", "s.v1", "b.v1").collect()] == [e for _, e in cases]
    assert "json" in validators.receipt_errors(spark.createDataFrame([("{",)], "payload string"), "payload", "p", "s", "b").first().errors


def test_registers(spark):
    schema = "register string, id string, title string, source_type string, evidence_role string, urls array<string>, supports array<string>, cannot_support array<string>"
    ok = ("a", "1", "t", "s", "e", ["https://x.org"], ["s"], ["c"])
    rows = [ok, ("b", *ok[1:]), ("b", *ok[1:]), ("a", "2", "", "s", "e", ["http://x.org"], ["s"], [])]
    got = sorted((r.register, r.id, r.code) for r in validators.source_findings(spark.createDataFrame(rows, schema)).collect())
    assert got == [("a", "2", "cannot_support:required"), ("a", "2", "title:required"), ("a", "2", "urls:https"), ("b", "1", "id:repeated")]


def test_adjudication(spark):
    people = spark.createDataFrame([(c,) for c in "abcdefghij"], "person_id string")
    schema = "person_id string, birth string, death string, death_not_after string, completed_age_years int, death_by_cutoff boolean, conflict string, disposition string, class string"
    rows = [("b", "1919", None, None, None, None, None, None, "male"), ("c", "1900-01-01", "1950-01-01", None, None, None, None, None, "female"), ("d", "1900", None, None, None, None, None, None, "female"), ("e", "1900", None, "1960", None, None, None, None, "male"), ("f", None, None, None, 80, True, None, None, "male"), ("g", None, None, None, 80, None, None, None, "male"), ("h", "1902/1900", None, None, None, None, None, None, "male"), ("i", "1900", None, None, None, None, "two births", None, "male"), ("j", "1900", None, None, None, None, None, "muted_edge_case", "male")]
    got = {r.person_id: (r.status, r["class"], r.priority) for r in awards.adjudicate(people, spark.createDataFrame(rows, schema), "2026-10-22", 107, 307).collect()}
    assert got == {"a": ("insufficient_age_evidence", "unknown", 0), "b": ("bounded_below", "male", 2), "c": ("exact_below", "female", 2), "d": ("possible_above", "female", 4), "e": ("bounded_below", "male", 2), "f": ("bounded_below", "male", 2), "g": ("insufficient_age_evidence", "male", 0), "h": ("identity_conflict", "unknown", 0), "i": ("identity_conflict", "unknown", 0), "j": ("muted", "male", 0)}


def test_policy_differs_between_exports_and_packets(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    label, no = F.lit("do_not_share"), F.lit(False)
    assert not one(export_decision(label, no, no, "private_full")).include and one(packet_keeps(label, no, "private_full"))
    assert one(export_decision(F.lit("public_ok"), no, F.lit(None).cast("boolean"), "public")).reasons == "potentially_living"
    assert one(export_decision(F.lit("public_ok"), no, no, "other")).reasons == "unknown_profile"


def test_packet(spark, tmp_path):
    (tmp_path / "t.ged").write_text(GED)
    nodes = gedcom.read_nodes(spark, str(tmp_path / "t.ged"))
    people, fams = gedcom.persons(nodes), gedcom.families(nodes)
    manifest = spark.createDataFrame([("a/x.pdf", "x.pdf", None, "public_ok"), ("b/raw-dna.txt", "raw-dna.txt", None, "public_ok")], "relative_path string, filename string, artifact_id string, privacy_label string")
    links = spark.createDataFrame([(1, "a/x.pdf", "I2", "do_not_share", "probable", "filename"), (2, "a/x.pdf", "I2", None, "confirmed", "manual"), (3, "b/raw-dna.txt", "I2", None, "confirmed", "manual")], "ordinal int, relative_path string, person_id string, privacy_label string, match_confidence string, match_method string")
    rows = {r.relative_path: r for r in packet.export_rows(manifest, links, people, "public").collect()}
    assert rows["a/x.pdf"].include and rows["a/x.pdf"].match_confidence == "confirmed" and rows["b/raw-dna.txt"].reasons == "raw_dna"
    text_rows = [(r.section, r.text) for r in packet.packet("I2", people, fams, links, manifest, "private_full").collect()]
    assert ("timeline", "death: 1950") in text_rows and ("timeline", "marriage: 1920") in text_rows and ("relationships", "spouse in F1") in text_rows
    assert not any("raw-dna" in t for _, t in text_rows)
    assert packet.packet("I1", people, fams, links, manifest, "public").count() == 0


def test_text_and_web(spark):
    assert column(spark, ["Zoë Ann", "", None], "string", text.name_token) == ["ann", "", ""]
    assert column(spark, ["in 1950, 2099 2100 and x1950"], "string", text.years) == [[1950, 2099]]
    assert column(spark, ["https://x.org/a", "https://u@x.org", "http://x.org", "https://x.org/?q", "no url", None], "string", web.clean_url) == [True, False, False, False, False, False]
    assert column(spark, ["https://x.org/a?b=1", "https://x.org/?token=1", "http://127.0.0.1/", "http://host/", "ftp://x.org"], "string", web.public_url) == [True, False, False, False, False]
    assert column(spark, ["It proves kinship.", "It cannot prove kinship.", None], "string", web.prohibited_claim) == [True, False, False]
    told = spark.createDataFrame([("Her mother was born in 1900. " + "x " * 50 + "Ann Álpha was born in 1931.", "Ann Alpha", None), ("Alpha, born in the 1930s", "Ann Alpha", None)], "t string, n string, y int")
    assert [r[0] and r[0].birth_year for r in told.select(html.birth_statement("t", "n", "y")).collect()] == [1931, None]
    page = spark.createDataFrame([("<p>a<script>x</script> b</p><a href='https://q.org/1'>c</a>",)], "h string")
    assert page.select(html.page_text(F.col("h"))["text"]).first()[0] == "a b c"


def test_longest_prefix_and_queue(spark):
    items = spark.createDataFrame([("z/a/b/c.txt",), ("z/a/x.txt",), ("q.txt",)], "path string")
    contexts = spark.createDataFrame([("z/a/",), ("z/a/b/",)], "prefix string")
    assert {r.path: r.prefix for r in linking.longest_prefix(items, "path", contexts, "prefix").collect()} == {"z/a/b/c.txt": "z/a/b/", "z/a/x.txt": "z/a/", "q.txt": None}
    people = spark.createDataFrame([(i, "g", i % 3) for i in range(123)], "id int, g string, priority int")
    sizes = [r["count"] for r in queue.chunks(people, ["g"], ["priority", "id"], 50).groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == [50, 50, 23]
    log = spark.createDataFrame([("q", 1, "failed", "rate"), ("q", 2, "failed", "rate"), ("r", 1, "searched", None), ("s", 3, "failed", "x")], "query_id string, attempt int, status string, failure string")
    assert {r.query_id: r.status for r in queue.replay(log).collect()} == {"q": "pending", "r": "searched", "s": "failed"}


def test_hypotheses(spark):
    from evispark.operators import research

    base = research.RANK_A_VALUES | {"hypothesis_id": "h", "status": "confirmatory_ready", "rank_band": "A", "privacy_label": "R4", "share_status": "do_not_share", "unknowns": [], "cannot_support": "It cannot prove kinship.", "cannot_support_categories": research.MUST_NOT_SUPPORT, "source_urls": ["https://x.org/a"], "origin_evidence_roles": ["public_record"], "array_confirmation_status": "not_applicable", "reference_build": None, "orientation_status": None, "access_verified_on": "2026-01-02"}
    cases = [({}, []), ({"rank_band": "Z"}, ["rank_band_invalid"]), ({"rank_band": "B", "power_status": "pending"}, []), ({"power_status": "pending"}, ["rank_a_power_status_not_met"]), ({"source_urls": ["http://x.org"]}, ["source_url_not_clean", "source_url_not_https"]), ({"origin_evidence_roles": ["array_call"]}, ["rank_a_array_confirmation_not_met", "rank_a_genome_harmonization_missing"]), ({"access_verified_on": "soon"}, ["rank_a_access_date_invalid"]), ({"unknowns": ["x"]}, ["rank_a_unknowns_present"])]
    names = sorted(base)
    arrays = {"unknowns", "cannot_support_categories", "source_urls", "origin_evidence_roles"}
    schema = ", ".join(f"{n} {'array<string>' if n in arrays else 'string'}" for n in names)
    df = spark.createDataFrame([tuple((base | c | {"hypothesis_id": str(i)})[n] for n in names) for i, (c, _) in enumerate(cases)], schema)
    got = {}
    for r in research.hypothesis_findings(df).collect():
        got.setdefault(int(r.record_id), []).append(r.code)
    assert {i: sorted(v) for i, v in got.items()} == {i: want for i, (_, want) in enumerate(cases) if want}
    assert research.rank_counts(df).first().asDict() == {"A": 6, "B": 1, "C": 0, "D": 0}


def test_scenario_and_citations(spark):
    from evispark.operators import research

    schema = "scenario_id string, id string, role string, low double, high double, evidence_level string, independence string, source_url string"
    factors = spark.createDataFrame([("s", "f1", "share", 0.0001, 0.01, "assumption", "independent", "https://x"), ("s", "f2", "event_presence", 0.1, 2.0, "observed", "overlapping", "http://x")], schema)
    r = research.scenario(10.0, 20.0, factors).first()
    assert (r.display_low, r.display_high, r.warnings) == (0, 1, "f1 is an assumption; f2 may overlap other factors") and abs(r.high - 0.4) < 1e-12
    assert sorted(r.code for r in research.factor_findings(factors).collect()) == ["interval_invalid", "role_prohibited", "source_url_missing"]
    sources = spark.createDataFrame([("u", "h", "some  long\ntext")], "source_url string, source_sha256 string, text string")
    citations = spark.createDataFrame([("1", "u", "h", "long text", "r"), ("2", "u", "x", "long", "r"), ("3", "u", "h", "other", "r"), ("4", "u", "h", "some", None)], "citation_id string, source_url string, source_sha256 string, excerpt string, rationale string")
    assert sorted((r.record_id, r.code) for r in research.citation_findings(citations, sources).collect()) == [("2", "source_not_registered"), ("3", "excerpt_not_in_source"), ("4", "excerpt_missing")]
    ranges = spark.createDataFrame([("c", "x", 1900, 1910), ("c", "y", 1905, 1920)], "convention string, label string, start_year int, end_year int")
    assert sorted(r.label for r in research.generation_matches(spark.createDataFrame([(1, 1907)], "p int, y int"), "y", ranges).collect()) == ["x", "y"]
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "url string")
    assert sorted(map(tuple, research.coverage(keys("a", "b", "b", "z"), keys("a", "b", "c"), "url").collect())) == [("b", "repeated"), ("c", "missing"), ("z", "unexpected")]
    texts = spark.createDataFrame([("p/Secret.txt", "fine"), ("q.txt", "a Codename here")], "path string, text string")
    assert sorted(map(tuple, research.forbidden_terms(texts, texts, ["codename", "secret"]).collect())) == [("path", "p/Secret.txt", "secret"), ("text", "q.txt", "codename")]


def test_batch_executor(spark, tmp_path):
    from evispark.plans.executor import Adapter, ProviderError, run_batch

    df = spark.createDataFrame([(f"q{i}", "web" if i else "off", f"x{i}", i % 2, 0) for i in range(6)], "query_id string, provider string, query string, priority int, source_priority int")
    calls = []

    def search(q):
        calls.append(q)
        if q in ("x1", "x3", "x5"):
            raise ProviderError("rate")
        return [] if q == "x4" else [{"url": "u"}]

    web = {"web": Adapter(search, "https://terms", True, 1, 0.0)}
    state = run_batch(df, web, str(tmp_path / "c.json"), limit=4)
    assert calls == ["x2", "x4", "x1"] and {k: v["status"] for k, v in state.items()} == {"q0": "manual_followup", "q2": "searched", "q4": "not_found", "q1": "failed"}
    state = run_batch(df, web, str(tmp_path / "c.json"), limit=9)
    assert calls[3:] == ["x3", "x5"] and state["q5"]["halt"] == "three_failures"
    assert run_batch(df, web, str(tmp_path / "c.json")) == state and len(calls) == 5
    assert {r["status"] for r in run_batch(df, {}, str(tmp_path / "d.json"), dry_run=True).values()} == {"dry_run"} and not (tmp_path / "d.json").exists()


def test_json_walk(spark):
    from evispark.sources.json_walk import secret_paths, walk

    df = spark.createDataFrame([(1, '{"a": [{"userPassword": "x"}, "t"], "apiKeys": 1, "api_key": 2}'), (2, "{")], "id int, body string")
    walked = walk(df, "id", "body")
    assert sorted((r.key, r.path) for r in secret_paths(walked).collect()) == [("1", "a[0].userPassword"), ("1", "api_key")]
    assert [r.text for r in walked.where("path = 'a[1]'").collect()] == ["t"] and walked.where("path is null").count() == 1


def test_command_line(spark, tmp_path):
    from evispark.cli import main

    (tmp_path / "paths.txt").write_text("ok.py\nsecret/.env\nscan.pdf\n")
    assert main(["privacy-audit", str(tmp_path / "paths.txt"), str(tmp_path / "out"), "--strict"], spark) == 1
    assert sorted(r.rule for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["media_or_document_file", "secret_or_environment_file"]
    (tmp_path / "t.ged").write_text(GED)
    assert main(["parse-gedcom", str(tmp_path / "t.ged"), str(tmp_path / "people")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "people")).count() == 3
    assert main(["nothing"], spark) == 2


def test_award_groups_and_publication(spark):
    from evispark.operators import publish

    members = spark.createDataFrame([("a", "exact_below"), ("a", "bounded_below"), ("b", "exact_below"), ("b", "possible_above"), ("c", "exact_below")], "award_id string, status string")
    groups = spark.createDataFrame([("a", False), ("b", False), ("c", True), ("d", False)], "award_id string, open boolean")
    assert {r.award_id: r.fully_excluded for r in awards.award_status(groups, members).collect()} == {"a": True, "b": False, "c": False, "d": False}
    day = datetime.date(2000, 5, 1)
    screen = spark.createDataFrame([(day, 40, 5), (day, 40, 4), (day, 95, 5)], "as_of date, stated_age int, tolerance int")
    assert [r.screened for r in awards.group_screen(screen, 107_307, "2026-10-22").collect()] == [True, False, False]
    plans = awards.finder_plans(spark.createDataFrame([("p", "A B")], "person_id string, name string"), [1940, 1950], [("f", "https://x.org/?n={name}&y={year}")])
    assert sorted(r.url for r in plans.collect()) == ["https://x.org/?n=A+B&y=1940", "https://x.org/?n=A+B&y=1950"]
    df = spark.createDataFrame([("a/x.pdf", "x.pdf", None, "document", "public_ok", "h", "confirmed"), ("private/y.pdf", "y.pdf", "I", "document", "public_ok", "h", "confirmed"), ("z.pdf", "z.pdf", None, "document", None, "h", "confirmed")], "relative_path string, filename string, artifact_id string, file_category string, privacy_label string, sha256 string, source_confidence string")
    assert [r.title for r in publish.static_site_rows(df).collect()] == ["x.pdf"]
    assert [r.payload.title for r in publish.bibliography_items(df).collect()] == ["x.pdf", "I", "z.pdf"]


def test_gedcom_below_level_nine(spark, tmp_path):
    from evispark.sources.gedcom import assembled, read_nodes

    (tmp_path / "deep.ged").write_text("\n".join(["0 @I1@ INDI", *[f"{i} NOTE n{i}" for i in range(1, 13)], "13 CONT more"]))
    nodes = read_nodes(spark, str(tmp_path / "deep.ged"))
    assert [(r.level, r.parent) for r in nodes.orderBy("n").collect()] == [(0, None), *[(i, i - 1) for i in range(1, 14)]]
    assert {r.level: r.value for r in assembled(nodes).collect()}[12] == "n12\nmore"
