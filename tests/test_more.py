"""Folders, containers and edge cases of the operators in queries_more."""

import io
import json
import math
import subprocess
import zipfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evispark.functions import html, text
from evispark.operators import evidence, genome, keyed, linking, validators
from evispark.queries import QUERIES
from evispark.sources import stores


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('﻿{"packet_default_profile": "public", "other": 1}', "utf-8")
    found = stores.load_config(str(tmp_path / "c.json"))
    assert found.packet_default_profile == "public" and found.excluded_directory_names == [".git", "__pycache__"]
    (tmp_path / "c.json").write_text("[]")
    with pytest.raises(ValueError):
        stores.load_config(str(tmp_path / "c.json"))
    with pytest.raises(FileNotFoundError):
        stores.load_config(str(tmp_path / "none.json"))


def test_evidence_folder_and_import(spark, tmp_path):
    for name, body in (("b.evidence.json", {"envelope_id": "b"}), ("a.evidence.json", {"envelope_id": "a"}), ("c.json", {"envelope_id": "c"})):
        (tmp_path / name).write_text(json.dumps(body))
    rows = stores.read_evidence(spark, str(tmp_path), "envelope_id string")
    assert sorted(map(tuple, rows.select("file", "envelope_id").collect())) == [("a.evidence.json", "a"), ("b.evidence.json", "b")]
    checked = rows.withColumn("errors", F.when(F.col("envelope_id") == "b", "bad").otherwise(""))
    assert stores.import_envelopes(checked, str(tmp_path / "private"), str(tmp_path / "public"), F.lit("withheld")) == 1
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "public")).select("envelope_id", "preview").collect()] == [("a", "withheld")]


def test_tracked_paths_and_inventory(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / "sub").mkdir(parents=True)
    (repo / "sub" / "a.HTML").write_text("<title>T</title><link rel='canonical' href='https://x.org/'>a")
    (repo / "b.bin").write_text("b")
    assert [r.path for r in stores.tracked_paths(spark, str(repo)).collect()] == ["b.bin", "sub/a.HTML"]
    subprocess.run(["git", "init", "-q"], cwd=repo, check=True)
    subprocess.run(["git", "add", "b.bin"], cwd=repo, check=True)
    assert [r.path for r in stores.tracked_paths(spark, str(repo)).collect()] == ["b.bin"]
    (tmp_path / "secret.pdf").write_text("s")
    (repo / "link.pdf").symlink_to(tmp_path / "secret.pdf")
    (repo / ".scan.PNG").write_text("png")
    (repo / "notes.txt").write_text("not a type of the inventory")
    found, receipts = stores.private_inventory(spark, {"r": str(repo), "none": str(tmp_path / "none")})
    rows = {r.relative_path: r for r in found.collect()}
    assert sorted(rows) == [".scan.PNG", "sub/a.HTML"] and {r.privacy_label for r in rows.values()} == {"do_not_share"}
    assert (rows["sub/a.HTML"].extracted_text, rows["sub/a.HTML"].source_url_hints, rows[".scan.PNG"].extracted_text) == ("T a", ["https://x.org/"], None)
    assert rows[".scan.PNG"].artifact_id == rows[".scan.PNG"].sha256[:24] and rows[".scan.PNG"].format == ".png"
    assert sorted(map(tuple, receipts.collect())) == [("none", "FileNotFoundError"), ("r", "inventoried")]


def test_workbook(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    parts = {
        "xl/workbook.xml": f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {main}><si><t>shared</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>1</v></c></row><row><c r="A2"><v>1.5</v></c><c r="B2" t="b"><v>1</v></c><c r="C2" t="inlineStr"><is><t>in</t></is></c><c r="D2"/></row></sheetData></worksheet>',
    }
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    rows = stores.workbook_cells(spark.createDataFrame([("w.xlsx", bytearray(body.getvalue()))], "path string, content binary"))
    assert sorted(map(tuple, rows.drop("path", "sheet").collect())) == [(1, 1, "shared", "text"), (1, 28, "rich", "text"), (2, 1, "1.5", "number"), (2, 2, "true", "boolean"), (2, 3, "in", "text")]


def test_whitelist_and_header(spark, tmp_path):
    (tmp_path / "w.json").write_text('[{"rsid": "RS9 ", "gene": "g"}, {"rsid": "rs1"}]')
    assert [(r.rsid, r.public_summary_allowed) for r in genome.read_whitelist(spark, str(tmp_path / "w.json")).collect()] == [("rs1", False), ("RS9", False)]
    (tmp_path / "w.json").write_text('[{"rsid": " "}]')
    with pytest.raises(Exception, match="rsid"):
        genome.read_whitelist(spark, str(tmp_path / "w.json")).collect()
    lines = spark.createDataFrame([(["RSID", "Chromosome", "position", "allele1", "allele2"],), (["rsid", "position"],), (None,)], "f array<string>")
    assert [r[0] for r in lines.select(genome.is_header(F.col("f"))).collect()] == [True, False, False]


def test_long_chain_of_origins_is_one_group(spark):
    rows = [(f"k{i:04d}", f"o{i}", f"o{i + 1}") for i in range(300)] + [("single", None, " ")]
    df = spark.createDataFrame(rows, "id string, a string, b string")
    got = {r.id: r.group_id for r in evidence.shared_origin_groups(df, "id", [F.col("a"), F.col("b")]).collect()}
    assert got.pop("single") == "single" and set(got.values()) == {"k0000"} and len(got) == 300


def test_token_subset_edges(spark):
    left = spark.createDataFrame([(1, "Ann Beta x"), (2, None), (3, "beta")], "l int, t string")
    right = spark.createDataFrame([("p", "ann beta"), ("q", "beta beta"), ("none", ""), ("r", "ann zeta")], "r string, t string")
    got = sorted(map(tuple, linking.token_subset(left, "l", F.col("t"), right, "r", F.col("t")).collect()))
    assert got == [(1, 2, None, "ambiguous"), (2, 0, None, "unmatched"), (3, 1, "q", "probable")]


def test_context_ties_and_unprefixed(spark):
    members = spark.createDataFrame([("d/A.zip", "x/y/z.jpg"), ("d/b.zip", "q.jpg")], "zip_path string, member_path string")
    contexts = spark.createDataFrame([(0, "", None), (1, "X\\y", None), (2, "x/y/", None), (3, "x/y/z", "b.zip")], "ord int, member_prefix string, zip_filename string")
    assert {r.member_path: r.context for r in keyed.context_match(members, contexts).collect()} == {"x/y/z.jpg": 1, "q.jpg": 0}


def test_page_and_birth_edges(spark):
    df = spark.createDataFrame([(None,), ("",)], "h string")
    assert [r[0] for r in df.select(html.page_text(F.col("h"))).collect()][0] is None
    said = spark.createDataFrame([(None, "A B", None), ("was born in 1990 and honored", "", 1990), ("B, born 1990 ", "A B", 1990)], "t string, n string, y int")
    got = [r[0] for r in said.select(html.birth_statement("t", "n", "y")).collect()]
    assert got[0] is None and got[1].birth_year == 1990 and got[2] is None
    assert [r[0] for r in spark.createDataFrame([("[1",), (None,), ('["", "a"]',)], "n string").select(text.notes_list(F.col("n"))).collect()] == [["[1"], [], ["a"]]


def test_receipts_are_parsed_once(spark):
    df = validators.receipt_errors(spark.createDataFrame([("{}",)], "payload string"), "payload", "p", "s.v1", "b.v1")
    assert df.columns == ["payload", "errors"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_last_links_are_fetched_by_place(spark):
    schema = "relative_path string, local_path string, artifact_id string, person_id string, person_slug string, gedcom_id string, privacy_label string, source_confidence string, notes string, ord long"
    records = spark.createDataFrame([("a", None, "X", "p", None, None, label, "c", "n", i) for i, label in ((1, "one"), (2, "two"), (2, "ten"))], schema)
    found = keyed.explicit_links(records, spark.createDataFrame([("p", "g")], "person_id string, gedcom_id string"), "ord")
    assert sorted((r.key, r.privacy_label) for r in found.collect()) == [("artifact:X", "two"), ("path:a", "two")]
    assert "max_by" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_products_in_the_order_of_the_file_however_it_is_split(spark, tmp_path):
    lines = pq.read_table("/root/testdata/sf0.01/lineitem.parquet", columns=["l_orderkey", "l_discount", "l_tax"])
    pq.write_table(lines, tmp_path / "lineitem.parquet", row_group_size=2000)
    want: dict = {}
    for key, discount, tax in zip(*(c.to_pylist() for c in lines.columns)):
        high, low = want.get(key, (1.0, 1.0))
        want[key] = high * (1 - discount), low * (1 - discount - tax / 2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        got = QUERIES["interval_product"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.l_orderkey: (r.high, r.low) for r in got} == {k: tuple(math.floor(1e6 * x + 0.5) for x in v) for k, v in want.items()} and len(got) == len(want)
