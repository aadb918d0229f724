"""Packets of all people on a small archive: profiles, refusals, one person against all, hot people."""

import pytest
from pyspark.sql import functions as F

from evispark.plans import packets


@pytest.fixture(scope="module")
def archive(spark):
    people = spark.createDataFrame(
        [("john", "I1", "John Smith", "John", "Smith", "1900", "Example City", "1980", None, ["Private note"], "private_family_only", False), ("jane", "I2", "Jane Smith", None, None, None, None, None, None, [], None, None), ("child", "I3", "Living Child", "Living", "Child", "1990", None, None, None, ["Sensitive"], "private_family_only", True)],
        "person_id string, gedcom_id string, display_name string, given_name string, surname string, birth_date string, birth_place string, death_date string, death_place string, notes array<string>, privacy_label string, is_potentially_living boolean",
    )
    families = spark.createDataFrame([("F1", ["I1", "I2"], ["I3"], "14 FEB 1925", "Example City")], "gedcom_id string, spouse_ids array<string>, child_ids array<string>, marriage_date string, marriage_place string")
    labels = {"public/photo.jpg": "public_ok", "private/letter.md": "private_family_only", "expert/review.pdf": "expert_review_only", "private/do-not-share.txt": "do_not_share", "sensitive/raw-dna-export.txt": "raw_dna_never_export"}
    manifest = spark.createDataFrame([(p, p.split("/")[1], f"A{i}", "document", label, "needs_review", f"sha{i}") for i, (p, label) in enumerate(labels.items())], "relative_path string, filename string, artifact_id string, file_category string, privacy_label string, source_confidence string, sha256 string")
    links = spark.createDataFrame([("john", p, label, "family_identified" if i == 0 else None, "manual_config", "confirmed") for i, (p, label) in enumerate(labels.items())] + [("nobody", "public/photo.jpg", None, None, None, None)], "person_id string, relative_path string, privacy_label string, source_confidence string, match_method string, match_confidence string")
    return people, families, links, manifest


def test_private_packet(archive):
    people, families, links, manifest = archive
    text = packets.markdown(packets.packet_lines(*archive), "john")
    assert [line for line in text.split("\n") if line.startswith("#")] == ["# Research Packet: John Smith", "## Summary", *[f"## {s}" for s in packets.SECTIONS[1:]]]
    for line in ["| Notes | Private note |", "- Spouse family `F1` with children: I3.", "| Marriage | 14 FEB 1925, Example City |", "- `private/letter.md` (needs_review)", "- Source confidence labels in packet: `family_identified`, `needs_review`", "- `public/photo.jpg` | artifact `A0` | privacy `public_ok`"]:
        assert line in text.split("\n"), line
    assert "raw-dna" not in text and "do-not-share" in text and "Expert review packet" not in text
    assert text.index("expert/review.pdf") < text.index("private/do-not-share.txt") < text.index("public/photo.jpg")
    rows = packets.packet_sources(people, links, manifest, citation_note="Note.").collect()
    assert len(rows) == 4 and {(r.person_id, r.citation_note) for r in rows} == {("john", "Note.")}


def test_public_and_expert_profiles(archive):
    public = packets.packet_lines(*archive, "public_redacted")
    text = packets.markdown(public, "john")
    assert "public/photo.jpg" in text and "Private note" not in text and "letter" not in text and "Redacted for public profile." in text
    assert {r.person_id for r in public.select("person_id").distinct().collect()} == {"john", "jane"}
    with pytest.raises(ValueError, match="child"):
        packets.markdown(public, "child")
    expert = packets.markdown(packets.packet_lines(*archive, "expert_review_packet"), "john")
    assert packets.EXPERT_NOTE in expert and "expert/review.pdf" in expert and "letter" not in expert
    with pytest.raises(ValueError, match="unknown profile"):
        packets.packet_lines(*archive, "loud")


def test_one_person_alone_has_the_same_lines(archive):
    people, families, links, manifest = archive
    whole = packets.packet_lines(*archive)
    for person in ("john", "jane", "child"):
        alone = packets.packet_lines(people.where(F.col("person_id") == person), families, links, manifest)
        assert sorted(alone.collect()) == sorted(whole.where(F.col("person_id") == person).collect())


def test_without_families_links_and_facts(spark, archive):
    people, families, links, manifest = archive
    text = packets.markdown(packets.packet_lines(people, families.limit(0), links.limit(0), manifest.limit(0)), "jane")
    for line in [packets.NO_RELATED, packets.NO_TIMELINE, packets.NO_SOURCES, packets.NO_MEDIA, packets.NO_CITATIONS, packets.ASK_LINKS, "- Artifact privacy labels in packet: `none`", "| Given name | Unknown |", "| GEDCOM ID | `I2` |"]:
        assert line in text.split("\n"), line
    bare = spark.createDataFrame([("x",), ("x",), (None,), ("",)], "person_id string")
    lines = packets.packet_lines(bare, families.select("gedcom_id", "spouse_ids"), links, manifest)
    assert {r.person_id for r in lines.collect()} == {"x"} and lines.where("line like '# %'").count() == 1
    assert packets.packet_lines(bare.limit(0), families, links, manifest).count() == 0


def test_a_hot_person_is_written_in_order_over_several_files(spark, archive, tmp_path):
    people, families, links, manifest = archive
    many = spark.range(3000).select(F.lit("john").alias("person_id"), F.format_string("f/%05d.txt", "id").alias("relative_path"), F.lit("public_ok").alias("privacy_label"))
    packets.write_packets(packets.packet_lines(people, families, many, manifest), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.where("person_id = 'john' and section = 4 and part = 1").count() == 3000
    assert back.select(F.input_file_name()).distinct().count() > 1
    assert packets.markdown(back, "john").count("f/00017.txt") == 3
