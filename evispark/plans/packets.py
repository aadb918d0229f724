"""Packets of all people at once: Markdown lines keyed by person, and the rows of their source lists.

A line carries its place (section, part, key, n), so each kind of line is made where its data lie:
from people alone without a shuffle, from families by a join on the record id, from linked
artifacts by a join on the path. Only what a whole packet must know of its artifacts (how many,
which labels) is aggregated by person, with partial sums before the shuffle. Nothing is gathered
per person: a person with very many links is many rows, and writing sorts by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fact
from ..operators.policy import effective_label, is_raw_dna, packet_keeps

#: Profiles, headings in order, and the sentences of packets.
PROFILES = {"private_full": "private_full", "expert_review_packet": "expert_review", "public_redacted": "public"}
SECTIONS = ["title", "Identity/Facts Table", "Relationship Summary", "Timeline", "Sources", "Linked Media/Artifacts", "Confidence Labels", "Privacy/Share Status", "Open Questions", "Citation-Ready Notes", "Audit Notes"]
EXPERT_NOTE = "> Expert review packet: do not publish or redistribute without explicit human review."
SUMMARY = "This packet summarizes locally supplied records for %s. Identity details are family-identified as supplied in the local person index. Birth: %s. Death: %s."
RELATED = "Relationships are listed only when represented by local GEDCOM family links."
NO_RELATED = "- No explicit family links were found in the supplied family index."
NO_TIMELINE = "| Pending review | No dated timeline facts supplied. |"
NO_SOURCES = "- No linked sources are available for this packet profile."
MEDIA = "Artifacts are family-identified as linked to this person. Any apparent date stamp remains pending scan verification."
NO_MEDIA = "- No linked media or artifacts are available for this profile."
KEPT_LABELS = "- Labels are preserved from local metadata and are not upgraded automatically."
REVIEW = "- Review this packet before sharing outside the intended privacy context."
ASK_LINKS = "- Confirm whether additional source artifacts should be linked."
ASK_LIVING = "- Confirm living-person status before any public sharing."
ASK_PUBLIC = "- Confirm all public facts are safe summaries and not private notes."
ASK_ALWAYS = ["- Verify apparent date stamp details against source scans.", "- Resolve any pending scan verification items before citation use."]
NO_CITATIONS = "- No citation candidates are available for this profile."
CITED = "- `%s`: family-identified as source/media; apparent date stamp pending scan verification; SHA-256 `%s`."
AUDIT = [
    "- Generated from local %s JSON metadata only.", "- Source files are not copied into packets in v0.6.",
    "- No network calls, crawling, WARC replay, login automation, or access-control bypassing.",
    "- No medical, genetic-deterministic, institutional endorsement, or validation claims.",
    "- PDF output is not generated automatically; convert Markdown manually after review if needed.",
]
#: Name of the program that the audit notes give as the source of the metadata.
PRODUCT = "archive"
CITATION_NOTE = "Citation-ready notes require human review before publication."

PEOPLE = {"person_id": "string", "gedcom_id": "string", "display_name": "string", "given_name": "string", "surname": "string", "birth_date": "string", "birth_place": "string", "death_date": "string", "death_place": "string", "notes": "array<string>", "privacy_label": "string", "is_potentially_living": "boolean"}
FAMILIES = {"gedcom_id": "string", "spouse_ids": "array<string>", "child_ids": "array<string>", "marriage_date": "string", "marriage_place": "string"}
LINKS = {"person_id": "string", "relative_path": "string", "privacy_label": "string", "source_confidence": "string", "match_method": "string", "match_confidence": "string"}
MANIFEST = {"relative_path": "string", "filename": "string", "artifact_id": "string", "file_category": "string", "privacy_label": "string", "source_confidence": "string", "sha256": "string"}


def _columns(df: DataFrame, wanted: dict[str, str], prefix: str = "") -> list[Column]:
    """The wanted columns by type, null where ``df`` has none."""
    return [(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(prefix + c) for c, kind in wanted.items()]


def _line(section: int, part: int, text: Column | str, key: Column | str = "", n: int = 0) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(section).alias("section"), F.lit(part).alias("part"), lit(key).alias("key"), F.lit(n).alias("n"), lit(text).alias("line"))


def _exploded(rows: DataFrame, *lines: Column) -> DataFrame:
    return rows.select("person_id", F.explode(F.array(*lines)).alias("x")).select("person_id", "x.*").where("line is not null")


def _or(value: Column, other: str) -> Column:
    """The value, or ``other`` where it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(other))


def shown_people(people: DataFrame, profile: str) -> DataFrame:
    """People with a packet: one row per id (the last by ``ordinal``, if there is one); a public
    packet of someone who may be living is refused, so those have none. Null ids have none."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile}; expected one of {', '.join(sorted(PROFILES))}")
    rows = people.select(*_columns(people, PEOPLE), *([F.col("ordinal")] if "ordinal" in people.columns else [])).where("person_id is not null and person_id <> ''")
    order = F.struct("ordinal", *(c for c in PEOPLE if c != "person_id")) if "ordinal" in people.columns else F.struct(*(c for c in PEOPLE if c != "person_id"))
    rows = rows.groupBy("person_id").agg(F.max_by(F.struct(*(c for c in PEOPLE if c != "person_id")), order).alias("p")).select("person_id", "p.*")
    return rows.where("is_potentially_living is not true") if PROFILES[profile] == "public" else rows


def linked_artifacts(people: DataFrame, links: DataFrame, manifest: DataFrame, profile: str) -> DataFrame:
    """Links of the people with a packet whose artifacts the profile shows, with the manifest's columns
    under ``m_``, ``label`` and ``confidence`` (the link's, else the manifest's). Paths are unique in a
    manifest; of repeated ones the largest row counts."""
    m = manifest.select(*_columns(manifest, MANIFEST, "m_")).groupBy("m_relative_path").agg(F.max(F.struct(*(f"m_{c}" for c in MANIFEST if c != "relative_path"))).alias("m")).select("m_relative_path", "m.*")
    rows = links.select(*_columns(links, LINKS)).join(people.select("person_id"), "person_id", "left_semi")
    rows = rows.join(m, F.col("relative_path") == F.col("m_relative_path"), "left")
    raw = is_raw_dna(F.col("m_relative_path"), F.col("m_filename"), F.col("m_artifact_id"))
    rows = rows.where(packet_keeps(effective_label(F.col("privacy_label"), F.col("m_privacy_label")), raw, PROFILES[profile]))
    either = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.nullif(F.col(f"m_{c}"), F.lit("")))
    return rows.withColumns({"label": either("privacy_label"), "confidence": either("source_confidence")})


def packet_lines(people: DataFrame, families: DataFrame, links: DataFrame, manifest: DataFrame, profile: str = "private_full", citation_note: str = CITATION_NOTE, product: str = PRODUCT) -> DataFrame:
    """(person_id, section, part, key, n, line): every line of every packet, in the order of the
    place columns; lines that tie in all of them are equal up to their text.

    Relations are listed by family record; artifacts by path, once for each link. Missing columns
    count as null. Empty tables of families, links or manifest give packets without those lines.
    """
    shown = shown_people(people, profile)
    living = F.coalesce("is_potentially_living", F.lit(False))
    public = PROFILES[profile] == "public"
    name = F.coalesce(F.nullif("display_name", F.lit("")), F.col("person_id"))
    birth, death = (F.coalesce(fact(F.col(f"{k}_date"), F.col(f"{k}_place")), F.lit("Unknown")) for k in ("birth", "death"))
    notes = F.lit("Redacted for public profile.") if public else _or(F.array_join(F.coalesce("notes", F.array().cast("array<string>")), "; "), "None")
    life = F.when(living, F.lit("true")).otherwise(F.lit("false"))
    table = [("Person ID", F.format_string("`%s`", "person_id")), ("GEDCOM ID", F.format_string("`%s`", F.coalesce("gedcom_id", F.lit("")))), ("Display name", name), ("Given name", _or(F.col("given_name"), "Unknown")), ("Surname", _or(F.col("surname"), "Unknown")), ("Birth", birth), ("Death", death), ("Potentially living", F.format_string("`%s`", life)), ("Notes", notes)]
    head = [F.concat(F.lit("# Research Packet: "), name), "", "## Summary", "", F.format_string(SUMMARY, name, birth, death), ""]
    head += [EXPERT_NOTE, ""] if profile == "expert_review_packet" else []
    fixed = [_line(0, 0, text, n=i) for i, text in enumerate(head)]
    opening = {
        1: ["| Field | Value |", "| --- | --- |", *[F.format_string(f"| {field} | %s |", value) for field, value in table]],
        2: [RELATED, ""],
        3: ["| Event | Details |", "| --- | --- |", *[F.when(value != "Unknown", F.format_string(f"| {field} | %s |", value)) for field, value in (("Birth", birth), ("Death", death))]],
        5: [MEDIA, ""],
        6: [F.format_string("- Person privacy label: `%s`", F.coalesce("privacy_label", F.lit("private_family_only")))],
        7: [f"- Packet profile: `{profile}`", F.format_string("- Potentially living: `%s`", life)],
        8: [],
        9: [citation_note, ""],
        10: [AUDIT[0] % product, *AUDIT[1:], f"- Profile policy applied: `{profile}`."],
    }
    for s in range(1, len(SECTIONS)):
        fixed += [_line(s, 0, text, n=i) for i, text in enumerate([f"## {SECTIONS[s]}", "", *opening.get(s, [])])]
        fixed += [_line(s, 2, "")]
    out = _exploded(shown, *fixed)

    artifacts = linked_artifacts(shown, links, manifest, profile)
    path = F.coalesce("relative_path", F.lit("None"))
    out = out.unionByName(_exploded(
        artifacts,
        _line(4, 1, F.format_string("- `%s` (%s)", path, F.coalesce("confidence", F.lit("None"))), path),
        _line(5, 1, F.format_string("- `%s` | artifact `%s` | privacy `%s`", path, _or(F.col("m_artifact_id"), "unknown"), F.coalesce("label", F.lit("None"))), path),
        _line(9, 1, F.format_string(CITED, path, F.coalesce("m_sha256", F.lit(""))), path),
    ))

    known = artifacts.groupBy("person_id").agg(F.count("*").alias("n_links"), F.array_sort(F.collect_set("label")).alias("labels"), F.array_sort(F.collect_set("confidence")).alias("confidences"))
    whole = shown.join(known, "person_id", "left")
    none = F.col("n_links").isNull()
    quoted = lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.concat(F.lit("`"), F.array_join(c, "`, `"), F.lit("`"))).otherwise(F.lit("`none`"))
    asked = [F.when(none, F.lit(ASK_LINKS)), F.when(living, F.lit(ASK_LIVING)), F.when(F.lit(public), F.lit(ASK_PUBLIC)), *ASK_ALWAYS]
    out = out.unionByName(_exploded(
        whole,
        *[_line(s, 1, F.when(none, F.lit(text))) for s, text in ((4, NO_SOURCES), (5, NO_MEDIA), (9, NO_CITATIONS))],
        _line(6, 1, F.concat(F.lit("- Source confidence labels in packet: "), quoted("confidences"))), _line(6, 1, KEPT_LABELS, n=1),
        _line(7, 1, F.concat(F.lit("- Artifact privacy labels in packet: "), quoted("labels"))), _line(7, 1, REVIEW, n=1),
        *[_line(8, 1, text, n=i) for i, text in enumerate(asked)],
    ))
    return out.unionByName(_family_lines(shown, families, birth, death))


def _family_lines(shown: DataFrame, families: DataFrame, birth: Column, death: Column) -> DataFrame:
    fam = families.withColumn("gedcom_id", F.coalesce(*(F.col(c) for c in ("gedcom_id", "family_id") if c in families.columns)))
    if "spouse_ids" not in fam.columns:
        fam = fam.withColumn("spouse_ids", F.array_distinct(F.array_compact(F.array("husband_id", "wife_id"))))
    fam = fam.select(*_columns(fam, FAMILIES)).withColumnRenamed("gedcom_id", "fam")
    ids = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    ends = F.concat(
        F.transform(F.array_distinct(ids("spouse_ids")), lambda i: F.struct(i.alias("member"), F.lit(0).alias("role"), ids("child_ids").alias("others"))),
        F.transform(F.array_distinct(ids("child_ids")), lambda i: F.struct(i.alias("member"), F.lit(1).alias("role"), ids("spouse_ids").alias("others"))),
    )
    married = fact(F.col("marriage_date"), F.col("marriage_place"))
    ends = fam.select("fam", married.alias("married"), F.explode(ends).alias("e")).select("fam", "married", "e.*")
    me = shown.select("person_id", F.coalesce(F.nullif("gedcom_id", F.lit("")), F.col("person_id")).alias("member"), F.coalesce(F.col("gedcom_id") == F.coalesce(F.nullif("gedcom_id", F.lit("")), F.col("person_id")), F.lit(False)).alias("by_record"))
    mine = ends.join(me, "member")
    others = F.coalesce(F.nullif(F.array_join("others", ", "), F.lit("")), F.lit("None"))
    fam_id = F.coalesce("fam", F.lit("None"))
    relation = F.when(F.col("role") == 0, F.format_string("- Spouse family `%s` with children: %s.", fam_id, others)).otherwise(F.format_string("- Child in family `%s` with parents/spouses: %s.", fam_id, others))
    wedding = F.when((F.col("role") == 0) & F.col("by_record"), F.format_string("| Marriage | %s |", F.col("married")))
    wedding = F.when(F.col("married").isNotNull(), wedding)
    rows = mine.select("person_id", F.concat(fam_id, F.col("role").cast("string")).alias("key"), relation.alias("relation"), wedding.alias("wedding"))
    out = _exploded(rows, _line(2, 1, F.col("relation"), F.col("key")), _line(3, 1, F.col("wedding"), F.col("key")))
    counts = rows.groupBy("person_id").agg(F.count("relation").alias("relations"), F.count("wedding").alias("weddings"))
    bare = shown.select("person_id", ((birth == "Unknown") & (death == "Unknown")).alias("undated")).join(counts, "person_id", "left")
    no_weddings = F.coalesce("weddings", F.lit(0)) == 0
    return out.unionByName(_exploded(bare, _line(2, 1, F.when(F.col("relations").isNull(), F.lit(NO_RELATED))), _line(3, 1, F.when(F.col("undated") & no_weddings, F.lit(NO_TIMELINE)))))


def packet_sources(people: DataFrame, links: DataFrame, manifest: DataFrame, profile: str = "private_full", citation_note: str = CITATION_NOTE) -> DataFrame:
    """Rows of every packet's source list, keyed by person."""
    rows = linked_artifacts(shown_people(people, profile), links, manifest, profile)
    return rows.select("person_id", "relative_path", F.col("m_artifact_id").alias("artifact_id"), F.col("m_file_category").alias("file_category"), F.col("label").alias("privacy_label"), F.col("confidence").alias("source_confidence"), "match_method", "match_confidence", F.lit(citation_note).alias("citation_note"))


def write_packets(lines: DataFrame, path: str, files: int | None = None) -> None:
    """Write the lines as Parquet in packet order: ranges of people, split within a person where one
    has very many lines, so that a packet is read by one range scan. Without ``files`` their number
    follows the data."""
    place = ["person_id", "section", "part", "key", "n", "line"]
    ranged = lines.repartitionByRange(files, *place) if files else lines.repartitionByRange(*place)
    ranged.sortWithinPartitions(*place).write.mode("overwrite").parquet(path)


def markdown(lines: DataFrame, person_id: str) -> str:
    """The text of one person's packet."""
    rows = lines.where(F.col("person_id") == person_id).orderBy("section", "part", "key", "n", "line").select("line")
    text = "\n".join(r.line for r in rows.toLocalIterator()).rstrip()
    if not text:
        raise ValueError(f"{person_id} has no packet in this profile")
    return text + "\n"
