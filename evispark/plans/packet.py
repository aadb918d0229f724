"""Person packets: section rows assembled from people, families, links and the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fact
from ..operators.picks import last_wins
from ..operators.policy import effective_label, export_decision, is_raw_dna, packet_keeps


def export_rows(manifest: DataFrame, links: DataFrame, people: DataFrame, profile: str) -> DataFrame:
    """Manifest, last link of each path and person, with the export decision of the profile.

    ``links`` has ``ordinal``; the label and names of links are prefixed ``link_``.
    """
    last = last_wins(links, ["relative_path"], "ordinal").select("relative_path", "person_id", F.col("privacy_label").alias("link_label"), F.col("match_confidence").alias("link_confidence"))
    rows = manifest.join(last, "relative_path", "left").join(people.select("person_id", "display_name", "is_potentially_living"), "person_id", "left")
    label = effective_label(F.col("link_label"), F.col("privacy_label"))
    living = F.when(F.col("person_id").isNull(), F.lit(False)).otherwise(F.col("is_potentially_living"))
    d = export_decision(label, is_raw_dna(F.col("relative_path"), F.col("filename"), F.col("artifact_id")), living, profile)
    name = F.when((F.lit(profile) == "public") & F.coalesce(living, F.lit(True)), F.lit(None)).otherwise(F.col("display_name"))
    return rows.select("relative_path", "artifact_id", "person_id", name.alias("display_name"), label.alias("privacy_label"), F.coalesce("link_confidence", F.lit("needs_review")).alias("match_confidence"), d["include"].alias("include"), d["reasons"].alias("reasons"))


def packet(person_id: str, people: DataFrame, families: DataFrame, links: DataFrame, manifest: DataFrame, profile: str) -> DataFrame:
    """(section, ord, text) rows of one person's packet; a public packet of a person who may be
    living has no rows."""
    p = people.where(F.col("person_id") == person_id)
    if profile == "public":
        p = p.where(~F.coalesce("is_potentially_living", F.lit(True)))

    def section(df: DataFrame, name: str, order, text) -> DataFrame:
        return df.select(F.lit(name).alias("section"), order.cast("string").alias("ord"), text.alias("text")).where("text is not null")

    out = section(p, "identity", F.lit("0"), F.concat_ws(" | ", "display_name", "sex"))
    for kind in ("birth", "death"):
        out = out.unionByName(section(p, "timeline", F.col(f"{kind}_date"), F.concat(F.lit(f"{kind}: "), fact(F.col(f"{kind}_date"), F.col(f"{kind}_place")))))
    me = p.select(F.col("person_id").alias("me"))
    spouses = F.array_distinct(F.array_compact(F.array("husband_id", "wife_id")))
    as_spouse = families.withColumn("spouse", F.explode(spouses)).join(me, F.col("me") == F.col("spouse"))
    as_child = families.withColumn("child", F.explode("child_ids")).join(me, F.col("me") == F.col("child"))
    out = out.unionByName(section(as_spouse, "timeline", F.col("marriage_date"), F.concat(F.lit("marriage: "), F.col("marriage_date"))))
    out = out.unionByName(section(as_spouse, "relationships", F.col("family_id"), F.concat(F.lit("spouse in "), F.col("family_id"))))
    out = out.unionByName(section(as_child, "relationships", F.col("family_id"), F.concat(F.lit("child in "), F.col("family_id"))))
    mine = links.join(me, F.col("person_id") == F.col("me")).select("relative_path", F.col("privacy_label").alias("link_label"), "match_confidence", "match_method")
    rows = mine.join(manifest.select("relative_path", "filename", "artifact_id", "privacy_label"), "relative_path", "left")
    label = effective_label(F.col("link_label"), F.col("privacy_label"))
    rows = rows.where(packet_keeps(label, is_raw_dna(F.col("relative_path"), F.col("filename"), F.col("artifact_id")), profile)).withColumn("label", label)
    out = out.unionByName(section(rows, "sources", F.col("relative_path"), F.concat_ws(" | ", "relative_path", "match_method", "label")))
    out = out.unionByName(section(rows.select("match_confidence").distinct(), "confidence", F.col("match_confidence"), F.col("match_confidence")))
    return out.unionByName(section(rows.select("label").distinct(), "privacy", F.col("label"), F.col("label")))
