"""GEDCOM text to a flat node table, persons and families."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_name, slug, strip_pointer
from ..operators.levels import chunk_parents

LINE = r"^\s*(\d+)\s+(?:(@[^@]+@)\s+)?(\S+)(?:\s(.*))?$"


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Nodes (file, n, level, pointer, tag, value, parent, rec) of GEDCOM files.

    Files are read by split, so one large file is parsed by many tasks; ``n`` rises over the lines of
    a file and never passes the byte that a line starts at. ``parent`` is the ``n`` of the node above,
    ``rec`` that of the record's first node. A line without level and tag fails the query, as does a
    level over 99. Blank lines are no nodes.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "^\ufeff", "").alias("line"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, count = None, 0
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            n = np.zeros(len(keys), np.int64)
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    if keys[a] != here:  # a later split's first line starts behind its first byte
                        here, count = keys[a], keys[a][1] + (keys[a][1] > 0)
                    n[a:b] = np.arange(count, count + b - a)
                    count += b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n)], ["file", "block", "line", "n"])

    lines = raw.mapInArrow(number, "file string, block long, line string, n long").where("trim(line) <> ''")
    level = F.regexp_extract("line", LINE, 1)
    checked = F.when(level == "", F.raise_error(F.concat(F.lit("not a GEDCOM line: "), F.col("line")))).otherwise(level)
    nodes = lines.select("file", "block", "n", checked.cast("int").alias("level"), strip_pointer(F.nullif(F.regexp_extract("line", LINE, 2), F.lit(""))).alias("pointer"), F.regexp_extract("line", LINE, 3).alias("tag"), F.regexp_extract("line", LINE, 4).alias("value"))
    return chunk_parents(nodes, "file", "block", "n", "level").withColumnRenamed("root", "rec").drop("block")


def assembled(nodes: DataFrame) -> DataFrame:
    """Nodes with CONC and CONT children folded into ``value``.

    CONC puts a space where both joints are letters or digits, CONT a line break.
    """
    parts = nodes.where(F.col("tag").isin("CONC", "CONT")).groupBy("file", F.col("parent").alias("n")).agg(F.array_sort(F.collect_list(F.struct(F.col("n").alias("i"), "tag", "value"))).alias("parts"))
    joint = lambda a, b: F.when(a.rlike(r"[\p{L}\p{N}]$") & b.rlike(r"^[\p{L}\p{N}]"), F.lit(" ")).otherwise(F.lit(""))
    step = lambda acc, x: F.concat(acc, F.when(x["tag"] == "CONT", F.lit("\n")).otherwise(joint(acc, x["value"])), x["value"])
    joined = nodes.where(~F.col("tag").isin("CONC", "CONT")).join(parts, ["file", "n"], "left")
    return joined.withColumn("value", F.aggregate(F.coalesce("parts", F.array().cast(parts.schema["parts"].dataType)), F.col("value"), step)).drop("parts")


#: Events whose own notes and sources count as the record's.
EVENTS = ["BIRT", "DEAT", "BURI", "MARR"]


def _records(nodes: DataFrame, tag: str) -> DataFrame:
    """Records of a tag with their nodes of levels 1 and 2: (file, root, id, n1, tag1, v1, n2, tag2, v2);
    children of continued lines are folded in."""
    whole = assembled(nodes)
    root = whole.where((F.col("level") == 0) & (F.col("tag") == tag)).select("file", F.col("n").alias("root"), F.coalesce("pointer", F.lit("")).alias("id"))
    one = whole.where("level > 0").select("file", F.col("parent").alias("root"), F.col("n").alias("n1"), F.col("tag").alias("tag1"), strip_pointer(F.col("value")).alias("v1"))
    two = whole.where("level > 1").select("file", F.col("parent").alias("n1"), F.col("tag").alias("tag2"), strip_pointer(F.col("value")).alias("v2"), F.col("n").alias("n2"))
    return root.join(one, ["file", "root"], "left").join(two, ["file", "n1"], "left")


def _first(tag: str) -> Column:
    """Value of the first node of a tag below the record."""
    return F.min_by(F.when(F.col("tag1") == tag, F.trim("v1")), F.when(F.col("tag1") == tag, F.col("n1")))


def _event(tag: str, sub: str) -> Column:
    """Value of the first ``sub`` of the record's first event of a tag; null where that event has none."""
    value = F.when(F.col("tag2") == sub, F.trim("v2"))
    other = F.when(F.col("tag2") == sub, F.lit(0)).otherwise(F.lit(1)).alias("other")
    return F.min_by(value, F.when(F.col("tag1") == tag, F.struct("n1", other, "n2")))


def _texts(tag: str) -> Column:
    """(place, text) of the nodes of a tag below the record, and below its events."""
    own = F.when((F.col("tag1") == tag) & (F.trim("v1") != ""), F.struct(F.col("n1").alias("at"), F.trim("v1").alias("text")))
    below = F.when(F.col("tag1").isin(EVENTS) & (F.col("tag2") == tag) & (F.trim("v2") != ""), F.struct(F.col("n2").alias("at"), F.trim("v2").alias("text")))
    return F.transform(F.array_sort(F.collect_set(F.coalesce(own, below))), lambda x: x["text"])


def persons(nodes: DataFrame) -> DataFrame:
    """A row per INDI record: person_id (its pointer), slug, name parts, dates and places of birth and
    death, sex, families, notes in order, sorted source references, and whether the person may be
    living (the first death event has no date, or there is none). Notes and sources of a record's
    events count as its own."""
    out = _records(nodes, "INDI").groupBy("file", "root", F.col("id").alias("person_id")).agg(
        _first("NAME").alias("name"), _first("SEX").alias("sex"),
        _event("BIRT", "DATE").alias("birth_date"), _event("BIRT", "PLAC").alias("birth_place"),
        _event("DEAT", "DATE").alias("death_date"), _event("DEAT", "PLAC").alias("death_place"),
        F.array_sort(F.collect_set(F.when(F.col("tag1") == "FAMC", F.col("v1")))).alias("famc"),
        F.array_sort(F.collect_set(F.when(F.col("tag1") == "FAMS", F.col("v1")))).alias("fams"),
        _texts("NOTE").alias("notes"), F.array_sort(F.array_distinct(_texts("SOUR"))).alias("source_refs"),
    )
    parsed = parse_name(F.coalesce("name", F.lit("")))
    names = {"given_name": parsed["given"], "surname": parsed["surname"], "display_name": parsed["display"]}
    whole_slug = F.concat_ws("-", F.coalesce(F.nullif(slug(parsed["display"]), F.lit("")), F.lit("unknown-person")), F.coalesce(F.nullif(slug(F.col("person_id")), F.lit("")), F.lit("unknown-id")))
    kept = ["sex", "birth_date", "birth_place", "death_date", "death_place", "famc", "fams", "notes", "source_refs"]
    return out.select("person_id", whole_slug.alias("slug"), *(c.alias(name) for name, c in names.items()), *kept, F.col("death_date").isNull().alias("is_potentially_living"))


def families(nodes: DataFrame) -> DataFrame:
    """A row per FAM record: family_id (its pointer), slug, husband, wife, children, date and place of
    the marriage, notes in order and sorted source references."""
    out = _records(nodes, "FAM").groupBy("file", "root", F.col("id").alias("family_id")).agg(
        _first("HUSB").alias("husband_id"), _first("WIFE").alias("wife_id"),
        F.array_sort(F.collect_set(F.when(F.col("tag1") == "CHIL", F.col("v1")))).alias("child_ids"),
        _event("MARR", "DATE").alias("marriage_date"), _event("MARR", "PLAC").alias("marriage_place"),
        _texts("NOTE").alias("notes"), F.array_sort(F.array_distinct(_texts("SOUR"))).alias("source_refs"),
    )
    return out.withColumn("slug", F.concat(F.lit("family-"), F.coalesce(F.nullif(slug(F.col("family_id")), F.lit("")), F.lit("unknown-id")))).drop("file", "root")


def relationships(people: DataFrame, fams: DataFrame) -> DataFrame:
    """(person_id, relation, other_id) from explicit family records only."""
    ends = fams.select("family_id", F.explode(F.array_compact(F.array("husband_id", "wife_id"))).alias("adult"))
    child = fams.select("family_id", F.explode("child_ids").alias("child"))
    both = ends.join(child, "family_id")
    spouses = ends.join(ends.withColumnRenamed("adult", "other"), "family_id").where("adult <> other")
    out = both.select(F.col("child").alias("person_id"), F.lit("parent").alias("relation"), F.col("adult").alias("other_id"))
    out = out.unionByName(both.select(F.col("adult").alias("person_id"), F.lit("child").alias("relation"), F.col("child").alias("other_id")))
    out = out.unionByName(spouses.select(F.col("adult").alias("person_id"), F.lit("spouse").alias("relation"), F.col("other").alias("other_id")))
    return out.join(people.select("person_id"), "person_id", "left_semi").distinct()
