"""First forbidden term of a text, over thousands of terms in one pass.

The terms are one automaton, built once by each Python worker; a text is read once, whatever their
number, and the smallest place in the list among all that occur wins.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File types whose text is read, and the most bytes of such a file.
TEXT_SUFFIXES = [".bat", ".cfg", ".ini", ".json", ".md", ".ps1", ".py", ".toml", ".txt", ".yaml", ".yml"]
MOST_BYTES = 2 * 1024 * 1024
_BUILT: dict[tuple[str, ...], ahocorasick.Automaton] = {}


def automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    found = _BUILT.get(terms)
    if found is None:
        found = ahocorasick.Automaton()
        for i, term in reversed(list(enumerate(terms))):  # of equal terms the first counts
            if term:
                found.add_word(term.lower(), i)
        found.make_automaton()
        _BUILT.clear()
        _BUILT[terms] = found
    return found


def first_in_list(text: str, terms: tuple[str, ...]) -> int | None:
    """Place of the first term in list order that occurs in the text, by lower case."""
    built, best = automaton(terms), None
    for _, i in built.iter(text.lower()) if len(built) else ():
        if best is None or i < best:
            best = i
            if not best:
                break
    return best


def first_term(text: Column, terms: list[str]) -> Column:
    """The first of ``terms`` that occurs in the text, by lower case; null if none does. Empty terms
    are passed over. ``terms`` travel with the plan: they are a policy list, not data."""
    listed = tuple(terms)

    @F.arrow_udf(T.StringType())
    def scan(column: pa.Array) -> pa.Array:
        found = [None if t is None else first_in_list(t, listed) for t in column.to_pylist()]
        return pa.array([None if i is None else listed[i] for i in found], pa.string())

    return scan(text)


def suffix(path: Column) -> Column:
    """Lower-cased suffix of a path's last part; empty for names without one, and for dot-files."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def boundary_findings(paths: DataFrame, texts: DataFrame, remotes: DataFrame, terms: list[str], suffixes: list[str] | None = None) -> DataFrame:
    """(location, kind, term): the first forbidden term of each tracked path (``path``), of each text
    file (``path``, ``text``) of the audited types and at most MOST_BYTES, and of each remote line
    (``line``)."""
    slashes = F.replace("path", F.lit("\\"), F.lit("/"))
    small = texts.where((F.octet_length("text") <= MOST_BYTES) & suffix(F.col("path")).isin(suffixes or TEXT_SUFFIXES))
    parts = [
        paths.select(slashes.alias("location"), F.lit("tracked_path").alias("kind"), slashes.alias("t_")),
        small.select(slashes.alias("location"), F.lit("file_content").alias("kind"), F.col("text").alias("t_")),
        remotes.select(F.lit("git remote -v").alias("location"), F.lit("remote").alias("kind"), F.col("line").alias("t_")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])  # scanned once
    return rows.select("location", "kind", first_term(F.col("t_"), terms).alias("term")).where("term is not null")


def boundary_summary(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """One row: scanned files, findings, and whether the boundary is ready (none)."""
    small = texts.where((F.octet_length("text") <= MOST_BYTES) & suffix(F.col("path")).isin(TEXT_SUFFIXES))
    return small.agg(F.count("*").alias("scanned_file_count")).crossJoin(findings.agg(F.count("*").alias("finding_count"), (F.count("*") == 0).alias("boundary_ready")))  # one row each
