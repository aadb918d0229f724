"""Trees read in parallel against a plain stack, and the records of a small GEDCOM file."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evispark.operators.levels import DEEPEST, nearest_below
from evispark.sources import gedcom


def stack_parents(levels):
    """(parent, root) places of each row, by a stack."""
    stack, root, out = [], None, []
    for i, level in enumerate(levels):
        while stack and stack[-1][1] >= level:
            stack.pop()
        root = i if level == 0 else root
        out.append((stack[-1][0] if stack else None, root))
        stack.append((i, level))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=60), st.integers(1, 20))
def test_chunks_equal_a_stack(levels, size):
    inherited, got = np.full(DEEPEST + 1, -1, np.int64), []
    for s in range(0, len(levels), size):
        part = np.array(levels[s : s + size])
        parent, inherited = nearest_below(part, np.arange(s, s + len(part)), inherited)
        got += parent.tolist()
    assert got == [-1 if p is None else p for p, _ in stack_parents(levels)]


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_one_large_file_on_many_tasks(spark, tmp_path, small_splits, newline):
    rng = random.Random(5)
    levels = [0]
    for _ in range(6000):
        levels.append(rng.randint(0, min(levels[-1] + 1, 9)) if rng.random() < 0.9 else rng.randint(1, 14))
    lines = [f"{x} NOTE v{i}" + "x" * rng.randrange(30) for i, x in enumerate(levels)]
    body = []
    for line in lines:
        body += [line, *[""] * (rng.random() < 0.05)]
    (tmp_path / "big.ged").write_bytes(("﻿" + newline.join(body)).encode())
    (tmp_path / "other.ged").write_bytes(b"0 HEAD\n1 CHAR UTF-8\n")
    nodes = gedcom.read_nodes(spark, str(tmp_path))
    assert nodes.rdd.getNumPartitions() > 8
    rows = [r for r in nodes.orderBy("n").collect() if r.file.endswith("big.ged")]
    assert [(r.level, r.value) for r in rows] == [(x, lines[i].split(" ", 2)[2]) for i, x in enumerate(levels)]
    at = {r.n: i for i, r in enumerate(rows)}
    assert len(at) == len(rows)
    assert [(at.get(r.parent), at.get(r.rec)) for r in rows] == stack_parents(levels)


def test_records(spark, tmp_path):
    (tmp_path / "t.ged").write_text("""0 HEAD
0 @I1@ INDI
1 NAME Ann /Alpha/
1 BIRT
2 PLAC Town
2 NOTE at home
1 BIRT
2 DATE 1900
1 NOTE first
2 CONC line
2 CONT second line
1 SOUR @S2@
1 DEAT
2 SOUR @S1@
1 SOUR @S2@
0 @I2@ INDI
1 DEAT Y
1 NOTE
0 @F1@ FAM
1 HUSB @I2@
1 WIFE @I1@
1 MARR
2 PLAC Church
2 DATE 1920
2 NOTE rain
1 SOUR book
0 @F2@ FAM
""")
    nodes = gedcom.read_nodes(spark, str(tmp_path / "t.ged"))
    people = {r.person_id: r for r in gedcom.persons(nodes).collect()}
    ann, other = people["I1"], people["I2"]
    assert (ann.birth_date, ann.birth_place) == (None, "Town")  # the first birth alone
    assert ann.notes == ["at home", "first line\nsecond line"] and ann.source_refs == ["S1", "S2"]
    assert ann.slug == "ann-alpha-i1" and other.slug == "unknown-i2" and other.is_potentially_living and other.notes == []
    families = {r.family_id: r for r in gedcom.families(nodes).collect()}
    one = families["F1"]
    assert (one.husband_id, one.wife_id, one.marriage_date, one.marriage_place, one.notes, one.source_refs, one.slug) == ("I2", "I1", "1920", "Church", ["rain"], ["book"], "family-f1")
    assert families["F2"].child_ids == [] and families["F2"].husband_id is None


def test_levels_over_the_bound_and_bad_lines(spark, tmp_path):
    for body, error in (("0 HEAD\n100 X\n", "over 99"), ("0 HEAD\nx y\n", "not a GEDCOM line")):
        (tmp_path / "bad.ged").write_text(body)
        with pytest.raises(Exception, match=error):
            gedcom.read_nodes(spark, str(tmp_path / "bad.ged")).collect()
    (tmp_path / "empty.ged").write_text("\n\n")
    assert gedcom.persons(gedcom.read_nodes(spark, str(tmp_path / "empty.ged"))).collect() == []
