"""Interval joins, first terms and table differences against plain loops."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evispark.operators import evidence, intervals, parity, terms


def test_covers_are_disjoint_and_whole(spark):
    rng = random.Random(1)
    rows = [(a, a + rng.choice([0, 1, 5, 100, 5000])) for a in (rng.randrange(3000) for _ in range(200))] + [(0, 2**intervals.LEVELS - 1), (0, 0), (2**intervals.LEVELS - 1,) * 2]
    df = spark.createDataFrame(rows, "a int, b int").select("a", "b", intervals.cover(F.col("a"), F.col("b")).alias("c"))
    for r in df.collect():
        spans = sorted((x.block << x.level, (x.block + 1 << x.level) - 1) for x in r.c)
        assert spans[0][0] == r.a and spans[-1][1] == r.b and all(p[1] + 1 == q[0] for p, q in zip(spans, spans[1:])) and len(spans) <= 2 * intervals.LEVELS


def test_overlaps_equal_a_loop(spark):
    rng = random.Random(2)
    day = lambda: rng.choice([None, dt.date(1900, 1, 1) + dt.timedelta(rng.randrange(400))])
    left = [(i, day(), day()) for i in range(120)] + [(0, None, None), (1, dt.date(1900, 3, 1), dt.date(1900, 3, 1))] * 2
    right = [(i, day(), day()) for i in range(90)] + [(7, dt.date(1900, 3, 1), dt.date(1900, 3, 1))] * 2
    meets = lambda p, q: p is None or q is None or p <= q
    want = sorted((i, j) for i, a, b in left for j, c, d in right if meets(a, b) and meets(c, d) and meets(a, d) and meets(c, b))
    x = spark.createDataFrame(left, "i int, a date, b date")
    y = spark.createDataFrame(right, "j int, c date, d date")
    assert sorted((r.i, r.j) for r in intervals.overlap_join(x, y, ("a", "b"), ("c", "d")).collect()) == want
    assert intervals.overlap_join(x.limit(0), y, ("a", "b"), ("c", "d")).count() == 0


def _shuffled_rows(df):
    """Rows that the exchanges of a query wrote, from the metrics of its plan once it has run."""

    def walk(node):
        kind = node.getClass().getSimpleName()
        below = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        own = node.metrics().get("shuffleRecordsWritten")
        return (own.get().value() if own.isDefined() else 0) + sum(map(walk, below))

    return walk(df._jdf.queryExecution().executedPlan())


def test_overlaps_shuffle_few_rows(spark):
    day = F.date_add(F.lit("1992-01-01").cast("date"), (F.col("id") * 7 % 2400).cast("int"))
    left = spark.range(20_000).select(F.col("id").alias("i"), F.when(F.col("id") % 11 != 0, day).alias("a"), F.when(F.col("id") % 13 != 0, F.date_add(day, 30)).alias("b"))
    right = spark.range(300).select(F.col("id").alias("j"), F.when(F.col("id") % 50 != 7, day).alias("c"), F.when(F.col("id") % 50 != 9, F.date_add(day, 3)).alias("d"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = intervals.overlap_join(left, right, ("a", "b"), ("c", "d"))
        pairs = {(r.i, r.j) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert _shuffled_rows(got) < 12 * 20_300  # a start in a block of each level alone would make 22 a row
    x, y = left.collect(), right.collect()
    assert pairs == {(r.i, s.j) for r in x for s in y if (r.a is None or s.d is None or r.a <= s.d) and (s.c is None or r.b is None or s.c <= r.b)}


def test_pairs_are_written_in_few_bytes(spark, tmp_path):
    first = F.lit("1992-01-01").cast("date")
    left = spark.range(2000).select(F.col("id").alias("i"), F.date_add(first, (F.col("id") % 2400).cast("int")).alias("a"), F.lit(None).cast("date").alias("b"))
    right = spark.range(3000).select(F.col("id").alias("j"), F.date_add(first, (F.col("id") * 23).cast("int")).alias("c"), F.date_add(first, (F.col("id") * 23 + 3).cast("int")).alias("d"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        intervals.overlap_join(left, right, ("a", "b"), ("c", "d"), keep=["i", "j"]).write.parquet(str(tmp_path / "pairs"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    pairs = sum(23 * j + 3 >= i % 2400 for i in range(2000) for j in range(3000))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == pairs
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < pairs / 2  # rows in no order that repeats take over a byte


@pytest.mark.parametrize(("sizes", "run", "pieces"), [((1, 2), 1, 3), ((2, 16), 2, 64), ((64, 4096), 16, 1)])
def test_overlaps_in_any_blocks(spark, monkeypatch, sizes, run, pieces):
    for name, value in (("SIZES", sizes), ("RUN", run), ("PIECES", pieces)):
        monkeypatch.setattr(intervals, name, value)
    rng = random.Random(4)
    day = lambda: rng.choice([None, *(dt.date(1900, 1, 1) + dt.timedelta(k) for k in (rng.randrange(5), rng.randrange(60)))])
    for n, m in ((200, 9), (9, 200), (0, 3)):
        left, right = [(i % 150, day(), day()) for i in range(n)], [(i % 150, day(), day()) for i in range(m)]
        meets = lambda p, q: p is None or q is None or p <= q
        want = sorted((i, j) for i, a, b in left for j, c, d in right if meets(a, b) and meets(c, d) and meets(a, d) and meets(c, b))
        got = intervals.overlap_join(spark.createDataFrame(left, "day int, a date, b date"), spark.createDataFrame(right, "first int, c date, d date"), ("a", "b"), ("c", "d"))
        assert sorted(map(lambda r: (r.day, r.first_), got.withColumnRenamed("first", "first_").collect())) == want


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abAB-é"), max_size=30), st.lists(st.text(st.sampled_from("abB-é"), max_size=4), max_size=12))
def test_first_term_in_list_order(text, listed):
    want = next((i for i, t in enumerate(listed) if t and t.lower() in text.lower()), None)
    assert terms.first_in_list(text, tuple(listed)) == want


def test_boundary(spark):
    paths = spark.createDataFrame([("a\\Bad.py",), ("ok.md",), (None,)], "path string")
    texts = spark.createDataFrame([("ok.md", "so worse and bad"), ("x.png", "bad"), ("y.TXT", "x" * (terms.MOST_BYTES + 1) + "bad"), ("d/.json", "bad"), ("n.txt", None)], "path string, text string")
    remotes = spark.createDataFrame([("origin git@x:BAD.git (fetch)",)], "line string")
    found = terms.boundary_findings(paths, texts, remotes, ["worse", "bad"])
    assert sorted(map(tuple, found.collect())) == [("a/Bad.py", "tracked_path", "bad"), ("git remote -v", "remote", "bad"), ("ok.md", "file_content", "worse")]
    assert tuple(terms.boundary_summary(found, texts).first()) == (1, 3, False)
    assert terms.boundary_findings(paths, texts, remotes, []).count() == 0


@pytest.mark.parametrize("fan", [2, 8, 1024])
def test_differences_equal_a_loop(spark, monkeypatch, fan):
    monkeypatch.setattr(parity, "FAN", fan)
    rng = random.Random(3)
    left = {i: (f"v{i}", rng.choice([None, "", "q"])) for i in range(300) if i % 71}
    right = {i: list(v) for i, v in left.items() if i % 83}
    for i in rng.sample(sorted(right), 12):
        right[i][rng.randrange(2)] = rng.choice([None, "other"])
    right[500] = ["new", None]
    schema = "n long, a string, b string"
    df = parity.table_differences(spark.createDataFrame([(i, *v) for i, v in left.items()] + [(None, "x", "y")], schema), spark.createDataFrame([(i, *v) for i, v in right.items()], schema), "n", ["a", "b"])
    want = [(i, "<row>", "1", "0") for i in left if i not in right] + [(i, "<row>", "0", "1") for i in right if i not in left]
    want += [(i, c, left[i][k], right[i][k]) for i in left if i in right for k, c in enumerate("ab") if left[i][k] != right[i][k]]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    same = spark.createDataFrame([(i, *v) for i, v in left.items()], schema)
    assert parity.table_differences(same, same.repartition(3), "n", ["a", "b"]).count() == 0
    twice = parity.table_differences(same, same.unionByName(same.where("n = 5")), "n", ["a", "b"]).collect()
    assert [tuple(r) for r in twice] == [(5, "<row>", "1", "2")]
    assert parity.table_differences(same.limit(0), same.limit(0), "n", ["a"]).count() == 0


def test_sheets_as_csv_shows_them(spark):
    cells = [(1, 1, "text", "id"), (1, 2, "text", "day"), (1, 3, "text", "ok"), (2, 1, "number", "7.0"), (2, 2, "number", "2"), (2, 3, "boolean", "true"), (3, 1, "number", "1.25"), (3, 2, "date", "1950-01-02T00:00:00")]
    df = spark.createDataFrame(cells, "row int, col int, kind string, value string")
    rows = parity.sheet_rows(df, ["id", "day", "ok"], dates=("day",)).orderBy("place").collect()
    assert [tuple(r) for r in rows] == [(0, "7", "1900-01-01", "True"), (1, "1.25", "1950-01-02", "")]
    with pytest.raises(Exception, match="header"):
        parity.sheet_rows(df, ["id", "other", "ok"]).collect()


def test_differing_fields(spark):
    rows = [("a", "r1", "t", None), ("a", "r2", "t", "x"), ("b", "r1", "t", None), ("b", "r2", "u", None), ("c", "r1", "t", "x"), ("c", "r1", "u", "y"), ("d", "r1", None, None), ("d", "r2", None, None), (None, "r1", "z", None), (None, "r2", "t", None)]
    df = spark.createDataFrame(rows, "id string, register string, title string, role string")
    assert {r.id: r.fields for r in evidence.differing_fields(df, "id", "register", ["title", "role"]).collect()} == {"a": ["role"], "b": ["title"], "d": []}
