"""Ranks by ranges of values."""

import itertools
import random

from evispark.operators import ranking


def test_no_window_without_partition_and_right_sums(spark, monkeypatch):
    rng = random.Random(3)
    values = sorted({rng.randrange(10**6) for _ in range(800)} | {-5, 0})
    rows = [(v, rng.randrange(5)) for v in values]
    for ranges in (1, 2, 7, 256):
        monkeypatch.setattr(ranking, "RANGES", ranges) if ranges > 1 else None
        df = ranking.sums_above(spark.createDataFrame(rows, "v long, n long"), "v", ["n"])
        got = {r.v: r.n_above for r in df.collect()}
        assert got == {v: sum(m for w, m in rows if w > v) for v, _ in rows}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window")[1].split("Aggregate")[0]
    for line in plan.split("\n"):
        if "Window [" in line:
            assert "[range_" in line.split("windowspecdefinition(")[1], line


def test_unbounded_ties_and_one_value(spark):
    rows = [(1, 5, None, False), (2, 5, 5, True), (3, 5, 5, False), (4, 9, 9, False)]
    got = {r.i: (r.rank_min, r.rank_max) for r in ranking.rank_envelope(spark.createDataFrame(rows, "i int, lo long, up long, ex boolean"), "lo", "up", "ex").collect()}
    # 1: unknown upper may lead or be behind 4 alone; 2 gives way to those at 5; 3 shares; 4 may be below 1
    want = {}
    for i, lo, up, ex in rows:
        others = [r for r in rows if r[0] != i]
        best = 1 if up is None else 1 + sum(l > up or (ex and l == up) for _, l, _, _ in others)
        want[i] = (best, 1 + sum(u is None or u > lo for _, _, u, _ in others))
    assert got == want
    df = spark.createDataFrame([(7,), (7,), (3,)], "v int")
    assert sorted((r.v, r.rank) for r in ranking.competition_rank(df, "v").collect()) == [(3, 3), (7, 1), (7, 1)]
    assert ranking.competition_rank(df.limit(0), "v").collect() == []


def test_range_totals_are_not_shuffled_with_rows(spark):
    lines = ranking.sums_above(spark.createDataFrame([(1, 1)], "v long, n long"), "v", ["n"])._jdf.queryExecution().optimizedPlan().toString().split("\n")
    first = next(i for i, line in enumerate(lines) if "Window [" in line)
    depth = lines[first].index("Window [")
    below = list(itertools.takewhile(lambda line: line and len(line) - len(line.lstrip(" :+-")) > depth, lines[first + 1 :]))
    assert below and not any("totals_" in line for line in below)
