"""Rank envelopes: best and worst rank that uncertain ages allow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Ranges that distinct values are cut into; a table of them is one row.
RANGES = 256


def sums_above(counts: DataFrame, value: str, sums: list[str], by: list[str] | None = None) -> DataFrame:
    """Add ``<s>_above`` for each of ``sums``: its sum over the rows of larger ``value`` (a number, date
    or time; distinct within ``by``).

    Values are cut into ranges at approximate quantiles. Rows of a range are summed by a window of
    their own; what lies in higher ranges comes from a broadcast row per range, joined only after that
    window, so that rows are shuffled with their own columns alone. Without ``by`` no task sees all
    values.
    """
    if by:
        above = Window.partitionBy(*by).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
        return counts.select("*", *(F.coalesce(F.sum(s).over(above), F.lit(0)).alias(f"{s}_above") for s in sums))
    edges = counts.agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 4 * RANGES).alias("edges_"))
    edges = edges.select(F.array_sort(F.array_distinct("edges_")).alias("edges_"))
    rows = counts.crossJoin(F.broadcast(edges)).withColumn("range_", F.size(F.filter("edges_", lambda e: e <= F.col(value)))).drop("edges_")  # one row of RANGES numbers
    totals = rows.groupBy("range_").agg(*(F.sum(s).alias(s) for s in sums)).agg(F.collect_list(F.struct("range_", *sums)).alias("totals_"))  # at most RANGES entries
    higher = lambda s: F.aggregate(F.filter("totals_", lambda x: x["range_"] > F.col("x.range_")), F.lit(0).cast("long"), lambda a, x: a + x[s])
    ranges = totals.select("totals_", F.explode("totals_").alias("x")).select("x.range_", *(higher(s).alias(f"{s}_higher_") for s in sums))
    within = Window.partitionBy("range_").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.select("*", *(F.coalesce(F.sum(s).over(within), F.lit(0)).alias(f"{s}_within_") for s in sums)).join(F.broadcast(ranges), "range_")  # a row per range
    return out.select(*counts.columns, *((F.col(f"{s}_within_") + F.col(f"{s}_higher_")).alias(f"{s}_above") for s in sums))


def rank_envelope(df: DataFrame, lower: str, upper: str, exclusive: str | None = None) -> DataFrame:
    """Add ``rank_min`` and ``rank_max``.

    Another row is surely ahead if its lower bound is above one's upper bound (or equal to an
    exclusive one), and possibly ahead if its upper bound is null or above one's lower bound.
    Bounds are counted by distinct value and summed from above over those counts by ranges, and
    joined back: no row meets all others, and no task all values. A row does not count itself.
    """
    ex = F.coalesce(F.col(exclusive), F.lit(False)) if exclusive else F.lit(False)
    values = df.select(F.col(lower).alias("v"), F.lit(1).alias("lo"), F.lit(0).alias("up")).unionAll(df.select(F.col(upper), F.lit(0), F.lit(1)))
    counts = values.where("v is not null").groupBy("v").agg(F.sum("lo").alias("lo"), F.sum("up").alias("up"))
    sums = sums_above(counts, "v", ["lo", "up"]).withColumnRenamed("lo", "lo_at")
    unbounded = df.agg(F.count_if(F.col(upper).isNull()).alias("n_unbounded"))
    by_upper = sums.select(F.col("v").alias(upper), F.col("lo_above").alias("u_above"), F.col("lo_at").alias("u_at"))
    by_lower = sums.select(F.col("v").alias(lower), F.col("up_above").alias("l_above"))
    joined = df.join(by_upper, upper, "left").join(by_lower, lower, "left").crossJoin(F.broadcast(unbounded))  # one row
    own_best = F.when(ex & (F.col(lower) == F.col(upper)), 1).otherwise(0)
    best = F.when(F.col(upper).isNull(), F.lit(1)).otherwise(1 + F.col("u_above") + F.when(ex, F.col("u_at")).otherwise(0) - own_best)
    own_worst = F.when(F.col(upper).isNull() | (F.col(upper) > F.col(lower)), 1).otherwise(0)
    worst = 1 + F.coalesce("l_above", F.lit(0)) + F.col("n_unbounded") - own_worst
    return joined.select(*df.columns, best.cast("long").alias("rank_min"), worst.cast("long").alias("rank_max"))


def competition_rank(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Add ``rank``: 1 + number of rows above; ties share. Counted by distinct value, so that only
    the distinct values of a group are sorted together; without groups they are summed by ranges."""
    by = by or []
    counts = sums_above(df.groupBy(*by, value).agg(F.count("*").alias("n_")), value, ["n_"], by)
    ranks = counts.select(*by, value, (F.col("n__above") + 1).alias("rank"))
    return df.join(ranks, [*by, value])


def closure(df: DataFrame, reference_ready: str, status: str, open_group: str) -> DataFrame:
    """One row: whether the comparison is closed (reference ready, no candidate, no open group)."""
    return df.agg(
        F.coalesce(F.bool_or(reference_ready), F.lit(False)).alias("reference_ready"),
        F.count_if(F.col(status) == "possible_above").alias("n_candidates"),
        F.count_if(open_group).alias("n_open"),
        F.count_if(F.col(status) == "muted").alias("n_muted"),
    ).withColumn("closed", F.col("reference_ready") & (F.col("n_candidates") == 0) & (F.col("n_open") == 0) & (F.col("n_muted") == 0))
