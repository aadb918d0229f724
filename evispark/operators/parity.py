"""Differences of two tables with an order, by a hash tree over ranges of rows.

A leaf is the parity of the hashes of FAN neighbouring rows, each over its place and values; a node
above is the parity of FAN leaves. Trees are compared from the top: only ranges below nodes that
differ are looked at further, and only rows of leaves that differ are joined by place. Equal tables
cost one scan of each and a join of one row per FAN squared rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a leaf, and leaves of a node.
FAN = 1024
#: Day 0 of serial dates in workbooks.
SERIAL_DAY = "1899-12-30"


def _leaves(rows: DataFrame, place: str, columns: list[str]) -> DataFrame:
    """A row per leaf: count and parity. Two seeds make 128 bits of a row's hash."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    one, two = F.xxhash64(place, *values), F.xxhash64(F.lit(7), *reversed(values), place)
    leaf = F.expr(f"`{place}` div {FAN}").alias("leaf")
    return rows.groupBy(leaf).agg(F.count("*").alias("n"), F.bit_xor(one).alias("x"), F.bit_xor(two).alias("y"))


def _nodes(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy(F.expr(f"leaf div {FAN}").alias("node")).agg(F.sum("n").alias("n"), F.bit_xor(F.xxhash64("leaf", "x")).alias("x"), F.bit_xor(F.xxhash64("leaf", "y")).alias("y"))


def _differing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys whose hashes differ, or that one side lacks."""
    renamed = b.select(key, *(F.col(c).alias(f"{c}_") for c in ("n", "x", "y")))
    same = reduce(lambda p, q: p & q, (F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("n", "x", "y")))
    return a.join(renamed, key, "full").where(~same).select(key)


def table_differences(left: DataFrame, right: DataFrame, place: str, columns: list[str]) -> DataFrame:
    """(``place``, column, left, right): cells that differ, as text; ``column`` is ``<row>`` where one
    table lacks the row or has its place again (its left and right are the numbers of rows there).

    ``place`` is a row's number, at least 0. Nulls equal nulls. Rows with a null place fail nothing and
    are not compared. Columns beyond ``columns`` are not read.
    """
    a, b = (df.select(F.col(place).cast("long").alias(place), *(F.col(c).cast("string").alias(c) for c in columns)).where(F.col(place).isNotNull()) for df in (left, right))
    la, lb = _leaves(a, place, columns), _leaves(b, place, columns)
    nodes = _differing(_nodes(la), _nodes(lb), "node")
    below = lambda leaves: leaves.withColumn("node", F.expr(f"leaf div {FAN}")).join(nodes, "node", "left_semi")
    leaves = _differing(below(la), below(lb), "leaf")
    inside = lambda df: df.withColumn("leaf", F.expr(f"`{place}` div {FAN}")).join(leaves, "leaf", "left_semi").drop("leaf")
    cells = F.struct(*columns)
    sides = [inside(df).groupBy(place).agg(F.min(cells).alias(f"c{i}"), F.count("*").alias(f"n{i}")) for i, df in enumerate((a, b))]
    rows = sides[0].join(sides[1], place, "full")
    odd = ~(F.col("n0").eqNullSafe(F.lit(1)) & F.col("n1").eqNullSafe(F.lit(1)))
    item = lambda name, x, y, when: F.when(when, F.struct(F.lit(name).alias("column"), x.cast("string").alias("left"), y.cast("string").alias("right")))
    found = [item("<row>", F.coalesce("n0", F.lit(0)), F.coalesce("n1", F.lit(0)), odd & ~(F.col("n0").eqNullSafe(F.col("n1")) & F.col("c0").eqNullSafe(F.col("c1"))))]
    found += [item(c, F.col(f"c0.{c}"), F.col(f"c1.{c}"), ~odd & ~F.col(f"c0.{c}").eqNullSafe(F.col(f"c1.{c}"))) for c in columns]
    return rows.select(place, F.explode(F.array_compact(F.array(*found))).alias("d")).select(place, "d.*")


def cell_text(kind: Column, value: Column, is_date: Column | bool = False) -> Column:
    """A workbook cell as a CSV shows it: whole numbers without a fraction, serial or ISO dates as ISO
    dates, booleans as True and False, empty cells as empty text."""
    number = value.try_cast("double")
    whole = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))
    serial = F.date_add(F.lit(SERIAL_DAY).cast("date"), F.floor(number).cast("int")).cast("string")
    date = is_date if isinstance(is_date, Column) else F.lit(is_date)
    shown = (
        F.when((kind == "number") & date, serial).when(kind == "number", F.coalesce(whole, value))
        .when(kind == "date", F.left(value, F.lit(10))).when(kind == "boolean", F.initcap(value)).otherwise(value)
    )
    return F.coalesce(shown, F.lit(""))


def sheet_rows(cells: DataFrame, fields: list[str], dates: tuple[str, ...] = ()) -> DataFrame:
    """(place, fields): rows of one sheet's cells (row, col, kind, value) below its header, from 0. A
    header that is not ``fields`` fails the query."""
    head = cells.where("row = 1").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]).alias("h"))  # one row of a sheet's width
    wrong = F.when(F.col("h") != F.array(*map(F.lit, fields)), F.raise_error(F.concat(F.lit("header: "), F.array_join("h", ","))))
    is_date = F.col("col").isin([fields.index(d) + 1 for d in dates]) if dates else F.lit(False)
    shown = cells.where("row > 1").withColumn("text", cell_text(F.col("kind"), F.col("value"), is_date))
    rows = shown.groupBy((F.col("row") - 2).cast("long").alias("place")).agg(*(F.coalesce(F.max(F.when(F.col("col") == i + 1, F.col("text"))), F.lit("")).alias(f) for i, f in enumerate(fields)))
    return rows.crossJoin(F.broadcast(head)).where(wrong.isNull()).drop("h")
