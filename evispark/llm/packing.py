"""Packing documents into fixed-length sequences by cutting-stock column generation.

Full sequences are cut off the front of long documents. What remains is grouped into length
classes; the classes' histogram, which has at most UNITS entries at any input size, is a
cutting-stock problem: a linear program over patterns of classes, whose columns a knapsack
dynamic program prices. Rounded pattern counts are assigned to the documents by rank within
their class. A reserved share of the documents then fills the gaps that rounding leaves: the
gaps of all sequences and the reserved documents are two long strips of tokens laid side by
side, and each gap takes the tokens beside it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import group_starts, slices, whole_groups
from .store import bound_batches, materialize, partitions
from .tokens import MEMO_BYTES, encoder

#: Length classes of a sequence.
UNITS = 128
#: Documents are dealt to 1024 lanes; the ids of the first LANES are kept, since any of them may
#: be asked to fill gaps. Where gaps ask for more, texts are encoded again with more lanes kept.
ALL_LANES, LANES = 1024, 96
#: Tokens of the two strips that one group of rows covers.
CELL = 65_536
MAX_COLUMNS = 3000


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value of an unbounded knapsack of ascending ``sizes``, and how many of each it takes."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for w in range(1, capacity + 1):
        best[w] = best[w - 1]
        if k := int(fits[w]):
            gains = best[w - sizes[:k]] + values[:k]
            at = int(gains.argmax())
            if gains[at] > best[w] + 1e-12:
                best[w], choice[w] = gains[at], at
    taken, w = np.zeros(len(sizes), np.int64), capacity
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            taken[choice[w]] += 1
            w -= sizes[choice[w]]
    return float(best[capacity]), taken


def generate_columns(sizes: np.ndarray, demand: np.ndarray, capacity: int, slack: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Linear program of least patterns that cover ``demand``: (patterns as columns, amounts).

    Columns are added until the best one is worth at most 1 + ``slack``; the amounts are then
    within that share of the optimum.
    """
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    amount = demand / np.diag(basis)
    inverse = np.diag(1 / np.diag(basis))
    for _ in range(MAX_COLUMNS):
        value, column = price(np.ones(m) @ inverse, sizes, capacity)
        if value <= 1 + slack:
            break
        direction = inverse @ column
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.where(up, amount / np.where(up, direction, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        row = inverse[out] / direction[out]
        inverse = inverse - direction[:, None] * row[None]
        inverse[out] = row
        amount = np.maximum(inverse @ demand, 0)
    return basis.round().astype(np.int64), amount


def plan_patterns(demand: dict[int, int], capacity: int = UNITS) -> list[tuple[dict[int, int], int]]:
    """Patterns (count of each class) and how many sequences use each; together they hold
    ``demand`` documents of every class at least. Amounts are rounded down, and the rest is
    packed largest first."""
    sizes = np.array(sorted(c for c, n in demand.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(c)] for c in sizes], float)
    columns, amount = generate_columns(sizes, need, capacity)
    whole = np.floor(amount + 1e-7).astype(np.int64)
    plan = [({int(c): int(k) for c, k in zip(sizes, columns[:, p]) if k}, int(whole[p])) for p in range(len(sizes)) if whole[p]]
    rest = np.maximum(need.astype(np.int64) - columns @ whole, 0)
    while rest.any():
        room, pattern = capacity, {}
        for at in np.flatnonzero(rest)[::-1]:
            k = min(int(rest[at]), room // int(sizes[at]))
            if k:
                pattern[int(sizes[at])] = k
                room -= k * int(sizes[at])
        times = min(int(rest[np.searchsorted(sizes, c)]) // k for c, k in pattern.items())
        plan.append((pattern, times))
        for c, k in pattern.items():
            rest[np.searchsorted(sizes, c)] -= k * times
    return plan


def _encoded(df: DataFrame, key: str, text: str, tokenizer: str, spaces: bool, end_id: int, length: int, kept: int, memo_bytes: int) -> DataFrame:
    """A row per document: its token count, checksums of its full cuts and of its rest, and,
    in the first ``kept`` lanes, the rest's ids."""
    unit = length // UNITS
    fields = [("k", pa.int64()), ("uid", pa.int64()), ("n", pa.int64()), ("cuts", pa.list_(pa.int64())), ("rest", pa.int64()), ("crc", pa.int64()), ("cls", pa.int32()), ("lane", pa.int32()), ("ids", pa.binary())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, spaces, end_id, memo_bytes)
        for batch in (part for whole in batches for part in slices(whole, 3)):
            rows = []
            for k, uid, lane, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                raw = enc.encode(t.as_py())
                n = len(raw) // 4
                full = n // length
                rest = raw[4 * full * length :]
                cuts = [zlib.crc32(raw[4 * c * length : 4 * (c + 1) * length]) for c in range(full)]
                r = len(rest) // 4
                rows.append((k, uid, n, cuts, r, zlib.crc32(rest), -(-r // unit), lane, rest if lane < kept else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], schema=schema)

    docs = df.select(F.col(key).cast("long").alias("k"), F.monotonically_increasing_id().alias("uid"), F.col(text).cast("string").alias("t"))
    docs = docs.select("k", "uid", F.pmod(F.xxhash64("uid"), F.lit(ALL_LANES)).cast("int").alias("lane"), "t")
    return docs.mapInArrow(run, "k long, uid long, n long, cuts array<long>, rest long, crc long, cls int, lane int, ids binary")


def _running(df: DataFrame, value: str, part: str, order: str, name: str, within: str | None = None) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all earlier rows by (``part``, ``order``), within
    groups of ``within``. Each part is summed by itself and only parts' totals are put in line."""
    group = [within] if within else []
    totals = df.groupBy(*group, part).agg(F.sum(value).alias("total"))
    line = Window.partitionBy(*group).orderBy(part) if group else Window.orderBy(part)
    base = totals.select(*group, part, F.coalesce(F.sum("total").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = Window.partitionBy(*group, part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumn("inside", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return inside.join(base, [*group, part]).withColumn(name, F.col("base") + F.col("inside")).drop("base", "inside")


def pack(df: DataFrame, tokenizer: str, spaces: bool, end_id: int, key: str = "doc_id", text: str = "text", length: int = 4096, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """Pieces of all documents in sequences of at most ``length`` tokens.

    Returns ``key``, ``start`` (ids of the document before the piece), ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id`` and ``offset``. Each id of each document lies in one piece,
    and the pieces of a sequence follow each other without gaps from offset 0. A null text
    counts as empty, so every document has its end id; rows with null or repeated keys are
    documents of their own. An empty table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    bound_batches(spark)
    unit = length // UNITS
    part = F.shiftright("uid", 33).alias("part")
    some = F.coalesce("rest", F.lit(0)) > 0  # kept from the Parquet reader, which was seen to stall on this filter once
    kept = LANES
    while True:
        docs = materialize(_encoded(df, key, text, tokenizer, spaces, end_id, length, kept, memo_bytes), "packing-docs")
        histogram = docs.where(some).groupBy("cls", F.least("lane", F.lit(kept)).alias("lane")).agg(F.count("*").alias("c"), F.sum("rest").alias("t")).collect()
        tokens = sum(r.t for r in histogram)
        gaps = sum(r.c * r.cls * unit - r.t for r in histogram) + 0.004 * tokens
        lanes = min(ALL_LANES, ceil(ALL_LANES * 1.02 * gaps / (tokens + gaps))) if tokens else 0
        if lanes <= kept:
            break
        kept = lanes
    light = docs.select("k", "uid", part, "n", "rest", "crc", "cls", "lane")
    demand: dict[int, int] = {}
    for r in histogram:
        if r.lane >= lanes:
            demand[r.cls] = demand.get(r.cls, 0) + r.c
    plan = plan_patterns(demand)
    n_patterned = sum(times for _, times in plan)
    ranges = _ranges(plan)

    normal = light.where(some & (F.col("lane") >= lanes)).withColumn("one", F.lit(1))
    ranked = _running(normal, "one", "part", "uid", "rank", "cls").select("k", "n", "rest", "crc", "cls", "rank")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, rank = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            seq, slot = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for c in np.unique(cls):
                firsts, bases, each = ranges[int(c)]
                rows = np.flatnonzero(cls == c)
                p = np.searchsorted(firsts, rank[rows], side="right") - 1
                seq[rows] = bases[p] + (rank[rows] - firsts[p]) // each[p]
                slot[rows] = -int(c) * 100_000 + (rank[rows] - firsts[p]) % each[p]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(seq), pa.array(slot)], ["k", "n", "rest", "crc", "seq", "slot"])

    placed = ranked.mapInArrow(assign, "k long, n long, rest long, crc long, seq long, slot long")
    before = Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = materialize(placed.withColumn("offset", F.coalesce(F.sum("rest").over(before), F.lit(0))), "packing-placed")
    out = placed.select(F.col("k").alias(key), (F.col("n") - F.col("rest")).alias("start"), F.col("rest").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), F.col("seq").alias("sequence_id"), "offset")

    used = placed.groupBy("seq").agg(F.sum("rest").alias("used")).where(F.col("used") < length)
    gap = _running(used.select("seq", "used", (length - F.col("used")).alias("gap"), F.shiftright("seq", 12).alias("part")), "gap", "part", "seq", "lo")
    gap = materialize(gap.select("seq", "used", "lo", (F.col("lo") + F.col("gap")).alias("hi")), "packing-gaps")
    filler = docs.where(some & (F.col("lane") < lanes)).select("k", "uid", part, "n", "rest")
    filler = materialize(_running(filler, "rest", "part", "uid", "lo").select("uid", "lo"), "packing-filler").withColumnRenamed("uid", "u")
    filler = docs.where(some & (F.col("lane") < lanes)).select("k", "uid", "n", "rest", "ids").join(filler, F.col("uid") == F.col("u")).select("k", "n", "ids", "lo", (F.col("lo") + F.col("rest")).alias("hi"))
    n_gap = gap.agg(F.max("hi")).first()[0] or 0
    n_fill = sum(r.t for r in histogram if r.lane < lanes)
    out = out.unionByName(_fill(filler, gap, n_gap, n_patterned, key, length, partitions(spark)))

    n_tail = max(0, -(-(n_fill - n_gap) // length))
    cut = docs.where(F.size("cuts") > 0).select("k", "uid", part, "n", "cuts", F.size("cuts").cast("long").alias("m"))
    cut = _running(cut, "m", "part", "uid", "first").select("k", "n", "first", F.posexplode("cuts").alias("i", "crc"))
    whole = cut.select(F.col("k").alias(key), (F.col("i").cast("long") * length).alias("start"), F.lit(length).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.col("first") + F.col("i") + n_patterned + n_tail).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return out.unionByName(whole)


def _ranges(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each class: first rank, first sequence and documents in each sequence, by pattern."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for pattern, times in plan:
        for c, k in pattern.items():
            found.setdefault(c, []).append((taken.get(c, 0), base, k))
            taken[c] = taken.get(c, 0) + k * times
        base += times
    return {c: tuple(np.array(x, np.int64) for x in zip(*rows)) for c, rows in found.items()}


def _fill(filler: DataFrame, gap: DataFrame, n_gap: int, first_tail: int, key: str, length: int, n_tasks: int) -> DataFrame:
    """Pieces of the filler strip: the part beside the gaps goes into them, the part beyond is
    cut into sequences of its own."""
    cells = F.explode(F.sequence(F.floor(F.col("lo") / CELL), F.floor((F.col("hi") - 1) / CELL))).alias("cell")
    left = filler.select("lo", "hi", "k", "n", "ids", F.lit(None).cast("long").alias("seq"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("kind"), cells)
    right = gap.select("lo", "hi", F.lit(None).cast("long").alias("k"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("ids"), "seq", "used", F.lit(1).alias("kind"), cells)
    rows = left.unionByName(right).repartition(n_tasks, "cell").sortWithinPartitions("cell", "kind", "lo")
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["cell"], 2000):
            starts = [*group_starts(table, ["cell"]).tolist(), table.num_rows]
            lo, hi, cell, kind, seq, used, n = (table.column(c).to_numpy() for c in ("lo", "hi", "cell", "kind", "seq", "used", "n"))
            keys, ids = table.column("k").to_pylist(), table.column("ids")
            out: list[tuple] = []
            for a, b in zip(starts, starts[1:]):
                split = a + int((kind[a:b] == 0).sum())
                if split == a:
                    continue
                low, high = int(cell[a]) * CELL, (int(cell[a]) + 1) * CELL
                ends = max(min(high, int(hi[a:split].max())), low)
                marks = np.concatenate([lo[a:b], hi[a:b], np.arange(n_gap, ends + length, length) if ends > n_gap else []]).astype(np.int64)
                marks = np.unique(np.clip(marks, low, ends))
                doc = np.searchsorted(lo[a:split], marks[:-1], side="right") - 1 + a
                hole = np.searchsorted(lo[split:b], marks[:-1], side="right") - 1 + split
                for x, y, d, g in zip(marks[:-1].tolist(), marks[1:].tolist(), doc.tolist(), hole.tolist()):
                    if x < n_gap:
                        where, offset = int(seq[g]), int(used[g] + x - lo[g])
                    else:
                        where, offset = first_tail + (x - n_gap) // length, (x - n_gap) % length
                    raw = ids[d].as_py()
                    at = x - int(lo[d])
                    out.append((keys[d], int(n[d]) - len(raw) // 4 + at, y - x, zlib.crc32(raw[4 * at : 4 * (at + y - x)]), int(n[d]), where, offset))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(7)], names)

    return rows.mapInArrow(run, ", ".join(f"`{c}` long" for c in names))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_documents(docs: DataFrame, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """``docs`` packed with the 49k word vocabulary."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), False, 2, memo_bytes=memo_bytes)
