"""Line dedup by an exact set-similarity join.

A line is the set of its lower-cased words. Two lines match if the Jaccard similarity of their
sets is 0.8 or more. Words are ordered by how many lines hold them, rarest first, so two
matching lines share a word in their short prefixes; the places of that word, the sizes and
a parity bitmap of the sets refuse most other pairs, and the rest are verified on the sets
themselves. A line goes if any earlier line matches it.

The corpus is scanned three times instead of being shuffled: for line classes and word counts,
for prefixes, and for the word sets of the few lines that are verified. Words are hashed as
arrays over the bytes of many texts (words.py), and prefix entries travel as packed blocks, so
neither costs an object per word. Equal lines are one class (equal in the 64-bit hash of the
set and in 64 parity bits; two of n classes are confused with probability under n^2 / 2^100),
so copies are never compared with each other; lines of up to three words match nothing but
copies. A line is verified against its nearest earlier candidate; only where that fails and
there were more, against all.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import fresh, group_starts, slices, whole_groups
from .memory import claim
from .store import bound_batches, materialize, partitions, release
from .words import Lines, counter, mix

#: Lines with fewer distinct words, which is those without any, are left alone.
MIN_WORDS = 1
#: Sets of fewer words match equal sets only: they are in classes, but not in the join.
JOIN_WORDS = 4
#: Counters of words for each document; their number is a power of two within these bounds, and a
#: byte of each is broadcast. Words that share one share a rarity: the order stays total, so the
#: join stays exact.
COUNTERS, LEAST_COUNTERS, MOST_COUNTERS = 16, 1 << 16, 1 << 24
SLICE = 1 << 16
#: Lines of one prefix word that a task compares at once; more are dealt in pairs of blocks. A word
#: whose counter shows up to CALM lines has no more entries than that and is not counted again.
BLOCK, CALM = 4096, 16_384
#: Places that the entries of a busier word are spread over until they are counted.
SPREAD = 1024
#: Prefix entries in a bucket, about, and in the blocks that a task holds before it sends them.
BUCKET, HELD = 1_000_000, 1_000_000
#: Bits of the broadcast filter of lines to verify for each, within bounds. It may only let more pass.
FILTER_BITS, LEAST_FILTER, MOST_FILTER = 32, 1 << 17, 1 << 28
#: Lines that a task combines by class before they are shuffled, and documents, at most, whose lines
#: are in one bucket of classes on average.
COMBINE, BUCKET_DOCS = 100_000, 5000
#: Words of the sets that a task keeps while it verifies the pairs of a cell.
SET_WORDS = 200_000
#: Odd factor of a line's number in its hash, which is that of its document's key but for these bits.
STEP = 2654435761
#: Line classes that a task remembers in order to send each once; others are sent again.
SEEN = 300_000
ENTRY = "word int, cell long, shape long, before long, cls long, bitmap long"
PACKED = np.dtype([("word", "<u4"), ("cell", "<i2"), ("size", "<u4"), ("place", "<u4"), ("before", "<u8"), ("cls", "<i8"), ("bitmap", "<u8")])
#: A class: its first line, the number of its lines and 256 parity bits.
CLASS = np.dtype([("cls", "<i8"), ("bitmap", "<i8"), ("fk", "<i8"), ("fl", "<i4"), ("fh", "<i8"), ("n", "<i8"), ("wide", "<u8", 4)])
CLASS_SQL = "cls long, bitmap long, fk long, fl int, fh long, n long, wide binary"


def _power(n: float, least: int, most: int) -> int:
    """The power of two at or over ``n``, within bounds that are powers of two."""
    return min(most, max(least, 1 << max(0, int(n) - 1).bit_length()))


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of eight steps to a doubling, one byte each."""
    return np.minimum(8 * np.log2(1.0 + counts), 255).astype(np.uint8)


def _sum_counters(parts: DataFrame, counters: int) -> tuple[np.ndarray, int]:
    """Levels of the sums of slices ``s``, ``counts`` and the sum of all: a row per slice of SLICE
    counters reaches the driver, a byte each."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs = np.frombuffer(raw, "<u4").reshape(2, -1)
                held.setdefault(s, np.zeros(SLICE, np.int64))[pairs[0]] += pairs[1]
        rows = [pa.array(list(held), pa.int32()), pa.array([levels(v).tobytes() for v in held.values()], pa.binary()), pa.array([int(v.sum()) for v in held.values()], pa.int64())]
        yield pa.RecordBatch.from_arrays(rows, ["s", "levels", "total"])

    out, total = np.zeros(counters, np.uint8), 0
    dealt = parts.repartition(min(counters // SLICE, 4 * partitions(parts.sparkSession)), "s")
    for r in dealt.mapInArrow(add, "s int, levels binary, total long").toLocalIterator():
        out[r.s * SLICE : (r.s + 1) * SLICE] = np.frombuffer(bytes(r.levels), np.uint8)
        total += r.total
    return out, total


def _scan(docs: DataFrame, make: Callable[[pa.RecordBatch, Lines, dict], Iterator[list]], schema: pa.Schema, sql: str, end: Callable[[dict], Iterator[list]], level: np.ndarray | None = None) -> DataFrame:
    """Run ``make`` over the lines of slices of ``docs`` (columns k, th, t), with a dict that
    lives as long as the task, and ``end`` after the last. ``level``: as in Lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lines", lambda: None)
        held: dict = {}
        for batch in batches:
            for part in slices(batch, 2):
                for arrays in make(part, Lines(part.column(2).cast(pa.large_binary()).to_pylist(), level), held):
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        for arrays in end(held):
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return docs.mapInArrow(run, sql)


def _blocks(rows: np.ndarray, hashes: np.ndarray, buckets: int) -> tuple[pa.Array, pa.Array]:
    """The buckets that occur among the rows' hashes, and their rows' bytes."""
    bucket = (mix(hashes) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
    data, ends = rows.tobytes(), np.append(starts, len(rows)) * rows.itemsize
    return pa.array(bucket[starts].astype(np.int32)), pa.array([data[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.binary())


def _merged(rows: np.ndarray) -> np.ndarray:
    """Rows of CLASS with each class once: its first line and the sum of ``n``."""
    rows = rows[np.argsort(rows["cls"])]
    same = np.zeros(len(rows) + 1, bool)
    same[1:-1] = rows["cls"][1:] == rows["cls"][:-1]
    several = np.flatnonzero(same[1:] | same[:-1])
    part = rows[several]
    rows[several] = part[np.lexsort([part[c] for c in ("fh", "fl", "fk", "bitmap", "cls")])]
    starts = np.flatnonzero(~same[:-1] | np.append(True, rows["bitmap"][1:] != rows["bitmap"][:-1])[: len(rows)])
    out = rows[starts]
    out["n"] = np.add.reduceat(rows["n"], starts) if len(rows) else 0
    return out


def _classes(docs: DataFrame, counters: int, buckets: int) -> DataFrame:
    """A row per line; in rows with ``counts`` the number of lines of each counter's words (equal
    lines of a task count once, and those that the join leaves out do not), ``line`` being their
    slice; and in rows with ``block`` classes of up to COMBINE lines, ``line`` being their bucket."""
    schema = pa.schema([("k", pa.int64()), ("th", pa.int64()), ("line", pa.int32()), ("cls", pa.int64()), ("bitmap", pa.int64()), ("counts", pa.binary()), ("block", pa.binary())])
    least, seen, most = JOIN_WORDS, SEEN, COMBINE

    def send(held: dict) -> list:
        rows = _merged(np.concatenate(held["rows"]))
        held["rows"], held["n"] = [], 0
        names, data = _blocks(rows, rows["cls"].astype(np.uint64), buckets)
        none = pa.nulls(len(names), pa.int64())
        return [none, none, names, none, none, pa.nulls(len(names), pa.binary()), data]

    def make(batch: pa.RecordBatch, lines: Lines, held: dict) -> Iterator[list]:
        new = lines.new(held.setdefault("seen", set()), seen) & (lines.size >= least)
        total = held.setdefault("total", np.zeros(counters, np.uint32))
        np.add.at(total, counter(lines.words[new[lines.owner]], counters), np.uint32(1))
        k, th = (batch.column(i).to_numpy(zero_copy_only=False)[lines.row] for i in (0, 1))
        rows = np.empty(len(k), CLASS)
        rows["cls"], rows["bitmap"], rows["fk"], rows["fl"], rows["fh"], rows["n"], rows["wide"] = lines.cls, lines.bitmap, k, lines.line, th, 1, lines.wide()
        held.setdefault("rows", []).append(rows)
        held["n"] = held.get("n", 0) + len(rows)
        none = pa.nulls(len(k), pa.binary())
        yield [pa.array(k, pa.int64()), pa.array(th, pa.int64()), pa.array(lines.line), pa.array(lines.cls), pa.array(lines.bitmap), none, none]
        if held["n"] >= most:
            yield send(held)

    def end(held: dict) -> Iterator[list]:
        if held.get("n"):
            yield send(held)
        rows = []
        for s in range(0, counters if held else 0, SLICE):
            part = held["total"][s : s + SLICE]
            at = np.flatnonzero(part)
            if len(at):
                rows.append((s // SLICE, np.stack([at.astype("<u4"), part[at]]).tobytes()))
        none = pa.nulls(len(rows), pa.int64())
        yield [none, none, pa.array([s for s, _ in rows], pa.int32()), none, none, pa.array([c for _, c in rows], pa.binary()), pa.nulls(len(rows), pa.binary())]

    return _scan(docs, make, schema, "k long, th long, line int, cls long, bitmap long, counts binary, block binary", end)


def _firsts(blocks: DataFrame) -> DataFrame:
    """Each class (``cls``, ``bitmap``) once, from ``bucket`` and ``block``: its first line (``fk``,
    ``fl``, ``fh``), the number ``n`` of its lines and ``wide``. A task holds one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket"], 1):
            starts = [*group_starts(table, ["bucket"]).tolist(), table.num_rows]
            for a, b in zip(starts, starts[1:]):
                rows = _merged(np.concatenate([np.frombuffer(x.as_buffer(), CLASS) for x in table.column("block").slice(a, b - a)]))
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    wide = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(np.arange(len(part) + 1, dtype=np.int32) * 32), pa.py_buffer(np.ascontiguousarray(part["wide"]))])
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(part[c])) for c in CLASS.names[:-1]), wide], list(CLASS.names))

    dealt = blocks.repartition(partitions(blocks.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, CLASS_SQL)


def _entries(docs: DataFrame, level: np.ndarray, buckets: int) -> DataFrame:
    """Prefix entries as packed blocks: ``bucket`` and ``data``, rows of PACKED. Entries of a busy
    word have negative cells, which spread them, and are not compared yet. A word whose counter
    shows one line is in no other class: it has no entry."""
    schema = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])
    (alone, calm), least, seen, spread, most = levels(np.array([1, CALM])), JOIN_WORDS, SEEN, SPREAD, HELD

    def send(held: dict) -> Iterator[list]:
        if not held.get("n"):
            return
        rows = np.concatenate(held.pop("rows"))
        held["n"] = 0
        yield [*_blocks(rows, rows["word"].astype(np.uint64) << np.uint64(32) | rows["cell"].astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF), buckets)]

    def make(batch: pa.RecordBatch, lines: Lines, held: dict) -> Iterator[list]:
        owner, words, place, before = lines.prefixes(lines.new(held.setdefault("seen", set()), seen) & (lines.size >= least))
        rarity = level[counter(words, len(level))]
        shared = np.flatnonzero(rarity > alone)
        owner, words, rarity = owner[shared], words[shared], rarity[shared]
        rows = np.empty(len(owner), PACKED)
        cls = lines.cls[owner]
        rows["word"], rows["size"], rows["place"], rows["before"], rows["cls"], rows["bitmap"] = words & np.uint64(0xFFFFFFFF), lines.size[owner], place[shared], before[shared], cls, lines.bitmap[owner].view(np.uint64)
        rows["cell"] = np.where(rarity > calm, -1 - (mix(cls.view(np.uint64)) % np.uint64(spread)).astype(np.int64), 0)
        held.setdefault("rows", []).append(rows)
        held["n"] = held.get("n", 0) + len(rows)
        if held["n"] >= most:
            yield from send(held)

    return _scan(docs, make, schema, "bucket int, data binary", send, level=level)


def _compare(group: np.ndarray, size: np.ndarray, place: np.ndarray, before: np.ndarray, cls: np.ndarray, bitmap: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group that pass the size, place and bitmap filters, step by step. Rows are
    sorted by group (numbers from 0) and size, so those that a row's size allows follow it. Two
    lines that share the word before too (0: none) meet at that one or an earlier one."""
    key = group.astype(np.uint64) << np.uint64(32) | size.astype(np.uint64)
    ends = np.searchsorted(key, group.astype(np.uint64) << np.uint64(32) | np.minimum(size * 5 // 4, 2**32 - 1).astype(np.uint64), side="right")
    left = 9 * (size - place)
    rows, step = np.flatnonzero(left >= 8 * size), 1
    while True:
        rows = rows[rows + step < ends[rows]]
        if not len(rows):
            return
        other = rows + step
        total = size[rows] + size[other]
        ok = np.minimum(left[rows], left[other]) >= 4 * total
        a, b = rows[ok], other[ok]
        total = total[ok]
        ok = np.bitwise_count(bitmap[a] ^ bitmap[b]) <= total - 2 * ((4 * total + 8) // 9)
        ok &= (before[a] != before[b]) | (before[a] == 0)
        ok &= (cls[a] != cls[b]) | (bitmap[a] != bitmap[b])
        yield a[ok], b[ok]
        step += 1


def _compare_packed(rows: np.ndarray) -> np.ndarray:
    """The rows that pass the filters with another class of their word."""
    order = np.argsort(rows["word"].astype(np.uint64) << np.uint64(32) | rows["size"])
    rows = rows[order]
    word = rows["word"]
    group = np.cumsum(np.concatenate([[0], word[1:] != word[:-1]])) if len(rows) else np.zeros(0, np.int64)
    hit = np.zeros(len(rows), bool)
    for a, b in _compare(group, rows["size"].astype(np.int64), rows["place"].astype(np.int64), rows["before"], rows["cls"], rows["bitmap"]):
        hit[a] = hit[b] = True
    return rows[hit]


def _candidates(entries: DataFrame) -> DataFrame:
    """Entries that pass the filters with another class of their word, and the busy ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket"], 1):
            starts = [*group_starts(table, ["bucket"]).tolist(), table.num_rows]
            for a, b in zip(starts, starts[1:]):
                rows = np.concatenate([np.frombuffer(x.as_buffer(), PACKED) for x in table.column("data").slice(a, b - a)])
                busy = rows["cell"] < 0
                for out in (rows[busy], _compare_packed(rows[~busy])):
                    shape = out["size"].astype(np.int64) << 32 | out["place"]
                    columns = [out["word"].view(np.int32) if len(out) else np.zeros(0, np.int32), out["cell"].astype(np.int64), shape, out["before"].view(np.int64), out["cls"], out["bitmap"].view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["word", "cell", "shape", "before", "cls", "bitmap"])

    dealt = entries.repartition(partitions(entries.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, ENTRY)


def _compare_table(table: pa.Table) -> tuple[pa.Table, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """A table of whole groups of word and cell, sorted by group and size, and its pairs."""
    starts = group_starts(table, ["word", "cell"])
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
    shape = table.column("shape").to_numpy()
    order = np.lexsort((shape >> 32, group))
    table, shape = table.take(pa.array(order)), shape[order]
    return table, _compare(group, shape >> 32, shape & 0xFFFFFFFF, *(table.column(c).to_numpy() for c in ("before", "cls")), table.column("bitmap").to_numpy().view(np.uint64))


def _busy_candidates(busy: DataFrame) -> DataFrame:
    """As ``_candidates``, of entries dealt to cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["word", "cell"]):
            table, pairs = _compare_table(table)
            hit = np.zeros(table.num_rows, bool)
            for a, b in pairs:
                hit[a] = hit[b] = True
            yield from table.filter(pa.array(hit)).to_batches()

    dealt = busy.repartition(partitions(busy.sparkSession), "word", "cell").sortWithinPartitions("word", "cell")
    return dealt.mapInArrow(run, ENTRY)


def _deal_busy(busy: DataFrame) -> DataFrame:
    """Busy entries with their words counted: an entry of a word with more than BLOCK entries goes
    to every pair of blocks that holds its own. Of a class that several tasks sent, one entry
    stays."""
    busy = busy.select("word", "shape", "before", "cls", "bitmap").distinct()
    busy = materialize(busy, "busy-entries")
    counts = materialize(busy.groupBy("word").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"), F.count("*").alias("m")).where("m > 1"), "busy-words")
    own = F.pmod(F.xxhash64("cls", "bitmap"), F.col("blocks"))
    rows = busy.join(counts, "word").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.select("word", (F.shiftleft(F.least("own", "other"), 32) + F.greatest("own", "other")).alias("cell"), "shape", "before", "cls", "bitmap")


def _nearest(rows: DataFrame) -> DataFrame:
    """For each row its most similar earlier candidate in its cell, by 256 parity bits, which also
    refuse more pairs: ``cls``, ``bitmap``, ``cls_x``, ``bitmap_x``, ``apart``, the share of words
    that the bits show to differ, and ``more``, whether there were other candidates. A row that is
    but a candidate itself comes with nulls, one that is neither does not come."""
    keys = ["word", "cell"]
    names = ["cls", "bitmap", "cls_x", "bitmap_x", "apart", "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            n = table.num_rows
            table, pairs = _compare_table(table)
            order = np.lexsort([table.column(c).to_numpy() for c in ("bitmap", "cls", "fh", "fl", "fk")])
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            wide = np.frombuffer(b"".join(table.column("wide").to_pylist()), np.uint64).reshape(n, 4)
            size = table.column("shape").to_numpy() >> 32
            best, lead, count, hit = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
            for a, b in pairs:
                differ = np.bitwise_count(wide[a] ^ wide[b]).sum(1).astype(np.int64)
                total = size[a] + size[b]
                ok = differ <= total - 2 * ((4 * total + 8) // 9)
                a, b, apart = a[ok], b[ok], differ[ok] / total[ok]
                hit[a] = hit[b] = True
                later, earlier = np.where(rank[a] < rank[b], b, a), np.where(rank[a] < rank[b], a, b)
                # within a step a row is once the first and once the second of a pair at most
                for side in (later == a, later == b):
                    y, x, d = later[side], earlier[side], apart[side]
                    better = d < best[y]
                    best[y[better]], lead[y[better]] = d[better], x[better]
                    count[y] += 1
            y = np.flatnonzero(hit)
            x, none = lead[y], count[y] == 0
            cls, bitmap = table.column("cls").to_numpy(), table.column("bitmap").to_numpy()
            found = [pa.array(cls[y]), pa.array(bitmap[y])] + [pa.array(f, mask=none) for f in (cls[x], bitmap[x], best[y], count[y] > 1)]
            yield pa.RecordBatch.from_arrays(found, names)

    dealt = rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "cls long, bitmap long, cls_x long, bitmap_x long, apart double, more boolean")


def _filter(values: DataFrame, count: int) -> np.ndarray:
    """Packed bits of the hashes in the one column ``h``, FILTER_BITS for each of ``count``."""
    bits = _power(FILTER_BITS * count, LEAST_FILTER, MOST_FILTER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            at = _place_in_filter(batch.column(0).to_numpy(), bits)
            for s in np.unique(at >> 17).tolist():
                found.setdefault(s, np.zeros(1 << 17, bool))[at[at >> 17 == s] & 0x1FFFF] = True
        packed = [np.packbits(v).tobytes() for v in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(packed, pa.binary())], ["s", "bits"])

    out = np.zeros((bits >> 17, 1 << 14), np.uint8)
    slot = F.shiftright(F.pmod("h", F.lit(bits)), 17)
    dealt = values.withColumn("p", slot).repartition(min(len(out), 4 * partitions(values.sparkSession)), "p").select("h")
    for r in dealt.mapInArrow(run, "s int, bits binary").toLocalIterator():
        out[r.s] |= np.frombuffer(bytes(r.bits), np.uint8)
    return out.ravel()


def _place_in_filter(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes & (bits - 1)


def _passes(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _place_in_filter(hashes, 8 * len(packed))
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _word_sets(docs: DataFrame, of_docs: np.ndarray, of_lines: np.ndarray) -> DataFrame:
    """``cls``, ``bitmap`` and ``body``, the compressed words, of the lines that the filters of
    documents and of lines let pass; other lines are not hashed."""
    schema = pa.schema([("cls", pa.int64()), ("bitmap", pa.int64()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lines", lambda: None)
        for batch in batches:
            for part in slices(batch.filter(pa.array(_passes(of_docs, batch.column(1).to_numpy()))), 0):
                texts = [t.split(b"\n") for t in part.column(0).cast(pa.large_binary()).to_pylist()]
                many = np.array([len(t) for t in texts], np.int64)
                at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                pick = np.flatnonzero(_passes(of_lines, np.repeat(part.column(1).to_numpy(), many) ^ at * STEP))
                flat = [x for t in texts for x in t]
                lines = Lines([flat[i] for i in pick.tolist()])
                bodies = [zlib.compress("\n".join(lines.text_of(i)).encode("utf-8", "surrogatepass"), 1) for i in range(len(lines.kept))]
                yield pa.RecordBatch.from_arrays([pa.array(lines.cls), pa.array(lines.bitmap), pa.array(bodies, pa.binary())], schema=schema)

    return docs.select("t", F.xxhash64("k").alias("kh")).mapInArrow(run, "cls long, bitmap long, body binary")


def _words_of(body: bytes) -> set[str]:
    return set(zlib.decompress(body).decode("utf-8", "surrogatepass").split("\n"))


def _similar(a: set[str], b: set[str]) -> bool:
    return 9 * len(a & b) >= 4 * (len(a) + len(b))


def _verify_led(rows: DataFrame) -> DataFrame:
    """``cls``, ``bitmap``, ``more`` and ``dead`` of each member: whether its leader matches it."""
    keys = ["cls_x", "bitmap_x", "salt"]
    names = ["cls", "bitmap", "more", "dead"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, 4096):
            starts = [*group_starts(table, keys).tolist(), table.num_rows]
            member, body = table.column("member").to_pylist(), table.column("body")
            dead = np.zeros(table.num_rows, bool)
            for a, b in zip(starts, starts[1:]):
                lead = _words_of(body[a].as_py()) if not member[a] else None
                for i in range(a, b):
                    if member[i] and lead is not None:
                        dead[i] = _similar(lead, _words_of(body[i].as_py()))
            out = table.append_column("dead", pa.array(dead)).filter(table.column("member")).select(names)
            yield from out.to_batches()

    dealt = rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, "member")
    return dealt.mapInArrow(run, "cls long, bitmap long, more boolean, dead boolean")


def _matched(table: pa.Table, pairs: Iterator[tuple[np.ndarray, np.ndarray]], ask: np.ndarray | None = None) -> np.ndarray:
    """Rows (of those in ``ask``) of which an earlier one is a match, among ``pairs``. A row's set is
    made once, while the sets held stay within SET_WORDS words."""
    order = np.lexsort([table.column(c).to_numpy() for c in ("bitmap", "cls", "fh", "fl", "fk")])
    rank = np.empty(table.num_rows, np.int64)
    rank[order] = np.arange(table.num_rows)
    body, dead = table.column("body"), np.zeros(table.num_rows, bool)
    sets: dict[int, set[str]] = {}
    held = 0

    def words(i: int) -> set[str]:
        nonlocal held
        found = sets.get(i)
        if found is None:
            found = _words_of(body[i].as_py())
            if held > SET_WORDS:
                sets.clear()
                held = 0
            sets[i] = found
            held += len(found)
        return found

    for a, b in pairs:
        later, earlier = np.where(rank[a] < rank[b], b, a), np.where(rank[a] < rank[b], a, b)
        if ask is not None:
            later, earlier = later[ask[later]], earlier[ask[later]]
        for y, x in zip(later.tolist(), earlier.tolist()):
            if not dead[y]:
                dead[y] = _similar(words(y), words(x))
    return dead


def _verify(rows: DataFrame) -> DataFrame:
    """Classes (``cls``, ``bitmap``) that are ``open`` and of which a class with an earlier first line
    is a match: the pairs of each cell that pass the filters, until a match is found."""
    keys = ["word", "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, 4096):
            table, pairs = _compare_table(table)
            ask = table.column("open").to_numpy()
            yield from table.select(["cls", "bitmap"]).filter(pa.array(_matched(table, pairs, ask))).to_batches()

    dealt = rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "cls long, bitmap long")


def _verified(docs: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Classes that an earlier class matches: the nearest candidate of each, its leader, or,
    where that fails though there were more, any of the cells in ``found``. ``pairs`` has all
    classes that have candidates or are some.

    The members of a leader are dealt in parts of BLOCK, each with its own copy of the leader.
    """
    same, lead = ["cls", "bitmap"], ["cls_x", "bitmap_x"]
    sets = materialize(_sets_of(docs, found, pairs), "line-sets")
    pairs = pairs.where("cls_x is not null").select(*same, *lead, "more")
    sizes = materialize(pairs.groupBy(*lead).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts")), "line-leaders")
    salt = F.pmod(F.xxhash64(*same), F.col("parts"))
    members = pairs.join(sizes, lead).select(*same, *lead, salt.alias("salt"), F.lit(True).alias("member"), "more")
    leaders = sizes.select(F.col("cls_x").alias("cls"), F.col("bitmap_x").alias("bitmap"), *lead, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), F.lit(False).alias("member"), F.lit(False).alias("more"))
    tested = materialize(_verify_led(members.unionByName(leaders).join(sets, same)), "line-matches")
    release(docs.sparkSession)
    dead = tested.where("dead").select(*same, "dead")
    open_ = tested.where("more and not dead").select(*same, F.lit(True).alias("open"))
    if open_.isEmpty():
        return dead
    cells = found.join(open_, same, "left_semi").select("word", "cell").distinct()
    rows = found.join(cells, ["word", "cell"], "left_semi").join(open_, same, "left").withColumn("open", F.coalesce("open", F.lit(False)))
    rest = _verify(rows.drop("wide").join(sets, same))
    return dead.unionByName(rest.select(*same, F.lit(True).alias("dead"))).distinct()


def _sets_of(docs: DataFrame, found: DataFrame, named: DataFrame) -> DataFrame:
    """Word sets of the classes ``named``, which are in ``found``, each once, from their first lines."""
    same = ["cls", "bitmap"]
    named = materialize(found.select(*same, "fk", "fl").distinct().join(named.select(*same), same, "left_semi"), "lines-to-verify")
    n = named.count()
    of_docs = _filter(named.select(F.xxhash64("fk").alias("h")).distinct(), n)
    of_lines = _filter(named.select(F.xxhash64("fk").bitwiseXOR(F.col("fl").cast("long") * STEP).alias("h")), n)
    return _word_sets(docs, of_docs, of_lines).dropDuplicates(same)


def removed_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``k`` (the key), ``th`` (hash of the text) and ``removed`` (line numbers from 0) of the
    documents that lose lines."""
    spark = df.sparkSession
    bound_batches(spark)
    docs = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.col(text).cast("string").alias("t"))
    count = df.count()
    counters = _power(COUNTERS * count, LEAST_COUNTERS, MOST_COUNTERS)
    scanned = materialize(_classes(docs, counters, max(partitions(spark), count // BUCKET_DOCS)), "lines")
    level, total = _sum_counters(scanned.where("counts is not null").select(F.col("line").alias("s"), "counts"), counters)
    lines = scanned.where("cls is not null").select("k", "th", "line", "cls", "bitmap")
    same = ["cls", "bitmap"]
    classes = materialize(_firsts(scanned.where("block is not null").select(F.col("line").alias("bucket"), "block")), "line-classes")
    release(spark)

    buckets = max(4 * partitions(spark), total // (4 * BUCKET))  # about a quarter of the words are in prefixes
    compared = materialize(_candidates(_entries(docs, level, buckets)), "line-candidates")
    release(spark)
    busy = _busy_candidates(_deal_busy(compared.where("cell < 0")))
    release(spark)  # only now do the entries go
    found = compared.where("cell >= 0").unionByName(busy)
    found = materialize(found.hint("shuffle_hash").join(classes.select(*same, "fk", "fl", "fh", "wide"), same), "line-candidates")
    several = F.bool_or("more") | (F.min("cls_x") != F.max("cls_x"))
    pairs = _nearest(found).groupBy(*same).agg(F.min_by(F.struct("cls_x", "bitmap_x"), F.when(F.col("cls_x").isNotNull(), F.struct("apart", "cls_x"))).alias("x"), several.alias("more"))
    pairs = materialize(pairs.select(*same, "x.*", "more"), "line-pairs")
    release(spark)
    dead = _verified(docs, found, pairs)

    gone = materialize(classes.join(dead.hint("shuffle_hash"), same, "left").where("n > 1 or dead").select(F.col("cls").alias("c_"), F.col("bitmap").alias("b_"), "fk", "fl", "fh", F.coalesce("dead", F.lit(False)).alias("dead")), "gone-lines")
    later = F.col("dead") | (F.struct("k", "line", "th") > F.struct(F.col("fk").alias("k"), F.col("fl").alias("line"), F.col("fh").alias("th")))
    out = lines.join(gone.hint("shuffle_hash"), (F.col("cls") == F.col("c_")) & (F.col("bitmap") == F.col("b_"))).where(later)
    return out.groupBy("k", "th").agg(F.collect_set("line").alias("removed"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without the lines that match an earlier line; adds ``n_lines`` and ``n_removed``
    (columns of these names are replaced).

    Lines are ordered by key, then line number; where rows with one key have different texts,
    then by the text's hash. Rows that repeat key and text are one document and keep the same
    lines. Lines without words stay, as do all other rows, columns and null values; a null text has no lines, and a row with a null key has no place in the
    order: it is left alone and removes nothing. An empty table gives an empty result.
    """
    k, h, t, gone = fresh(df, "k", "h", "t", "removed")
    found = materialize(removed_lines(df, key, text), "removed-lines").select(F.col("k").alias(k), F.col("th").alias(t), F.col("removed").alias(gone))
    release(df.sparkSession)
    rows = df.drop("n_lines", "n_removed").withColumn(h, F.xxhash64(F.col(text).cast("string")))
    joined = rows.join(found.hint("shuffle_hash"), (F.col(key) == F.col(k)) & (F.col(h) == F.col(t)), "left")
    parts = F.split(F.col(text), "\n")
    n_lines = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    columns = [F.when(F.col(gone).isNotNull(), kept).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in df.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*columns, F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later matching lines."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_lines", "n_removed", "text")
