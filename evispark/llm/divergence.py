"""Source divergence audit by sort-based streaming.

Tasks count the terms of their documents and emit partial rows (lang, term, source, document).
These are repartitioned by (lang, term) and sorted within partitions; one scan adds up the runs:
a run's document frequency decides whether the term is kept, and its counts by source follow. A
second pass sorts the kept counts the same way, behind a row for each source of the language; its
scan turns counts to smoothed probabilities and emits, per run of terms, partial sums for pairs of
sources and the leading terms of each source.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import bound_batches, materialize, partitions

LEAST_DOCS, SMOOTH, TOP_TERMS = 30, 5, 50
#: Counted entries that a task holds before it emits them, and bytes of a text that are split at once.
HELD_ENTRIES, PIECE_BYTES = 300_000, 1 << 20
#: Cells (term by source) of probabilities that a task holds, and kept terms of a task at least.
CELLS, BUCKET_TERMS = 1 << 20, 64
#: Letters A-Z lower-cased; a-z and all bytes of characters beyond ASCII kept; the rest separates terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Lists of the terms of a text in UTF-8, of PIECE_BYTES each."""
    folded = text.translate(FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE_BYTES)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial rows: documents and occurrences of a term in a run of a task's documents. The term
    '' stands for the documents themselves."""
    task = TaskContext.get()
    first = place = (task.partitionId() if task else 0) << 40
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = 0
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
            group = held.get((lang, source))
            if group is None:
                group = held[lang, source] = (Counter(), Counter())
            counts, docs = group
            before = len(docs)
            seen = {b""}
            for piece in terms(text.as_py()):
                counts.update(piece)
                seen.update(piece)
            docs.update(seen)
            entries += len(docs) - before
            place += 1
            if entries >= HELD_ENTRIES:
                yield from _emitted(held, first)
                held, entries, first = {}, 0, place
    yield from _emitted(held, first)


def _emitted(held: dict[tuple[str, str], tuple[Counter, Counter]], first: int) -> Iterator[pa.RecordBatch]:
    for (lang, source), (counts, docs) in held.items():
        n = len(docs)
        names = pa.array(list(docs), pa.binary()).cast(pa.string())
        numbers = [np.full(n, first), np.fromiter(docs.values(), np.int64, n), np.fromiter(map(counts.__getitem__, docs), np.int64, n)]
        batch = pa.RecordBatch.from_arrays([pa.repeat(lang, n), names, pa.repeat(source, n), *map(pa.array, numbers)], ["lang", "term", "source", "document", "docs", "occurs"])
        for at in range(0, n, 50_000):
            yield batch.slice(at, 50_000)


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether each row differs from the one before in any key; nulls equal nulls."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in keys:
        column = table.column(key).combine_chunks()
        a, b = column.slice(1), column.slice(0, max(len(column) - 1, 0))
        same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
        new[1:] |= ~(same | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False)))
    return new


def _whole_runs(batches: Iterable[pa.RecordBatch], run: list[str], sums: list[str]) -> Iterator[pa.Table]:
    """Tables with whole runs only, rows of equal (run, source) added up. What is held back between
    batches has one row per source of the last run."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]).select([*run, "source", *sums])
        table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        starts = np.flatnonzero(_changes(table, [*run, "source"]))
        columns = [np.add.reduceat(table.column(c).to_numpy(), starts) for c in sums]
        table = table.select([*run, "source"]).take(pa.array(starts))
        for name, column in zip(sums, columns):
            table = table.append_column(name, pa.array(column))
        last = int(np.flatnonzero(_changes(table, run))[-1])
        if last:
            yield table.slice(0, last)
        held = table.slice(last)
    if held is not None:
        yield held


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by source of the terms in LEAST_DOCS documents or more, the language's under a null
    source; and a row with the term '' for each source."""
    for table in _whole_runs(batches, ["lang", "term"], ["docs", "occurs"]):
        starts = np.flatnonzero(_changes(table, ["lang", "term"]))
        sizes = np.diff([*starts, table.num_rows])
        known = pc.not_equal(table.column("term"), "").to_numpy()
        enough = np.repeat(np.add.reduceat(table.column("docs").to_numpy(), starts) >= LEAST_DOCS, sizes)
        rows = table.filter(pa.array(~known | enough)).select(["lang", "term", "source", "occurs"])
        yield from rows.to_batches()
        at = starts[(known & enough)[starts]]
        totals = np.add.reduceat(table.column("occurs").to_numpy(), starts)[(known & enough)[starts]]
        if len(at):
            whole = table.select(["lang", "term"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([whole.column("lang").combine_chunks(), whole.column("term").combine_chunks(), pa.nulls(len(at), pa.string()), pa.array(totals)], ["lang", "term", "source", "occurs"])


def probability(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + SMOOTH) / total), exactly: the quotient is taken three digits at a
    time, so that no product leaves 64 bits for totals up to 9e15."""
    rest = count + SMOOTH
    out, rest = rest // total, rest % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def _partials(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of pairs and leading terms, from rows sorted by language, bucket, term and
    source. A bucket begins with the term '', whose numbers are the denominators of the language
    (null source) and of each of its sources; runs of terms with their counts follow."""
    key, names, below, lang_below, chunks = None, [], np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for table in _whole_runs(batches, ["lang", "bucket", "term"], ["n"]):
        edges = [*np.flatnonzero(_changes(table, ["lang", "bucket"])).tolist(), table.num_rows]
        for a, b in zip(edges, edges[1:]):
            rows = table.slice(a, b - a).combine_chunks()
            here = rows.column("lang")[0].as_py(), rows.column("bucket")[0].as_py()
            if here != key:
                if key and not chunks:
                    yield from _pairs(key[0], names, np.zeros((0, len(names)), np.int64))
                heads = int(pc.sum(pc.equal(rows.column("term"), "")).as_py())
                key, names, chunks = here, rows.column("source").slice(1, heads - 1).to_pylist(), 0
                numbers = rows.column("n").to_numpy()
                lang_below, below, rows = numbers[:1], numbers[1:heads], rows.slice(heads).combine_chunks()
            first = np.flatnonzero(rows.column("source").is_null().to_numpy())
            step = max(1, CELLS // max(1, len(names)))
            for low in range(0, len(first), step):
                end = first[low + step] if low + step < len(first) else rows.num_rows
                chunks += 1
                yield from _chunk(here[0], names, below, lang_below, rows.slice(first[low], end - first[low]))
    if key and not chunks:
        yield from _pairs(key[0], names, np.zeros((0, len(names)), np.int64))


def _chunk(lang: str, names: list[str], below: np.ndarray, lang_below: np.ndarray, rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Partials of some whole runs of terms."""
    head = rows.column("source").is_null().to_numpy()
    term, count = np.cumsum(head) - 1, rows.column("n").to_numpy()
    source = pc.index_in(rows.column("source").filter(pa.array(~head)), pa.array(names, pa.string())).to_numpy().astype(np.int64)
    overall, term, count = probability(count[head], lang_below), term[~head], count[~head]
    p = np.repeat(probability(np.zeros(len(names), np.int64), below)[None], len(overall), 0)
    p[term, source] = found = probability(count, below[source])
    yield from _pairs(lang, names, p)
    more = found - overall[term]
    order = np.lexsort((term, -more, source))
    order = order[more[order] > 0]
    order = order[np.arange(len(order)) - np.searchsorted(source[order], source[order]) < TOP_TERMS]
    items = rows.column("term").filter(pa.array(head)).take(pa.array(term[order]))
    yield _found(lang, pa.array(names, pa.string()).take(pa.array(source[order])), "term", items.combine_chunks(), more[order])


def _pairs(lang: str, names: list[str], p: np.ndarray) -> Iterator[pa.RecordBatch]:
    for s, name in enumerate(names):
        others = pa.array(names[:s] + names[s + 1 :], pa.string())
        yield _found(lang, pa.repeat(name, len(others)), "pair", others, np.delete(np.abs(p - p[:, s : s + 1]).sum(0), s))


def _found(lang: str, source: pa.Array, part: str, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.repeat(lang, len(item)), source, pa.repeat(part, len(item)), item, pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """How the terms of each source differ from those of the other sources of its language.

    Terms are runs of letters A-Z, a-z and characters beyond ASCII, with A-Z lower-cased. A language
    keeps its terms of LEAST_DOCS documents or more. With count occurrences in a group and N of all
    kept terms, p = 1 + floor(10^9 (count + 5) / (N + 5 V)). Rows of part ``pair`` give, for each
    other source of the language, the sum of abs(p - q) over all kept terms (0 if there are none);
    rows of part ``term`` give the TOP_TERMS kept terms that the source has and whose p exceeds the
    language's by most. Returns lang, source, part, item, value, rank (from 1 per group and part,
    by value descending, then item by its UTF-8 bytes).

    Null language, source and text count as empty; a source without terms takes part in pairs. Each
    row is a document of its own, repeated ones too. Texts of any length are read whole. An empty
    table gives an empty result; other columns are not read. Counts are exact below 9e15.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    n = partitions(spark)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
    entries = rows.mapInArrow(_entries, "lang string, term string, source string, document long, docs long, occurs long")
    run = ["lang", "term", "source", "document"]
    entries = entries.repartition(n, "lang", "term").sortWithinPartitions(*run)
    kept = materialize(entries.mapInArrow(_kept, "lang string, term string, source string, occurs long"), "divergence-counts")

    is_term = F.when(F.col("term") != "", F.lit(1))
    size = kept.where("source is null").groupBy("lang").agg(F.count("*").alias("v"))
    size = kept.select("lang").distinct().join(size, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"))
    size = materialize(size.withColumn("buckets", F.least(F.lit(n), 1 + F.expr(f"v div {BUCKET_TERMS}")).cast("int")), "divergence-languages")
    # a language's own total is the sum over its sources
    total = kept.where("source is not null").groupBy("lang", "source").agg(F.sum(F.col("occurs") * F.coalesce(is_term, F.lit(0))).alias("n"))
    total = total.unionByName(total.groupBy("lang").agg(F.sum("n").alias("n")).withColumn("source", F.lit(None).cast("string")))
    heads = total.join(size, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), F.lit("").alias("term"), "source", (F.col("n") + SMOOTH * F.col("v")).alias("n"))
    counts = kept.where("term != ''").join(size, "lang").select("lang", F.pmod(F.xxhash64("term"), "buckets").cast("int").alias("bucket"), "term", "source", F.col("occurs").alias("n"))
    both = heads.unionByName(counts).repartition(n, "lang", "bucket").sortWithinPartitions("lang", "bucket", "term", "source")
    found = both.mapInArrow(_partials, "lang string, source string, part string, item string, value long")
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of all documents."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
    SELECT r, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
    FROM (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM docs)),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY lang, source),
cells AS (
    SELECT lang, source, term, coalesce(c, 0) AS c,
        1 + (1000000000 * (coalesce(c, 0) + 5)::HUGEINT) // (coalesce(n, 0) + 5 * v)::HUGEINT AS p
    FROM groups JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN counts USING (lang, source, term) LEFT JOIN totals USING (lang, source)),
overall AS (
    SELECT lang, term, 1 + (1000000000 * (sum(c) + 5)::HUGEINT) // ((SELECT sum(n) FROM totals t WHERE t.lang = cells.lang) + 5 * any_value(v))::HUGEINT AS q
    FROM cells JOIN sizes USING (lang) GROUP BY lang, term),
pairs AS (
    SELECT g.lang, g.source, h.source AS item, coalesce(sum(abs(a.p - b.p)), 0)::BIGINT AS value
    FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
    LEFT JOIN cells a ON a.lang = g.lang AND a.source = g.source
    LEFT JOIN cells b ON b.lang = h.lang AND b.source = h.source AND b.term = a.term
    GROUP BY g.lang, g.source, h.source),
ahead AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM cells JOIN overall USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM ahead))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
