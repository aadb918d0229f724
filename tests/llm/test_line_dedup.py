import random
import zlib

import pyarrow as pa
import pytest

from evispark.llm import line_dedup
from evispark.llm.line_dedup import MIN_WORDS, dedup_lines, op10_line_dedup
from evispark.llm.words import LEAST_UNCASED, lower_utf8

SCHEMA = "doc_id long, text string"


def brute(rows):
    """Kept text of each row, from the definition; rows have distinct keys or equal texts."""
    lines = []
    for k, t in sorted({(k, t) for k, t in rows if k is not None and t is not None}):
        lines += [(k, t, i, frozenset(x.lower().split())) for i, x in enumerate(t.split("\n"))]
    gone, before = set(), []
    for k, t, i, s in lines:
        if len(s) >= MIN_WORDS:
            if any(5 * len(s & e) >= 4 * len(s | e) for e in before):
                gone.add((k, t, i))
            before.append(s)
    out = []
    for k, t in rows:
        kept = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (k, t, i) not in gone)
        n = 0 if t is None else len(t.split("\n"))
        out.append((k, kept, n, n - (0 if t is None else len([i for i in range(n) if (k, t, i) not in gone]))))
    return sorted(out, key=str)


def corpus(n, seed=4):
    rng = random.Random(seed)
    common, rare = ["the", "of", "and", "é", "to", "In"], [f"w{i}" for i in range(400)]
    lines, rows = [], []
    for d in range(n):
        mine = []
        for _ in range(rng.randrange(0, 7)):
            if lines and rng.random() < 0.5:
                words = rng.choice(lines).split()
                for _ in range(rng.randrange(0, 4)):
                    if words:
                        words[rng.randrange(len(words))] = rng.choice(rare)
                rng.shuffle(words)
            else:
                words = rng.choices(common, k=rng.randrange(0, 8)) + rng.choices(rare, k=rng.randrange(0, 30))
            mine.append(rng.choice([" ", "\t"]).join(words))
            lines.append(mine[-1])
        rows.append((d * 3 - 20, "\n".join(mine)))
    return rows


@pytest.mark.parametrize(("block", "calm", "blind"), [(4096, 16_384, False), (3, 2, False), (4096, 16_384, True)])
def test_matches_brute_force(spark, monkeypatch, block, calm, blind):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    monkeypatch.setattr(line_dedup, "CALM", calm)
    if blind:  # first candidates that fail: all of their cells are verified
        real = line_dedup._nearest
        monkeypatch.setattr(line_dedup, "_nearest", lambda rows: real(rows).selectExpr("cls", "bitmap", "0L cls_x", "0L bitmap_x", "apart", "true more").where("pmod(cls, 2) = 0").unionAll(real(rows).where("pmod(cls, 2) = 1")))
    rows = corpus(150) + [(None, "a b c d e f"), (None, None), (5000, None), (5001, ""), (5002, "\n\n"), (1, corpus(9)[8][1])]
    rows += [rows[9], rows[9]]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS cls", "1 AS k", "2 AS n_removed").repartition(3)
    got = dedup_lines(df)
    assert got.columns == ["doc_id", "text", "cls", "k", "n_lines", "n_removed"]
    found = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str)
    assert found == brute(rows)
    assert sum(r[3] for r in found) > 50


def test_threshold_is_exact(spark):
    base = [f"t{i}" for i in range(9)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:8], "x"])), (3, " ".join([*base, "y", "z"])), (4, " ".join([*base, "y", "z", "q"])), (5, " ".join(base[:4])), (6, " ".join(base[:4]))]
    kept = {r.doc_id: r.n_removed for r in dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0, 6: 1}


def test_long_text_and_empty_table(spark):
    long = "\n".join(" ".join(f"v{i * 7 + j}" for j in range(6)) for i in range(3000))
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame([(1, long), (2, long + "\nshort")], SCHEMA)).collect()}
    assert got[1].text == long and got[2].text == "short" and got[2].n_removed == 3000
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in op10_line_dedup(spark, sf).collect()), key=str)
    assert got == brute(rows)


def test_short_lines(spark):
    rows = [(1, "All rights reserved.\n\na b c d"), (2, "all RIGHTS  reserved.\n\nd c b a e"), (3, "x\n \na b c\nno no no no no yes"), (4, "X\n\na b\nyes no"), (5, "a b c x\na b c d e f")]
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("", 2), 3: (rows[2][1], 0), 4: ("\na b", 2), 5: ("a b c x", 1)}


@pytest.mark.parametrize(("most", "made"), [(200_000, 40), (0, 781)])
def test_verification_makes_each_set_once(monkeypatch, most, made):
    n, calls = 40, []
    sets = [{f"w{i}-{k}" for k in range(10)} for i in range(n - 1)] + [{f"w0-{k}" for k in range(10)}]
    bodies = [zlib.compress("\n".join(sorted(s)).encode()) for s in sets]
    table = pa.table({"bitmap": [0] * n, "cls": range(n), "fh": [0] * n, "fl": [0] * n, "fk": range(n), "body": bodies})
    pairs = [line_dedup.np.array(p).T for p in [[(i, i + step) for i in range(n - step)] for step in range(1, n)]]
    real = line_dedup._words_of
    monkeypatch.setattr(line_dedup, "SET_WORDS", most)
    monkeypatch.setattr(line_dedup, "_words_of", lambda body: calls.append(1) or real(body))
    assert line_dedup._matched(table, iter(pairs)).nonzero()[0].tolist() == [n - 1]
    assert len(calls) == made if most else len(calls) >= made


def test_lower_case_is_that_of_python():
    chars = [chr(i) for i in range(LEAST_UNCASED) if not 0xD800 <= i < 0xE000]
    assert all(chr(i).lower() == chr(i) for i in range(LEAST_UNCASED, 0x110000))
    for text in ("", "ABC z", "\u00c9T\u00c9 \u0416", "\u039f\u03a3 \u03a3a", "\u0130x", "\U0001f600 A", *map("".join, zip(chars, chars[1:], "A" * len(chars)))):
        assert lower_utf8(text) == text.lower().encode("utf-8", "surrogatepass")
    rng = random.Random(6)
    for top in (0x80, 0x250, 0x590, 0x2100, LEAST_UNCASED + 99):
        for _ in range(50):
            text = "".join(chr(c) for c in (rng.randrange(top) for _ in range(60)))
            assert lower_utf8(text) == text.lower().encode("utf-8", "surrogatepass")


def _entries_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, t string").selectExpr("k", "xxhash64(t) AS th", "t").repartition(2)
    counters = line_dedup.LEAST_COUNTERS
    lines = line_dedup._classes(docs, counters, 5)
    level, _ = line_dedup._sum_counters(lines.where("counts is not null").selectExpr("line AS s", "counts"), counters)
    return line_dedup._entries(docs, level, 7)


def test_words_of_one_line_have_no_entries(spark):
    entries = _entries_of(spark, [" ".join([*(f"own{i}x{j}" for j in range(10)), "both"]) for i in range(20)])
    assert sum(len(r.data) for r in entries.collect()) == 0
    entries = _entries_of(spark, ["a b c d", "d c b a e"])  # prefixes of one word and of two, e first
    assert sum(len(r.data) for r in entries.collect()) == 2 * line_dedup.PACKED.itemsize


def test_copies_meet_at_few_words(spark):
    words = [f"w{j}" for j in range(60)]
    rows = [" ".join([*words, *(f"x{i}y{j}" for j in range(2))]) for i in range(6)]
    found = line_dedup._candidates(_entries_of(spark, rows)).collect()
    assert len(found) == len({r.cls for r in found}) == 6  # one word each, not every word of the prefix
    assert dedup_lines(spark.createDataFrame(list(enumerate(rows)), SCHEMA)).where("n_removed = 1").count() == 5


def test_classes_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "COMBINE", 3)
    texts = ["a b\nc d e f\na b", "B A\nx", "x\nx\nf e d c", "q"]
    docs = spark.createDataFrame([(9 - i, t) for i, t in enumerate(texts)], "k long, t string").selectExpr("k", "xxhash64(t) AS th", "t").repartition(3)
    blocks = line_dedup._classes(docs, line_dedup.LEAST_COUNTERS, 2).where("block is not null").selectExpr("line AS bucket", "block")
    got = sorted((r.fk, r.fl, r.n, len(r.wide)) for r in line_dedup._firsts(blocks).collect())
    assert got == [(6, 0, 1, 32), (7, 0, 3, 32), (7, 2, 2, 32), (8, 0, 3, 32)]
