import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evispark.llm.packing import generate_columns, pack, pack_documents, plan_patterns, price

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def check_pieces(rows, pieces, length):
    """Every id in one piece, gapless sequences, right checksums; returns the padding's share."""
    texts = defaultdict(list)
    for k, t in rows:
        texts[k].append(np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    by_key, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_key[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
        assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length]) == p.ids_crc32 for x in texts[p.doc_id])
        assert p.length > 0
    for k, docs in texts.items():
        spans = sorted((p.doc_tokens, p.start, p.length) for p in by_key[k])
        assert sum(s[2] for s in spans) == sum(map(len, docs))
        if len(docs) == 1:
            at = 0
            for _, start, n in spans:
                assert start == at
                at += n
    full = 0
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
        full += at if at & (at - 1) == 0 else length
    total = sum(len(x) for docs in texts.values() for x in docs)
    return 1 - total / full if full else 0


def given(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    return df, [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_given_documents(spark):
    df, rows = given(spark, "sf0.01")
    padding = check_pieces(rows, pack_documents(df).collect(), 4096)
    print("padding", padding)
    assert padding < 0.01


def test_odd_rows_and_short_sequences(spark):
    rows = [(i, " ".join(["word"] * (i * 7 % 300))) for i in range(300)]
    rows += [(None, "x y"), (None, None), (7, "again"), (7, "again"), (400, ""), (401, "long text " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'c' AS ids", "2 AS length").repartition(4)
    pieces = pack(df, PATH, False, 2, length=256).collect()
    assert check_pieces(rows, pieces, 256) < 0.03


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a"), (2, "b c")], [(5, "w " * 4095)], [(5, "w " * 9000), (6, "w " * 5000)]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_pieces(rows, pack_documents(df).collect(), 4096)


def test_knapsack_and_plan():
    value, taken = price(np.array([3.0, 5.0, 8.0]), np.array([2, 3, 5]), 11)
    assert value == pytest.approx(3 * 5 + 3) and (taken @ [2, 3, 5]) <= 11
    sizes, demand = np.array([45, 36, 31, 14]), np.array([97.0, 610, 395, 211])
    columns, amount = generate_columns(sizes[::-1], demand[::-1], 100, 1e-9)
    assert amount.sum() == pytest.approx(452.25)  # a known optimum of the literature
    assert (columns @ amount >= demand[::-1] - 1e-6).all()
    plan = plan_patterns({45: 97, 36: 610, 31: 395, 14: 211}, 100)
    assert sum(t for _, t in plan) <= 455
    for c, n in zip(sizes.tolist(), demand.tolist()):
        assert sum(p.get(c, 0) * t for p, t in plan) >= n
    assert all(sum(c * k for c, k in p.items()) <= 100 for p, _ in plan)
    assert plan_patterns({}) == []


def test_short_documents(spark):
    """Classes waste a large share of short texts, which more lanes than usual make good."""
    rows = [(i, " ".join(["word"] * (i * 7 % 30))) for i in range(12_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert check_pieces(rows, pack(df, PATH, False, 2, length=4096).collect(), 4096) < 0.03
