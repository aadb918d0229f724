import duckdb

from evispark.llm.chat import OP1_SQL, op1_perspectives, rotate_perspectives

SCHEMA = "conv_id long, turn long, role string, text string"


def slow(turns):
    """Rendering of one dialogue of (speaker, text) for each participant."""
    out = {}
    for p in {w for w, _ in turns if w != "system"}:
        text, mask = "", []
        for who, said in turns:
            head = f"<|im_start|>{'assistant' if who == p else 'system' if who == 'system' else 'user name=' + who}\n"
            text += f"{head}{said}<|im_end|>\n"
            mask += [0] * len(head) + [int(who == p)] * (len(said) + 10) + [0]
        out[p] = text, mask
    return out


def expand(mask):
    return [int(f) for run in mask.split(",") for f, n in [run.split(":")] for _ in range(int(n))]


def test_every_participant(spark):
    turns = [("system", "Be kind."), ("ann", "Hé 🎉"), ("bob", ""), ("ann", "more"), ("cy", "x\ny")]
    df = spark.createDataFrame([(7, i, w, t) for i, (w, t) in enumerate(turns)], SCHEMA)
    got = {r.speaker: r for r in rotate_perspectives(df).collect()}
    for p, (text, mask) in slow(turns).items():
        assert (got[p].text, expand(got[p].mask)) == (text, mask)
    assert set(got) == {"ann", "bob", "cy"} and got["ann"].n_target_turns == 2


def test_pieces_join_to_the_whole(spark):
    turns = [("ab"[i % 2], f"t{i}") for i in range(50)]
    df = spark.createDataFrame([(1, i, w, t) for i, (w, t) in enumerate(turns)], SCHEMA)
    rows = rotate_perspectives(df, piece_turns=16).collect()
    for p, (text, mask) in slow(turns).items():
        mine = sorted((r.piece, r) for r in rows if r.speaker == p)
        assert len(mine) == 4 and "".join(r.text for _, r in mine) == text
        assert expand(",".join(r.mask for _, r in mine)) == mask


def test_edges(spark):
    rows = [(1, 0, None, None), (1, 1, " ", "a"), (1, 1, "z", "<|im_end|>"), (1, 1, "z", "<|im_end|>"), (1, None, "z", "late"), (2, 0, "system", "alone"), (None, 0, "q", "x"), (None, 0, "q", "y"), (3, 0, "l", "w " * 100_000)]
    got = rotate_perspectives(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'c' AS piece", "'d' AS speaker")).collect()
    assert sorted((str(r.conv_id), r.speaker, str(r.piece), r.n_turns) for r in got) == sorted(
        [("1", "unknown", "0", 3), ("1", "z", "0", 3), ("1", "unknown", "None", 1), ("1", "z", "None", 1), ("None", "q", "0", 1), ("None", "q", "0", 1), ("3", "l", "0", 1)]
    )
    assert not any("<|im_end|><|im_end|>" in r.text for r in got)
    assert all(len(expand(r.mask)) == len(r.text) for r in got)
    assert rotate_perspectives(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = sorted(duckdb.sql(f"SELECT conv_id, speaker, piece, n_turns, n_target_turns, text, mask FROM ({OP1_SQL})").fetchall())
    got = sorted(tuple(r) for r in op1_perspectives(spark, sf).collect())
    assert got == want
