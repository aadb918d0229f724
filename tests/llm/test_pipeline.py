import corpus_pipeline
from corpus_pipeline import STAGES, drop_near_copies, drop_repeated_lines, drop_toxic, pack
from evispark.llm import toxicity

from .test_line_dedup import brute as brute_lines
from .test_packing import check_pieces
from .test_simhash import slow_groups
from .test_toxicity import slow_score

SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_stages_match_brute_force(spark):
    assert [n for n, _ in STAGES] == ["toxicity", "line_dedup", "simhash", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = drop_toxic(spark, docs, SF)
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = sorted(k for k, t in rows(docs, "doc_id", "text") if slow_score(model, t) < 0.5)
    assert sorted(k for (k,) in rows(clean, "doc_id")) == want and clean.columns == docs.columns

    lines = drop_repeated_lines(spark, clean, SF)
    assert sorted(rows(lines, "doc_id", "text"), key=str) == [r[:2] for r in brute_lines(rows(clean, "doc_id", "text"))]
    assert lines.columns == docs.columns and all(len(t) == n for t, n in rows(lines, "text", "n_chars"))

    single = drop_near_copies(spark, lines, SF)
    groups = slow_groups(rows(lines, "doc_id", "text"), 4, 5)
    assert sorted(k for (k,) in rows(single, "doc_id")) == sorted(k for k, _, c in groups if k == c)
    assert single.columns == docs.columns

    pieces = pack(spark, single, SF).collect()
    check_pieces(rows(single, "doc_id", "text"), pieces, 4096)
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, pieces))
