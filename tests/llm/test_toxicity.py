import random
import zlib

import numpy as np

from evispark.llm import toxicity
from evispark.llm.toxicity import fit, score, term_slots, train


def slow_score(model, text):
    at = [i for i, s in enumerate(model.slots) if s in set(term_slots(text).tolist())]
    raw = model.bias + sum(model.weights[i] for i in at)
    raw += sum(float(model.factors[i] @ model.factors[j]) for x, i in enumerate(at) for j in at[x + 1 :])
    return 1 / (1 + np.exp(-raw))


def pair_corpus(n, seed):
    """Toxic only where insult and group meet: no additive weights can tell."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = rng.choices(["the", "cat", "sat", "on", "mats", "today"], k=8) + ["insult" if a else "praise"] + ["group" if b else "stone"]
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(a == b)))
    return rows


def test_pairs_are_learned_and_score_is_the_formula(spark):
    rows = pair_corpus(1500, 1)
    model = fit([term_slots(t) for _, t, _ in rows], np.array([y for *_, y in rows]))
    assert len(model.slots) <= 4  # chi-square sees nothing in either word alone
    toxic = [(i, t, int("insult" in t and "group" in t)) for i, t, _ in rows]
    model = fit([term_slots(t) for _, t, _ in toxic], np.array([y for *_, y in toxic]))
    got = {r.doc_id: r for r in score(spark.createDataFrame(toxic, "doc_id long, text string, score int"), model).collect()}
    for i, t, y in pair_corpus(100, 1):
        assert abs(got[i].score - slow_score(model, t)) < 1e-9
    assert all(got[i].predicted == y for i, _, y in toxic)


def test_held_out_is_never_learned_from(spark):
    docs = spark.createDataFrame([(i, "bad word here" if i % 2 else "fine word here") for i in range(200)], "doc_id long, text string")
    truth = spark.createDataFrame([(i, (i % 2) if zlib.crc32(str(i).encode()) % 5 else 1 - i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = train(docs, truth)
    got = score(docs, model).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_sample_bound_holds(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 20)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, labels: seen.append(len(rows)))
    docs = spark.createDataFrame([(i % 30, f"t{i}") for i in range(300)], "doc_id long, text string")
    train(docs, spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int"))
    assert seen == [20]


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = train(empty, labels)
    assert score(empty, model).collect() == []
    df = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (1, "x " * 50_000, "c")], empty.schema)
    got = score(df, model).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert score(df, model, keep=True).columns == df.columns


def test_given_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.op5_toxicity(spark, sf).join(labels, "doc_id").where("held_out").select("score", "toxic").collect()
    scores, truth = np.array([r.score for r in got]), np.array([r.toxic for r in got])
    ranks = np.argsort(np.argsort(scores)) + 1
    n1, n0 = truth.sum(), (1 - truth).sum()
    auc = (ranks[truth == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    hit = ((scores >= 0.5) & (truth == 1)).sum()
    print("auc", auc, "recall", hit / n1, "precision", hit / max(1, (scores >= 0.5).sum()), "n", len(got))
    assert auc > 0.9
    assert hit / n1 > 0.7 and hit / (scores >= 0.5).sum() > 0.9


def test_two_models_in_one_session(spark):
    """Workers keep words by model: a second model of the same session must not read the first's."""
    docs = spark.createDataFrame([(i, ("red" if i % 2 else "blue") + " word") for i in range(400)], "doc_id long, text string").coalesce(1)
    truth = [spark.createDataFrame([(i, int(i % 2 == side)) for i in range(400)], "doc_id long, toxic int") for side in (0, 1)]
    other = spark.createDataFrame([(i, f"{'red' if i % 4 < 2 else 'blue'} {'up' if i % 2 else 'down'}") for i in range(400)], "doc_id long, text string").coalesce(1)
    third = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    for side in (0, 1):
        assert all(r.predicted == int(r.doc_id % 2 == side) for r in score(docs, train(docs, truth[side])).collect())
        assert all(r.predicted == r.doc_id % 2 for r in score(other, train(other, third)).collect())


def test_words_that_tell_only_together(spark):
    """Toxic where insult and group are both there or both absent: additive weights alone fail."""
    rows, unseen = pair_corpus(1500, 1), pair_corpus(400, 2)
    model = fit([term_slots(t) for _, t, _ in rows], np.array([y for *_, y in rows]))
    additive = toxicity.FactorizationMachine(model.slots, model.bias, model.weights, 0 * model.factors)
    truth = {i: y for i, _, y in unseen}
    df = spark.createDataFrame(unseen, "doc_id long, text string, y int")
    right = [np.mean([r.predicted == truth[r.doc_id] for r in score(df, m).collect()]) for m in (model, additive)]
    assert right[0] > 0.98 and right[1] < 0.7, right


def test_terms_bound_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TERMS", 25)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, labels: seen.append(sum(map(len, rows))))
    docs = spark.createDataFrame([(i, f"a b c d e{chr(97 + i % 26)}") for i in range(60)], "doc_id long, text string")
    train(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))
    assert seen == [25]
