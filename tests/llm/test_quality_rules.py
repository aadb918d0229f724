import math
import random
import re
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from evispark.llm import quality_rules as q

SCHEMA = "doc_id long, text string, lang string, quality int, n_words string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, dup, len(inside)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é日  \x1c \t\n\r\x0b#|<"), max_size=60), max_size=5))
def test_measures_of_random_texts(texts):
    assert q.measure([t.encode() for t in texts]).tolist() == [brute(t) for t in texts]


def test_repeated_windows():
    rng = random.Random(2)
    texts = []
    for _ in range(60):
        part = [rng.choice("xyzuvw") for _ in range(rng.randrange(20))]
        texts.append(" ".join(part + [rng.choice("abc") for _ in range(rng.randrange(40))] + part))
    texts += ["a " * 9, "a " * 8, "a " * 7, "", "b c d e f g h i b c d e f g h i"]
    assert q.measure([t.encode() for t in texts]).tolist() == [brute(t) for t in texts]


def exact_tail(k, n, p):
    p = Fraction(p)
    return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_tail_is_binomial():
    for n, k, p in [(100, 0, 0.02), (500, 3, 0.02), (1000, 4, 0.01), (3000, 11, 0.004), (50, 0, 0.5)]:
        assert abs(q.tail(k, n, p) / exact_tail(k, n, p) - 1) < 1e-9
    assert q.tail(5, 100, 0.02) == 1 and q.tail(0, 0, 0.1) == 1
    assert q.tail(3_000_000, 10**9, 0.004) < 1e-300 or q.tail(3_000_000, 10**9, 0.004) == 0


def test_certified_cutoffs():
    good, bad = np.array([0, 0, 1, 40, 959]), np.array([5, 0, 30, 50, 15])
    assert q.tail(1, 1000, 0.01) <= 0.01 < q.tail(41, 1000, 0.01)
    assert q.certified(good, bad, 0.01, 0.01) == 2  # the fourth fails, the second adds nothing
    assert q.certified(good, bad, 0.01, 1e-9) is None
    assert q.certified(np.array([0, 5000]), np.array([0, 10]), 0.01, 0.01) is None  # of no use
    assert q.certified(np.zeros(3, int), np.zeros(3, int), 0.01, 0.01) is None


def test_false_rejection_stays_within_the_risk():
    """Over many drawn holdouts, a cutoff whose true rate exceeds the risk is used in no more than the level."""
    rng = np.random.default_rng(4)
    wrong = 0
    for _ in range(2000):
        good = rng.multinomial(400, [0.011, 0.01, 0.979])
        at = q.certified(good, np.array([1000, 1000, 0]), 0.01, 0.05)
        wrong += at is not None
    assert wrong <= 2000 * 0.05


def rows(n=4000, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(22, 40))]
        junk = i % 8 == 0
        if junk:
            words = [w + "##$|" for w in words]
        out.append((i, " ".join(words), "en" if i % 3 else None, None if i % 5 == 4 else int(not junk), "x"))
    out += [(5000, None, "en", 1, None), (5001, "", "en", 0, None), (5002, "few words", "en", 1, None), (None, " ".join("abcdefghijklmnopqrstuvwxyz"), "new", None, None), (5003, "one two three four five six seven eight " * 4, "en", 1, None)]
    return out + out[:3]


def test_verdicts(spark, monkeypatch):
    docs = spark.createDataFrame(rows(), SCHEMA)
    labels = docs.select("doc_id", "quality", "lang")
    got = q.judge(docs.drop("quality"), labels, risk=0.05).collect()
    texts = {i: t for i, t, *_ in rows()}
    assert len(got) == len(rows())
    for r in got:
        want = brute(texts[r.doc_id] or "")
        assert [r[m] for m in q.MEASURES] == want
        failed = want[0] < 20 or 100 * want[5] > 30 * want[0]
        assert r.base_failed == failed
        junk = want[2] > 0
        assert r.kept == (not failed and not junk), r
    few = q.judge(docs.drop("quality"), labels.limit(100)).collect()
    assert all(r.kept != r.base_failed for r in few)  # too few labels: nothing is certified


def test_cutoffs_equal_a_plain_search(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    risk, error, strata = 0.05, 0.05, 2
    got = {(r.doc_id, r.rejected_by) for r in q.judge(docs.drop("quality"), docs.select("doc_id", "quality"), risk=risk, error=error).collect()}
    data = [(i, lang, y, dict(zip(q.MEASURES, brute(t or "")))) for i, t, lang, y, _ in rows()]
    base = [(i, lang, y, m) for i, lang, y, m in data if not (m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"])]
    labelled = {i: y for i, _, _, y, _ in rows() if i is not None and y is not None}
    cuts = {}
    for lang in {b[1] for b in base}:
        for name, (above, below, factor, grid) in q.RULES.items():
            values = [(factor * m[above] // max(m[below], 1), labelled[i]) for i, g, _, m in base if g == lang and i in labelled]
            n, best = sum(y for _, y in values), (0, None)
            for cut in grid:
                k, b = sum(y for v, y in values if v >= cut), sum(1 - y for v, y in values if v >= cut)
                if n == 0 or k >= n * risk / 5 or exact_tail(k, n, risk / 5) > error / (5 * strata):
                    break
                best = max(best, (b - k, cut), key=lambda x: x[0])
            cuts[lang, name] = best[1]
    want = {(i, ",".join(name for name, (a, b, f, _) in q.RULES.items() if cuts[lang, name] is not None and f * m[a] // max(m[b], 1) >= cuts[lang, name])) for i, lang, _, m in base}
    want |= {(i, "") for i, *_ in data} - {(i, "") for i, *_ in base}
    assert got == want


def test_empty_tables_and_clashing_names(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert q.judge(none, labels).collect() == []
    docs = spark.createDataFrame([(1, "a b", "en", 1, "z")], SCHEMA).selectExpr("*", "1 as key", "2 as stratum", "3 as kept")
    assert [(r.doc_id, r.n_words, r.kept) for r in q.judge(docs, labels).collect()] == [(1, 2, False)]


def test_long_text(spark):
    text = "word other " * 400_000
    got = q.judge(spark.createDataFrame([(1, text, "en", 1, None)], SCHEMA), spark.createDataFrame([], "doc_id long, quality int")).first()
    assert (got.n_words, got.n_repeat_words, got.base_failed) == (800_000, 800_000, True)
