import random
import re
from collections import Counter, defaultdict

import pytest

from evispark.llm import divergence as d

SCHEMA = "doc_id long, text string, lang string, source string, value string, rank int"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        found = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]
        groups[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = {s: c for (g, s), c in groups.items() if g == lang}

        def p(counter, t):
            return 1 + 10**9 * (counter[t] + 5) // (sum(counter[x] for x in kept) + 5 * len(kept))

        whole = sum(mine.values(), Counter())
        p_of = {s: {t: p(c, t) for t in kept} for s, c in mine.items()}
        q = {t: p(whole, t) for t in kept}
        for s, c in mine.items():
            pairs = [(o, sum(abs(p_of[s][t] - p_of[o][t]) for t in kept)) for o in mine if o != s]
            ahead = [(t, p_of[s][t] - q[t]) for t in kept if c[t] and p_of[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", ahead, 50)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])]
    return sorted(out)


def run(spark, rows, schema=SCHEMA):
    return sorted(tuple(r) for r in d.divergence(spark.createDataFrame(rows, schema)).collect())


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)] + ["É", "é", "straße", "ÇA", "日本"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words[: 40 + 5 * (i % 25)]).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randrange(60)))
        rows.append((i, text.replace(" ", rng.choice([" ", "1", "\n", "_", "\x00", "\t- "])), rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "b", "é", None, "hot", "hot", "hot"]), "x", 1))
    rows += [(1000, None, "fr", "a", None, None), (1001, "", "fr", "b", None, None), (1002, "12 34", "fr", None, None, None), (1003, "alone", "xx", "only", None, None)]
    return rows + rows[:20] + [(2000 + i, "tie one two", "tt", s, None, None) for i, s in enumerate("ab" * 20)]


def test_equals_brute_force(spark):
    rows = corpus()
    found = run(spark, rows)
    assert found == brute(rows, d.LEAST_DOCS)
    assert {r[0] for r in found if r[2] == "pair"} == {"", "en", "de", "fr", "tt"}
    assert [r[4] for r in found if r[0] == "fr"] == [0] * 6  # no kept term


def test_small_holds_and_chunks_change_nothing(spark, monkeypatch):
    rows = corpus(300, 5)
    expected = run(spark, rows)
    monkeypatch.setattr(d, "CELLS", 16)
    monkeypatch.setattr(d, "BUCKET_TERMS", 8)
    monkeypatch.setattr(d, "HELD_ENTRIES", 50)
    monkeypatch.setattr(d, "PIECE_BYTES", 7)
    batches = [b for b in d._entries(spark.createDataFrame(rows, SCHEMA).selectExpr("coalesce(lang, '') lang", "coalesce(source, '') source", "coalesce(text, '') text").toArrow().to_batches(50))]
    assert len(batches) > 20  # flushed often
    assert run(spark, rows) == expected == brute(rows, d.LEAST_DOCS)


def test_probability_is_exact_for_large_counts():
    import numpy as np

    rng = random.Random(1)
    counts = [rng.randrange(10**15) for _ in range(200)]
    totals = [c + 5 + rng.randrange(1, 8 * 10**15) for c in counts]
    got = d.probability(np.array(counts), np.array(totals))
    assert got.tolist() == [1 + 10**9 * (c + 5) // t for c, t in zip(counts, totals)]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None, None)]])
def test_empty(spark, rows):
    assert run(spark, rows) == []


def test_long_text(spark):
    rows = [(1, "Long word " * 300_000, "en", "a", None, None)] + [(2 + i, "long other", "en", "b", None, None) for i in range(30)]
    assert run(spark, rows) == brute(rows, d.LEAST_DOCS)
