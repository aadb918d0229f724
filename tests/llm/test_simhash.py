import random
import re

import pytest
import xxhash

from evispark.llm.simhash import covering_masks, fingerprint, near_dedup, simhash_groups

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def slow_fingerprint(text, k=4):
    words = WORDS.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows, radius=4, k=4):
    fps = [(i, slow_fingerprint(t, k)) for i, t in rows]
    root = {i: i for i, _ in fps if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in fps:
        for j, b in fps:
            if i is not None and j is not None and bin(a ^ b).count("1") <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, f"{f:016x}", None if i is None else find(i)) for i, f in fps), key=str)


def corpus(n=120):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeÉé", k=4)) for _ in range(300)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.choice([0, 1, 3, 4, 30, 400]))
        if rows and rng.random() < 0.5:
            words = (rng.choice(rows)[1] or "").split()
            if words and rng.random() < 0.7:
                words[rng.randrange(len(words))] = "Other"
        rows.append((i * 3, rng.choice([" ", "\n", "\t "]).join(words)))
    return [*rows, (None, "a b c"), (None, None), (1000, None), (1001, ""), (1001, ""), (1002, " x  Y")]


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, key int")
    got = sorted((tuple(r) for r in simhash_groups(df).collect()), key=str)
    assert got == slow_groups(rows)
    assert len({r[2] for r in got}) < len(got) - 10


@pytest.mark.parametrize("text", [None, "", " \n", "one", "A b C", "a b c d", "É é " * 9, "x\x0by\x1cz"])
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_long_text():
    text = " ".join(str(i % 977) for i in range(60_000))
    assert fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_masks_cover_the_radius(radius):
    masks, rng = covering_masks(radius), random.Random(5)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        differ = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(differ & m == 0 for m in masks)


def test_large_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("evispark.llm.simhash.BLOCK", 8)
    rows = corpus(100)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in simhash_groups(df).collect()), key=str) == slow_groups(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_groups(df).collect() == []
    assert near_dedup(df).collect() == []


def test_near_dedup_keeps_columns_and_first(spark):
    rows = [(3, "same text of many words here", "a"), (1, "same text of many words here", "b"), (None, "x", "c"), (9, "else", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(map(str, [r.doc_id for r in kept.collect()])) == ["1", "9", "None"]


def test_near_dedup_links_exactly_at_jaccard(spark):
    rng, rows = random.Random(8), []
    for g in range(60):
        words = [f"w{g}x{i}" for i in range(rng.randrange(30, 300))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(5):
            changed = list(words)
            for at in rng.sample(range(len(words)), max(1, len(words) * rng.randrange(1, 8) // 200)):
                changed[at] = f"n{rng.random()}"
            rows.append((len(rows), rng.choice([" ", "\n"]).join(changed)))
    rows += [(len(rows), ""), (len(rows) + 1, " \n")]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if a == b or a & b and 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    kept = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=5)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
    assert 100 < len(set(root)) < 300


def test_near_dedup_one_key_with_two_texts(spark):
    same, other = "same text of many words here", "quite another one of five words"
    rows = [(1, same), (2, same), (2, other), (3, other), (3, other), (2, other)]
    kept = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == [(1, same), (2, other), (2, other)]
