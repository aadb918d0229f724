"""Quality rules whose cutoffs are certified on labelled holdouts.

A rule rejects a document whose rate (an integer, larger is worse) reaches a cutoff. The cutoffs of
a rule are a fixed grid from lenient to strict, chosen before any label is seen, so all labelled
rows are the holdout. Within a stratum a cutoff is certified if an exact binomial test rejects
"good documents are falsely rejected at a rate over RISK / rules" at the level ERROR / (strata
times rules): a fixed sequence from lenient to strict that ends at the first failure, corrected
over strata and rules. With probability 1 - ERROR no stratum then loses more than RISK of its good
documents. Of the certified cutoffs, the one with most bad less good rejected documents is used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import slices
from .store import bound_batches, materialize
from .words import PAD, word_hashes

#: Most good documents (share) that the rules together may reject in a stratum, and the probability
#: that this fails in any stratum.
RISK, ERROR = 0.02, 0.05
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
SPACES, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
_NO_CHARACTER = SPACES + bytes(range(0x80, 0xC0))  # white space and continuation bytes of UTF-8
_IS_SPACE = np.isin(np.arange(256), list(SPACES))
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def grid(top: int, steps: int, per_octave: int) -> list[int]:
    """Cutoffs from lenient to strict."""
    return list(dict.fromkeys(round(top * 2 ** (-k / per_octave)) for k in range(steps)))


#: Rate (numerator, denominator, factor) and cutoffs of each rule.
RULES: dict[str, tuple[str, str, int, list[int]]] = {
    "symbols": ("n_symbols", "word_chars", 1000, grid(1000, 20, 2)),
    "repeated_words": ("n_repeat_words", "n_words", 1000, grid(1000, 20, 2)),
    "repeated_lines": ("n_dup_lines", "n_lines", 1000, grid(1000, 20, 2)),
    "long_words": ("word_chars", "n_words", 1000, grid(64_000, 49, 8)),
    "short_words": ("n_words", "word_chars", 1000, grid(1000, 25, 8)),
}


def measure(texts: list[bytes]) -> np.ndarray:
    """MEASURES of each text, in UTF-8."""
    out = np.zeros((len(texts), len(MEASURES)), np.int64)
    for i, text in enumerate(texts):
        lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
        out[i, 1:5] = len(text.translate(None, _NO_CHARACTER)), len(text) - len(text.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines))
    raw = b"\n" + b"\n".join(texts) + b"\n" + b" " * PAD
    space = _IS_SPACE[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, size = edges[0::2], edges[1::2] - edges[0::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(start, ends)
    out[:, 0] = np.diff(last, prepend=0)
    if len(start) >= WINDOW:
        doc = np.repeat(np.arange(len(texts)), out[:, 0])
        for i in np.unique(doc[_suspects(word_hashes(raw, start, size), doc)]).tolist():
            out[i, 5] = repeat_words(texts[i].split())
    return out


def _suspects(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Starts of windows whose hash occurs again in their document: all that repeat, and a few more."""
    window = hashes[: len(hashes) - WINDOW + 1].copy()
    for j in range(1, WINDOW):
        window = window * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(hashes) - WINDOW + 1 + j]
    whole = np.flatnonzero(doc[: len(window)] == doc[WINDOW - 1 :])
    bits = np.uint64(int(doc[-1]).bit_length())
    keys = window[whole] >> bits | (doc[whole].astype(np.uint64) << (np.uint64(64) - bits) if bits else np.uint64(0))
    order = np.argsort(keys)
    again = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    return whole[order[again]]


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words found twice or more, compared word by word."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    span = 1
    while span < WINDOW:  # names of runs of twice as many words
        ids = np.unique(ids[:-span] * len(words) + ids[span:], return_inverse=True)[1]
        span *= 2
    twice = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[WINDOW:] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def tail(k: int, n: int, p: float) -> float:
    """Probability of at most k successes in n trials. Terms are added from k down while they
    matter: below the mean they fall at least geometrically."""
    if k >= n or k >= n * p:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, i = term, k
    while i > 0 and term > total * 1e-18:
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        i -= 1
    return min(total, 1.0)


def certified(good: np.ndarray, bad: np.ndarray, risk: float, level: float) -> int | None:
    """Index of the cutoff to use, from documents by the first cutoff that rejects them (the last
    entry: none does)."""
    n, best, most = int(good.sum()), None, 0
    rejected, caught = np.cumsum(good[:-1]), np.cumsum(bad[:-1])
    for j in range(len(rejected)):
        if tail(int(rejected[j]), n, risk) > level:
            break
        if caught[j] - rejected[j] > most:
            best, most = j, caught[j] - rejected[j]
    return best


def cutoffs(counts: DataFrame, strata: int, risk: float, error: float) -> DataFrame:
    """A row per stratum with a cutoff for each rule, null where none is certified or of use.
    ``counts`` has rows (stratum, rule, first, good, bad), at most one per cutoff and rule."""
    names = list(RULES)

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, object] = {"stratum": key[0]}
        for name in names:
            cuts = RULES[name][3]
            mine, tallies = rows[rows["rule"] == name], np.zeros((2, len(cuts) + 1), np.int64)
            tallies[0, mine["first"]], tallies[1, mine["first"]] = mine["good"], mine["bad"]
            at = certified(*tallies, risk / len(names), error / (strata * len(names)))
            out[name] = None if at is None else cuts[at]
        return pd.DataFrame([out], columns=["stratum", *names]).astype({name: "Int64" for name in names})

    return counts.groupBy("stratum").applyInPandas(choose, "stratum string, " + ", ".join(f"{name} long" for name in names))


def rate(rule: str) -> Column:
    above, below, factor, _ = RULES[rule]
    return F.expr(f"{factor} * {above} div greatest({below}, 1)")


def _first(rule: str) -> Column:
    """Index of the first cutoff that rejects a document, past the last if none does."""
    value = rate(rule)
    return F.size(F.filter(F.array(*map(F.lit, RULES[rule][3])), lambda cut: cut > value))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Measures of each document and whether it is kept.

    Words are runs without the six ASCII white-space characters. ``base_failed``: fewer than 20
    words, or over 30 % of them in repeated windows of 8 words. Others are kept unless a rule's rate
    reaches its certified cutoff in their stratum (their ``stratum`` column; null is one of its own);
    ``rejected_by`` lists those rules. Where labels are too few to certify anything, all are kept.

    A row with a label is one holdout document, of its own even if repeated; a key with several
    labels counts as good if any is 1; null keys and labels are not counted. Null texts have no
    words. Texts of any length are read whole. Empty tables give an empty result, no labels no
    cutoffs; other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                found = measure([t or b"" for t in part.column(2).cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, found.T.copy())], ["key", "stratum", *MEASURES])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(stratum).cast("string").alias("stratum"), F.col(text).cast("string").alias("text"))
    rows = materialize(rows.mapInArrow(run, "key long, stratum string, " + ", ".join(f"{m} long" for m in MEASURES)), "quality-measures")
    rows = rows.withColumn("base_failed", F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words"))

    known = labels.select(F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("good")).where("key is not null and good is not null")
    known = known.groupBy("key").agg(F.max("good").alias("good"))
    first = F.array(*(F.struct(F.lit(name).alias("rule"), _first(name).alias("first")) for name in RULES))
    counts = rows.where("not base_failed").join(known, "key").select("stratum", "good", F.explode(first).alias("r"))
    counts = counts.groupBy("stratum", "r.rule", "r.first").agg(F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("good") != 1).alias("bad"))
    counts = materialize(counts, "quality-counts")
    strata = counts.groupBy("stratum").agg(F.lit(1)).count()
    chosen = materialize(cutoffs(counts, max(strata, 1), risk, error).withColumnRenamed("stratum", "s"), "quality-cutoffs")

    out = rows.join(chosen, F.col("stratum").eqNullSafe(F.col("s")), "left")
    broken = F.array_compact(F.array(*(F.when(~F.col("base_failed") & (rate(name) >= F.col(name)), F.lit(name)) for name in RULES)))
    out = out.select(*(F.col(c) for c in ["key", *MEASURES, "base_failed"]), F.array_join(broken, ",").alias("rejected_by"))
    out = out.withColumn("kept", F.expr("not base_failed and rejected_by = ''"))
    return out.withColumnRenamed("key", key)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdicts on all documents."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
