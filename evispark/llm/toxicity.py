"""Toxicity by a factorization machine over hashed terms.

A text is the set of its lower-cased words. Words are hashed into slots. Features are the slots
whose presence depends most on the label (chi-square over the sample), and those of frequent
words that tell something only together: pairs whose odds ratio with the label differs between
texts with and without the other word. The score is the logistic of w0 + sum w_i + sum over
pairs of <v_i, v_j>: the factors give a pair such as an insult and a group mention a weight of
its own, which additive weights cannot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import slices
from .memory import Memo, claim
from .store import bound_batches, materialize

#: Most labelled rows that a model is fitted on, and most distinct terms of all of them (four bytes
#: each on the driver): those with the smallest hash of their id.
SAMPLE_ROWS, SAMPLE_TERMS = 20_000, 8_000_000
SLOT_BITS = 22
MAX_FEATURES = 16_384
LEAST_CHI2 = 15.0
LEAST_DOCS = 3
#: Most frequent words that are tested in pairs, and the least deviate of a pair's interaction.
PAIR_WORDS, LEAST_Z = 1024, 5.0
FACTORS = 8
EPOCHS, LEAST_STEPS = 12, 600
#: Bytes of the words whose features a worker remembers.
MEMO_BYTES = 32 << 20
WORD = re.compile(r"[^\W\d_]+")


def slots(chunk: str) -> tuple[int, ...]:
    """Hash slots of the words in a lower-cased run without white space."""
    return tuple(xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) >> (64 - SLOT_BITS) for w in WORD.findall(chunk))


def term_slots(text: str | None) -> np.ndarray:
    """Distinct slots of a text, sorted; none for null and empty texts."""
    found: set[int] = set()
    for chunk in set((text or "").lower().split()):
        found.update(slots(chunk))
    return np.array(sorted(found), dtype=np.int32)


@dataclass
class FactorizationMachine:
    """Features by slot, their weights and factors."""

    slots: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, features: list[int]) -> float:
        if not features:
            return self.bias
        v = self.factors[features]
        s = v.sum(0)
        return float(self.bias + self.weights[features].sum() + 0.5 * ((s * s).sum() - (v * v).sum()))


def select_features(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Slots in at least LEAST_DOCS rows whose chi-square with the label is LEAST_CHI2 or more,
    the MAX_FEATURES largest, and those of pairs that interact."""
    if not rows or labels.all() or not labels.any():
        return np.zeros(0, np.int32)
    flat = np.concatenate(rows)
    of = np.repeat(labels, [len(r) for r in rows]).astype(bool)
    known, at = np.unique(flat, return_inverse=True)
    a = np.bincount(at[of], minlength=len(known)).astype(float)
    b = np.bincount(at[~of], minlength=len(known)).astype(float)
    n, n1 = len(rows), labels.sum()
    c, d = n1 - a, (n - n1) - b
    chi2 = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9)
    chi2[a + b < LEAST_DOCS] = 0
    best = np.argsort(-chi2, kind="stable")[:MAX_FEATURES]
    often = np.argsort(-(a + b), kind="stable")[:PAIR_WORDS]
    often = np.sort(known[often[(a + b)[often] >= LEAST_DOCS]])
    return np.union1d(known[best[chi2[best] >= LEAST_CHI2]], often[interacting(rows, labels, often)]).astype(np.int32)


def interacting(rows: list[np.ndarray], labels: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which of the sorted slots ``words`` are in a pair whose log odds ratio with the label differs
    by LEAST_Z standard deviations between texts with and without the partner."""
    m = len(words)
    if not m:
        return np.zeros(0, bool)
    alone, joint = np.zeros((2, m)), np.zeros((2, m, m), np.float32)
    for y in (0, 1):
        mine = np.flatnonzero(labels == y)
        for s in range(0, len(mine), 1024):
            x = np.zeros((min(1024, len(mine) - s), m), np.float32)
            for i, r in enumerate(mine[s : s + 1024]):
                at = np.searchsorted(words, rows[r])
                at[at == m] = 0
                x[i, at[words[at] == rows[r]]] = 1
            alone[y] += x.sum(0)
            joint[y] += x.T @ x
    n = [float((labels == 0).sum()), float((labels == 1).sum())]
    found = np.zeros(m, bool)
    for s in range(0, m, 128):  # rows of the pair table at once
        part, ratios, spread = slice(s, s + 128), [], 0.0
        for partner in (1, 0):
            cells = []
            for y in (1, 0):
                both = joint[y][part].astype(float)
                with_a = both if partner else alone[y][part, None] - both
                without = (alone[y][None] if partner else n[y] - alone[y][None]) - with_a
                cells += [with_a + 0.5, without + 0.5]
            ratios.append(np.log(cells[0]) - np.log(cells[1]) - np.log(cells[2]) + np.log(cells[3]))
            spread = spread + sum(1 / c for c in cells)
        z = np.abs(ratios[0] - ratios[1]) / np.sqrt(spread)
        z[np.arange(len(z)), np.arange(s, s + len(z))] = 0
        found[part] = (z >= LEAST_Z).any(1)
    return found


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> FactorizationMachine:
    """Fit by Adam on the logistic loss. ``rows`` hold sorted slots. Without rows, or with one
    class only, the model is a constant."""
    labels = np.asarray(labels, float)
    rate = (labels.sum() + 0.5) / (len(labels) + 1.0)
    chosen = select_features(rows, labels)
    rng = np.random.default_rng(seed)
    m = len(chosen)
    bias = float(np.log(rate / (1 - rate)))
    w, v = np.zeros(m), rng.normal(0, 0.05, (m, FACTORS))
    if not m:
        return FactorizationMachine(chosen, bias, w, v)
    kept = []
    for r in rows:
        at = np.searchsorted(chosen, r)
        at[at == m] = 0
        kept.append(at[chosen[at] == r])
    theta = [np.array([bias]), w, v]
    moments = [(np.zeros_like(t), np.zeros_like(t)) for t in theta]
    step, n_batches = 0, max(1, len(rows) // 128)
    epochs = max(EPOCHS, -(-LEAST_STEPS // n_batches))
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for batch in np.array_split(order, n_batches):
            step += 1
            sizes = np.array([len(kept[i]) for i in batch])
            ids = np.concatenate([kept[i] for i in batch]).astype(np.int64)
            owner = np.repeat(np.arange(len(batch)), sizes)
            vi = theta[2][ids]
            sums = np.zeros((len(batch), FACTORS))
            np.add.at(sums, owner, vi)
            squares = np.bincount(owner, (vi * vi).sum(1), len(batch))
            raw = theta[0][0] + np.bincount(owner, theta[1][ids], len(batch)) + 0.5 * ((sums * sums).sum(1) - squares)
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[batch]) / len(batch)
            gw = np.bincount(ids, err[owner], m) + 1e-5 * theta[1]
            gv = np.zeros((m, FACTORS))
            np.add.at(gv, ids, err[owner][:, None] * (sums[owner] - vi))
            gv += 1e-4 * theta[2]
            rate_now = 0.03 * (1 - epoch / epochs)
            for t, g, (m1, m2) in zip(theta, (np.array([err.sum()]), gw, gv), moments):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                t -= rate_now * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return FactorizationMachine(chosen, float(theta[0][0]), theta[1], theta[2])


def held_out(key) -> F.Column:
    """Whether crc32 of the key as text leaves 0 on division by 5; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> FactorizationMachine:
    """Fit on at most SAMPLE_ROWS labelled rows of the training part with at most SAMPLE_TERMS
    terms in all, which bounds what reaches the driver.

    Rows with a null key or label are not learned from; a key with both labels counts as
    toxic; rows that repeat key and text count once. The bounds hold too where keys repeat in
    ``docs``.
    """
    chosen = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
        .groupBy(F.col(key).cast("long").alias("_k"))
        .agg((F.max(label) > 0).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_k"), "_k")
        .limit(SAMPLE_ROWS)
    )
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).cast("string").alias("_t")).join(F.broadcast(chosen), F.col("_id") == F.col("_k"))
    order = ["h", "id", "th"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3):
                terms = [term_slots(t.as_py()) for t in part.column(3)]
                columns = [*part.columns[:3], pa.array([t.tobytes() for t in terms], pa.binary()), pa.array([len(t) for t in terms], pa.int64()), part.column(4)]
                yield pa.RecordBatch.from_arrays(columns, ["h", "id", "th", "terms", "n", "y"])

    found = rows.select(F.xxhash64("_id").alias("h"), "_id", F.xxhash64("_t").alias("th"), "_t", "_y").mapInArrow(run, "h long, id long, th long, terms binary, n long, y int")
    found = materialize(found.dropDuplicates(order), "toxicity-sample")
    sizes = found.select(*order, "n").orderBy(*order).limit(SAMPLE_ROWS).collect()
    taken = int(np.searchsorted(np.cumsum([r.n for r in sizes]), SAMPLE_TERMS, side="right")) if sizes else 0
    if not taken:
        return fit([], np.zeros(0, int))
    last = F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip(order, sizes[taken - 1])])
    got = found.where(F.struct(*order) <= last).select(*order, "terms", "y").orderBy(*order).collect()
    return fit([np.frombuffer(bytes(r.terms), np.int32) for r in got], np.array([r.y for r in got]))


def score(docs: DataFrame, model: FactorizationMachine, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` of every row; a null or empty text
    scores the model's bias. With ``keep``, the columns of ``docs`` of the rows that are not
    toxic instead (the model decides from the text alone)."""
    bound_batches(docs.sparkSession)
    columns = docs.columns
    name = xxhash.xxh64_hexdigest(model.slots.tobytes())
    at = {int(s): i for i, s in enumerate(model.slots)}

    def scores(texts) -> list[float]:
        memo, out = _memo(name), []
        for t in texts:
            features: set[int] = set()
            for chunk in set((t.as_py() or "").lower().split()):
                got = memo.words.get(chunk)
                if got is None:
                    got = tuple(at[s] for s in slots(chunk) if s in at)
                    memo.add({chunk: got})
                if got:
                    features.update(got)
            out.append(float(1 / (1 + np.exp(-np.clip(model.raw(sorted(features)), -30, 30)))))
        return out

    if keep:

        def run_keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = pa.array([s < 0.5 for s in scores(batch.column(columns.index(text)))], pa.bool_())
                yield batch.filter(clean)

        return docs.mapInArrow(run_keep, docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], [key, "held_out", "score", "predicted"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string"), held_out(F.col(key))).mapInArrow(run, f"`{key}` long, held_out boolean, score double, predicted int")


_MEMOS: dict[str, Memo] = {}


def _memo(name: str) -> Memo:
    """Features of the words seen by this worker under the model whose features have this hash."""
    claim("toxicity", _MEMOS.clear)
    if name not in _MEMOS:
        _MEMOS.clear()
        _MEMOS[name] = Memo(MEMO_BYTES, 1 << 20)
    return _MEMOS[name]


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that learned from the training part of the labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
