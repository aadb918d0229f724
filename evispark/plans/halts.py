"""When runs of a queue halt: from a whole log, and from a stream of it with keyed state.

A run halts at the first attempt that is blocked by its provider, that is the ``total``-th failure, or
that is the ``same``-th failure of one kind; whatever comes later belongs to a halted run and is not
counted. So a run's state holds fewer than ``total`` kinds, however long its log is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Reasons of a halt, the first that holds at the halting attempt.
BLOCK, TOTAL, SAME = "provider_block", "three_failed_attempts", "three_same_errors"
STATE = "seen long, failed long, kinds array<string>, halt_at long, reason string"
#: Columns of a log: run, position (rising within a run), kind of a failure (null: none), blocked.
LOG = ["run", "position", "kind", "blocked"]


def halts(log: DataFrame, total: int = 3, same: int = 3) -> DataFrame:
    """(run, seen, failed, halt_at, reason) of each run of a log with the columns LOG: attempts and
    failures up to the halt, its ``position`` and reason, null while the run goes on.

    Positions are distinct within a run; a null ``blocked`` is false. Failures are numbered by
    windows; a run is as long as its queue, and only its failures are ordered.
    """
    rows = log.select(*LOG).withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    bad = rows.where("kind is not null or blocked")
    order = Window.partitionBy("run").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    of_kind = Window.partitionBy("run", "kind").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    bad = bad.withColumn("n", F.count("kind").over(order)).withColumn("k", F.count("kind").over(of_kind))
    reason = F.when(F.col("blocked"), BLOCK).when(F.col("n") >= total, TOTAL).when(F.col("kind").isNotNull() & (F.col("k") >= same), SAME)
    first = bad.withColumn("why", reason).where("why is not null").groupBy("run").agg(F.min("position").alias("halt_at"), F.min_by("why", "position").alias("reason"))
    counted = rows.join(first, "run", "left").where("halt_at is null or position <= halt_at")
    return counted.groupBy("run").agg(F.count("*").alias("seen"), F.count("kind").alias("failed"), F.first("halt_at").alias("halt_at"), F.first("reason").alias("reason"))


def stream_halts(log: DataFrame, total: int = 3, same: int = 3) -> DataFrame:
    """``halts`` of a streaming log: the state of each run that a batch of rows touched (update mode).

    A run's rows must come in batches by rising ``position``; within a batch they are ordered here.
    The state store keeps one small row a run, so a restart from the checkpoint goes on where it was.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, failed, kinds, halt_at, reason = state.get if state.exists else (0, 0, [], None, None)
        kinds = list(kinds)
        rows = pd.concat(list(frames)).sort_values("position") if halt_at is None else None
        for position, kind, blocked in rows[["position", "kind", "blocked"]].itertuples(index=False) if rows is not None else ():
            seen += 1
            if isinstance(kind, str):
                failed += 1
                kinds.append(kind)
            why = BLOCK if blocked is True or blocked == 1 else None
            if isinstance(kind, str):
                why = why or (TOTAL if failed >= total else SAME if kinds.count(kind) >= same else None)
            if why:
                halt_at, reason, kinds = int(position), why, []
                break
        state.update((seen, failed, kinds, halt_at, reason))
        yield pd.DataFrame({"run": [key[0]], "seen": [seen], "failed": [failed], "halt_at": pd.array([halt_at], "Int64"), "reason": [reason]})

    kind = log.schema["run"].dataType.simpleString()
    out = f"run {kind}, seen long, failed long, halt_at long, reason string"
    return log.select(*LOG).groupBy("run").applyInPandasWithState(step, out, STATE, "update", GroupStateTimeout.NoTimeout)
