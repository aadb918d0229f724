"""Work queues: expansion, chunks, pending items, halting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_id


def expand_queries(people: DataFrame, person: str, name: str, templates: list[tuple[str, str]]) -> DataFrame:
    """A query per person and provider template; ``{name}`` is replaced."""
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(t).alias("template")) for p, t in templates]))
    out = people.select(F.col(person), F.col(name), rows.alias("_t"))
    query = F.replace(F.col("_t.template"), F.lit("{name}"), F.col(name))
    return out.select(person, F.col("_t.provider").alias("provider"), query.alias("query"), stable_id("query", F.concat_ws("|", F.col(person).cast("string"), F.col("_t.provider"), query)).alias("query_id"))


def chunks(df: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """Add ``chunk``: (row number - 1) div ``size`` within each group."""
    rn = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("chunk", F.floor((rn - 1) / size).cast("long"))


def pending(items: DataFrame, key: str, finished: DataFrame, order: list[Column | str], limit: int) -> DataFrame:
    """Unfinished items in order, at most ``limit`` (which is what the queue asks for)."""
    return items.join(finished.select(key).distinct(), key, "left_anti").orderBy(*order).limit(limit)


def halt_position(log: DataFrame, group: str, order: str, failed: Column, limit: int = 3) -> DataFrame:
    """Position (from 1) of the failure that halts each run, null if it never halts."""
    w = Window.partitionBy(group).orderBy(order)
    running = log.withColumn("_i", F.row_number().over(w)).withColumn("_f", F.count_if(failed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return running.groupBy(group).agg(F.min(F.when(F.col("_f") >= limit, F.col("_i"))).cast("long").alias("halt_at"), F.max("_f").alias("n_failed"))


def timeline(events: list[DataFrame]) -> DataFrame:
    """Union of (person, date, kind, detail) projections without unknown dates."""
    out = events[0]
    for e in events[1:]:
        out = out.unionByName(e, allowMissingColumns=True)
    return out.where("date is not null")


def replay(log: DataFrame, retries: int = 3) -> DataFrame:
    """State of each queued item from its log (query_id, attempt, status, failure): the last
    attempt decides; a failed item is pending again until it has had ``retries`` attempts."""
    last = log.groupBy("query_id").agg(F.max_by(F.struct("status", "failure"), "attempt").alias("l"), F.max("attempt").alias("attempts"))
    again = (F.col("l.status") == "failed") & (F.col("attempts") < retries)
    return last.select("query_id", "attempts", F.when(again, "pending").otherwise(F.col("l.status")).alias("status"), F.col("l.failure").alias("failure"))
