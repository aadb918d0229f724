"""Linking artifacts to persons: precedence cascade, token subsets, longest prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens


def precedence(items: DataFrame, key: str, tiers: list[tuple[str, DataFrame]], value: str, none: str = "needs_review") -> DataFrame:
    """The first tier that has a value for each item.

    ``tiers`` are (method, table with ``key`` and ``value``), strongest first; each has one value
    per key. All candidates are one union that is reduced by ``min_by``, so each tier is read
    once and the items are joined once.
    """
    candidates = None
    for rank, (method, tier) in enumerate(tiers):
        rows = tier.select(key, F.lit(rank).alias("_rank"), F.lit(method).alias("method"), F.col(value).alias(value)).where(F.col(value).isNotNull())
        candidates = rows if candidates is None else candidates.unionByName(rows)
    best = candidates.groupBy(key).agg(F.min_by(F.struct("method", value), "_rank").alias("_b"))
    return items.join(best, key, "left").select(*items.columns, F.coalesce("_b.method", F.lit(none)).alias("method"), F.col(f"_b.{value}").alias(value))


def token_subset(left: DataFrame, left_id: str, left_text: Column, right: DataFrame, right_id: str, right_text: Column) -> DataFrame:
    """Rows of ``left`` whose text holds all tokens of rows of ``right``.

    Returns ``left_id``, ``n_matches``, ``matched`` (the right id if there is exactly one) and
    ``outcome`` (unmatched, probable, ambiguous). Each right row is probed by the one of its tokens
    that the fewest left rows hold, and only those rows are tested for the others, so a common
    token never brings all rows together. A right text without tokens matches nothing.
    """
    l = left.select(F.col(left_id), tokens(left_text).alias("lt"))
    r = right.select(F.col(right_id), tokens(right_text).alias("ts")).where(F.size("ts") > 0)
    held = l.select(F.explode("lt").alias("token")).groupBy("token").agg(F.count("*").alias("held"))
    asked = r.select(right_id, F.explode("ts").alias("token")).join(held, "token")  # a token that no left row holds matches nothing
    probe = asked.groupBy(right_id).agg(F.min_by("token", F.struct("held", "token")).alias("token"), F.count("*").alias("n"))
    r = r.join(probe, right_id).where(F.size("ts") == F.col("n")).select(right_id, "ts", "token")
    hits = l.select(left_id, "lt", F.explode("lt").alias("token")).join(r, "token").where(F.size(F.array_except("ts", "lt")) == 0)
    found = hits.groupBy(left_id).agg(F.count("*").alias("n_matches"), F.min(right_id).alias("matched"))
    n = F.coalesce("n_matches", F.lit(0))
    return left.select(left_id).join(found, left_id, "left").select(
        left_id,
        n.alias("n_matches"),
        F.when(n == 1, F.col("matched")).alias("matched"),
        F.when(n == 0, "unmatched").when(n == 1, "probable").otherwise("ambiguous").alias("outcome"),
    )


def longest_prefix(items: DataFrame, path: str, contexts: DataFrame, prefix: str, separators: str = "/") -> DataFrame:
    """For each item the longest context prefix of its path that ends at a separator (or the path).

    Prefixes of a path are exploded and equi-joined, so the contexts may be of any size. Ties
    cannot occur: contexts are distinct.
    """
    cuts = F.expr(f"filter(sequence(1, length({path})), i -> i = length({path}) OR instr('{separators}', substr({path}, i, 1)) > 0)")
    probes = items.where(F.length(path) > 0).select(path, F.explode(cuts).alias("_n")).distinct().withColumn("_p", F.substring(F.col(path), F.lit(1), F.col("_n")))
    hits = probes.join(contexts.select(F.col(prefix).alias("_p")).distinct(), "_p").groupBy(path).agg(F.max_by("_p", "_n").alias(prefix))
    return items.join(hits, path, "left")


def year_overlap(births: Column, deaths: Column, artifact_years: Column) -> Column:
    """Whether any artifact year lies between the earliest birth and the latest death year."""
    return F.coalesce(F.exists(artifact_years, lambda y: y.between(F.array_min(births), F.array_max(deaths))), F.lit(False))
