"""Evidence: merges that fail closed, shared-origin groups, claim graphs, presence, registers."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROUNDS = 100


def identity_merge(df: DataFrame, key: str, order: str, exact: list[str], aliases: str) -> DataFrame:
    """One row per identity: values of the first row; ``conflict`` if a later row has another
    non-null value than the first row's non-null one; distinct aliases, sorted.

    A null in the first row is neither a conflict nor filled in.
    """
    firsts = F.min_by(F.struct(*exact), order).alias("_f")
    kinds = [(F.min(c) != F.max(c)).alias(f"_s_{c}") for c in exact]  # nulls aside
    merged = df.groupBy(key).agg(firsts, *kinds, F.array_sort(F.collect_set(aliases)).alias("aliases"), F.count("*").alias("n_rows"))
    conflict = F.lit(False)
    for c in exact:
        conflict = conflict | (F.col(f"_f.{c}").isNotNull() & F.coalesce(F.col(f"_s_{c}"), F.lit(False)))
    return merged.select(key, *[F.col(f"_f.{c}").alias(c) for c in exact], conflict.alias("conflict"), "aliases", "n_rows")


def shared_origin_groups(df: DataFrame, key: str, origins: list[Column]) -> DataFrame:
    """``key`` and ``group_id``: smallest key reachable over rows that share an origin value.

    Origins have one namespace; null or blank ones join nothing. Each key hooks onto the smallest
    key that shares an origin with it, keys are renamed to what they hang on, and origins left
    with one key are dropped. Only keys smaller than all neighbours stay, so at least half of the
    keys go each round, whatever the shape of the groups; a round is written to the checkpoint
    folder.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.master", "local")
        if not folder and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        spark.sparkContext.setCheckpointDir(folder or f"file://{tempfile.mkdtemp()}")
    base = df.select(F.col(key).alias("k"), F.array(*origins).alias("o"))
    pairs = base.select("k", F.explode("o").alias("o")).where(F.length(F.trim("o")) > 0).distinct().checkpoint()
    maps: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        low = pairs.groupBy("o").agg(F.min("k").alias("low"), F.count("*").alias("n")).where("n > 1").select("o", "low")
        pairs = pairs.join(low, "o").checkpoint()
        if pairs.isEmpty():
            break
        parent = pairs.groupBy("k").agg(F.min("low").alias("p")).checkpoint()
        while True:  # to the end of each chain, whose length halves
            up = parent.select(F.col("k").alias("q"), F.col("p").alias("up"))
            step = parent.join(up, parent["p"] == up["q"]).select("k", F.col("up").alias("p"), (F.col("up") != F.col("p")).alias("moved")).checkpoint()
            parent = step.select("k", "p")
            if step.where("moved").isEmpty():
                break
        maps.append(parent)
        pairs = pairs.select("k", "o").join(parent, "k").select(F.col("p").alias("k"), "o").distinct().checkpoint()
    else:
        raise RuntimeError(f"groups did not settle in {MAX_ROUNDS} rounds")
    label = base.select("k").distinct().withColumn("g", F.col("k"))
    for parent in maps:
        up = parent.select(F.col("k").alias("q"), "p")
        label = label.join(up, label["g"] == up["q"], "left").select("k", F.coalesce("p", "g").alias("g")).checkpoint()
    return label.select(F.col("k").alias(key), F.col("g").alias("group_id"))


def relation_counts(edges: DataFrame, claim: str, relation: str) -> DataFrame:
    """Zero-filled counts of the three relations of each claim and its evidence state."""
    counts = edges.groupBy(claim).agg(*[F.count_if(F.col(relation) == r).alias(r) for r in ("supports", "contradicts", "contextualizes")])
    state = F.when((F.col("supports") > 0) & (F.col("contradicts") > 0), "mixed_evidence").when(F.col("contradicts") > 0, "contradiction_present").when(F.col("supports") > 0, "support_present").when(F.col("contextualizes") > 0, "context_only").otherwise("no_evidence_links")
    return counts.withColumn("state", state)


def presence(df: DataFrame, event: str = "event_id") -> DataFrame:
    """Status of presence at each event from its sources.

    Sources have category, subject_specific, human_reviewed, authenticated, complete and
    independent_group; a null flag is false. Direct evidence is a reviewed, subject-specific
    record that is authenticated, or roster that is complete. contested (direct and contradicting)
    > confirmed > contradicted > supported (a reviewed contemporaneous report, and reports of two
    independent groups) > reported > unknown.
    """
    flag = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("subject_specific", "human_reviewed", "authenticated", "complete")}
    cat, own = F.col("category"), flag["subject_specific"]
    reviewed = own & flag["human_reviewed"]
    direct = reviewed & (((cat == "direct_record") & flag["authenticated"]) | ((cat == "complete_roster") & flag["complete"]))
    contemporary = reviewed & (cat == "contemporaneous_named_report")
    report = own & cat.isin("first_person_report", "family_report")
    group = F.when(contemporary | report, F.nullif(F.col("independent_group").cast("string"), F.lit("")))
    counts = df.groupBy(event).agg(
        F.count_if(direct).alias("n_direct"),
        F.count_if(reviewed & (cat == "contradiction")).alias("n_contradiction"),
        F.count_if(contemporary).alias("n_contemporary"),
        F.count_if(report).alias("n_reports"),
        F.count_distinct(group).alias("n_groups"),
        F.count_if(cat.isin("opportunity_context", "public_scene_context")).alias("n_non_proof"),
    )
    d, c = F.col("n_direct") > 0, F.col("n_contradiction") > 0
    status = F.when(d & c, "contested").when(d, "confirmed").when(c, "contradicted").when((F.col("n_contemporary") > 0) & (F.col("n_groups") >= 2), "supported").when(F.col("n_reports") > 0, "reported").otherwise("unknown")
    return counts.withColumn("status", status)


def dangling(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, code: str) -> DataFrame:
    """Finding rows (record_id, code, severity) for references without a target."""
    keys = parent.select(F.col(parent_key).alias("_p")).distinct()
    rows = child.select(F.col(child_key).alias("_c")).where("_c is not null").distinct()
    return rows.join(keys, F.col("_c") == F.col("_p"), "left_anti").select(F.col("_c").cast("string").alias("record_id"), F.lit(code).alias("code"), F.lit("blocker").alias("severity"))


def differing_fields(df: DataFrame, key: str, register: str, fields: list[str]) -> DataFrame:
    """``key``, ``n_registers`` and ``fields``: the names, in the given order, of the fields in which the
    records of a key differ, for keys that several registers declare. A null differs from any value.

    Each field's state is its smallest and largest value and its number of values, whatever the
    number of records.
    """
    same = [((F.min(c) == F.max(c)) & (F.count(c) == F.count("*"))) | (F.count(c) == 0) for c in fields]
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(register).alias("n_registers"), *(F.coalesce(s, F.lit(False)).alias(f"same_{i}") for i, s in enumerate(same)))
    names = F.array_compact(F.array(*(F.when(~F.col(f"same_{i}"), F.lit(c)) for i, c in enumerate(fields))))
    return out.where("n_registers > 1").select(key, "n_registers", names.alias("fields"))


def declaring_registers(declared: DataFrame, key: str, register: str) -> DataFrame:
    """Registers that declare each id, and whether it is cross-listed (in two registers or more)."""
    out = declared.groupBy(key).agg(F.array_sort(F.collect_set(register)).alias("_r"), F.count("*").alias("n_records"))
    return out.select(key, F.array_join("_r", "|").alias("registers"), F.size("_r").cast("long").alias("n_registers"), "n_records", (F.size("_r") > 1).alias("cross_listed"))


def resolve_references(refs: DataFrame, ref: str, declared: DataFrame, key: str, register: str) -> DataFrame:
    """Outcome of ``register:id`` and bare references: resolved, wrong_register, ambiguous, unknown."""
    known = declared.select(F.col(key).cast("string").alias("_k"), F.col(register).alias("_g")).distinct().groupBy("_k").agg(F.collect_set("_g").alias("_gs"))
    qualified = F.instr(F.col(ref), ":") > 0
    target = F.when(qualified, F.substring_index(ref, ":", -1)).otherwise(F.col(ref))
    where = F.when(qualified, F.substring_index(ref, ":", 1))
    joined = refs.withColumn("_t", target).withColumn("_w", where).join(known, F.col("_t") == F.col("_k"), "left")
    outcome = F.when(F.col("_gs").isNull(), "unknown").when(F.col("_w").isNotNull(), F.when(F.array_contains("_gs", F.col("_w")), "resolved").otherwise("wrong_register")).when(F.size("_gs") == 1, "resolved").otherwise("ambiguous")
    return joined.select(*refs.columns, outcome.alias("outcome"))


def finding_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "code").agg(F.count("*").alias("n"))


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, counted with repeats; empty if both agree."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def key_differences(keys: Column, allowed: list[str], required: list[str]) -> Column:
    """struct(unknown, missing) of a document's keys against a closed schema."""
    a, r = F.array(*map(F.lit, allowed)), F.array(*map(F.lit, required))
    return F.struct(F.array_join(F.array_sort(F.array_except(keys, a)), ",").alias("unknown"), F.array_join(F.array_sort(F.array_except(r, keys)), ",").alias("missing"))


def rule_errors(rules: list[tuple[str, Column]]) -> Column:
    """Codes of the rules that fail, in order, joined by ``; ``. A null test fails."""
    return F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules])), "; ")
