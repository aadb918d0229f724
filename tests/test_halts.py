"""Halts of queues: a log at once, and as a stream that is restarted."""

import random

from pyspark.sql import functions as F

from evispark.plans.halts import halts, stream_halts

SCHEMA = "run long, position long, kind string, blocked boolean"


def plain(rows, total, same):
    out = {}
    for run, position, kind, blocked in sorted(rows, key=lambda r: (r[0], r[1])):
        seen, kinds, halt, why = out.get(run, (0, [], None, None))
        if halt is None:
            kinds = kinds + [kind] if kind else kinds
            why = "provider_block" if blocked else "three_failed_attempts" if kind and len(kinds) >= total else "three_same_errors" if kind and kinds.count(kind) >= same else None
            out[run] = (seen + 1, kinds, position if why else None, why)
    return sorted((run, seen, len(kinds), halt, why) for run, (seen, kinds, halt, why) in out.items())


def log(n=1500, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(60), i, rng.choice([None] * 6 + ["rate", "tls", "dns", "x"]), rng.choice([False] * 40 + [True, None])) for i in range(n)]


def test_a_log_at_once(spark):
    rows = log()
    for total, same in ((3, 3), (6, 2), (100, 4)):
        got = halts(spark.createDataFrame(rows, SCHEMA).repartition(5), total, same)
        assert sorted(map(tuple, got.select("run", "seen", "failed", "halt_at", "reason").collect())) == plain(rows, total, same)
    assert halts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_stream_equals_the_log_also_after_a_restart(spark, tmp_path):
    rows = log(600, 2)
    source, out, state = (str(tmp_path / name) for name in ("log", "out", "state"))
    seen = {}

    def keep(batch, _):
        seen.update({r.run: tuple(r) for r in batch.collect()})

    def run_once():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = stream_halts(stream, 5, 2).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()

    for part in range(3):
        for s in range(200 * part, 200 * part + 200, 100):
            spark.createDataFrame(rows[s : s + 100], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run_once()  # a new query each time: the state comes from the checkpoint
        assert sorted(seen.values()) == plain(rows[: 200 * part + 200], 5, 2)
    batch = halts(spark.read.parquet(source), 5, 2).select("run", "seen", "failed", "halt_at", "reason")
    assert sorted(map(tuple, batch.collect())) == sorted(seen.values())
