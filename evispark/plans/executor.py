"""Driver loop of a resumable search queue. Adapters are off unless given and enabled; no adapter
that uses a network is part of this package."""

from __future__ import annotations

import hashlib
import json
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import canonical_json, replace_file

DONE = ("searched", "not_found", "failed")
MAX_FAILURES = 3


class ProviderError(ValueError):
    """A provider's refusal; ``halt`` stops the batch at once."""

    def __init__(self, kind: str, http_status: int | None = None, halt: bool = False):
        super().__init__(kind)
        self.kind, self.http_status, self.halt = kind, http_status, halt


@dataclass
class Adapter:
    search: Callable[[str], list]
    terms_url: str
    enabled: bool = False
    attempts: int = 1
    interval_seconds: float = 1.0


def failures(state: dict[str, dict]) -> Counter:
    return Counter(e for row in state.values() for e in row.get("failure_history", []))


def halted(state: dict[str, dict]) -> bool:
    """A recorded halt, three failures in all, or three of one kind."""
    counts = failures(state)
    return any(r.get("halt") for r in state.values()) or sum(counts.values()) >= MAX_FAILURES


def run_batch(queries: DataFrame, adapters: dict[str, Adapter], checkpoint: str, limit: int = 20, dry_run: bool = False) -> dict[str, dict]:
    """Run at most ``limit`` pending queries (query_id, provider, query, priority,
    source_priority) one by one; the state file is replaced after each.

    The pending set is small by its limit: it is ordered and cut in Spark, and only then collected.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    path = Path(checkpoint)
    state: dict[str, dict] = json.loads(path.read_text("utf-8")) if path.exists() else {}
    if halted(state):
        return state
    live = [p for p, a in adapters.items() if a.enabled and a.terms_url]
    done = [q for q, r in state.items() if r["status"] in DONE or (r["status"] == "manual_followup" and r["provider"] not in live)]
    finished = queries.sparkSession.createDataFrame([(q,) for q in done], "query_id string")
    pending = queries.join(finished, "query_id", "left_anti")
    last: dict[str, float] = {}
    for row in pending.orderBy("priority", "source_priority", "query_id").limit(limit).collect():
        q = row.asDict()
        adapter = adapters.get(q["provider"])
        if dry_run or q["provider"] not in live:
            state[q["query_id"]] = q | {"status": "dry_run" if dry_run else "manual_followup"}
        else:
            state[q["query_id"]] = _attempt(q, adapter, state, last)
        if not dry_run:
            replace_file(checkpoint, canonical_json(state))
        if state[q["query_id"]].get("halt"):
            break
    return state


def _attempt(q: dict, adapter: Adapter, state: dict[str, dict], last: dict[str, float]) -> dict:
    if not 1 <= adapter.attempts <= 3 or adapter.interval_seconds < 0:
        raise ValueError("adapter limits are invalid")
    counts, history = failures(state), []
    for n in range(adapter.attempts):
        time.sleep(max(0.0, adapter.interval_seconds - (time.monotonic() - last.get(q["provider"], float("-inf")))))
        last[q["provider"]] = time.monotonic()
        try:
            hits = adapter.search(q["query"])
        except (OSError, ValueError) as error:
            kind = error.kind if isinstance(error, ProviderError) else type(error).__name__
            counts[kind] += 1
            history.append(kind)
            out = q | {"status": "failed", "failure": kind, "attempts": n + 1, "failure_history": list(history)}
            if isinstance(error, ProviderError) and error.halt:
                out["halt"] = "provider_block"
            elif sum(counts.values()) >= MAX_FAILURES:
                out["halt"] = "three_failures"
            if out.get("halt") or n + 1 == adapter.attempts:
                return out
        else:
            digest = hashlib.sha256(json.dumps(hits, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
            return q | {"status": "searched" if hits else "not_found", "hits": hits, "attempts": n + 1, "response_sha256": digest, "failure_history": history}
    raise AssertionError("unreachable")


def reusable_slices(slices: DataFrame, receipts: DataFrame) -> DataFrame:
    """Slices whose content fingerprint has a receipt of a finished run."""
    return slices.join(receipts.where("status = 'complete'").select("fingerprint").distinct(), "fingerprint", "left_semi")


def closure_batch(people: DataFrame, templates: list[tuple[str, str]], preferred: list[str], people_limit: int, query_limit: int) -> DataFrame:
    """Queries of the first people (preferred names, then early or missing births, award year,
    id) by every provider, cut in the order in which they come. Both limits are what a batch
    asks for."""
    first = F.when(F.col("name").isin(preferred), 0).otherwise(1)
    order = [first, F.coalesce("birth_year", F.lit(0)), "award_year", "person_id"]
    chosen = people.orderBy(*order).limit(people_limit)
    each = F.posexplode(F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(t).alias("template")) for p, t in templates])).alias("source_priority", "t")
    out = chosen.select("*", each).orderBy(*order, "source_priority").limit(query_limit)
    return out.select("person_id", F.col("t.provider").alias("provider"), F.replace(F.col("t.template"), F.lit("{name}"), F.col("name")).alias("query"))
