"""Canonical JSON of nested columns, their fingerprints, and commitments to them."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Prefix that keeps commitments of one kind apart from any other hash.
DOMAIN = b"RESEARCH-RECEIPT-v1\x00"
LEAST_NONCE = 16


def _refuse(number: str) -> None:
    raise ValueError(f"{number} is no JSON number")


def canonical(text: str) -> str:
    """JSON with sorted keys and no spaces; numbers that are not finite and repeated keys are errors."""

    def pairs(items: list[tuple[str, object]]) -> dict:
        out = dict(items)
        if len(out) < len(items):
            raise ValueError("repeated key")
        return out

    value = json.loads(text, parse_constant=_refuse, object_pairs_hook=pairs)
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True, allow_nan=False)


@F.arrow_udf(T.StringType())
def canonical_text(text: pa.Array) -> pa.Array:
    """Canonical form of JSON texts; null for null."""
    return pa.array([None if t is None else canonical(t) for t in text.to_pylist()], pa.string())


def canonical_json(value: Column) -> Column:
    """Canonical JSON of a struct, map, array or VARIANT. Fields that are null are kept as null, so that
    a missing value and a missing field of a VARIANT differ."""
    return canonical_text(F.to_json(value, {"ignoreNullFields": "false"}))


def sha256(value: Column) -> Column:
    """Hex digest of the canonical JSON in UTF-8."""
    return F.sha2(F.encode(canonical_json(value), "UTF-8"), 256)


def commitment(value: Column, nonce: Column, domain: bytes = DOMAIN) -> Column:
    """Hex SHA-256 of the domain, the nonce (at least LEAST_NONCE bytes, else an error) and the
    canonical JSON: binds to a value without telling it."""
    held = F.when(F.octet_length(nonce) >= LEAST_NONCE, nonce).otherwise(F.raise_error(F.lit(f"a nonce must contain at least {LEAST_NONCE} bytes")).cast("binary"))
    return F.sha2(F.concat(F.lit(domain), held, F.encode(canonical_json(value), "UTF-8")), 256)


def bound_run(run_id: Column, bundle: Column) -> Column:
    """The run id that a bundle of inputs must carry: ``run-`` and 24 hex digits of its fingerprint;
    null where ``run_id`` is another."""
    own = F.concat(F.lit("run-"), F.left(sha256(bundle), F.lit(24)))
    return F.when(run_id == own, own)
