"""Recursive walk over JSON documents with dotted and indexed paths."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys of secrets and raw genetic data, keys of private identity, and words of such keys.
SENSITIVE = ["access_token", "api_key", "cookie", "cookies", "genotype", "password", "raw_dna", "refresh_token", "session_token"]
FORBIDDEN_KEYS = [
    "access_token", "account_id", "address", "allele_call", "api_key", "cookie", "date_of_birth", "dob", "email", "family_id",
    "full_name", "gedcom_id", "genotype", "genotype_call", "local_path", "name", "password", "patient_id", "person_id", "phone",
    "private_key", "private_path", "provider_id", "raw_dna", "refresh_token", "session_token",
]
FORBIDDEN_WORDS = ["account", "address", "cookie", "email", "genotype", "name", "password", "patient", "person", "phone", "provider", "secret", "token"]


def _walk(value: object, path: str) -> Iterator[tuple[str, str | None, str | None]]:
    if isinstance(value, dict):
        for k, v in value.items():
            at = f"{path}.{k}" if path else k
            yield at, k, v if isinstance(v, str) else None
            yield from _walk(v, at)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            at = f"{path}[{i}]"
            if not isinstance(v, (dict, list)):
                yield at, None, v if isinstance(v, str) else None
            yield from _walk(v, at)


def walk(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, path, name, text) of every key and every text below; unreadable documents give one
    row with null fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(k, *r) for r in _walk(json.loads(body), "")]
                except (TypeError, ValueError):
                    rows.append((k, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["key", "path", "name", "text"])

    return df.select(F.col(key).cast("string"), payload).mapInArrow(run, "key string, path string, name string, text string")


def forbidden_key(name: Column) -> Column:
    """Whether a key, in snake or camel case, is on the list or has a listed word."""
    snake = F.lower(F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", "_"))
    plain = F.regexp_replace(F.regexp_replace(snake, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    words = F.array(*map(F.lit, FORBIDDEN_WORDS))
    return F.coalesce(plain.isin(FORBIDDEN_KEYS) | F.arrays_overlap(F.split(plain, "_"), words), F.lit(False))


def secret_paths(walked: DataFrame) -> DataFrame:
    """(key, path) of keys that must not be published."""
    return walked.where(forbidden_key(F.col("name"))).select("key", "path")


def sensitive_paths(walked: DataFrame) -> DataFrame:
    """(key, path) of keys that are, whatever their case, exactly a secret's or raw data's."""
    return walked.where(F.lower("name").isin(SENSITIVE)).select("key", "path")
