"""Adapters to outside services, all disabled here: plans, the result normalizer and the error map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Error kinds by HTTP status, and the fields of a search result that are kept.
HTTP_KINDS = {401: "access_block", 403: "access_block", 402: "billing_block", 429: "rate_limit"}
HIT_FIELDS = ["url", "title", "text", "publishedDate", "author", "id"]
ROLE = "discovery_lead_requires_source_review"


def error_kind(status: Column) -> Column:
    """struct(kind, halt_batch) of an HTTP status from 100 to 599; null for any other number."""
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in HTTP_KINDS.items() for x in kv]), status.cast("int")), F.lit("http_error"))
    return F.when(status.between(100, 599), F.struct(kind.alias("kind"), status.between(400, 499).alias("halt_batch")))


def search_hits(responses: DataFrame, key: str, payload: str, provider: str) -> DataFrame:
    """One row per result of JSON responses: the public fields, as leads that exclude nobody.

    ``invalid`` tells a response without a result list, and a result without an http(s) URL; such
    rows have no fields.
    """
    kind = f"array<struct<{', '.join(f'`{f}`: string' for f in HIT_FIELDS)}>>"
    results = F.from_json(F.get_json_object(payload, "$.results"), kind)
    rows = responses.select(F.col(key), F.posexplode_outer(results).alias("position", "hit"))
    url = F.col("hit.url")
    good = F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https") & (F.length(F.try_parse_url(url, F.lit("HOST"))) > 0), F.lit(False))
    kept = [F.when(good, F.col(f"hit.{f}")).alias(f) for f in HIT_FIELDS]
    return rows.select(key, "position", *kept, F.lit(provider).alias("provider"), F.lit(ROLE).alias("result_role"), F.lit(False).alias("age_exclusion_authorized"), (~good).alias("invalid"))


def disabled_plan(df: DataFrame, service: str, fields: list[str]) -> DataFrame:
    """What a disabled service would be sent; nothing is."""
    return df.select(F.lit(service).alias("service"), F.lit(False).alias("enabled"), F.lit(True).alias("dry_run"), F.struct(*fields).alias("payload"))
