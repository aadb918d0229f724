"""URL rules and scans for content that must not be published."""

from __future__ import annotations

import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What published texts must not hold.
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
GENOME = r"(?i)\b[ACGT]{40,}\b"
LOCAL_PATH = r"(?i)(?:\b[A-Z]:[\\/]|\\\\[^\\]+\\[^\\]+|file://|/(?:home|Users|private/var)/)"
SIGNED_URL = r"(?i)https?://[^\s]+(?:X-Amz-Signature|sig=|signature=|token=)[^\s]*"
GENOTYPE_ROW = r"(?im)^\s*(?:rs\d+|\d+)\s+(?:[0-9XYMT]+)\s+\d+\s+[ACGTDI-]{1,4}\s*$"
UNSAFE = re.compile(
    r"(?i)(?:(?<![a-z])[a-z]:[\\/]|file://|(?:^|[\\/])\.git(?:[\\/]|$)|SHA-?256(?: prefix)?[ :]+[a-f0-9]{8,}|"
    r"local-vault|private_archive|\.loop/|ancestrydna|genotype|haplotype|haplogroup|private_identity|raw_dna|\.ged(?:com)?\b|"
    r"gh[pousr]_[a-z0-9]{20,}|github_pat_|sk-[a-z0-9]{20,}|\brs\d{3,}\b|-----BEGIN .*PRIVATE KEY|EXA_API_KEY\s*[:=]\s*\S+)"
)
# Keys that carry credentials, hosts behind a login, and hosts that are no public source.
AUTH_KEYS = ["token", "access_token", "auth", "authorization", "key", "api_key", "signature", "session", "sessionid", "jwt", "code"]
PRIVATE_HOSTS = ["ancestry.com", "familysearch.org", "myheritage.com", "23andme.com", "localhost"]
OTHER_HOSTS = ["github.com", "raw.githubusercontent.com"]
LOCAL_SUFFIXES = [".local", ".internal", ".corp", ".lan", ".localhost"]
#: Times that a text is URL-decoded; it is tested after each.
DECODINGS = 3


@F.arrow_udf(T.BooleanType())
def unsafe_text(text: pa.Array) -> pa.Array:
    """Whether a text, URL-decoded up to three times, shows local paths, secrets or genetic data. Null
    is safe. Decoding leaves plus signs and broken escapes alone, which SQL's decoding does not."""

    def unsafe(value: str | None) -> bool:
        for _ in range(DECODINGS if value else 0):
            value = unquote(value)
            if UNSAFE.search(value):
                return True
        return False

    return pa.array([unsafe(t) for t in text.to_pylist()], pa.bool_())


def forbidden_codes(text: Column) -> Column:
    """Codes of what a text must not hold, in a fixed order; empty if it is clean."""
    rules = (("email", EMAIL), ("genome_sequence", GENOME), ("genotype_row", GENOTYPE_ROW), ("local_path", LOCAL_PATH), ("signed_url", SIGNED_URL))
    return F.array_compact(F.array(*[F.when(F.coalesce(text, F.lit("")).rlike(p), F.lit(code)) for code, p in rules]))


def clean_url(url: Column) -> Column:
    """https with a host and without user, query or fragment; what cannot be parsed is unclean."""
    def part(name: str) -> Column:
        return F.try_parse_url(url, F.lit(name))

    return F.coalesce(
        (part("PROTOCOL") == "https") & (F.length(part("HOST")) > 0) & part("USERINFO").isNull() & part("QUERY").isNull() & part("REF").isNull(),
        F.lit(False),
    )


def public_url(url: Column) -> Column:
    """http(s), a public named host that needs no login and is no code repository, no user, no
    credentials in the query or fragment, and no unsafe text."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    parts = F.concat_ws("&", F.try_parse_url(url, F.lit("QUERY")), F.try_parse_url(url, F.lit("REF")))
    keys = F.transform(F.split(parts, "&"), lambda p: F.lower(F.regexp_extract(p, "^([^=]*)=.", 1)))
    blocked = host.isin(PRIVATE_HOSTS + OTHER_HOSTS) | host.rlike(r"^[0-9.]+$|^\[")
    for suffix in [f".{h}" for h in PRIVATE_HOSTS] + LOCAL_SUFFIXES:
        blocked = blocked | host.endswith(suffix)
    return F.coalesce(
        F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https")
        & F.try_parse_url(url, F.lit("USERINFO")).isNull()
        & host.contains(".")
        & ~blocked
        & ~host.rlike(r"(^|\.)(home|test|invalid|example)$")
        & ~F.exists(keys, lambda k: k.isin(AUTH_KEYS) | k.startswith("x-amz-"))
        & ~unsafe_text(url),
        F.lit(False),
    )


# Verbs and nouns of claims that public records cannot carry.
CLAIM_VERBS = r"(?:support(?:s|ed|ing)?|prov(?:e|es|ed|ing)|establish(?:es|ed|ing)?|confirm(?:s|ed|ing)?|guarantee(?:s|d|ing)?)"
CLAIMED = r"(?:diagnosis|causation|replication|prize(?:\s+qualification)?|leaderboard\s+ranking|ranking|payout)"
NEUTRAL = rf"(?i)\b(?:cannot|does not|do not|must not|never)\s+{CLAIM_VERBS}\b"
PROHIBITED = rf"(?i)\b{CLAIM_VERBS}\b"
PASSIVE = rf"(?i)\b(?:an?\s+)?{CLAIMED}(?:\s*(?:,|and|or)\s*{CLAIMED})*\s+(?:is|are|was|were|has\s+been|have\s+been)\s+(?:(?:clearly|fully|strongly)\s+)?(?:supported|proven|established|confirmed|guaranteed)\b"


def prohibited_claim(text: Column) -> Column:
    """A claim of support or proof, active or passive, once negated verbs are taken out."""
    plain = F.regexp_replace(text, NEUTRAL, "limits")
    return F.coalesce(plain.rlike(PROHIBITED) | plain.rlike(PASSIVE), F.lit(False))
