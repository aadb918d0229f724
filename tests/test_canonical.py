"""Canonical JSON against the plain serializer."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evispark.functions import canonical

NESTED = st.recursive(st.none() | st.booleans() | st.integers(-(2**60), 2**60) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(NESTED)
def test_any_json_text(value):
    want = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert canonical.canonical(json.dumps(value, indent=2)) == want
    assert canonical.canonical(want) == want


@pytest.mark.parametrize("text", ['{"a": NaN}', '[Infinity]', '{"a": 1, "a": 1}', "{", ""])
def test_what_is_refused(text):
    with pytest.raises(ValueError):
        canonical.canonical(text)


def test_variants_and_structs(spark):
    texts = ['{"b": {"z": [1, 2.50, "é\\n"], "a": null}, "a": true}', "[]", '"x"', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(canonical.canonical_json(F.parse_json("t"))).collect()]
    assert got == ['{"a":true,"b":{"a":null,"z":[1,2.5,"é\\n"]}}', "[]", '"x"', None]
    row = spark.range(1).select(F.struct(F.lit(2).alias("z"), F.create_map(F.lit("k2"), F.lit(1.0), F.lit("k1"), F.lit(1e20)).alias("m"), F.lit(None).cast("string").alias("a")).alias("s"))
    body = '{"a":null,"m":{"k1":1e+20,"k2":1.0},"z":2}'
    nonce = b"n" * 16
    out = row.select(canonical.canonical_json(F.col("s")), canonical.sha256(F.col("s")), canonical.commitment(F.col("s"), F.lit(nonce))).first()
    assert out[0] == body and out[1] == hashlib.sha256(body.encode()).hexdigest()
    assert out[2] == hashlib.sha256(canonical.DOMAIN + nonce + body.encode()).hexdigest()
    own = f"run-{out[1][:24]}"
    assert [r[0] for r in row.select(F.explode(F.array(F.lit(own), F.lit("run-x"))).alias("r"), "s").select(canonical.bound_run(F.col("r"), F.col("s"))).collect()] == [own, None]
    with pytest.raises(Exception, match="16 bytes"):
        row.select(canonical.commitment(F.col("s"), F.lit(b"short"))).collect()
