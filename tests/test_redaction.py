"""Redaction of undeclared JSON and of typed maps and nested lists."""

import json

from pyspark.sql import functions as F

from ledgerlens.operators.audit import REDACTED, redact_json, redact_struct

TEXTS = [
    '{"a":{"user_id":{"deep":[1]},"b":[[{"lat":1.50,"x":1.50}],["U_123456 x",null,true]]}}', '{"user_id":1,"user_id":2,"k":"D_000001"}',
    '[]', '"A_000002"', "12", "null", None, "", "not json U_000009", '{"unterminated": "U_000001', "[" * 5000 + "]" * 5000,
    '{"é":"ü U_000003","n":-1.0e-7,"big":123456789012345678901234567890}', ' { "lon" : 1 , "q" : [ ] } ',
]
WANT = [
    '{"a":{"user_id":"[REDACTED]","b":[[{"lat":"[REDACTED]","x":1.50}],["[REDACTED] x",null,true]]}}',
    '{"user_id":"[REDACTED]","user_id":"[REDACTED]","k":"[REDACTED]"}', '[]', '"[REDACTED]"', "12", "null", None, "",
    "not json [REDACTED]", '{"unterminated": "[REDACTED]', '"[REDACTED]"',
    '{"é":"ü [REDACTED]","n":-1.0e-7,"big":123456789012345678901234567890}', '{"lon":"[REDACTED]","q":[]}',
]


def test_json_of_any_shape(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").repartition(3)
    got = {r.i: r.o for r in df.select("i", redact_json(F.col("t")).alias("o")).collect()}
    assert [got[i] for i in range(len(TEXTS))] == WANT


def test_typed_maps_and_lists_of_lists(spark):
    df = spark.sql("""SELECT named_struct('notes', map('user_id', 'x', 'free', 'by U_000001'), 'cells', array(array('D_000002', 'k'), array()),
        'by_case', map('c1', named_struct('lat', 1.5D, 'text', 'A_000003')), 'n', map('lat', 1)) AS report""")
    got = json.loads(df.select(F.to_json(redact_struct(df, "report")).alias("j")).first().j)
    assert got == {"notes": {"user_id": REDACTED, "free": "by " + REDACTED}, "cells": [[REDACTED, "k"], []],
                   "by_case": {"c1": {"lat": REDACTED, "text": REDACTED}}, "n": {"lat": None}}
