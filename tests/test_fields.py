"""Recursive unwrap against a plain recursion over parsed JSON."""

import json
import random

from tallyforge.sources import fields


def plain(field, path=""):
    """(path, value, confidence) of every leaf."""
    if isinstance(field, dict) and "valueArray" in field:
        for i, x in enumerate(field["valueArray"] or []):
            yield from plain(x, f"{path}[{i}]")
    elif isinstance(field, dict) and "valueObject" in field:
        for k, x in (field["valueObject"] or {}).items():
            yield from plain(x, f"{path}.{k}" if path else k)
    else:
        value, sure = field, None
        if isinstance(field, dict):
            sure = field.get("confidence")
            name = next((n for n in fields.TYPED if field.get(n) is not None), "value" if "value" in field else None)
            value = field if name is None else field[name]
            if name == "valueCurrency" and isinstance(value, dict):
                value = value.get("amount")
            elif name == "valueDate":
                value = value[:10]
        text = value if value is None or isinstance(value, str) else json.dumps(value, separators=(",", ":"), sort_keys=True)
        yield path, text, sure


def made(rng, depth):
    kind = rng.random()
    if depth and kind < 0.3:
        return {"valueArray": rng.choice([None, [], [made(rng, depth - 1) for _ in range(rng.randint(1, 3))]]), "content": "list"}
    if depth and kind < 0.6:
        return {"valueObject": rng.choice([None, {}, {n: made(rng, depth - 1) for n in rng.sample(["A", "b b", "C.d", "é"], rng.randint(1, 3))}])}
    out = {n: v for n, v in [("valueString", rng.choice([None, "", "text", "a\"b"])), ("valueNumber", 3), ("valueInteger", 7), ("valueDate", "2026-01-02T03:04:05"), ("valueTime", "03:04"), ("valueCurrency", rng.choice([{"amount": 12}, {"code": "X"}, 9])), ("valueAddress", {"city": "Y"}), ("content", "raw"), ("value", "v"), ("other", 1)] if rng.random() < 0.25}
    if rng.random() < 0.3:
        out["confidence"] = 0.5
    return rng.choice([out, out, out, None, "bare", 5, True])


def test_unwrap_equals_a_plain_recursion(spark):
    rng = random.Random(8)
    docs = [made(rng, 4) for _ in range(150)]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(900, "{broken"), (901, None), (902, "")]
    found = fields.unwrapped(spark.createDataFrame(rows, "id int, json string"))
    assert found.columns == ["id", "path", "value", "confidence"]
    expected = sorted(((i, *leaf) for i, d in enumerate(docs) for leaf in plain(d)), key=str)
    assert sorted(map(tuple, found.collect()), key=str) == expected and any(p.count(".") + p.count("[") > 3 for _, p, _, _ in expected)


def test_no_responses(spark):
    assert fields.unwrapped(spark.createDataFrame([], "id int, json string")).count() == 0


def test_one_pass_whatever_the_nesting(spark):
    deep = '{"valueNumber":1.50,"confidence":"0.5"}'
    for i in range(150):
        deep = f'{{"valueArray":[{deep}]}}' if i % 2 else f'{{"valueObject":{{"a":{deep}}}}}'
    texts = [deep, '{"valueArray":{"b":"\\ud800","a":-0}}', '{"valueObject":["x"]}', '{"valueString":true,"valueDate":1}', '{"valueDate":{"b":1,"a":1e30}} ']
    sc = spark.sparkContext
    sc.setJobGroup("unwrap", "")
    try:
        found = sorted(map(tuple, fields.unwrapped(spark.createDataFrame(list(enumerate(texts)), "id int, json string")).collect()), key=str)
        jobs = len(sc.statusTracker().getJobIdsForGroup("unwrap"))
    finally:
        sc._jsc.clearJobGroup()
    assert found == [(0, "[0].a" + "[0].a" * 74, "1.5", 0.5), (1, "[0]", "0", None), (1, "[1]", "?", None), (2, None, "x", None), (3, "", "true", None), (4, "", '{"a":1.0E3', None)]
    assert jobs <= 2
