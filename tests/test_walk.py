"""The walk over linked-data blocks against a plain depth-first one."""

import json
import random

from pyspark.sql import functions as F

from rentweave.functions.paths import nesting
from rentweave.sources import jsonld

TYPES = ["House", "Offer"]


def objects(root):
    if isinstance(root, dict):
        yield root
        whole = sorted((k for k in root if k.isdigit() and (k == "0" or k[0] != "0")), key=int)
        for k in [*whole, *(k for k in root if k not in whole)]:
            yield from objects(root[k])
    elif isinstance(root, list):
        for x in root:
            yield from objects(x)


def value(rng, depth=0):
    roll = rng.random()
    if depth < 6 and roll < 0.45:
        names = rng.sample(["z", "@type", "a", "10", "2", "b b", "é", '"q"'], rng.randint(0, 5))
        return {n: rng.choice(["House", "Offer", "Else", 3, ["House"]]) if n == "@type" else value(rng, depth + 1) for n in names}
    if depth < 6 and roll < 0.65:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([1, 1.5, None, True, "x", '{"@type":"House"}', "[1", "a,\"B\":", "é"])


def test_equals_a_depth_first_walk(spark):
    rng = random.Random(7)
    pages = []
    for i in range(150):
        blocks = [json.dumps(value(rng), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])) for _ in range(rng.randint(0, 3))]
        pages.append((i, blocks + rng.choice([[], ["{bad"], ['{"@type":"House"} x'], ["{'@type':'House'}"], [None], [""]])))
    jsonld.lenient_json(spark)
    df = spark.createDataFrame(pages, "k int, b array<string>")
    got = {r["k"]: [(n["block"], n["type"], json.loads(n["node"])) for n in r["n"]] for r in df.select("k", jsonld.walk_jsonld(F.col("b"), TYPES).alias("n")).collect()}
    for k, blocks in pages:
        want = []
        for i, text in enumerate(blocks):
            try:
                root = json.loads(text or "")
            except ValueError:
                continue
            want += [(i, o["@type"], o) for o in objects(root) if isinstance(o.get("@type"), str) and o["@type"] in TYPES]
        assert got[k] == want, blocks


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([("u", "<script type='application/ld+json'>{}</script>")], "url string, html string")
    plan = jsonld.with_nodes(pages, TYPES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_small_cases(spark):
    jsonld.lenient_json(spark)

    def of(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    nodes = jsonld.walk_jsonld(F.array(F.lit('{"a":{"@type":"House","n":1},"a":{"@type":"Offer"}}')), TYPES)
    assert [n["type"] for n in of(nodes)] == ["Offer"]
    assert of(jsonld.lower_first(F.lit('{"Name": "A, \\"B\\": c", "Of": [{"X":1},"Yes"], "@type":"T"}'))) == '{"name": "A, \\"B\\": c", "of": [{"x":1},"Yes"], "@type":"T"}'
    assert of(nesting(F.lit('{"a":["}{",[{}]]}'))) == 4
    assert json.loads(of(jsonld.first_shaped_node(F.lit('{"p":{"rooms":"3"},"q":[{"grossPrice":1},{"grossPrice":1,"surfaceLiving":2.5}]}')))) == {"grossPrice": 1, "surfaceLiving": 2.5}
    assert of(jsonld.first_shaped_node(F.lit(None).cast("string"))) is None
    deep = '{"a":' * 200 + '{"@type":"House"}' + "}" * 200
    assert [n["type"] for n in of(jsonld.walk_jsonld(F.array(F.lit(deep)), TYPES))] == ["House"]
